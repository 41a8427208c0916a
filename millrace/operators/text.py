"""A corpus: a frame with one text column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.stats import fuse
from millrace.schema import q, require, row_hash


def issue_counts(df: DataFrame, column: str) -> DataFrame:
    """One row of counts: missing, empty, short, long, addresses, mark-up, and lengths; one scan."""
    x = q(column)
    n = F.length(x)
    return df.agg(
        F.count(F.lit(1)).alias("total_texts"),
        F.count_if(x.isNull()).alias("missing"),
        F.count_if(F.trim(F.regexp_replace(x, T._u(T.WHITE), " ")) == "").alias("empty"),
        F.count_if(n < 5).alias("very_short"),
        F.count_if(n > 5000).alias("very_long"),
        F.count_if(x.rlike(T.URL_MARK)).alias("contains_urls"),
        F.count_if(x.rlike(T._u(T.EMAIL))).alias("contains_emails"),
        F.count_if(x.rlike(T.HTML)).alias("contains_html"),
        F.avg(n).alias("avg_length"),
        F.median(n).alias("median_length"),
    )


def drop_duplicates(df: DataFrame, columns: list[str], keep: str | bool = "first", order: list[str] | None = None) -> DataFrame:
    """Rows of distinct columns: the first or last of each in the given order, or (False) only those without equals.

    first and last are aggregations with partial sums, so a value that very many rows
    share costs no more than any other. Without an order, a hash of the row decides.
    """
    if keep not in ("first", "last", False):
        raise ValueError("keep must be 'first', 'last' or False")
    rank = F.struct(*[q(c) for c in order]) if order else F.struct(row_hash(df, 0))
    row = F.struct(*[q(c) for c in df.columns])
    best = F.max_by(row, rank) if keep == "last" else F.min_by(row, rank)
    grouped = df.groupBy(*[q(c).alias(f"__k{i}") for i, c in enumerate(columns)]).agg(best.alias("row"), F.count(F.lit(1)).alias("n"))
    if keep is False:
        grouped = grouped.where("n = 1")
    return grouped.select("row.*")


def vocabulary(df: DataFrame, column: str, top_n: int | None = 100) -> DataFrame:
    """(word, n): the most frequent lower-cased words; ties in the order of words."""
    counts = df.select(F.explode(T.words(F.lower(q(column)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts if top_n is None else counts.orderBy(F.desc("n"), "word").limit(top_n)


class TextPrep:
    """Chained text preparation; df is the present plan, log what was asked for."""

    def __init__(self, df: DataFrame, text_column: str) -> None:
        require(df, text_column)
        self.original = self.df = df
        self.column = text_column
        self.log: list[dict] = []

    def _set(self, df: DataFrame, action: str, **details) -> DataFrame:
        self.df = df
        self.log.append({"action": action} | details)
        return df

    def detect_issues(self) -> dict:
        return issue_counts(self.df, self.column).first().asDict()

    def clean_text(self, **options: bool) -> DataFrame:
        return self._set(self.df.withColumn(self.column, T.clean(q(self.column), **options)), "clean_text", **options)

    def remove_stopwords(self, stopwords: Iterable[str] | None = None, language: str = "english") -> DataFrame:
        chosen = list(T.STOP_WORDS if stopwords is None else stopwords)
        return self._set(self.df.withColumn(self.column, T.without_stop_words(q(self.column), chosen)), "remove_stopwords", count=len(chosen))

    def tokenize(self, method: str = "word") -> DataFrame:
        if method not in ("word", "sentence"):
            raise ValueError(f"Unknown tokenization method: {method}")
        made = T.words if method == "word" else T.sentences
        return self._set(self.df.withColumn(f"{self.column}_tokens", made(q(self.column))), "tokenize", method=method)

    def extract_features(self) -> DataFrame:
        return self._set(self.df.withColumns({f"{self.column}_{k}": v for k, v in T.features(q(self.column)).items()}), "extract_features")

    def detect_language(self) -> DataFrame:
        return self._set(self.df.withColumn(f"{self.column}_language", T.language(q(self.column))), "detect_language")

    def remove_duplicates(self, keep: str | bool = "first", order: list[str] | None = None) -> DataFrame:
        return self._set(drop_duplicates(self.df, [self.column], keep, order), "remove_duplicates", keep=keep)

    def filter_by_length(self, min_length: int = 5, max_length: int = 5000) -> DataFrame:
        return self._set(self.df.where(F.length(q(self.column)).between(min_length, max_length)), "filter_by_length", min=min_length, max=max_length)

    def get_vocabulary(self, top_n: int = 100) -> dict[str, int]:
        return {r["word"]: r["n"] for r in vocabulary(self.df, self.column, top_n).collect()}

    def report(self) -> dict:
        sizes = [fuse(d, {"n": F.count(F.lit(1))})["n"] for d in (self.original, self.df)]
        return {"original_shape": [sizes[0], len(self.original.columns)], "current_shape": [sizes[1], len(self.df.columns)], "issues": self.detect_issues(), "logs": self.log}

    def save_report(self, path: str) -> None:
        from millrace.sources.reports import save_report

        save_report(self.report(), path)


__all__ = ["TextPrep", "drop_duplicates", "issue_counts", "vocabulary"]
