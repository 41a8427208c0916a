"""Exploratory profiles: fused scans for moments and counts, exact quantiles of bounded memory, shuffles for values alone."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.stats import correlation, fuse, kurtosis, modes, null_count, quantiles, skewness, value_counts
from millrace.schema import categorical_columns, datetime_columns, number, numeric_columns, q

STRONG, HIGH = 0.9, 0.7


def distributions(df: DataFrame) -> DataFrame:
    """A row of statistics for each numeric column: moments in one scan, exact quantiles, and distinct values counted by one shuffle."""
    names = numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, count long, mean double, median double, std double, min double, max double, q25 double, q75 double, skewness double, kurtosis double, unique long, zeros long")
    parts = quantiles(df, {c: number(df, c) for c in names}, [0.25, 0.5, 0.75])
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), number(df, c).alias("v")) for i, c in enumerate(names)])).alias("s")
    distinct = df.select(values).where("s.v IS NOT NULL").select("s.i", "s.v").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    unique = {r["i"]: r["n"] for r in distinct.collect()}
    cells = []
    for i, c in enumerate(names):
        x = number(df, c)
        low, mid, high = (F.lit(v).cast("double") for v in parts[c] or [None] * 3)
        cells.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), mid.alias("median"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"), low.alias("q25"), high.alias("q75"),
            skewness(x).alias("skewness"), kurtosis(x).alias("kurtosis"), F.lit(unique.get(i, 0)).cast("long").alias("unique"), F.count_if(x == 0).alias("zeros"),
        ))
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r) for every pair of numeric columns, from one scan; r is null where a column is constant."""
    names = columns or numeric_columns(df)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(number(df, a), number(df, b)).alias("r")) for a, b in combinations(names, 2)]
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def outlier_counts(df: DataFrame) -> DataFrame:
    """Per numeric column of four values or more: quartile fences, values outside them and values beyond three deviations; only columns with any."""
    names = numeric_columns(df)
    wanted = {}
    for c in names:
        x = number(df, c)
        wanted |= {f"n {c}": F.count(x), f"m {c}": F.avg(x), f"s {c}": F.stddev_samp(x)}
    s = fuse(df, wanted) if wanted else {}
    parts = quantiles(df, {c: number(df, c) for c in names}, [0.25, 0.75])
    cells = []
    for c in names:
        if s[f"n {c}"] < 4:
            continue
        low, high = parts[c]
        reach = 1.5 * (high - low)
        x = number(df, c)
        far = F.count_if(F.abs((x - s[f"m {c}"]) / s[f"s {c}"]) > 3) if s[f"s {c}"] else F.lit(0).cast("long")
        cells.append(F.struct(F.lit(c).alias("column"), F.count_if((x < low - reach) | (x > high + reach)).alias("iqr_count"), far.alias("zscore_count"), F.lit(float(low - reach)).alias("lower"), F.lit(float(high + reach)).alias("upper"), F.count(x).alias("n")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, iqr_count long, zscore_count long, lower double, upper double, n long")
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*").where("iqr_count > 0 OR zscore_count > 0")


def top_values(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """(column, value, n, rank): the most frequent values of each column; ties in the order of values."""
    counts = value_counts(df, columns)
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= n)


def duplicate_rows(df: DataFrame) -> int:
    """Rows that equal an earlier one; whole rows are compared, by a hash table with partial counts."""
    groups = df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return fuse(groups, {"n": F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))})["n"]


class Profile:
    """Everything worth knowing of a frame, computed once and kept."""

    def __init__(self, df: DataFrame) -> None:
        if not isinstance(df, DataFrame):
            raise TypeError("df must be a Spark DataFrame")
        if df.isEmpty():
            raise ValueError("DataFrame is empty")
        self.df = df
        self.results: dict = {}
        self.insights: list[str] = []

    def data_info(self) -> dict:
        types = dict(self.df.dtypes)
        counts: dict[str, int] = {}
        for t in types.values():
            counts[t] = counts.get(t, 0) + 1
        return {"dtypes": types, "dtype_counts": counts, "numeric_columns": numeric_columns(self.df), "categorical_columns": categorical_columns(self.df), "datetime_columns": datetime_columns(self.df)}

    def missing_values(self, rows: int) -> dict:
        found = fuse(self.df, {c: null_count(self.df, c) for c in self.df.columns})
        return {
            "missing_count": {c: n for c, n in found.items() if n},
            "missing_percent": {c: n * 100 / rows for c, n in found.items() if n},
            "total_missing": sum(found.values()),
            "columns_with_missing": sum(1 for n in found.values() if n),
            "fully_missing": [c for c, n in found.items() if n == rows],
        }

    def categorical(self) -> dict:
        names = categorical_columns(self.df)
        if not names:
            return {}
        distinct = fuse(self.df, {c: F.countDistinct(q(c)) for c in names} | {f"missing {c}": null_count(self.df, c) for c in names})
        top: dict[str, dict] = {c: {} for c in names}
        for r in top_values(self.df, names).orderBy("column", "rank").collect():
            top[r["column"]][r["value"]] = r["n"]
        most = modes(self.df, names)
        return {c: {"unique_count": distinct[c], "top_values": top[c], "cardinality": "high" if distinct[c] > 50 else "low", "mode": most.get(c), "missing": distinct[f"missing {c}"]} for c in names}

    def analyze(self, include_correlations: bool = True, include_distributions: bool = True, include_outliers: bool = True, generate_insights: bool = True) -> dict:
        rows = fuse(self.df, {"n": F.count(F.lit(1))})["n"]
        size = self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        table = {r["column"]: r.asDict() for r in distributions(self.df).collect()} if numeric_columns(self.df) else {}
        found = {
            "basic_stats": {"shape": [rows, len(self.df.columns)], "n_rows": rows, "n_columns": len(self.df.columns), "memory_mb": int(size) / 2**20, "duplicate_rows": duplicate_rows(self.df), "describe": table},
            "data_info": self.data_info(),
            "missing_values": self.missing_values(rows),
            "categorical": self.categorical(),
        }
        if include_distributions:
            found["distributions"] = table
        if include_correlations:
            found["correlations"] = self.correlations()
        if include_outliers:
            found["outliers"] = {r["column"]: r.asDict() | {"iqr_percent": r["iqr_count"] * 100 / r["n"], "zscore_percent": r["zscore_count"] * 100 / r["n"]} for r in outlier_counts(self.df).collect()}
        self.results = found
        if generate_insights:
            self.insights = found["insights"] = self._say()
        return found

    def correlations(self) -> dict:
        names = numeric_columns(self.df)
        if len(names) < 2:
            return {"message": "At least two numeric columns are needed"}
        rows = correlations(self.df, names).collect()
        matrix = {a: {a: 1.0} for a in names}
        for r in rows:
            matrix[r["a"]][r["b"]] = matrix[r["b"]][r["a"]] = r["r"]
        high = [{"feature1": r["a"], "feature2": r["b"], "correlation": r["r"], "strength": "strong" if abs(r["r"]) > STRONG else "moderate"} for r in rows if r["r"] is not None and abs(r["r"]) > HIGH]
        return {"matrix": matrix, "high_correlations": high}

    def _say(self) -> list[str]:
        r = self.results
        rows, columns = r["basic_stats"]["shape"]
        said = [f"{rows:,} rows in {columns} columns, about {r['basic_stats']['memory_mb']:.2f} MB"]
        if n := r["basic_stats"]["duplicate_rows"]:
            said.append(f"{n:,} rows repeat earlier ones ({n / rows * 100:.1f} %)")
        if n := r["missing_values"]["columns_with_missing"]:
            said.append(f"{n} columns miss values")
        if n := len(r.get("correlations", {}).get("high_correlations", [])):
            said.append(f"{n} pairs of columns are highly correlated")
        if n := len(r.get("outliers", {})):
            said.append(f"{n} numeric columns hold outliers")
        if n := sum(x["cardinality"] == "high" for x in r["categorical"].values()):
            said.append(f"{n} categorical columns have many distinct values")
        info = r["data_info"]
        said.append(f"{len(info['numeric_columns'])} numeric and {len(info['categorical_columns'])} categorical columns")
        return said

    def get_insights(self) -> list[str]:
        if not self.insights:
            self.get_summary()
        return self.insights

    def get_summary(self) -> dict:
        r = self.results or self.analyze()
        self.insights = self.insights or self._say()
        return {
            "dataset_shape": r["basic_stats"]["shape"],
            "n_numeric_columns": len(r["data_info"]["numeric_columns"]),
            "n_categorical_columns": len(r["data_info"]["categorical_columns"]),
            "total_missing_values": r["missing_values"]["total_missing"],
            "duplicate_rows": r["basic_stats"]["duplicate_rows"],
            "columns_with_outliers": len(r.get("outliers", {})),
            "high_correlations": len(r.get("correlations", {}).get("high_correlations", [])),
            "insights": self.insights,
        }

    def to_json(self, path: str | None = None) -> str:
        text = json.dumps(self.results or self.analyze(), default=str, indent=2)
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        return text

    def generate_report(self, path: str, title: str = "Exploratory profile") -> str:
        from millrace.sources.reports import profile_html

        page = profile_html(self.results or self.analyze(), self.get_insights(), title)
        with open(path, "w", encoding="utf-8") as f:
            f.write(page)
        return path


__all__ = ["Profile", "correlations", "distributions", "duplicate_rows", "outlier_counts", "top_values"]
