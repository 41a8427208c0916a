"""Registered queries of the core operators with their SQL equivalents.

The test tables miss no values, so nulls are put in on both sides by rules on
the keys. Doubles are rounded on both sides; timestamps are shown as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import balance, clean, detect, eda, features, graph, impute, text
from millrace.operators.timeseries import SeriesPrep
from millrace.plans.pipeline import Prep
from millrace.plans.stats import missing_table
from millrace.sources import charts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x: Column | str, places: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, places)


def shown(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd HH:mm:ss").alias(ts)


# ---- tables with nulls

LI = "(SELECT * REPLACE (CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem)"
CU = "(SELECT * REPLACE (CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment) FROM customer)"
EV = "(SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events)"


def lineitem_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))


def customer_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))


def events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impute, label-encode and z-score lineitem; keys and dates stay."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    df = lineitem_with_nulls(spark, sf_dir)
    imputed = clean.Imputer().fit(df).apply(df)
    encoded = clean.Encoder("label").fit(imputed).apply(imputed)
    return clean.Scaler("standard").fit(encoded, keys).apply(encoded)


@query(f"""
    WITH a AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT median(l_quantity) FROM {LI})) AS l_quantity, l_extendedprice, l_discount, l_tax,
        CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS l_returnflag, CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS DOUBLE) AS l_linestatus FROM {LI})
    SELECT l_orderkey, l_linenumber, {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))} FROM a""")
def tabular_pipeline(spark, sf_dir):
    df = flagship(spark, sf_dir)
    return df.select("l_orderkey", "l_linenumber", *[r(c, 5).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")])


@query(f"""
    WITH a AS (SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, coalesce(l_quantity, (SELECT median(l_quantity) FROM {LI})) AS l_quantity, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS l_returnflag FROM {LI})
    SELECT {", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS {c}" for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))} FROM a""")
def prep_clean(spark, sf_dir):
    """The chained entry point: detect, impute, encode, scale."""
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    df, _ = Prep(lineitem_with_nulls(spark, sf_dir).select(*columns), {"detection": {"outlier_method": "zscore"}, "cleaning": {"remove_outliers": False}}).clean()
    return df.select(*[r(c, 5).alias(c) for c in columns])


# ---- detection


@query(f"SELECT 'l_quantity' AS \"column\", count(*) FILTER (l_quantity IS NULL) AS \"count\", round_even(count(*) FILTER (l_quantity IS NULL) * 100 / count(*), 2) AS percent, 'double' AS dtype FROM {LI}")
def detect_missing(spark, sf_dir):
    return missing_table(lineitem_with_nulls(spark, sf_dir))


def _measures(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), "l_quantity", "l_extendedprice", "l_discount")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount")


@query(f"""
    SELECT l_orderkey || '-' || l_linenumber AS k, {" OR ".join(f"coalesce(abs(({c} - avg({c}) OVER ()) / nullif(stddev({c}) OVER (), 0)) > 1.7, FALSE)" for c in _MEASURES)} AS is_outlier FROM lineitem""")
def outliers_zscore(spark, sf_dir):
    return detect.flag_outliers(_measures(spark, sf_dir), "zscore", threshold=1.7).select("k", "is_outlier")


_IQR = f"""
    WITH s AS (SELECT {", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in _MEASURES)} FROM lineitem),
    f AS (SELECT l_orderkey || '-' || l_linenumber AS k, {" OR ".join(f"{c} < a_{c} - 0.4 * (b_{c} - a_{c}) OR {c} > b_{c} + 0.4 * (b_{c} - a_{c})" for c in _MEASURES)} AS is_outlier FROM lineitem, s)"""


@query(_IQR + " SELECT * FROM f")
def outliers_iqr(spark, sf_dir):
    return detect.flag_outliers(_measures(spark, sf_dir), "iqr", threshold=0.4).select("k", "is_outlier")


@query(_IQR + " SELECT k FROM f WHERE NOT is_outlier")
def remove_outliers(spark, sf_dir):
    return detect.remove_outliers(detect.flag_outliers(_measures(spark, sf_dir), "iqr", threshold=0.4)).select("k")


@query()
def outliers_iforest(spark, sf_dir):
    return detect.flag_outliers(_measures(spark, sf_dir), "iforest", 0.05).where("is_outlier").select("k")


@query("SELECT o_orderstatus AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY 1")
def imbalance(spark, sf_dir):
    return detect.class_shares(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("SELECT toxic AS class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM labels GROUP BY 1")
def imbalance_labels(spark, sf_dir):
    return detect.class_shares(table(spark, sf_dir, "labels"), "toxic")


# ---- cleaning


def _imputed(spark, sf_dir, strategy):
    return clean.impute_missing(lineitem_with_nulls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity"), strategy).withColumn("l_quantity", r("l_quantity"))


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT median(l_quantity) FROM {LI})), 6) AS l_quantity FROM {LI}")
def impute_median(spark, sf_dir):
    return _imputed(spark, sf_dir, "median")


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, (SELECT avg(l_quantity) FROM {LI})), 6) AS l_quantity FROM {LI}")
def impute_mean(spark, sf_dir):
    return _imputed(spark, sf_dir, "mean")


@query(f"""
    SELECT c_custkey, coalesce(c_mktsegment, (SELECT c_mktsegment FROM {CU} WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM {CU}""")
def impute_mode(spark, sf_dir):
    return clean.impute_missing(customer_with_nulls(spark, sf_dir).select("c_custkey", "c_mktsegment"), "mode")


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM {LI} WHERE l_quantity IS NOT NULL")
def impute_drop(spark, sf_dir):
    return _imputed(spark, sf_dir, "drop")


@query(f"SELECT c_custkey, coalesce(c_mktsegment, '') AS c_mktsegment FROM {CU}")
def impute_fallback(spark, sf_dir):
    return clean.impute_missing(customer_with_nulls(spark, sf_dir).select("c_custkey", "c_mktsegment"), "mean")


@query(f"SELECT c_custkey, c_mktsegment FROM {CU} WHERE c_mktsegment IS NOT NULL")
def drop_missing(spark, sf_dir):
    return clean.drop_missing(customer_with_nulls(spark, sf_dir).select("c_custkey", "c_mktsegment"))


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice FROM part")
def scale_standard(spark, sf_dir):
    df = clean.scale_features(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "standard", ["p_partkey"])
    return df.select("p_partkey", r("p_size").alias("p_size"), r("p_retailprice").alias("p_retailprice"))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal FROM customer")
def scale_minmax(spark, sf_dir):
    return clean.scale_features(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "minmax", ["c_custkey"]).withColumn("c_acctbal", r("c_acctbal"))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders")
def encode_label(spark, sf_dir):
    return clean.encode_categorical(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name FROM customer")
def encode_label_large(spark, sf_dir):
    return clean.encode_categorical(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS \"l_returnflag_N\", l_returnflag = 'R' AS \"l_returnflag_R\", l_linestatus = 'O' AS \"l_linestatus_O\" FROM lineitem")
def encode_onehot(spark, sf_dir):
    return clean.encode_categorical(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), "onehot")


@query("SELECT toxic, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS n FROM labels GROUP BY toxic")
def balance_over(spark, sf_dir):
    return balance.balance_classes(table(spark, sf_dir, "labels"), "toxic").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT toxic, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS n FROM labels GROUP BY toxic")
def balance_under(spark, sf_dir):
    return balance.balance_classes(table(spark, sf_dir, "labels"), "toxic", "undersample").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT toxic, n, (SELECT max(n) FROM c) AS most FROM c)
    SELECT toxic, CAST(k AS BIGINT) AS copies, CAST(CASE WHEN k = most // n THEN n - most % n ELSE most % n END AS BIGINT) AS rows
    FROM (SELECT *, unnest([most // n, most // n + 1]) AS k FROM t) WHERE rows > 0""")
def balance_over_copies(spark, sf_dir):
    """How many rows of each class occur how often: each as often as any other, or once more."""
    rows = balance.balance_classes(table(spark, sf_dir, "labels"), "toxic").groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("copies"))
    return rows.groupBy("toxic", "copies").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT toxic, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS documents, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS found FROM labels GROUP BY toxic")
def balance_under_rows(spark, sf_dir):
    """Distinct documents that stay of each class, and how many of these rows the table holds."""
    labels = table(spark, sf_dir, "labels")
    rows = balance.balance_classes(labels, "toxic", "undersample").join(labels.withColumn("known", F.lit(1)), labels.columns, "left")
    return rows.groupBy("toxic").agg(F.countDistinct("doc_id").alias("documents"), F.count("known").alias("found"))


@query("SELECT toxic, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS n FROM labels GROUP BY toxic")
def balance_smote(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", "n_chars", "toxic")
    return balance.smote(rows, "toxic").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query()
def balance_smote_digests(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select("quality", "n_chars", "toxic")
    shown = F.concat_ws("|", *[F.format_string("%.6f", F.col(c).cast("double")) for c in ("quality", "n_chars", "toxic")])
    return balance.smote(rows, "toxic").groupBy("toxic", F.sha2(shown, 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0 AS part, CAST(floor(count(*) * 0.7) AS BIGINT) AS n FROM customer UNION ALL SELECT 1, CAST(floor(count(*) * 0.15) AS BIGINT) FROM customer UNION ALL SELECT 2, count(*) - CAST(floor(count(*) * 0.7) AS BIGINT) - CAST(floor(count(*) * 0.15) AS BIGINT) FROM customer")
def split_dataset(spark, sf_dir):
    parts = balance.split_rows(table(spark, sf_dir, "customer"))
    out = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("part"), "n") for i, p in enumerate(parts)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_custkey, 1 AS parts, 1 AS copies FROM customer")
def split_dataset_rows(spark, sf_dir):
    """In how many parts each row is, and how often."""
    parts = [p.select("c_custkey", F.lit(i).alias("part")) for i, p in enumerate(balance.split_rows(table(spark, sf_dir, "customer")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("c_custkey").agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("copies"))


@query("SELECT c_custkey, c_name FROM customer")
def shuffle_dataset(spark, sf_dir):
    return balance.shuffle_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


def _parts(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    return df


@query("""
    WITH p AS (SELECT p_partkey AS k, CAST(CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS DOUBLE) AS s, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS r FROM part),
    d AS (SELECT a.k, b.k AS j, b.s, b.r, ((a.k - b.k) ** 2 + coalesce((a.s - b.s) ** 2, 0) + coalesce((a.r - b.r) ** 2, 0)) * 3 / (1 + CAST(a.s + b.s IS NOT NULL AS INTEGER) + CAST(a.r + b.r IS NOT NULL AS INTEGER)) AS d
        FROM p a JOIN p b ON a.k <> b.k WHERE a.s IS NULL OR a.r IS NULL),
    s AS (SELECT k, avg(s) AS s FROM (SELECT * FROM d WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, j) <= 5) GROUP BY k),
    r AS (SELECT k, avg(r) AS r FROM (SELECT * FROM d WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, j) <= 5) GROUP BY k)
    SELECT p.k AS p_partkey, round(coalesce(p.s, s.s), 6) AS p_size, round(coalesce(p.r, r.r), 6) AS p_retailprice FROM p LEFT JOIN s ON s.k = p.k LEFT JOIN r ON r.k = p.k""")
def impute_knn(spark, sf_dir):
    return impute.impute_knn(_parts(spark, sf_dir)).withColumns({c: r(c) for c in ("p_size", "p_retailprice")})


@query()
def impute_iterative(spark, sf_dir):
    return impute.impute_iterative(_parts(spark, sf_dir))


# ---- text

_WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


@query("""
    SELECT count(*) AS total_texts, count(*) FILTER (text IS NULL) AS missing, count(*) FILTER (trim(regexp_replace(text, '\\s+', ' ', 'g')) = '') AS empty,
        count(*) FILTER (length(text) < 5) AS very_short, count(*) FILTER (length(text) > 5000) AS very_long,
        count(*) FILTER (regexp_matches(text, 'http[s]?://|www\\.')) AS contains_urls, count(*) FILTER (regexp_matches(text, '\\S+@\\S+')) AS contains_emails,
        count(*) FILTER (regexp_matches(text, '<[^>]+>')) AS contains_html, round(avg(length(text)), 6) AS avg_length, round(median(length(text)), 6) AS median_length FROM documents""")
def text_detect(spark, sf_dir):
    df = text.issue_counts(table(spark, sf_dir, "documents"), "text")
    return df.withColumns({"avg_length": r("avg_length"), "median_length": r("median_length")})


_CLEAN = "trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), 'http[s]?://\\S+|www\\.\\S+', ' ', 'g'), '\\S+@\\S+', ' ', 'g')), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_CLEAN.format('html')} AS html FROM pages")
def text_clean(spark, sf_dir):
    return text.TextPrep(table(spark, sf_dir, "pages").select("page_id", "html"), "html").clean_text()


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text || ' http://x.example/' || doc_id, '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\d+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def text_clean_strict(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" http://x.example/"), F.col("doc_id")).alias("text"))
    return text.TextPrep(df, "text").clean_text(lowercase=False, remove_urls=False, remove_emails=False, remove_html=False, remove_special_chars=True, remove_numbers=True)


@query(f"SELECT doc_id, CASE WHEN text = '' THEN text ELSE array_to_string(list_filter({_WORDS.format('text')}, lambda w: NOT list_contains([{', '.join(repr(w) for w in T.STOP_WORDS)}], lower(w))), ' ') END AS text FROM documents")
def text_stopwords(spark, sf_dir):
    return text.TextPrep(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").remove_stopwords()


@query(f"SELECT conv_id, turn, array_to_string({_WORDS.format('text')}, '|') AS tokens, len({_WORDS.format('text')}) AS n FROM conversations")
def text_tokens_word(spark, sf_dir):
    df = text.TextPrep(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").tokenize("word")
    return df.select("conv_id", "turn", F.array_join("text_tokens", "|").alias("tokens"), F.size("text_tokens").cast("long").alias("n"))


@query("SELECT conv_id, turn, array_to_string(regexp_split_to_array(text, '[.!?]+'), '|') AS tokens, len(regexp_split_to_array(text, '[.!?]+')) AS n FROM conversations")
def text_tokens_sentence(spark, sf_dir):
    df = text.TextPrep(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text").tokenize("sentence")
    return df.select("conv_id", "turn", F.array_join("text_tokens", "|").alias("tokens"), F.size("text_tokens").cast("long").alias("n"))


@query(f"""
    SELECT doc_id, length(text) AS text_length, len({_WORDS.format('text')}) AS text_word_count, len(regexp_extract_all(text, '[A-Z]')) AS text_upper_count,
        len(regexp_extract_all(text, '\\d')) AS text_digit_count, len(regexp_extract_all(text, '[!@#$%^&*(),.?":{{}}|<>]')) AS text_special_char_count,
        round(coalesce(list_sum(list_transform({_WORDS.format('text')}, lambda w: length(w))) / nullif(len({_WORDS.format('text')}), 0), 0), 6) AS text_avg_word_len FROM documents""")
def text_features(spark, sf_dir):
    return text.TextPrep(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").extract_features().drop("text").withColumn("text_avg_word_len", r("text_avg_word_len"))


@query(f"SELECT doc_id, CASE WHEN len(list_intersect(list_distinct({_WORDS.format('lower(text)')}), ['the', 'is', 'are', 'and', 'of', 'to', 'in', 'a', 'for'])) >= 2 THEN 'english' ELSE 'other' END AS text_language FROM documents")
def text_language(spark, sf_dir):
    return text.TextPrep(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").detect_language().drop("text")


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def text_dedupe(spark, sf_dir):
    return text.TextPrep(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").remove_duplicates("first", ["doc_id"])


@query("SELECT max(doc_id) AS doc_id, text FROM documents GROUP BY text")
def text_dedupe_last(spark, sf_dir):
    return text.TextPrep(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").remove_duplicates("last", ["doc_id"])


@query("SELECT max(doc_id) AS doc_id, text FROM documents GROUP BY text HAVING count(*) = 1")
def text_dedupe_none(spark, sf_dir):
    return text.TextPrep(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").remove_duplicates(False)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 100 AND 5000")
def text_length_filter(spark, sf_dir):
    df = text.TextPrep(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").filter_by_length(100, 5000)
    return df.select("doc_id", F.length("text").cast("long").alias("n"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS.format('lower(text)')}) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 100")
def text_vocabulary(spark, sf_dir):
    return text.vocabulary(table(spark, sf_dir, "documents"), "text", 100)


# ---- time series

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _minutes(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", "ts").alias("ts")).agg(F.sum("value").alias("value"))


_MINUTES = "(SELECT date_trunc('minute', ts) AS ts, sum(value) AS value FROM events GROUP BY 1)"


def _series(spark, sf_dir):
    return SeriesPrep(events_with_nulls(spark, sf_dir), "ts", "value", order=["event_id"])


@query(f"""
    WITH e AS {EV} SELECT count(*) AS total_records, count(*) - count(DISTINCT ts) AS duplicate_timestamps, count(*) FILTER (value IS NULL) AS missing_values,
        count(*) FILTER (value = 0) AS zero_values, count(*) FILTER (value < 0) AS negative_values, {_TS.format('min(ts)')} AS start, {_TS.format('max(ts)')} AS "end" FROM e""")
def ts_detect(spark, sf_dir):
    found = _series(spark, sf_dir).detect_issues()
    names = ("total_records", "duplicate_timestamps", "missing_values", "zero_values", "negative_values")
    row = [int(found[n]) for n in names] + [found[n].strftime("%Y-%m-%d %H:%M:%S") for n in ("start", "end")]
    return spark.createDataFrame([tuple(row)], ", ".join(f"{n} long" for n in names) + ", start string, `end` string")


@query(f"""
    WITH s AS (SELECT ts, epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts)) AS d FROM events)
    SELECT {_TS.format('ts')} AS timestamp, round(d / 1e6, 6) AS seconds FROM s WHERE d > 2 * (SELECT median(d) FROM s)""")
def ts_gaps(spark, sf_dir):
    return SeriesPrep(table(spark, sf_dir, "events"), "ts", "value", order=["event_id"]).gaps().select(shown("timestamp"), r("seconds").alias("seconds"))


@query("""
    SELECT 'event_id' AS by, count(*) = 0 AS is_chronological FROM (SELECT lag(ts) OVER (ORDER BY event_id) > ts AS falls FROM events) WHERE falls
    UNION ALL SELECT 'ts', TRUE""")
def ts_chronological(spark, sf_dir):
    rows = [(c, SeriesPrep(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", order=[c]).is_chronological()) for c in ("event_id", "ts")]
    return spark.createDataFrame(rows, "by string, is_chronological boolean")


@query(f"SELECT {_TS.format('l_shipdate')} AS l_shipdate, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS l_quantity, min(l_orderkey * 10 + l_linenumber) AS k FROM lineitem GROUP BY lineitem.l_shipdate")
def ts_dedupe(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return SeriesPrep(df, "l_shipdate", "l_quantity", order=["k"]).remove_duplicate_timestamps("first").select(shown("l_shipdate"), "l_quantity", "k")


@query(f"SELECT {_TS.format('l_shipdate')} AS l_shipdate, round(avg(l_quantity), 6) AS l_quantity, min(l_orderkey * 10 + l_linenumber) AS k FROM lineitem GROUP BY lineitem.l_shipdate")
def ts_dedupe_agg(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return SeriesPrep(df, "l_shipdate", "l_quantity", order=["k"]).remove_duplicate_timestamps(aggregate="mean").select(shown("l_shipdate"), r("l_quantity").alias("l_quantity"), "k")


@query(f"SELECT {_TS.format('s.ts')} AS ts, round(e.value, 6) AS value FROM (SELECT unnest(generate_series((SELECT min(ts) FROM {_MINUTES}), (SELECT max(ts) FROM {_MINUTES}), INTERVAL 1 MINUTE)) AS ts) s LEFT JOIN {_MINUTES} e ON e.ts = s.ts")
def ts_fill(spark, sf_dir):
    return SeriesPrep(_minutes(spark, sf_dir), "ts", "value").fill_missing_timestamps("min").select(shown("ts"), r("value").alias("value"))


def _filled(spark, sf_dir, method):
    return _series(spark, sf_dir).interpolate_missing(method).select("event_id", r("value").alias("value"))


@query(f"SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id), 6) AS value FROM {EV}")
def ts_ffill(spark, sf_dir):
    return _filled(spark, sf_dir, "ffill")


@query(f"SELECT event_id, round(first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value FROM {EV}")
def ts_bfill(spark, sf_dir):
    return _filled(spark, sf_dir, "bfill")


_INTERPOLATE = f"""
    WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS i, epoch_us(ts) AS t FROM {EV}),
    m AS (SELECT *, CASE WHEN value IS NOT NULL THEN {{at}} END AS pos FROM e),
    n AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS p, last_value(pos IGNORE NULLS) OVER b AS pa, first_value(value IGNORE NULLS) OVER a AS q, first_value(pos IGNORE NULLS) OVER a AS qa FROM m
        WINDOW b AS (ORDER BY i), a AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(coalesce(value, p + (q - p) * (({{at}} - pa) / nullif(CAST(qa - pa AS DOUBLE), 0)), p), 6) AS value FROM n"""


@query(_INTERPOLATE.format(at="i"))
def ts_interp_linear(spark, sf_dir):
    return _filled(spark, sf_dir, "linear")


@query(_INTERPOLATE.format(at="t"))
def ts_interp_time(spark, sf_dir):
    return _filled(spark, sf_dir, "time")


@query("SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) - 1 AS ts_dayofweek, hour(ts) AS ts_hour, quarter(ts) AS ts_quarter, isodow(ts) >= 6 AS ts_is_weekend FROM events")
def ts_time_features(spark, sf_dir):
    df = SeriesPrep(table(spark, sf_dir, "events").select("event_id", "ts"), "ts").add_time_features().drop("ts")
    return df.select("event_id", *[F.col(c).cast("long").alias(c) for c in df.columns if c not in ("event_id", "ts_is_weekend")], "ts_is_weekend")


@query(f"SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 7) OVER w AS value_lag_7, lag(value, 30) OVER w AS value_lag_30 FROM {EV} WINDOW w AS (ORDER BY ts, event_id)")
def ts_lag(spark, sf_dir):
    return _series(spark, sf_dir).add_lag_features().drop("ts", "value")


@query("SELECT event_id, lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag_1 FROM events")
def ts_lag_by_user(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return SeriesPrep(df, "ts", "value", ["user_id"], ["event_id"]).add_lag_features([1]).select("event_id", "value_lag_1")


@query(f"""
    SELECT event_id, {", ".join(f"CASE WHEN count(value) OVER w{k} = {k} THEN round({f}(value) OVER w{k}, 6) END AS value_rolling_{n}_{k}" for k in (3, 7) for n, f in (("mean", "avg"), ("std", "stddev"), ("min", "min"), ("max", "max")))}
    FROM {EV} WINDOW w3 AS (ORDER BY ts, event_id ROWS 2 PRECEDING), w7 AS (ORDER BY ts, event_id ROWS 6 PRECEDING)""")
def ts_rolling(spark, sf_dir):
    df = _series(spark, sf_dir).add_rolling_features([3, 7], ["mean", "std", "min", "max"]).drop("ts", "value")
    return df.select("event_id", *[r(c).alias(c) for c in df.columns if c != "event_id"])


@query(f"""
    WITH e AS {EV}, s AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e)
    SELECT event_id, coalesce(value < a - 0.5 * (b - a) OR value > b + 0.5 * (b - a), FALSE) AS value_is_outlier FROM e, s""")
def ts_outliers(spark, sf_dir):
    return _series(spark, sf_dir).detect_outliers("iqr", 0.5).select("event_id", "value_is_outlier")


def _resampled(spark, sf_dir, freq, f):
    return SeriesPrep(table(spark, sf_dir, "events").select("ts", "value"), "ts", "value").resample(freq, f).select(shown("ts"), r("value").alias("value"))


def _resample_sql(bucket: str, spine: str, f: str) -> str:
    return f"""
    WITH b AS (SELECT {bucket} AS ts, {f}(value) AS value FROM events GROUP BY 1), s AS (SELECT {spine} AS ts FROM b)
    SELECT {_TS.format('s.ts')} AS ts, round(b.value, 6) AS value FROM s LEFT JOIN b ON b.ts = s.ts"""


@query(_resample_sql("date_trunc('hour', ts)", "unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR))", "avg"))
def ts_resample_h(spark, sf_dir):
    return _resampled(spark, sf_dir, "h", "mean")


@query(_resample_sql("date_trunc('day', ts)", "unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY))", "sum"))
def ts_resample_d(spark, sf_dir):
    return _resampled(spark, sf_dir, "D", "sum")


@query(_resample_sql("time_bucket(INTERVAL 2 DAYS, ts, (SELECT date_trunc('day', min(ts)) FROM events))", "unnest(generate_series(min(ts), max(ts), INTERVAL 2 DAY))", "max"))
def ts_resample_2d(spark, sf_dir):
    return _resampled(spark, sf_dir, "2D", "max")


@query(_resample_sql("date_trunc('week', ts) + INTERVAL 6 DAY", "unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY))", "sum"))
def ts_resample_w(spark, sf_dir):
    return _resampled(spark, sf_dir, "W", "sum")


@query(f"""
    WITH b AS (SELECT CAST(last_day(o_orderdate) AS TIMESTAMP) AS ts, count(o_totalprice) AS value FROM orders GROUP BY 1),
    s AS (SELECT CAST(last_day(unnest(generate_series(date_trunc('month', min(ts)), max(ts), INTERVAL 1 MONTH))) AS TIMESTAMP) AS ts FROM b)
    SELECT {_TS.format('s.ts')} AS ts, coalesce(b.value, 0) AS value FROM s LEFT JOIN b ON b.ts = s.ts""")
def ts_resample_m(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return SeriesPrep(df, "ts", "value").resample("M", "count").select(shown("ts"), "value")


# ---- graphs

# every order is an edge twice (so edges repeat), and every customer has a loop

_EDGES = """(SELECT o_custkey AS source, o_orderkey % 3000 AS target FROM orders
    UNION ALL SELECT o_custkey, o_orderkey % 3000 FROM orders
    UNION ALL SELECT c_custkey, c_custkey FROM customer)"""


def _graph(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 3000).alias("target"))
    loops = customers.select(F.col("c_custkey").alias("source"), F.col("c_custkey").alias("target"))
    return graph.GraphPrep(customers.select(F.col("c_custkey").alias("id")), pairs.unionAll(pairs).unionAll(loops))


@query(f"""
    WITH e AS {_EDGES} SELECT (SELECT count(*) FROM customer) AS total_nodes, count(*) AS total_edges, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS duplicate_edges,
        count(*) FILTER (source = target) AS self_loops,
        (SELECT count(DISTINCT source) FROM e WHERE source NOT IN (SELECT c_custkey FROM customer)) + (SELECT count(DISTINCT target) FROM e WHERE target NOT IN (SELECT c_custkey FROM customer)) AS dangling_edges FROM e""")
def graph_detect(spark, sf_dir):
    found = _graph(spark, sf_dir).detect_issues()
    names = ("total_nodes", "total_edges", "duplicate_edges", "self_loops", "dangling_edges")
    return spark.createDataFrame([tuple(int(found[n]) for n in names)], ", ".join(f"{n} long" for n in names))


@query("SELECT DISTINCT o_custkey AS id FROM orders")
def node_validate(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return graph.GraphPrep(nodes.unionAll(nodes.limit(1).select(F.lit(None).cast("long").alias("id")))).validate_node_ids()


@query(f"SELECT * FROM {_EDGES} WHERE source <> target AND source IN (SELECT c_custkey FROM customer) AND target IN (SELECT c_custkey FROM customer)")
def edge_validate(spark, sf_dir):
    return _graph(spark, sf_dir).validate_edges()


@query(f"SELECT DISTINCT source, target FROM {_EDGES}")
def edge_dedupe(spark, sf_dir):
    return _graph(spark, sf_dir).remove_duplicate_edges()


@query(f"""
    WITH e AS {_EDGES}, o AS (SELECT source, count(*) AS n FROM e GROUP BY 1), i AS (SELECT target, count(*) AS n FROM e GROUP BY 1)
    SELECT c_custkey AS id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS total_degree, o.n IS NULL AND i.n IS NULL AS is_isolated
    FROM customer LEFT JOIN o ON o.source = c_custkey LEFT JOIN i ON i.target = c_custkey""")
def node_features(spark, sf_dir):
    return _graph(spark, sf_dir).add_node_features()


@query(f"SELECT source, target, count(*) OVER (PARTITION BY source, target) AS edge_count FROM {_EDGES}")
def edge_features(spark, sf_dir):
    return _graph(spark, sf_dir).add_edge_features()


@query(f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT source AS a, target AS b FROM {_EDGES} UNION SELECT target, source FROM {_EDGES}),
    cc(id, m) USING KEY (id) AS (
        SELECT a, a FROM e GROUP BY a
        UNION SELECT e.a, min(c.m) FROM e JOIN cc c ON c.id = e.b JOIN recurring.cc u ON u.id = e.a WHERE c.m < u.m GROUP BY e.a),
    n AS (SELECT c_custkey AS id, coalesce(m, c_custkey) AS m FROM customer LEFT JOIN cc ON cc.id = c_custkey),
    s AS (SELECT id, min(id) OVER (PARTITION BY m) AS least FROM n)
    SELECT id, dense_rank() OVER (ORDER BY least) - 1 AS component_id FROM s""")
def graph_components(spark, sf_dir):
    return _graph(spark, sf_dir).identify_components()


@query(f"WITH e AS {_EDGES} SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT source FROM e) OR c_custkey IN (SELECT target FROM e)")
def graph_isolated(spark, sf_dir):
    return _graph(spark, sf_dir).filter_isolated_nodes()


@query(f"SELECT source AS node, array_to_string(list_sort(list(target)), ',') AS neighbours FROM {_EDGES} GROUP BY source")
def graph_adjacency(spark, sf_dir):
    return _graph(spark, sf_dir).adjacency().select("node", F.array_join(F.array_sort("neighbours"), ",").alias("neighbours"))


@query(f"SELECT source, target FROM {_EDGES}")
def graph_edge_list(spark, sf_dir):
    return _graph(spark, sf_dir).edge_list()


@query(f"WITH n AS (SELECT count(*) AS n FROM customer), m AS (SELECT count(*) AS m FROM {_EDGES}) SELECT n AS num_nodes, m AS num_edges, round(2 * m / (n * (n - 1)), 9) AS density FROM n, m")
def graph_stats(spark, sf_dir):
    s = _graph(spark, sf_dir).get_graph_stats()
    return spark.createDataFrame([(s["num_nodes"], s["num_edges"], float(s["density"]))], "num_nodes long, num_edges long, density double").withColumn("density", r("density", 9))


# ---- features


def _engine(spark, sf_dir, *columns, target=None, name="lineitem"):
    return features.FeatureEngine(table(spark, sf_dir, name).select(*columns), target)


_THREE = ["l_quantity", "l_discount", "l_tax"]


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({e}, 6) AS \"{n}\"" for n, e in [(f"{a}^2", f"{a} * {a}") for a in _THREE] + [(f"{a} {b}", f"{a} * {b}") for i, a in enumerate(_THREE) for b in _THREE[i + 1 :]]) + " FROM lineitem")
def feature_polynomial(spark, sf_dir):
    df = _engine(spark, sf_dir, "l_orderkey", "l_linenumber", *_THREE).create_polynomial_features(_THREE).drop(*_THREE)
    return df.select("l_orderkey", "l_linenumber", *[r(F.col(f"`{c}`")).alias(c) for c in df.columns[2:]])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) AS l_quantity_x_l_discount, round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax, round(l_discount * l_tax, 6) AS l_discount_x_l_tax FROM lineitem")
def feature_interactions(spark, sf_dir):
    df = _engine(spark, sf_dir, "l_orderkey", "l_linenumber", *_THREE).create_interactions(_THREE).drop(*_THREE)
    return df.select("l_orderkey", "l_linenumber", *[r(c).alias(c) for c in df.columns[2:]])


@query("SELECT l_orderkey, l_linenumber, round(l_discount / l_quantity, 6) AS l_discount_div_l_quantity, round(l_tax / l_quantity, 6) AS l_tax_div_l_quantity FROM lineitem")
def feature_ratios(spark, sf_dir):
    df = _engine(spark, sf_dir, "l_orderkey", "l_linenumber", *_THREE).create_ratio_features(_THREE).drop(*_THREE)
    return df.select("l_orderkey", "l_linenumber", *[r(c).alias(c) for c in df.columns[2:]])


@query(f"""
    WITH a AS (SELECT l_orderkey, l_linenumber, list_filter([l_quantity, l_discount, l_tax], lambda x: x IS NOT NULL) AS v FROM {LI})
    SELECT l_orderkey, l_linenumber, round(list_sum(v), 6) AS agg_sum, round(list_avg(v), 6) AS agg_mean, round(list_stddev_samp(v), 6) AS agg_std, round(list_min(v), 6) AS agg_min, round(list_max(v), 6) AS agg_max, round(list_median(v), 6) AS agg_median FROM a""")
def feature_row_stats(spark, sf_dir):
    e = features.FeatureEngine(lineitem_with_nulls(spark, sf_dir).select("l_orderkey", "l_linenumber", *_THREE))
    df = e.create_aggregation_features(_THREE, ["sum", "mean", "std", "min", "max", "median"]).drop(*_THREE)
    return df.select("l_orderkey", "l_linenumber", *[r(c).alias(c) for c in df.columns[2:]])


@query("WITH s AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part) SELECT p_partkey, CAST(" + " + ".join(f"CAST(p_retailprice >= a + {i} * ((b - a) / 5) AS INTEGER)" for i in range(1, 5)) + " AS DOUBLE) AS p_retailprice_binned FROM part, s")
def feature_bin_uniform(spark, sf_dir):
    return _engine(spark, sf_dir, "p_partkey", "p_retailprice", name="part").create_binned_features(["p_retailprice"], 5, "uniform").drop("p_retailprice")


@query("WITH s AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM part) SELECT p_partkey, CAST(" + " + ".join(f"CAST(p_retailprice >= e[{i}] AS INTEGER)" for i in range(1, 5)) + " AS DOUBLE) AS p_retailprice_binned FROM part, s")
def feature_bin_quantile(spark, sf_dir):
    return _engine(spark, sf_dir, "p_partkey", "p_retailprice", name="part").create_binned_features(["p_retailprice"], 5, "quantile").drop("p_retailprice")


@query()
def feature_bin_kmeans(spark, sf_dir):
    return _engine(spark, sf_dir, "p_partkey", "p_retailprice", name="part").create_binned_features(["p_retailprice"], 5, "kmeans").drop("p_retailprice")


@query("SELECT o_orderkey, year(o_orderdate) AS o_orderdate_year, month(o_orderdate) AS o_orderdate_month, day(o_orderdate) AS o_orderdate_day, isodow(o_orderdate) - 1 AS o_orderdate_dayofweek, hour(o_orderdate) AS o_orderdate_hour FROM orders")
def feature_datetime(spark, sf_dir):
    df = _engine(spark, sf_dir, "o_orderkey", "o_orderdate", name="orders").create_datetime_features().drop("o_orderdate")
    return df.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in df.columns[1:]])


def _scores(spark, found):
    return spark.createDataFrame(sorted(found.items()), "feature string, score double").withColumn("score", r("score", 4))


@query("\n    UNION ALL\n".join(f"""
    SELECT '{c}' AS feature, round((b / (g - 1)) / (w / (n - g)), 4) AS score FROM (
        SELECT sum(k * (m - t) * (m - t)) AS b, sum(s) AS w, sum(k) AS n, count(*) AS g FROM (
            SELECT l_returnflag, count(*) AS k, avg({c}) AS m, var_pop({c}) * count(*) AS s, (SELECT avg({c}) FROM lineitem) AS t FROM lineitem GROUP BY 1))""" for c in _MEASURES))
def feature_f_test(spark, sf_dir):
    return _scores(spark, features.f_scores(table(spark, sf_dir, "lineitem"), list(_MEASURES), "l_returnflag"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(var_samp({c}), 4) AS score FROM lineitem" for c in _MEASURES))
def feature_variance(spark, sf_dir):
    return _scores(spark, features.variances(table(spark, sf_dir, "lineitem"), list(_MEASURES)))


@query(" UNION ALL ".join(f"""
    SELECT '{c}' AS feature, round((SELECT sum(n / t * ln(n * t / (a * b))) FROM (
        SELECT CAST(n AS DOUBLE) AS n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS a, sum(n) OVER (PARTITION BY y) AS b FROM (
            SELECT l_returnflag AS y, len(list_filter(e, lambda t: t <= {c} AND t < m)) AS x, count(*) AS n
            FROM lineitem, (SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, max({c}) AS m FROM lineitem) GROUP BY 1, 2))), 4) AS score""" for c in _MEASURES))
def feature_mutual_info(spark, sf_dir):
    return _scores(spark, features.mutual_information(table(spark, sf_dir, "lineitem"), list(_MEASURES), "l_returnflag"))


# ---- profiles and charts


@query(" UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
        count(DISTINCT {c}) AS "unique", count(*) FILTER ({c} = 0) AS zeros FROM {LI}""" for c in _MEASURES))
def eda_distributions(spark, sf_dir):
    df = eda.distributions(lineitem_with_nulls(spark, sf_dir).select(*_MEASURES))
    return df.select("column", "count", *[r(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis")], "unique", "zeros")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {LI}" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :]))
def eda_correlations(spark, sf_dir):
    return eda.correlations(lineitem_with_nulls(spark, sf_dir), list(_MEASURES)).withColumn("r", r("r"))


@query("""
    WITH p AS (SELECT exp(l_quantity / 10) AS v FROM lineitem), s AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, avg(v) AS m, stddev(v) AS d, count(v) AS n FROM p)
    SELECT 'v' AS "column", count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS iqr_count, count(*) FILTER (abs(v - m) / d > 3) AS zscore_count,
        round(any_value(a - 1.5 * (b - a)), 4) AS lower, round(any_value(b + 1.5 * (b - a)), 4) AS upper, any_value(n) AS n FROM p, s""")
def eda_outliers(spark, sf_dir):
    df = eda.outlier_counts(table(spark, sf_dir, "lineitem").select(F.exp(F.col("l_quantity") / 10).alias("v")))
    return df.withColumns({"lower": r("lower", 4), "upper": r("upper", 4)})


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM part GROUP BY {c}) WHERE rank <= 10" for c in ("p_brand", "p_type")))
def eda_top_values(spark, sf_dir):
    return eda.top_values(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)) AS n FROM lineitem")
def eda_duplicate_rows(spark, sf_dir):
    n = eda.duplicate_rows(table(spark, sf_dir, "lineitem").select(*_THREE, "l_returnflag"))
    return spark.createDataFrame([(n,)], "n long")


@query("""
    WITH s AS (SELECT min(l_extendedprice) AS a, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem)
    SELECT CAST(least(floor((l_extendedprice - a) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1""")
def chart_histogram(spark, sf_dir):
    return charts.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("bin", "n")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(min({c}), 6) AS low, round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS mid, round(quantile_cont({c}, 0.75), 6) AS q3, round(max({c}), 6) AS high FROM lineitem" for c in _MEASURES))
def chart_five_numbers(spark, sf_dir):
    found = charts.five_numbers(table(spark, sf_dir, "lineitem"), list(_MEASURES))
    return spark.createDataFrame([(c, *[round(x, 6) for x in v]) for c, v in found.items()], "`column` string, low double, q1 double, mid double, q3 double, high double")


__all__ = ["ORACLES", "QUERIES", "flagship"]
