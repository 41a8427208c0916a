import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import balance, clean, detect, impute, neighbours
from millrace.operators.balance import shuffle_rows
from millrace.operators.clean import encode_categorical
from millrace.operators.forest import IsolationForest
from millrace.plans import stats
from millrace.plans.pipeline import Prep
from millrace.plans.scratch import Scratch
from millrace.plans.stats import missing_table, modes


def column(df, name, order=None):
    return [r[name] for r in (df.orderBy(order) if order else df).collect()]


def test_impute_auto_fills_median_and_mode(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, None), (3, None, "b"), (4, 4.0, "a")], "i int, num double, cat string")
    out = clean.impute_missing(df)
    assert column(out, "num", "i") == [1.0, 2.0, 2.0, 4.0]
    assert column(out, "cat", "i") == ["a", "a", "b", "a"]


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), (None, None)], "s string, n int")
    assert modes(df, ["s", "n"]) == {"s": "a", "n": "9"}


def test_impute_drop_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,), (3.0,)], "x double")
    assert sorted(column(clean.impute_missing(df, "drop"), "x")) == [1.0, 3.0]
    assert column(missing_table(df), "count") == [2]


def test_all_null_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    out = clean.impute_missing(df)
    assert column(out, "x") == [None, None]
    assert column(out, "s") == ["", ""]


def test_scaling_uses_the_population_deviation_and_bears_constants(spark):
    df = spark.createDataFrame([(float(i), 10 * i, 7.0) for i in range(1, 5)], "a double, b long, c double")
    out = clean.scale_features(df)
    s = out.agg(F.avg("a"), F.stddev_pop("a"), F.stddev_pop("b"), F.max("c")).first()
    assert s[0] == pytest.approx(0) and s[1] == pytest.approx(1) and s[2] == pytest.approx(1) and s[3] == 0
    low_high = clean.scale_features(df, "minmax", ["b"]).agg(F.min("a"), F.max("a"), F.max("c"), F.max("b")).first()
    assert tuple(low_high) == (0.0, 1.0, 0.0, 40)
    with pytest.raises(ValueError):
        clean.scale_features(df, "other")


def test_encoding(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "i int, cat string")
    assert column(clean.encode_categorical(df), "cat", "i") == [0, 1, 0, 2]
    hot = clean.encode_categorical(df, "onehot")
    assert hot.columns == ["i", "cat_b"] and column(hot, "cat_b", "i") == [False, True, False, False]


def test_large_dictionaries_are_joined(spark):
    df = spark.range(600).select("id", F.format_string("v%05d", F.col("id")).alias("s"))
    assert column(clean.encode_categorical(df), "s", "id") == list(range(600))


def test_balancing_is_exact_and_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, 0 if i < 10 else 1) for i in range(15)] + [(99, None)], "x long, target int")
    over = balance.balance_classes(df, "target")
    assert over.count() == 20 and set(column(over.groupBy("target").count(), "count")) == {10}
    under = balance.balance_classes(df, "target", "undersample")
    assert under.count() == 10
    assert sorted(column(under, "x")) == sorted(column(balance.balance_classes(df.repartition(7), "target", "undersample"), "x"))
    with pytest.raises(ValueError):
        balance.balance_classes(df, "nothing")


def test_smote_fills_up_between_neighbours(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.random(), 0) for _ in range(90)] + [(5 + rng.random(), 5 + rng.random(), 1) for _ in range(10)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    out = balance.smote(df, "y").toPandas()
    assert (out.y == 1).sum() == 90 and out[out.y == 1].a.between(5, 6).all()
    with pytest.raises(ValueError, match="SMOTE balancing failed"):
        balance.smote(df.where("y = 0 OR a > 5.5"), "y", k_neighbors=50)


def test_smote_seeks_neighbours_in_the_whole_class(spark):
    # pairs far from each other: the nearest row is the other of the pair, so nothing lies between pairs
    n = 40_000
    rare = spark.range(n).select((F.floor(F.col("id") / 2) * 10 + F.col("id") % 2 * 0.1).alias("a"), F.lit(1).alias("y"))
    many = spark.range(n + 200).select(F.lit(0.0).alias("a"), F.lit(0).alias("y"))
    out = balance.smote(rare.unionByName(many), "y", k_neighbors=1).where("y = 1")
    rest = F.expr("a - 10 * floor(a / 10)")
    assert out.count() == n + 200 and out.where(rest > 0.1001).count() == 0


def test_smote_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.random(), rng.random(), int(i < 60)) for i in range(200)], "a double, b double, y int")
    want = sorted(map(tuple, balance.smote(df, "y").collect()))
    monkeypatch.setattr(balance, "CHUNK", 16)
    assert sorted(map(tuple, balance.smote(df.repartition(7), "y").collect())) == want


def test_split_has_exact_sizes(spark):
    parts = balance.split_rows(spark.range(10), (0.7, 0.15, 0.15))
    assert [p.count() for p in parts] == [7, 1, 2]
    assert sorted(r["id"] for p in parts for r in p.collect()) == list(range(10))


def test_split_takes_shares_as_they_are_written(spark):
    assert int(90_000 * 0.7) == 62_999  # in doubles
    assert [p.count() for p in balance.split_rows(spark.range(90_000))] == [63_000, 13_500, 13_500]
    assert balance.share_of(3, 1 / 3) == 1 and balance.share_of(10**17, 0.7) == 7 * 10**16 and balance.share_of(10**9, 0.123456789) == 123_456_789


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 100, 2, 3]], "x double")
    assert column(detect.remove_outliers(detect.flag_outliers(df, "zscore", threshold=2.0)), "x") == [1, 2, 3, 2, 3]
    assert detect.detect_outliers(df, "zscore", threshold=2.0)["outlier_count"] == 1
    assert detect.detect_outliers(spark.createDataFrame([("a",)], "s string"))["outlier_count"] == 0
    constant = spark.createDataFrame([(1.0,)] * 5, "x double")
    assert detect.detect_outliers(constant, "zscore")["outlier_count"] == 0


def test_isolation_forest_finds_planted_rows(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 1), False) for _ in range(300)] + [(9.0 + i, -9.0, True) for i in range(6)] + [(None, 1.0, False)], "a double, b double, planted boolean")
    found = detect.flag_outliers(df, "iforest", 0.05)
    assert found.where("planted AND NOT is_outlier").count() == 0
    assert 10 <= found.where("is_outlier").count() <= 16
    assert IsolationForest(["a"]).fit(df.where("a > 100")).score(df, "s").count() == 307


def test_imbalance(spark):
    df = spark.createDataFrame([(0,)] * 90 + [(1,)] * 10, "y int")
    found = detect.detect_imbalance(df, "y")
    assert found["is_imbalanced"] and found["minority_class"] == 1 and found["class_distribution"][1] == 0.1
    assert not detect.detect_imbalance(df.where("y = 0"), "y")["is_imbalanced"]
    assert "error" in detect.detect_imbalance(df, "z")


def nan_euclidean_knn(p: pd.DataFrame, k: int) -> pd.DataFrame:
    x = p.to_numpy(float)
    out = x.copy()
    for i, j in zip(*(math_isnan(x)).nonzero(), strict=True):
        rows = []
        for d in range(len(x)):
            both = ~math_isnan(x[i]) & ~math_isnan(x[d])
            if not math_isnan(x[d, j]) and both.any():
                rows.append((((x[i, both] - x[d, both]) ** 2).sum() * x.shape[1] / both.sum(), d))
        out[i, j] = sum(x[d, j] for _, d in sorted(rows)[:k]) / min(k, len(rows))
    return pd.DataFrame(out, columns=p.columns)


def math_isnan(x):
    import numpy as np

    return np.isnan(x)


def test_knn_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [tuple(None if rng.random() < 0.15 else round(rng.random() * 9, 3) for _ in range(3)) for _ in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c double").coalesce(1)
    got = impute.impute_knn(df, 3).toPandas().sort_values(["a", "b", "c"]).round(9).to_numpy()
    want = nan_euclidean_knn(pd.DataFrame(rows, columns=list("abc"), dtype=float), 3).sort_values(["a", "b", "c"]).round(9).to_numpy()
    assert (abs(got - want) < 1e-6).all()


@pytest.mark.parametrize("width, share, scale, k", [(3, 0.2, (900, 9, 9), 5), (4, 0.5, (4, 4, 4, 4), 20), (2, 0.3, (1, 500), 1)])
def test_knn_in_groups_equals_brute_force(spark, monkeypatch, width, share, scale, k):
    for name, value in (("GROUP", 64), ("BOX", 16), ("ASKED", 20)):
        monkeypatch.setattr(neighbours, name, value)
    rng = random.Random(width)
    names = list("abcd")[:width]
    rows = [tuple(None if rng.random() < share else float(rng.randrange(m + 1)) for m in scale) for _ in range(400)]  # many ties, copies and rows without numbers
    rows.sort(key=lambda r: [(v is not None, v or 0.0) for v in r])  # equally near: first by value
    shuffled = random.Random(1).sample(rows, len(rows))
    got = impute.impute_knn(spark.createDataFrame(shuffled, ", ".join(f"{c} double" for c in names)).repartition(5), k).toPandas()
    x = np.array(rows, dtype=float)
    want = x.copy()
    for i, j in zip(*np.isnan(x).nonzero(), strict=True):
        both = ~np.isnan(x[i]) & ~np.isnan(x)
        shared = both.sum(axis=1)
        apart = np.where(both, (x - x[i]) ** 2, 0).sum(axis=1) * width
        near = sorted((apart[d] / shared[d], d) for d in np.flatnonzero((shared > 0) & ~np.isnan(x[:, j])))[:k]
        want[i, j] = np.mean([x[d, j] for _, d in near]) if near else np.nanmean(x[:, j])
    assert sorted(map(tuple, got.to_numpy().round(6).tolist())) == sorted(map(tuple, want.round(6).tolist()))


def test_knn_visits_only_groups_within_reach(spark, monkeypatch):
    for name, value in (("GROUP", 512), ("BOX", 64)):
        monkeypatch.setattr(neighbours, name, value)
    seen, routed = [], neighbours._routed
    monkeypatch.setattr(neighbours, "_routed", lambda *a: seen.append((a[0], routed(*a))) or seen[-1][1])
    df = spark.range(16_000).selectExpr("id", "IF(id % 5 = 0, NULL, id % 50) AS s", "IF(id % 7 = 0, NULL, id % 1000 / 10D) AS r")
    out = impute.impute_knn(df)
    assert out.count() == 16_000 and out.where("s IS NULL OR r IS NULL").count() == 0
    (asked, (visits, donors)), = seen
    assert donors.groupBy("g").count().count() > 20  # all with all: as many visits for each row
    assert visits.count() < 1.5 * asked.count()


def test_iterative_imputation_follows_linear_relations(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1 if i % 7 else None, "s") for i in range(70)], "a double, b double, t string")
    out = impute.impute_iterative(df).toPandas()
    assert out.b.notna().all() and (abs(out.b - (2 * out.a + 1)) < 0.1).all()
    assert (out.t == "s").all()


def test_facade_cleans_classification_data(spark):
    df = spark.createDataFrame([(1.0, "a", 0), (None, "b", 0), (3.0, None, 0), (4.0, "a", 0), (5.0, "b", 0), (6.0, "a", 1)], "feat1 double, feat2 string, target int")
    prep = Prep(df, {"detection": {"outlier_method": "zscore"}})
    out, report = prep.clean("classification", "target")
    assert out.count() == 10 and detect.detect_missing(out) == {}
    assert [x["action"] for x in report["logs"]] == ["detect", "impute_missing", "encode_categorical", "scale_features", "balance_classes"]
    assert prep.fitted.apply(df).count() == 6


def test_empty_frames(spark):
    df = spark.createDataFrame([], "x double, s string, y int")
    assert clean.impute_missing(df).count() == 0
    assert clean.scale_features(df).count() == 0
    assert balance.balance_classes(df, "y").count() == 0
    assert detect.flag_outliers(df, "zscore").count() == 0


@pytest.mark.parametrize("few", [1, 40, 20_000])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "FEW", few)
    monkeypatch.setattr(stats, "ACCURACY", 20)
    monkeypatch.setattr(stats, "MARGIN", 0.1)
    rng = np.random.default_rng(3)
    columns = {"even": rng.normal(size=700), "two": rng.choice([1.0, 2.0], 700), "ties": np.round(rng.exponential(size=700), 1), "one": np.full(700, 5.0)}
    rows = [tuple(float(v[i]) if (i + k) % 9 else None for k, v in enumerate(columns.values())) for i in range(700)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).withColumn("none", F.lit(None).cast("double")).repartition(3)
    shares = [0.0, 0.25, 0.5, 0.77, 1.0]
    found = stats.quantiles(df, {c: F.col(c) for c in [*columns, "none"]}, shares)
    assert found.pop("none") is None
    for k, c in enumerate(columns):
        np.testing.assert_allclose(found[c], np.quantile([r[k] for r in rows if r[k] is not None], shares), rtol=1e-12)


def test_label_codes_of_values_with_one_beginning(spark):
    df = spark.range(2000).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"), "id").repartition(4)
    assert encode_categorical(df).where("name <> id").count() == 0


def test_one_hot_has_no_cap(spark):
    df = spark.range(1200).select(F.format_string("v%04d", "id").alias("v"))
    out = encode_categorical(df, "onehot")
    assert len(out.columns) == 1199 and out.columns[0] == "v_v0001"


def test_shuffle(spark):
    df = spark.range(200)
    a, b = ([r["id"] for r in shuffle_rows(d, 1).collect()] for d in (df, df.repartition(7)))
    assert a == b and sorted(a) == list(range(200)) and a != sorted(a) and a != [r["id"] for r in shuffle_rows(df, 2).collect()]


def test_scratch_tables_go_once_settled(spark):
    outer, made = Scratch(spark, "outer"), []

    def make():
        made.append(Scratch(spark, "inner"))
        return made[0].save(spark.range(10)).where("id > 3")

    def exists(folder):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    kept = outer.settle(make, "kept")
    assert kept.count() == 6 and exists(outer.root) and not exists(made[0].root)
    outer.drop(kept)
    assert not exists(f"{outer.root}/1-kept")
