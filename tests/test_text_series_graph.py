import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.catalogue import QUERIES
from millrace.operators import timeseries
from millrace.operators.graph import GraphPrep
from millrace.operators.text import TextPrep
from millrace.operators.timeseries import SeriesPrep


def test_text_cleaning(spark):
    df = spark.createDataFrame([(1, "See <b>http://x.io/a</b> or WWW.a.b me@x.org\tNOW"), (2, None), (3, "")], "id int, text string")
    p = TextPrep(df, "text")
    assert [r["text"] for r in p.clean_text().orderBy("id").collect()] == ["see or www.a.b now", "", ""]
    assert p.log[-1]["action"] == "clean_text"
    with pytest.raises(ValueError):
        TextPrep(df, "other")


def test_stop_words_tokens_features(spark):
    df = spark.createDataFrame([("this is a test of the system",), ("",), (None,)], "text string")
    assert [r[0] for r in TextPrep(df, "text").remove_stopwords().collect()] == ["test system", "", None]
    t = TextPrep(df, "text")
    t.tokenize("word")
    assert t.df.first()["text_tokens"] == ["this", "is", "a", "test", "of", "the", "system"]
    one = spark.createDataFrame([("Hello World! 123",)], "text string")
    row = TextPrep(one, "text").extract_features().first()
    assert (row["text_word_count"], row["text_digit_count"], row["text_upper_count"], row["text_special_char_count"]) == (3, 3, 2, 1)
    assert TextPrep(one, "text").tokenize("sentence").first()["text_tokens"] == ["Hello World", " 123"]
    assert [r["text_language"] for r in TextPrep(df, "text").detect_language().collect()] == ["english", "other", "other"]


def test_text_counts_and_vocabulary(spark):
    df = spark.createDataFrame([("",), ("valid text",), ("   ",), (None,)], "text string")
    found = TextPrep(df, "text").detect_issues()
    assert found["missing"] == 1 and found["empty"] == 2
    v = TextPrep(spark.createDataFrame([("hello world hello",), ("Hello world test",)], "text string"), "text").get_vocabulary()
    assert v == {"hello": 3, "world": 2, "test": 1}


def test_text_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "id int, text string")
    ids = lambda keep: sorted(r["id"] for r in TextPrep(df, "text").remove_duplicates(keep, ["id"]).collect())
    assert ids("first") == [1, 2, 4] and ids("last") == [2, 3, 5] and ids(False) == [2]


def series(spark, values, start="2024-01-01", step="D"):
    ts = pd.date_range(start, periods=len(values), freq=step)
    return spark.createDataFrame([(t.to_pydatetime(), v) for t, v in zip(ts, values, strict=True)], "date timestamp_ntz, value double")


@pytest.mark.parametrize("method", ["linear", "ffill", "bfill", "time"])
def test_interpolation_equals_pandas(spark, method):
    values = [None, 10.0, None, None, 20.0, 30.0, None]
    got = [r["value"] for r in SeriesPrep(series(spark, values), "date", "value").interpolate_missing(method).orderBy("date").collect()]
    s = pd.Series(values, index=pd.date_range("2024-01-01", periods=7), dtype=float)
    want = s.ffill() if method == "ffill" else s.bfill() if method == "bfill" else s.interpolate("time" if method == "time" else "linear")
    assert [None if x is None else round(x, 9) for x in got] == [None if pd.isna(x) else round(x, 9) for x in want]


def test_stretches_and_halos_change_nothing(spark, monkeypatch):
    rng = range(1, 60)
    values = [None if i % 5 == 0 or 20 < i < 34 else float(i * i % 17) for i in rng]
    whole = SeriesPrep(series(spark, values), "date", "value")
    want_lag = whole.add_lag_features([1, 7]).orderBy("date").collect()
    want_roll = SeriesPrep(series(spark, values), "date", "value").add_rolling_features([3], ["mean", "std"]).orderBy("date").collect()
    want_fill = SeriesPrep(series(spark, values), "date", "value").interpolate_missing("linear").orderBy("date").collect()
    monkeypatch.setattr(timeseries, "STRETCH", 10)
    assert SeriesPrep(series(spark, values), "date", "value").add_lag_features([1, 7]).orderBy("date").collect() == want_lag
    assert SeriesPrep(series(spark, values), "date", "value").add_rolling_features([3], ["mean", "std"]).orderBy("date").collect() == want_roll
    assert SeriesPrep(series(spark, values), "date", "value").interpolate_missing("linear").orderBy("date").collect() == want_fill


def test_functions_look_back_over_several_stretches(spark, monkeypatch):
    values = [None if i % 7 == 0 else float(i * i % 23) for i in range(1, 70)]
    frame = pd.Series(values, dtype=float)
    monkeypatch.setattr(timeseries, "STRETCH", 10)
    got = SeriesPrep(series(spark, values), "date", "value").add_lag_features([25, 41]).orderBy("date").collect()
    for k in (25, 41):
        assert [r[f"value_lag_{k}"] for r in got] == [None if pd.isna(x) else x for x in frame.shift(k)]
    filled = frame.fillna(0)
    rolled = SeriesPrep(series(spark, filled.tolist()), "date", "value").add_rolling_features([33], ["mean", "max"]).orderBy("date").collect()
    for f in ("mean", "max"):
        want = getattr(filled.rolling(33), f)()
        assert [None if r[f"value_rolling_{f}_33"] is None else round(r[f"value_rolling_{f}_33"], 9) for r in rolled] == [None if pd.isna(x) else round(x, 9) for x in want]


def test_a_long_series_of_several_is_cut_up(spark, monkeypatch):
    rows = [(p, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if i % 4 == 0 or 15 < i < 40 else float(i + 100 * (p or 0))) for p, n in ((1, 70), (2, 3), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "p int, date timestamp_ntz, value double")
    make = lambda: [SeriesPrep(df, "date", "value", ["p"]).add_lag_features([1, 12]), *(SeriesPrep(df, "date", "value", ["p"]).interpolate_missing(m) for m in ("linear", "bfill", "ffill"))]
    want = [d.orderBy("p", "date").collect() for d in make()]
    monkeypatch.setattr(timeseries, "STRETCH", 10)
    assert [d.orderBy("p", "date").collect() for d in make()] == want
    by_key = {(r["p"], r["date"].hour + 24 * (r["date"].day - 1)): r["value_lag_12"] for r in want[0]}
    assert by_key[1, 69] == 157 and by_key[None, 13] == 1 and by_key[2, 2] is None


def test_chronological(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, d(1)), (2, d(1)), (3, d(4)), (4, d(3))]
    df = spark.createDataFrame(rows, "k int, date timestamp_ntz")
    assert not SeriesPrep(df, "date", order=["k"]).detect_issues()["is_chronological"]
    assert not SeriesPrep(df.coalesce(1), "date").is_chronological()
    assert SeriesPrep(df.where("k < 4"), "date", order=["k"]).detect_issues()["is_chronological"]
    assert SeriesPrep(df.where("k < 4").coalesce(1), "date").is_chronological()
    assert not SeriesPrep(spark.createDataFrame([(1, None), (2, d(1))], df.schema), "date", order=["k"]).is_chronological()


def test_calendar(spark):
    d = lambda n: dt.datetime(2024, 1, n)
    df = spark.createDataFrame([(d(1), 1), (d(2), 2), (d(5), 3), (d(8), 4)], "date timestamp_ntz, value long")
    p = SeriesPrep(df, "date", "value")
    assert p.fill_missing_timestamps("D").count() == 8
    assert SeriesPrep(df, "date", "value").detect_issues()["gaps"] == 0
    dup = spark.createDataFrame([(d(1), 10, 1), (d(1), 20, 2), (d(2), 30, 3)], "date timestamp_ntz, value long, k int")
    assert [r["value"] for r in SeriesPrep(dup, "date", "value", order=["k"]).remove_duplicate_timestamps().orderBy("date").collect()] == [10, 30]
    assert [r["value"] for r in SeriesPrep(dup, "date", "value", order=["k"]).remove_duplicate_timestamps(aggregate="mean").orderBy("date").collect()] == [15, 30]


@pytest.mark.parametrize(("freq", "f"), [("2D", "mean"), ("W", "sum"), ("h", "sum"), ("M", "max"), ("D", "count")])
def test_resample_equals_pandas(spark, freq, f):
    ts = pd.to_datetime(["2024-01-03 05:00", "2024-01-03 23:10", "2024-01-06 00:00", "2024-01-14 12:00", "2024-03-02 01:00"])
    values = [1.0, 2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(t.to_pydatetime(), v) for t, v in zip(ts, values, strict=True)], "date timestamp_ntz, value double")
    got = {r["date"]: r["value"] for r in SeriesPrep(df, "date", "value").resample(freq, f).collect()}
    want = getattr(pd.Series(values, index=ts).resample({"M": "ME"}.get(freq, freq)), f)()
    assert got == {k.to_pydatetime(): (None if pd.isna(v) else v) for k, v in want.items()}


def test_series_from_strings(spark):
    df = spark.createDataFrame([("2024-01-02", 1)], "date string, value long")
    assert SeriesPrep(df, "date", "value").add_time_features().first()["date_dayofweek"] == 1
    with pytest.raises(ValueError):
        SeriesPrep(spark.createDataFrame([("never", 1)], "date string, value long"), "date")
    with pytest.raises(ValueError):
        SeriesPrep(df, "date").add_lag_features()


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 5), (3, 3), (9, 1), (None, 2)], "source long, target long")
    g = GraphPrep(nodes, edges)
    found = g.detect_issues()
    assert (found["duplicate_edges"], found["self_loops"], found["dangling_edges"], found["missing_endpoints"]) == (1, 1, 1, 1)
    assert sorted(map(tuple, g.validate_edges().collect())) == [(1, 2), (2, 3), (4, 5), (4, 5)]
    assert g.remove_duplicate_edges().count() == 3
    assert [r["component_id"] for r in g.identify_components().orderBy("id").collect()] == [0, 0, 0, 1, 1, 2]
    assert g.add_node_features().where("id = 2").first()["total_degree"] == 2
    assert g.filter_isolated_nodes().count() == 5
    assert g.to_adjacency_dict() == {1: [2], 2: [3], 4: [5]}
    assert GraphPrep(edges=edges).report()["graph_stats"]["num_nodes"] == 0


def test_components_of_ids_of_any_type(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("c",), ("10",), ("9",), (None,)], "id string")
    edges = spark.createDataFrame([("a", "x"), ("x", "b"), ("9", "9"), (None, "c")], "source string, target string")
    out = {r["id"]: r["component_id"] for r in GraphPrep(texts, edges).identify_components().collect()}
    assert out == {"10": 0, "9": 1, "a": 2, "b": 2, "c": 3, None: -1}
    numbers = spark.createDataFrame([(10, 9), (2, 2)], "source long, target int")
    out = {r["id"]: r["component_id"] for r in GraphPrep(texts, numbers).identify_components().collect()}
    assert out == {"10": 0, "9": 0, "a": 1, "b": 2, "c": 3, None: -1}
    halves = spark.createDataFrame([(1.0,), (2.0,), (2.5,)], "id double")
    out = {r["id"]: r["component_id"] for r in GraphPrep(halves, spark.createDataFrame([(1, 2)], "source long, target long")).identify_components().collect()}
    assert out == {1.0: 0, 2.0: 0, 2.5: 1}
    none = spark.createDataFrame([], "source string, target string")
    assert [r["component_id"] for r in GraphPrep(texts, none).identify_components().orderBy("id").collect()] == [-1, 0, 1, 2, 3, 4]


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")).repartition(5)
    out = GraphPrep(spark.range(n), edges).identify_components()
    assert out.select("component_id").distinct().count() == 1


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_components_of_all_orders_equal_union_find(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    orders = pd.read_parquet(f"{folder}/orders.parquet", columns=["o_orderkey", "o_custkey"])
    customers = sorted(pd.read_parquet(f"{folder}/customer.parquet", columns=["c_custkey"]).c_custkey)
    above = {}

    def root(x):
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for order, customer in zip(orders.o_orderkey, orders.o_custkey, strict=True):
        above[root(customer)] = root(order % 3000)
    numbers = {}
    want = {c: numbers.setdefault(root(c), len(numbers)) for c in customers}
    assert QUERIES["graph_edge_list"](spark, folder).count() == 2 * len(orders) + len(customers)
    assert {r["id"]: r["component_id"] for r in QUERIES["graph_components"](spark, folder).collect()} == want
