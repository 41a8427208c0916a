import json
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import assist, cli, config, keys
from millrace.operators import eda, features
from millrace.operators.features import bin_edges
from millrace.operators.forest import IsolationForest
from millrace.operators.images import PASSES, ImagePrep, decode, encode_png, resize
from millrace.plans.pipeline import Prep
from millrace.sources import charts, reports
from millrace.sources.charts import column_table
from millrace.sources.tables import read_table
from millrace.streaming import streams


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(42)
    p = pd.DataFrame({"age": rng.integers(18, 70, 100), "income": rng.normal(5e4, 1e4, 100), "loan": rng.normal(1e4, 3e3, 100), "category": rng.choice(list("ABCD"), 100), "target": rng.integers(0, 2, 100)})
    p.loc[::10, "income"] = np.nan
    return spark.createDataFrame(p.astype(object).where(p.notna(), None).to_dict("records"), "age long, income double, loan double, category string, target int"), p


def test_distributions_equal_pandas(frame):
    df, p = frame
    got = {r["column"]: r for r in eda.distributions(df).collect()}
    for c in ("age", "income", "loan"):
        assert got[c]["skewness"] == pytest.approx(p[c].skew()) and got[c]["kurtosis"] == pytest.approx(p[c].kurt())
        assert got[c]["q25"] == pytest.approx(p[c].quantile(0.25)) and got[c]["std"] == pytest.approx(p[c].std())


def test_profile(frame, spark, tmp_path):
    df, p = frame
    prof = eda.Profile(df)
    s = prof.get_summary()
    assert s["total_missing_values"] == 10 and s["dataset_shape"] == [100, 5] and s["n_categorical_columns"] == 1
    assert prof.results["correlations"]["matrix"]["age"]["loan"] == pytest.approx(p.age.corr(p.loan))
    prof.generate_report(str(tmp_path / "r.html"))
    assert "Insights" in (tmp_path / "r.html").read_text()
    assert json.loads(prof.to_json())["basic_stats"]["n_rows"] == 100
    assert eda.duplicate_rows(spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2), (2, 2), (3, 3)], "a int, b int")) == 3
    constant = spark.createDataFrame([(1.0, float(i)) for i in range(20)], "c double, v double")
    assert eda.Profile(constant).analyze()["correlations"]["matrix"]["c"]["v"] is None
    with pytest.raises(ValueError):
        eda.Profile(df.limit(0))


def test_feature_names_and_values(frame):
    df, p = frame
    e = features.FeatureEngine(df, "target")
    out = e.create_polynomial_features(["age", "loan"])
    assert out.columns[-3:] == ["age^2", "age loan", "loan^2"]
    e.create_ratio_features(["age", "loan"])
    assert e.df.columns[-2:] == ["age_div_loan", "loan_div_age"]
    assert e.reset().columns == df.columns
    zero = df.withColumn("z", F.lit(0))
    assert [c for c in features.FeatureEngine(zero).create_ratio_features(["age", "z"]).columns if "_div_" in c] == ["z_div_age"]
    row = features.FeatureEngine(df.where("income IS NULL")).create_aggregation_features(["income"], ["sum", "mean", "std"]).first()
    assert row["agg_sum"] == 0 and row["agg_mean"] is None and row["agg_std"] is None


def test_bins_equal_pandas(frame):
    df, p = frame
    got = features.FeatureEngine(df).create_binned_features(["loan"], 4, "quantile").select("loan", "loan_binned").toPandas()
    want = np.searchsorted(np.quantile(p.loan, [0.25, 0.5, 0.75]), got.loan, side="right")
    assert (got.loan_binned == want).all()
    k = features.FeatureEngine(df).create_binned_features(["loan"], 3, "kmeans").select("loan_binned").distinct().count()
    assert k == 3


def test_selection(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    df = spark.createDataFrame(pd.DataFrame({"good": y + rng.normal(0, 0.1, 400), "bad": rng.normal(0, 1, 400), "y": y}))
    for method in ("f_test", "mutual_info"):
        assert features.FeatureEngine(df, "y").select_features(method, 1).columns == ["good", "y"]
    mi = features.FeatureEngine(df, "y").get_feature_importance()
    assert list(mi)[0] == "good" and mi["good"] == pytest.approx(math.log(2), abs=0.1)
    assert len(features.auto_features(df, "y", 5).columns) <= 7


def test_charts_and_reports(frame, tmp_path):
    df, _ = frame
    assert set(charts.all_charts(df)) == {"missing", "outliers", "distributions", "correlation"}
    assert charts.histogram(df, "loan").agg(F.sum("n")).first()[0] == 100
    d = charts.Dashboard(df)
    assert "<svg" in d.create_dashboard(path=str(tmp_path / "d.html"))
    assert "<svg" in d.create_missing_data_plot() and "<svg" in d.create_correlation_heatmap()
    compile(open(d.generate_app(str(tmp_path / "app.py"))).read(), "app", "exec")
    prep = Prep(df, {"detection": {"outlier_method": "zscore"}})
    prep.detect("target")
    prep.save_report(str(tmp_path / "a.html"))
    prep.save_report(str(tmp_path / "a.json"))
    assert "base64" in (tmp_path / "a.html").read_text()
    assert json.loads((tmp_path / "a.json").read_text())["plots"]["missing"] == "<chart>"
    with pytest.raises(ValueError):
        reports.save_report({}, "x.txt")


def test_config(tmp_path):
    before = config.default_config()
    (tmp_path / "c.yaml").write_text("cleaning:\n  scale_method: minmax\n")
    got = config.load_config(str(tmp_path / "c.yaml"))
    assert got["cleaning"]["scale_method"] == "minmax" and got["cleaning"]["encode_method"] == "label"
    assert config.default_config() == before
    config.save_config(got, str(tmp_path / "c.json"))
    assert config.load_config(str(tmp_path / "c.json")) == got


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,x\n,y\n3,x\n5,x\n")
    assert cli.main(["-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "out.csv"), "-r", str(tmp_path / "r.json"), "--no-plots"]) == 0
    assert read_table(spark, str(tmp_path / "out.csv")).count() == 4
    assert cli.main(["-i", str(tmp_path / "in.txt"), "-o", str(tmp_path / "out.csv")]) == 1


def test_keys(tmp_path, monkeypatch):
    monkeypatch.setenv("MILLRACE_HOME", str(tmp_path))
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    keys.set_api_key("openai", "abcd1234567890wxyz")
    assert keys.get_api_key("openai") == "abcd1234567890wxyz"
    monkeypatch.setenv("OPENAI_API_KEY", "from-environment")
    assert keys.get_api_key("openai") == "from-environment"
    assert "1234567890" not in json.dumps(keys.list_api_keys())
    assert keys.main(["--remove", "openai"]) == 0 and keys.main(["--set", "nobody"]) == 1


def test_advice(frame):
    df, _ = frame
    a = assist.Advisor(lambda prompt: '```json\n["one", "two"]\n```')
    assert a.suggest_features(df) == ["one", "two"]
    assert "raw_response" in a.analyze_dataframe(df)
    assert assist.Advisor(lambda p: "income_usd\nbecause").suggest_column_rename(df, "income") == "income_usd"
    assert assist.Advisor(lambda p: 1 / 0).suggest_fix(df, "income").startswith("Error")
    assert Prep(df).get_suggestions() == "No advisor is set."


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    for i, (h, w, c) in enumerate([(100, 100, 3), (50, 60, 3), (70, 70, 1), (100, 100, 3)]):
        pixels = np.full((h, w, c), 77, np.uint8) if i in (0, 3) else rng.integers(0, 256, (h, w, c)).astype(np.uint8)
        (tmp_path / f"i{i}.png").write_bytes(encode_png(pixels))
        assert (decode(encode_png(pixels)) == pixels).all()
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    prep = ImagePrep(spark, str(tmp_path), target_size=(100, 100))
    found = prep.detect()
    assert (found["total_images"], found["corrupted"], found["size_mismatch"], found["color_mode_issues"], found["duplicates"]) == (5, 1, 2, 1, 1)
    images = prep.clean()
    array = prep.to_array(images)
    assert array.shape == (4, 100, 100, 3) and 0 <= array.min() and array.max() <= 1
    saved = prep.save_processed(images, str(tmp_path / "out"))
    assert decode(saved.where("name = 'processed_i0.png'").first()["content"])[0, 0].tolist() == [77, 77, 77]
    assert prep.get_statistics()["unique_sizes"] == 3
    flat = np.full((31, 17, 3), 9, np.uint8)
    assert (resize(flat, 8, 40) == 9).all()


def test_images_of_other_formats(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(40, 30, 1)
    for x in range(40):
        for y in range(30):
            picture.setRGB(x, y, 200 << 16 | 100 << 8 | 50)
    for kind in ("jpg", "gif", "bmp"):
        assert jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(str(tmp_path / f"p.{kind}")))
    (tmp_path / "q.png").write_bytes(encode_png(np.full((30, 40, 3), 9, np.uint8)))
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8nothing")
    prep = ImagePrep(spark, str(tmp_path), target_size=(30, 40), normalize=False)
    found = prep.detect()
    assert (found["total_images"], found["corrupted"], found["unsupported"], found["size_mismatch"]) == (5, 1, 0, 0)
    images = {r["path"].rsplit("/", 1)[-1]: np.frombuffer(r["pixels"], np.uint8).reshape(30, 40, 3) for r in prep.clean().collect()}
    assert set(images) == {"p.jpg", "p.gif", "p.bmp", "q.png"}
    assert all(np.abs(images[f"p.{k}"].astype(int) - [200, 100, 50]).max() <= 6 for k in ("jpg", "gif", "bmp"))
    assert prep.save_files(prep.clean(), str(tmp_path / "out")) == 4
    assert (decode((tmp_path / "out" / "processed_q.png").read_bytes()) == 9).all()
    (tmp_path / "w.webp").write_bytes(b"RIFF\x00\x00\x00\x00WEBPVP8 nothing")
    odd = ImagePrep(spark, str(tmp_path), target_size=(30, 40))
    assert odd.detect()["unsupported"] == 1
    with pytest.raises(Exception, match="No decoder"):
        odd.clean().count()


@pytest.mark.parametrize(("depth", "kind"), [(1, 0), (2, 0), (4, 0), (8, 2), (16, 2), (16, 6)])
def test_png_of_all_depths_and_interlaced(depth, kind):
    rng = np.random.default_rng(depth)
    h, w, c = 13, 11, {0: 1, 2: 3, 6: 4}[kind]
    values = rng.integers(0, 1 << depth, (h, w, c))
    want = (values * (255 // ((1 << depth) - 1)) if depth < 8 else values >> (depth - 8)).astype(np.uint8)

    def packed(part):
        bits = ((part.reshape(len(part), -1)[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1).astype(np.uint8)
        return b"".join(b"\0" + np.packbits(line.ravel()).tobytes() for line in bits)

    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    for interlaced in (0, 1):
        parts = [values[y::dy, x::dx] for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),))]
        body = b"".join(packed(p) for p in parts if p.size)
        head = struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlaced)
        assert (decode(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")) == want).all()


def test_key_wizard_and_default_models(monkeypatch, tmp_path, capsys):
    monkeypatch.setenv("MILLRACE_HOME", str(tmp_path))
    for name in keys.PROVIDERS.values():
        monkeypatch.delenv(name, raising=False) if name else None
    said = iter(["1", "nobody", "ollama", "google", ""])
    assert keys.wizard(lambda _: next(said), lambda _: "secret-key-0123456789") == 2
    assert keys.get_api_key("openai") == keys.get_api_key("google") == "secret-key-0123456789"
    assert "Unknown provider: nobody" in capsys.readouterr().out
    assert all(assist.Advisor(provider=p).model_name for p in keys.PROVIDERS)


def test_column_table(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, None, 1.0), (2, "a", None)], "i int, s string, x double")
    assert {tuple(r) for r in column_table(df).collect()} == {("i", "int", 3, 0, 2), ("s", "string", 2, 1, 1), ("x", "double", 1, 2, 1)}


def test_whole_trees_equal_plain_descent():
    rng = np.random.default_rng(4)
    forest = IsolationForest(["a", "b"], trees=9, rows=64)
    x = rng.normal(size=(300, 2))
    forest.sampled = 64
    forest.nodes = [forest._grow(x[rng.choice(300, 64, replace=False)], rng) for _ in range(9)]

    def depth(row):
        total = 0.0
        for feature, cut, low, high, worth in forest.nodes:
            at = 0
            while feature[at] >= 0:
                at = low[at] if row[feature[at]] <= cut[at] else high[at]
            total += worth[at]
        return total / 9

    np.testing.assert_allclose(forest.depths(x), [depth(r) for r in x])


def test_kmeans_bins_equal_plain_lloyd(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 0.5, 80) for m in (0, 5, 9)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = bin_edges(df, ["x"], 3, "kmeans")["x"]
    edges = np.linspace(x.min(), x.max(), 4)
    centres = (edges[1:] + edges[:-1]) / 2
    for _ in range(100):
        nearest = np.abs(x[:, None] - centres).argmin(axis=1)
        centres = np.sort([x[nearest == k].mean() for k in range(3)])
    np.testing.assert_allclose(got, [x.min(), *(centres[1:] + centres[:-1]) / 2, x.max()], rtol=1e-6)


def test_streams(spark, tmp_path):
    schema = "ts timestamp, k int, value double"
    rows = spark.range(48).selectExpr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT), 0, 0) AS ts", "CAST(id % 3 AS INT) AS k", "CAST(id AS DOUBLE) AS value")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.write(streams.resample(source, "ts", "value", "1 day", delay="1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r["ts"].day: r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: float(sum(range(24)))}  # the second day is still open
    q = streams.drop_duplicates(source, ["k"], "ts", "100 days").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 3
