"""Charts as SVG text from aggregates: counts, quartiles, histograms, correlations."""

from __future__ import annotations

import base64
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.eda import correlations, top_values
from millrace.plans.stats import fuse, null_count, quantiles
from millrace.schema import categorical_columns, number, numeric_columns, row_hash, value

BAR = "#3b6ea5"


def _page(width: int, height: int, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11">' + "".join(parts) + "</svg>"


def _text(x: float, y: float, said: object, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escape(str(said))}</text>'


def note(said: str) -> str:
    return _page(400, 60, [_text(200, 35, said, "middle")])


def bars(title: str, rows: list[tuple[str, float]], unit: str = "") -> str:
    most = max((v for _, v in rows), default=0) or 1
    parts = [_text(10, 18, title)]
    for i, (name, v) in enumerate(rows):
        y = 30 + 20 * i
        parts += [_text(140, y + 12, name, "end"), f'<rect x="150" y="{y}" width="{300 * v / most:.1f}" height="15" fill="{BAR}"><title>{escape(str(name))}: {v:g}{unit}</title></rect>', _text(155 + 300 * v / most, y + 12, f"{v:g}{unit}")]
    return _page(560, 45 + 20 * len(rows), parts)


def five_numbers(df: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Minimum, quartiles and maximum of each column."""
    found = quantiles(df, {c: number(df, c) for c in columns}, [0.0, 0.25, 0.5, 0.75, 1.0])
    return {c: v for c, v in found.items() if v}


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, n) of equal-width bins; empty bins are absent."""
    x = number(df, column)
    s = fuse(df, {"a": F.min(x), "b": F.max(x)})
    low = s["a"] if s["a"] is not None else 0.0
    width = ((s["b"] or 0.0) - low) / bins or 1.0
    code = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(code.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


def missing_chart(df: DataFrame) -> str:
    found = {c: n for c, n in fuse(df, {c: null_count(df, c) for c in df.columns}).items() if n}
    return bars("Missing values", sorted(found.items(), key=lambda x: (-x[1], x[0]))) if found else note("No missing values")


def outlier_chart(df: DataFrame, columns: list[str] | None = None, most: int = 5) -> str:
    names = (columns or numeric_columns(df))[:most]
    found = five_numbers(df, names)
    if not found:
        return note("No numeric columns")
    parts = [_text(10, 18, "Quartiles and range")]
    for i, (c, (a, q1, m, q3, b)) in enumerate(found.items()):
        y, scale = 35 + 34 * i, 300 / ((b - a) or 1)
        at = [150 + (v - a) * scale for v in (a, q1, m, q3, b)]
        parts += [_text(140, y + 14, c, "end"), f'<line x1="{at[0]:.1f}" x2="{at[4]:.1f}" y1="{y + 10}" y2="{y + 10}" stroke="#555"/>', f'<rect x="{at[1]:.1f}" y="{y}" width="{max(1, at[3] - at[1]):.1f}" height="20" fill="{BAR}" fill-opacity="0.6"/>', f'<line x1="{at[2]:.1f}" x2="{at[2]:.1f}" y1="{y}" y2="{y + 20}" stroke="#000"/>', _text(460, y + 14, f"{a:.4g} … {b:.4g}")]
    return _page(600, 50 + 34 * len(found), parts)


def distribution_chart(df: DataFrame, columns: list[str] | None = None, bins: int = 30) -> str:
    names = columns or numeric_columns(df)
    if not names:
        return note("No numeric columns")
    parts = []
    for k, c in enumerate(names):
        x0, y0 = 20 + 240 * (k % 3), 30 + 150 * (k // 3)
        rows = histogram(df, c, bins).collect()
        most = max((r["n"] for r in rows), default=1)
        parts.append(_text(x0, y0 - 8, c))
        parts += [f'<rect x="{x0 + 7 * r["bin"]}" y="{y0 + 110 - 110 * r["n"] / most:.1f}" width="6" height="{110 * r["n"] / most:.1f}" fill="{BAR}"><title>{r["low"]:.6g} to {r["high"]:.6g}: {r["n"]}</title></rect>' for r in rows]
    return _page(740, 40 + 150 * (-(-len(names) // 3)), parts)


def correlation_chart(df: DataFrame, columns: list[str] | None = None) -> str:
    names = columns or numeric_columns(df)
    if len(names) < 2:
        return note("At least two numeric columns are needed")
    r = {(x["a"], x["b"]): x["r"] for x in correlations(df, names).collect()}
    parts = []
    for i, a in enumerate(names):
        parts += [_text(140, 50 + 30 * i, a, "end"), _text(165 + 40 * i, 20, a[:6], "middle")]
        for j, b in enumerate(names):
            v = 1.0 if a == b else r.get((a, b), r.get((b, a)))
            shade = "#eee" if v is None else f"rgb({int(255 - 190 * max(0, v))},{int(255 - 120 * abs(v))},{int(255 - 190 * max(0, -v))})"
            parts += [f'<rect x="{145 + 40 * j}" y="{30 + 30 * i}" width="38" height="28" fill="{shade}"/>', _text(164 + 40 * j, 48 + 30 * i, "" if v is None else f"{v:.2f}", "middle")]
    return _page(180 + 40 * len(names), 60 + 30 * len(names), parts)


def as_data(svg: str) -> str:
    return base64.b64encode(svg.encode()).decode()


def all_charts(df: DataFrame) -> dict[str, str]:
    """The four charts of a report, base64-encoded."""
    made = {"missing": missing_chart, "outliers": outlier_chart, "distributions": distribution_chart, "correlation": correlation_chart}
    return {name: as_data(f(df)) for name, f in made.items()}


def column_table(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, missing, unique) of every column."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(df, c).cast("string").alias("v")) for i, c in enumerate(df.columns)])).alias("s")
    counts = df.select(cells).groupBy("s.i", "s.v").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("unique"))
    names = df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "i int, column string, dtype string")
    return names.join(counts, "i", "left").select("column", "dtype", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("non_null", "missing", "unique")])


def scatter_chart(df: DataFrame, a: str, b: str, points: int = 1000) -> str:
    """At most `points` rows, chosen by a hash of their content."""
    rows = df.select(number(df, a).alias("a"), number(df, b).alias("b"), row_hash(df, 1).alias("h")).where("a IS NOT NULL AND b IS NOT NULL").orderBy("h").limit(points).collect()
    if not rows:
        return note("No values")
    xs, ys = [r["a"] for r in rows], [r["b"] for r in rows]
    sx, sy = 300 / ((max(xs) - min(xs)) or 1), 200 / ((max(ys) - min(ys)) or 1)
    return _page(360, 260, [_text(20, 15, f"{b} over {a}"), *[f'<circle cx="{30 + (x - min(xs)) * sx:.1f}" cy="{235 - (y - min(ys)) * sy:.1f}" r="2" fill="{BAR}"><title>{x:.6g}, {y:.6g}</title></circle>' for x, y in zip(xs, ys, strict=True)]])


# what a mark stands for shows when it is pointed at; charts are zoomed with the wheel and dragged
_HANDLING = """<script>
for (const svg of document.querySelectorAll('svg')) {
  const w = +svg.getAttribute('width'), h = +svg.getAttribute('height'), box = [0, 0, w, h];
  const show = () => svg.setAttribute('viewBox', box.join(' '));
  svg.addEventListener('wheel', e => {
    e.preventDefault();
    const r = svg.getBoundingClientRect(), f = e.deltaY > 0 ? 1.2 : 1 / 1.2;
    const x = box[0] + (e.clientX - r.left) / r.width * box[2], y = box[1] + (e.clientY - r.top) / r.height * box[3];
    box[0] = x - (x - box[0]) * f; box[1] = y - (y - box[1]) * f; box[2] *= f; box[3] *= f; show();
  });
  svg.addEventListener('mousemove', e => {
    if (e.buttons) { box[0] -= e.movementX * box[2] / w; box[1] -= e.movementY * box[3] / h; show(); }
  });
  svg.addEventListener('dblclick', () => { box.splice(0, 4, 0, 0, w, h); show(); });
}
</script>"""


class Dashboard:
    """Pages of charts that are zoomed, dragged and pointed at; without other files."""

    def __init__(self, df: DataFrame) -> None:
        if not isinstance(df, DataFrame):
            raise TypeError("df must be a Spark DataFrame")
        if df.isEmpty():
            raise ValueError("DataFrame is empty")
        self.df = df

    @staticmethod
    def _finish(title: str, charts: list[str], path: str | None) -> str:
        page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>" + "".join(f"<div>{c}</div>" for c in charts) + _HANDLING + "</body></html>"
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(page)
        return page

    def create_dashboard(self, title: str = "Dashboard", path: str | None = None) -> str:
        numeric, labels = numeric_columns(self.df), categorical_columns(self.df)
        charts = [distribution_chart(self.df, numeric[:1])] if numeric else [note("No numeric columns")]
        if len(numeric) > 1:
            charts += [outlier_chart(self.df, numeric[1:2]), scatter_chart(self.df, numeric[0], numeric[1])]
        if labels:
            rows = top_values(self.df, labels[:1]).orderBy("rank").collect()
            charts.append(bars(f"Most frequent values of {labels[0]}", [(r["value"], r["n"]) for r in rows]))
        return self._finish(title, charts, path)

    def create_correlation_heatmap(self, path: str | None = None) -> str:
        if len(numeric_columns(self.df)) < 2:
            raise ValueError("At least two numeric columns are needed")
        return self._finish("Correlations", [correlation_chart(self.df)], path)

    def create_missing_data_plot(self, path: str | None = None) -> str:
        rows = fuse(self.df, {"": F.count(F.lit(1))} | {c: null_count(self.df, c) for c in self.df.columns})
        total = rows.pop("")
        found = sorted(((c, round(n * 100 / total, 2)) for c, n in rows.items() if n), key=lambda x: (x[1], x[0]))
        return self._finish("Missing data", [bars("Missing values", found, " %") if found else note("No missing values")], path)

    create_missing_plot = create_missing_data_plot

    def generate_app(self, path: str) -> str:
        return generate_app(path)


APP = '''"""Profile and clean a table in a browser: streamlit run this file."""

import streamlit as st
from pyspark.sql import SparkSession

from millrace.operators.balance import balance_classes
from millrace.operators.clean import drop_missing, encode_categorical, impute_missing, scale_features
from millrace.operators.detect import flag_outliers, missing_table, remove_outliers
from millrace.operators.eda import Profile
from millrace.sources.charts import column_table
from millrace.sources.tables import read_table, write_table

spark = SparkSession.builder.getOrCreate()
path = st.text_input("Path of a table (csv, parquet, json, orc)")
if path:
    df = read_table(spark, path)
    st.dataframe(df.limit(100).toPandas())
    st.dataframe(column_table(df).toPandas())
    st.json(Profile(df).get_summary())
    st.dataframe(missing_table(df).toPandas())
    if st.checkbox("Drop rows with missing values"):
        df = drop_missing(df)
    if st.checkbox("Impute"):
        df = impute_missing(df)
    if st.checkbox("Drop repeated rows"):
        df = df.dropDuplicates()
    if st.checkbox("Remove outliers"):
        df = remove_outliers(flag_outliers(df))
    if st.checkbox("Encode"):
        df = encode_categorical(df)
    if st.checkbox("Scale"):
        df = scale_features(df)
    target = st.text_input("Folder for the result (csv)")
    if target:
        write_table(df, target)
    if st.checkbox("Download the first 100,000 rows"):
        st.download_button("Download", df.limit(100_000).toPandas().to_csv(index=False), "cleaned.csv")
'''


def generate_app(path: str) -> str:
    """Write the source of a small browser app over this package."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(APP)
    return path
