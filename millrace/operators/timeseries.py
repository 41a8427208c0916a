"""Time series: a frame with a timestamp column, perhaps a value column, perhaps many series.

Order is by timestamp and then the order columns (without any, a hash of the
row). If no series is longer than a stretch, every series is a window of its own.
Else all rows are numbered by a range sort, series by series, and cut into
stretches; functions that look back see their stretch and a halo of the rows
before it, as far as they look, so that no task ever holds a whole series. Both
plans give the same rows. Numbering runs jobs and writes an intermediate table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.frequency import Frequency
from millrace.operators.detect import iqr_flag, zscore_flag
from millrace.operators.text import drop_duplicates
from millrace.plans.scratch import Scratch
from millrace.plans.stats import fuse, quantiles
from millrace.schema import numeric_columns, q, require, row_hash, value

#: Rows of a stretch of a series that is cut up; more where functions look back further.
STRETCH = 100_000
#: Steps of a calendar that one row expands to.
CALENDAR_STEPS = 100_000
_TIME_PARTS = {"year": F.year, "month": F.month, "day": F.day, "dayofweek": F.weekday, "hour": F.hour, "quarter": F.quarter}


def time_parts(ts: Column, parts: Iterable[str]) -> dict[str, Column]:
    """Calendar parts; Monday is day 0 of the week."""
    out = {}
    for p in parts:
        if p == "is_weekend":
            out[p] = F.weekday(ts) >= 5
        elif p in _TIME_PARTS:
            out[p] = _TIME_PARTS[p](ts)
        else:
            raise ValueError(f"Unknown time feature: {p}")
    return out


def numbered(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "__row") -> DataFrame:
    """df with consecutive row numbers in the given order; a range sort and the sizes of its parts, no global window."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    saved = scratch.save(parts.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftrightunsigned("__m", 33)))
    sizes = sorted((r["__p"], r["n"]) for r in saved.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for p, n in sizes:
        before[p] = total
        total += n
    starts = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    return saved.withColumn(name, starts[F.col("__p")] + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p")


class SeriesPrep:
    def __init__(self, df: DataFrame, timestamp_column: str, value_column: str | None = None, partition_cols: list[str] | None = None, order: list[str] | None = None) -> None:
        require(df, timestamp_column, *([value_column] if value_column else []), *(partition_cols or []))
        self.ts, self.value, self.parts, self.order = timestamp_column, value_column, partition_cols or [], order or []
        if isinstance(df.schema[timestamp_column].dataType, T.StringType):
            parsed = df.withColumn(timestamp_column, F.try_to_timestamp(q(timestamp_column)).cast("timestamp_ntz"))
            if not df.where(F.try_to_timestamp(q(timestamp_column)).isNull() & q(timestamp_column).isNotNull()).isEmpty():
                raise ValueError(f"Could not convert column '{timestamp_column}' to datetime")
            df = parsed
        elif isinstance(df.schema[timestamp_column].dataType, (T.DateType, T.TimestampType)):
            df = df.withColumn(timestamp_column, q(timestamp_column).cast("timestamp_ntz"))
        self.original = self.df = df
        self.log: list[dict] = []
        self.scratch = Scratch(df.sparkSession, "series")

    def _set(self, df: DataFrame, action: str, **details) -> DataFrame:
        self.df = df
        self.log.append({"action": action} | details)
        return df

    def _need_value(self) -> str:
        if not self.value:
            raise ValueError("value_column must be specified")
        return self.value

    def _keys(self) -> list[Column]:
        return [q(self.ts), *([q(c) for c in self.order] or [row_hash(self.df, 0)])]

    def _short(self) -> bool:
        """Whether every series fits a stretch, so that plain windows do."""
        if not self.parts:
            return False
        sizes = self.df.groupBy(*[q(c) for c in self.parts]).agg(F.count(F.lit(1)).alias("n"))
        return (fuse(sizes, {"n": F.max("n")})["n"] or 0) <= STRETCH

    def _stretches(self, size: int) -> DataFrame:
        """The rows with their number __row, series by series, and their stretch __s."""
        return numbered(self.df, [*[q(c) for c in self.parts], *self._keys()], self.scratch).withColumn("__s", F.floor(F.col("__row") / size))

    def _look_back(self, made: dict[str, tuple], reach: int) -> DataFrame:
        """Add columns made from a window of at most reach rows back. made: name -> function of a window."""
        names, series = self.df.columns, [q(c) for c in self.parts]
        if self._short():
            w = Window.partitionBy(*series).orderBy(*self._keys())
            return self.df.withColumns({n: f(w) for n, f in made.items()})
        size = max(STRETCH, reach)
        # the last rows of a stretch also stand before the next one; none is needed further on
        late = F.col("__row") % size >= size - reach
        dealt = self._stretches(size).withColumn("__to", F.explode(F.when(late, F.array(F.col("__s"), F.col("__s") + 1)).otherwise(F.array(F.col("__s")))))
        w = Window.partitionBy("__to", *series).orderBy("__row")
        out = dealt.withColumns({n: f(w) for n, f in made.items()}).where("__to = __s")
        return out.select(*[q(n) for n in names if n not in made], *[q(n) for n in made])

    def _neighbours(self, x: Column) -> tuple[DataFrame, Column, Column, Column, Column, Column]:
        """Rows with the previous and next non-null value and where they stand: frame, row, prev, prev row, next, next row.

        The next value is the last one of the reverse order, so both are running values.
        """
        mark = F.when(x.isNotNull(), F.struct(F.col("__row").alias("at"), q(self.ts).alias("ts"), x.alias("v")))
        series = [q(c) for c in self.parts]
        last = lambda c, w, until: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, until))
        both = lambda c, w, at, until: (last(c, w.orderBy(F.col(at)), until), last(c, w.orderBy(F.desc(at)), until))
        if self._short():
            group = Window.partitionBy(*series)
            prev, after = both(mark, group, "__row", 0)
            rows = self.df.withColumn("__row", F.row_number().over(group.orderBy(*self._keys())).cast("long"))
            found = rows.withColumns({"__prev": prev, "__next": after})
        else:
            rows = self._stretches(STRETCH)
            # a row for each stretch and series carries its first and last value to its neighbours
            known = F.when(mark.isNotNull(), F.col("__row"))
            keys = [f"__k{i}" for i in range(len(series))]
            edges = rows.groupBy(F.col("__s").alias("__e"), *[c.alias(k) for c, k in zip(series, keys, strict=True)]).agg(F.min_by(mark, known).alias("lo"), F.max_by(mark, known).alias("hi"))
            over = Window.partitionBy(*keys)
            carried = edges.select("__e", *keys, both(F.col("hi"), over, "__e", -1)[0].alias("before"), both(F.col("lo"), over, "__e", -1)[1].alias("after"))
            prev, after = both(mark, Window.partitionBy("__s", *series), "__row", 0)
            inner = rows.withColumns({"__prev": prev, "__next": after})
            same = F.col("__s") == F.col("__e")
            for c, k in zip(series, keys, strict=True):
                same = same & c.eqNullSafe(F.col(k))
            found = inner.join(carried, same, "left").withColumns({"__prev": F.coalesce("__prev", "before"), "__next": F.coalesce("__next", "after")})
        p, n = F.col("__prev"), F.col("__next")
        return found, F.col("__row"), p["v"], p["at"], n["v"], n["at"]

    def is_chronological(self) -> bool:
        """Whether timestamps never fall in the order of the order columns, or without any in the order in which the rows are stored; not if any is missing."""
        own = SeriesPrep(self.df.select(F.struct(*[q(c) for c in self.order]).alias("__at") if self.order else F.monotonically_increasing_id().alias("__at"), q(self.ts).alias("__ts")), "__ts")
        own._keys = lambda: [F.col("__at"), F.col("__ts")]
        falls = own._look_back({"__falls": lambda w: F.col("__ts").isNull() | (F.lag("__ts").over(w) > F.col("__ts"))}, 1)
        return falls.where("__falls").isEmpty()

    def detect_issues(self) -> dict:
        ts, x = q(self.ts), value(self.df, self.value) if self.value else None
        wanted = {
            "total_records": F.count(F.lit(1)),
            "missing_timestamps": F.count_if(ts.isNull()),
            "distinct": F.countDistinct(ts),
            "start": F.min(ts),
            "end": F.max(ts),
        }
        if self.value:
            wanted |= {"missing_values": F.count_if(x.isNull()), "zero_values": F.count_if(x == 0), "negative_values": F.count_if(x < 0)}
        found = fuse(self.df, wanted)
        found["duplicate_timestamps"] = found["total_records"] - found.pop("distinct") - (1 if found["missing_timestamps"] else 0)
        found["gaps"] = self.gaps().count()
        found["is_chronological"] = self.is_chronological()
        return found

    def gaps(self, factor: float = 2.0) -> DataFrame:
        """(timestamp, seconds): steps longer than factor times the median step."""
        old = self.df
        self.df = self.df.where(q(self.ts).isNotNull())
        stepped = self._look_back({"__step": lambda w: F.timestamp_diff("MICROSECOND", F.lag(q(self.ts)).over(w), q(self.ts)) / 1e6}, 1)
        self.df = old
        stepped = stepped.select(q(self.ts).alias("timestamp"), F.col("__step").alias("seconds")).where("seconds IS NOT NULL")
        stepped = self.scratch.save(stepped)
        middle = quantiles(stepped, {"m": F.col("seconds")}, [0.5])["m"]
        return stepped.where(F.col("seconds") > F.lit(middle[0] if middle else 0.0) * factor)

    def _calendar(self, ends: DataFrame, f: Frequency, low: str, high: str, name: str) -> DataFrame:
        """The calendar of each row of ends, whose other columns stay; long ones are expanded in parallel."""
        kept = [q(c) for c in ends.columns if c not in (low, high)]
        if not f.seconds:
            return ends.select(*kept, F.explode(f.months_between(F.col(low), F.col(high))).alias(name))
        steps = F.floor(F.timestamp_diff("SECOND", F.col(low), F.col(high)) / f.seconds)
        blocks = ends.select(*kept, F.col(low).alias("__from"), steps.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), steps, F.lit(CALENDAR_STEPS).cast("long"))).alias("__b"))
        blocks = blocks.repartition(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__b")
        step = F.explode(F.sequence(F.col("__b"), F.least(F.col("__b") + (CALENDAR_STEPS - 1), F.col("__n"))))
        return blocks.select(*kept, "__from", step.alias("__i")).select(*kept, F.timestamp_add("SECOND", F.col("__i") * f.seconds, F.col("__from")).alias(name))

    def sort_by_time(self) -> DataFrame:
        return self._set(self.df.orderBy(*self._keys()), "sort_by_time")

    def remove_duplicate_timestamps(self, keep: str | bool = "first", aggregate: str | None = None) -> DataFrame:
        keys = [*self.parts, self.ts]
        if aggregate and self.value:
            if aggregate not in ("mean", "sum", "min", "max"):
                raise ValueError(f"Unknown aggregate: {aggregate}")
            f = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[aggregate]
            rank = F.struct(*[q(c) for c in self.order]) if self.order else F.lit(0)
            cells = [f(value(self.df, c)).alias(c) if c == self.value else F.min_by(q(c), F.when(q(c).isNotNull(), rank)).alias(c) for c in self.df.columns if c not in keys]
            out = self.df.where(q(self.ts).isNotNull()).groupBy(*[q(k) for k in keys]).agg(*cells).select(*[q(c) for c in self.df.columns])
        else:
            out = drop_duplicates(self.df, keys, keep, self.order or None)
        return self._set(out, "remove_duplicate_timestamps", keep=keep, aggregate=aggregate)

    def fill_missing_timestamps(self, freq: str = "D") -> DataFrame:
        """All timestamps of the calendar from the first to the last; rows off the calendar go, new rows are null."""
        f = Frequency(freq)
        ends = self.df.groupBy(*[q(c) for c in self.parts]).agg(F.min(q(self.ts)).alias("__a"), F.max(q(self.ts)).alias("__b"))
        low = F.next_day(F.date_sub("__a", 1), "SUN").cast("timestamp_ntz") if f.unit == "W" else F.col("__a")
        spine = self._calendar(ends.where("__a IS NOT NULL").withColumn("__a", low), f, "__a", "__b", self.ts)
        out = spine.join(self.df, [*self.parts, self.ts], "left").select(*[q(c) for c in self.df.columns])
        return self._set(out, "fill_missing_timestamps", freq=freq)

    def interpolate_missing(self, method: str = "linear") -> DataFrame:
        """linear (by position), time, ffill or bfill; leading nulls stay in all but bfill, trailing ones take the last value."""
        if method not in ("linear", "time", "ffill", "bfill"):
            raise ValueError(f"Unknown interpolation method: {method}")
        name = self._need_value()
        names = self.df.columns
        x = value(self.df, name)
        rows, at, prev, prev_at, after, after_at = self._neighbours(x)
        if method in ("ffill", "bfill"):
            filled = F.coalesce(x, prev if method == "ffill" else after)
        else:
            if method == "time":
                micros = lambda t: F.unix_micros(t.cast("timestamp")).cast("double")
                share = (micros(q(self.ts)) - micros(F.col("__prev")["ts"])) / F.nullif(micros(F.col("__next")["ts"]) - micros(F.col("__prev")["ts"]), F.lit(0.0))
            else:
                share = (at - prev_at) / F.nullif((after_at - prev_at).cast("double"), F.lit(0.0))
            filled = F.coalesce(x.cast("double"), prev.cast("double") + (after.cast("double") - prev.cast("double")) * share, prev.cast("double"))
        out = rows.select(*[filled.alias(c) if c == name else q(c) for c in names])
        return self._set(out, "interpolate_missing", method=method)

    def detect_outliers(self, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
        name = self._need_value()
        if method not in ("zscore", "iqr"):
            raise ValueError(f"Unknown outlier method: {method}")
        flag = zscore_flag(self.df, [name], threshold) if method == "zscore" else iqr_flag(self.df, [name], threshold)
        return self._set(self.df.withColumn(f"{name}_is_outlier", flag), "detect_outliers", method=method)

    def add_time_features(self) -> DataFrame:
        made = time_parts(q(self.ts), ("year", "month", "day", "dayofweek", "hour", "quarter", "is_weekend"))
        return self._set(self.df.withColumns({f"{self.ts}_{k}": v for k, v in made.items()}), "add_time_features")

    def add_lag_features(self, lags: Iterable[int] = (1, 7, 30)) -> DataFrame:
        name, lags = self._need_value(), list(lags)
        made = {f"{name}_lag_{k}": (lambda w, k=k: F.lag(q(name), k).over(w)) for k in lags}
        return self._set(self._look_back(made, max(lags, default=0)), "add_lag_features", lags=lags)

    def add_rolling_features(self, windows: Iterable[int] = (7, 30), functions: Iterable[str] = ("mean",)) -> DataFrame:
        """Rolling statistics, null until a window holds as many non-null values as rows."""
        name, windows = self._need_value(), list(windows)
        known = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
        x = value(self.df, name)

        def rolled(f, size: int):
            def over(w):
                frame = w.rowsBetween(-(size - 1), 0)
                return F.when(F.count(x).over(frame) == size, f(x).over(frame))

            return over

        made = {f"{name}_rolling_{f}_{k}": rolled(known[f], k) for k in windows for f in functions if f in known}
        return self._set(self._look_back(made, max(windows, default=1) - 1), "add_rolling_features", windows=windows)

    def resample(self, freq: str, agg_func: str = "sum") -> DataFrame:
        """All buckets from the first to the last, empty ones too (sum 0, count 0, else null)."""
        known = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
        if agg_func not in known:
            raise ValueError(f"Unknown aggregate: {agg_func}")
        f = Frequency(freq)
        columns = [c for c in (numeric_columns(self.df, self.parts) if agg_func in ("sum", "mean") else [c for c in self.df.columns if c not in self.parts]) if c != self.ts]
        rows = self.df.where(q(self.ts).isNotNull())
        keys = [q(c) for c in self.parts]
        if f.seconds and f.unit != "W":
            if self.parts:
                first = rows.groupBy(*keys).agg(F.min(q(self.ts)).alias("__first"))
                rows, origin = rows.join(first, self.parts), F.col("__first")
            else:
                origin = F.lit(fuse(rows, {"a": F.min(q(self.ts))})["a"]).cast("timestamp_ntz")
        else:
            origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        made = rows.groupBy(*keys, f.bucket(q(self.ts), origin).alias("__b")).agg(*[known[agg_func](value(self.df, c)).alias(c) for c in columns])
        made = self.scratch.save(made)
        ends = made.groupBy(*keys).agg(F.min("__b").alias("__lo"), F.max("__b").alias("__hi"))
        spine = self._calendar(ends.where("__lo IS NOT NULL"), f, "__lo", "__hi", "__b")
        zero = agg_func in ("sum", "count")
        cells = [F.coalesce(q(c), F.lit(0).cast(made.schema[c].dataType)).alias(c) if zero else q(c) for c in columns]
        out = spine.join(made, [*self.parts, "__b"], "left").select(*keys, F.col("__b").alias(self.ts), *cells)
        return self._set(out, "resample", freq=freq, agg_func=agg_func)

    def report(self) -> dict:
        sizes = [fuse(d, {"n": F.count(F.lit(1))})["n"] for d in (self.original, self.df)]
        return {"original_shape": [sizes[0], len(self.original.columns)], "current_shape": [sizes[1], len(self.df.columns)], "issues": self.detect_issues(), "logs": self.log}

    def save_report(self, path: str) -> None:
        from millrace.sources.reports import save_report

        save_report(self.report(), path)
