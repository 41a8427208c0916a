"""Isolation forest: trees from small samples, scored where the rows are.

A tree needs 256 rows, whatever the table's size, so the trees are grown on the
driver from a sample of at most trees x 256 rows chosen by a hash of their
content, and scoring is a vectorised pass over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.schema import number, q, row_hash

TREES = 100
ROWS = 256


def _usual_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, dtype=np.float64)
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big))


class IsolationForest:
    def __init__(self, columns: list[str], trees: int = TREES, rows: int = ROWS, seed: int = 42) -> None:
        self.columns, self.trees, self.rows, self.seed = columns, trees, rows, seed
        self.nodes: list[tuple[np.ndarray, ...]] = []
        self.sampled = 0

    def fit(self, df: DataFrame) -> IsolationForest:
        picked = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(self.columns)], row_hash(df, self.seed).alias("h"))
        rows = picked.orderBy("h", *[f"c{i}" for i in range(len(self.columns))]).limit(self.trees * self.rows).drop("h").collect()
        x = np.array([tuple(r) for r in rows], dtype=np.float64).reshape(-1, len(self.columns))
        rng = np.random.default_rng(self.seed)
        self.sampled = min(self.rows, len(x))
        self.nodes = [self._grow(x[rng.choice(len(x), self.sampled, replace=False)], rng) for _ in range(self.trees)] if len(x) else []
        return self

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        feature, cut, low, high, worth = [], [], [], [], []
        waiting = [(np.arange(len(x)), 0, -1, False)]
        while waiting:
            at, depth, parent, right = waiting.pop()
            me = len(feature)
            if parent >= 0:
                (high if right else low)[parent] = me
            span = np.ptp(x[at], axis=0) if len(at) else np.zeros(x.shape[1])
            wide = np.flatnonzero(span > 0)
            leaf = depth >= limit or len(at) <= 1 or not len(wide)
            f = -1 if leaf else int(rng.choice(wide))
            c = 0.0 if leaf else float(rng.uniform(x[at, f].min(), x[at, f].max()))
            feature.append(f)
            cut.append(c)
            low.append(me)
            high.append(me)
            worth.append(depth + float(_usual_depth(len(at))) if leaf else 0.0)
            if not leaf:
                left = x[at, f] <= c
                waiting += [(at[left], depth + 1, me, False), (at[~left], depth + 1, me, True)]
        return tuple(np.array(a) for a in (feature, cut, low, high, worth))

    def _whole(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each tree with all its leaves on the last level: features and cuts of the inner nodes, worth of the leaves."""
        out = []
        for feature, cut, low, high, worth in self.nodes:
            levels, at = int(np.ceil(np.log2(max(2, self.sampled)))), np.zeros(1, dtype=np.int64)
            features, cuts = [], []
            for _ in range(levels):
                inner = feature[at] >= 0
                features.append(np.where(inner, feature[at], 0))
                cuts.append(np.where(inner, cut[at], np.inf))  # below a leaf all goes left
                at = np.stack([low[at], high[at]], axis=1).ravel()
            out.append((np.concatenate(features), np.concatenate(cuts), worth[at]))
        return out

    def depths(self, x: np.ndarray) -> np.ndarray:
        """Mean depth of each row over all trees."""
        total, first = np.zeros(len(x)), np.arange(len(x)) * x.shape[1]
        flat = np.ascontiguousarray(x).ravel()
        for feature, cut, worth in self._whole():
            at = np.zeros(len(x), dtype=np.int64)
            while at.size and at[0] < len(feature):
                at = 2 * at + 1 + (flat[first + feature[at]] > cut[at])
            total += worth[at - len(feature)]
        return total / max(1, len(self.nodes))

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """df with the anomaly score of each row (near 1: isolated early); null where a number is missing."""
        columns, forest = df.columns, self
        wide = df.select(*[q(c) for c in columns], F.array(*[number(df, c) for c in self.columns]).alias("__x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(len(columns)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                whole = np.isfinite(x).all(axis=1)
                score = np.full(batch.num_rows, np.nan)
                if forest.nodes and whole.any():
                    score[whole] = 2.0 ** (-forest.depths(x[whole]) / max(1e-9, float(_usual_depth(forest.sampled))))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(score, mask=~whole)], names=[*columns, name])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return wide.mapInArrow(run, f"{kinds}, `{name}` double")
