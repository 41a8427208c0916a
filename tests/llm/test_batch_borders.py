"""Rows that stream by in batches give the same result however they are cut."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm.jaccard import shared_keys
from millrace.llm.substring import _later
from millrace.operators.components import local_forest


def batches(rows, names, rng):
    at = 0
    while at < len(rows):
        n = rng.choice([0, 1, 1, 2, 3, 7])
        part = rows[at : at + n]
        at += n
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in range(len(names))], names=names)


def read(found):
    return [tuple(r.values()) for b in found for r in b.to_pylist()]


@pytest.mark.parametrize("seed", range(30))
def test_shared_keys(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randint(0, 9), rng.randint(-5, 5)) for _ in range(rng.randint(0, 60)))
    classes = {}
    for k, c in rows:
        classes.setdefault(k, set()).add(c)
    want = sorted((k, c, min(cs)) for k, cs in classes.items() if len(cs) > 1 for c in cs)
    assert sorted(read(shared_keys(batches(rows, ["key", "class"], rng)))) == want


@pytest.mark.parametrize("seed", range(30))
def test_later(seed):
    rng = random.Random(seed)
    rows = sorted((rng.randint(0, 9), rng.randint(0, 5)) for _ in range(rng.randint(0, 60)))
    first = {}
    for d, i in rows:
        first.setdefault(d, i)
    assert read(_later(batches(rows, ["digest", "id"], rng))) == [(d, i) for d, i in rows if i != first[d]]


@pytest.mark.parametrize("seed", range(20))
def test_local_forest(seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(25)]
    parent = list(range(41))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = dict(read(local_forest([pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*links, strict=True)], names=["u", "v"])])))
    nodes = {n for link in links for n in link}
    assert all(got.get(n, n) == root(n) for n in nodes)
