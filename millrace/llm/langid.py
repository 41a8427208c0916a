"""Operator 3: language identification with calibrated rejection.

A document's vector is the mean of the embeddings of its hashed subwords (byte
3-grams and 4-grams of the text with ASCII letters lower-cased and ASCII
digits and punctuation as blanks, so that n-grams mark word borders); a linear
softmax on it gives the language. Embeddings and weights are trained together
by stochastic gradient descent in numpy on a sample of labelled rows that is
bounded for each language; what reaches the driver of a sampled row is its
histogram of buckets, never its text. Since mean and weights are linear, a
trained model collapses to one row of logits for each bucket, and scoring a
batch is one gather and one segmented sum.

Calibration: a fifth of the sample takes no part in training. On it a
temperature is fitted for the softmax, and for each language the rejection
threshold: typicality, the mean log ratio of a text's subwords under the
training histogram against even spread, halfway between text of wholly unknown
subwords and the least typical calibration text of the language, and lower for
short texts. Texts below the threshold are rejected.

Null texts and texts without any letter are `und` with score 0 and rejected. Of
languages of equal score the first in the order of their names is said.
Empty tables give empty tables; repeated rows are scored alike. Without any
labelled row, every text is `und`. Labels, sources and ids are no inputs of a
prediction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_CHARS, free_name, small_batches, steps, utf8

BUCKETS = 1 << 16
GRAMS = (3, 4)
#: Labelled rows that training may take of each language (expected number; chosen by a hash of the id).
SAMPLE_PER_LANGUAGE = 500
DIMENSIONS = 16
EPOCHS = 4
#: A text is rejected if its typicality lies below this share of the way from wholly unknown subwords to the least typical calibration text.
REJECT_BELOW = 0.5
#: Calibration texts of at least so many n-grams set that level.
LONG_ENOUGH = 200
#: Less this much, divided by the root of the number of n-grams: means of short texts vary more.
SHORT_MARGIN = 8.0
LETTER = regex.compile(r"\p{L}")


def _folded() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[:128] = 32
    for c in range(ord("a"), ord("z") + 1):
        table[c] = c
        table[c - 32] = c
    return table


FOLDED = _folded()


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram (one row for each order; BUCKETS where it would leave its text), and n-grams by text."""
    n = len(raw)
    codes = np.zeros(n + 4, dtype=np.uint32)
    codes[:n] = FOLDED[raw]
    rolled = codes[:n] | codes[1 : n + 1] << 8
    found = np.empty((len(GRAMS), n), dtype=np.int32)
    sizes = np.diff(offsets)
    counts = np.zeros(len(sizes), dtype=np.int64)
    for row, g in zip(found, GRAMS, strict=True):
        gram = rolled | codes[2 : n + 2] << 16
        if g == 4:
            gram |= codes[3 : n + 3] << 24
        gram = gram * np.uint32(2654435761) + np.uint32(g * 40503)
        row[:] = gram >> np.uint32(16)
        for back in range(1, g):
            last = offsets[1:] - back
            row[last[sizes >= back]] = BUCKETS
        counts += np.maximum(sizes - g + 1, 0)
    return found, counts


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS + 1 rows, the last all zero; a column for each language
    bias: np.ndarray
    temperature: float
    ratio: np.ndarray  # BUCKETS + 1: log ratio of each bucket's training frequency to even spread
    threshold: np.ndarray  # for each language

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language (index) and probability of each text, and whether it is too untypical."""
        found, counts = buckets(raw, offsets)
        n = len(counts)
        table = np.concatenate([self.logits, self.ratio[:, None]], axis=1)
        sums = np.zeros((n, table.shape[1]))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            for row in found:
                sums[full] += np.add.reduceat(table[row], offsets[:-1][full], axis=0)
        mean = sums / np.maximum(counts, 1)[:, None]
        z = (mean[:, :-1] + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(n), best], mean[:, -1] < self.threshold[best] - SHORT_MARGIN / np.sqrt(np.maximum(counts, 1))


def train(rows: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """rows: language, distinct buckets, their counts, and one random number that picks the calibration part."""
    languages = sorted({r[0] for r in rows})
    of = {x: i for i, x in enumerate(languages)}
    y = np.array([of[r[0]] for r in rows])
    weights = [(r[1], (r[2] / max(1, r[2].sum())).astype(np.float64)) for r in rows]
    held = np.array([r[3] < 0.2 for r in rows])
    fit, check = np.flatnonzero(~held), np.flatnonzero(held)
    if not len(fit) or not len(check):
        fit = check = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    lin = np.zeros((DIMENSIONS, len(languages)))
    lin += rng.normal(0, 0.1, lin.shape)
    bias = np.zeros(len(languages))
    total, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = 2.0 * (1 - done / total) + 0.02
            done += 1
            at, w = weights[i]
            v = w @ emb[at]
            z = v @ lin + bias
            z = np.exp(z - z.max())
            z /= z.sum()
            z[y[i]] -= 1
            back = lin @ z
            lin -= rate * np.outer(v, z)
            bias -= 0.05 * rate * z
            emb[at] -= rate * w[:, None] * back[None, :] * 10
    logits = np.concatenate([emb @ lin, np.zeros((1, len(languages)))])
    seen = np.ones(BUCKETS + 1)
    for i in fit:
        at, w = weights[i]
        seen[at] += w * 1000
    ratio = np.log(seen / seen[:-1].mean())
    ratio[-1] = 0
    z = np.array([w @ logits[at] for at, w in (weights[i] for i in check)]) + bias
    doubt = 1 / (len(check) + 2)  # targets short of 1, so that a perfect part has a finite best temperature
    target = np.full(z.shape, doubt / max(1, len(languages) - 1))
    target[np.arange(len(check)), y[check]] = 1 - doubt

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        return -float((target * s).sum())

    temperature = float(min(np.geomspace(0.05, 50, 80), key=loss))
    typical = np.array([w @ ratio[at] for at, w in (weights[i] for i in check)])
    threshold = np.full(len(languages), -math.inf)
    long = np.array([rows[i][2].sum() >= LONG_ENOUGH for i in check])
    for k in range(len(languages)):
        own = typical[long & (y[check] == k)]
        own = own if len(own) >= 20 else typical[long]  # too few of one language: those of all
        if len(own) >= 20:
            threshold[k] = ratio[:-1].min() + REJECT_BELOW * (own.min() - ratio[:-1].min())
    return Model(languages, logits, bias, temperature, ratio, threshold)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        at, counts = [], []
        for i in range(len(texts)):
            raw, offsets = utf8(texts.slice(i, 1))
            found, _ = buckets(raw, offsets)
            u, c = np.unique(found[found < BUCKETS], return_counts=True)
            at.append(u.astype(np.uint16).tobytes())
            counts.append(c.astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "u", "at", "counts"])


def held_out(id_column: str) -> Column:
    return F.crc32(F.col(f"`{id_column}`").cast("string")) % 3 == 1


def fit(df: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model | None:
    """Train on a bounded sample of the labelled rows outside the held-out fold; None if there are none."""
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang"))
    rows = rows.where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    part = F.lit(0.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(part)
    u = (F.xxhash64("id", F.lit("sample")).bitwiseAND(0xFFFFFF)).cast("double") / float(1 << 24)
    v = (F.xxhash64("id", F.lit("calibrate")).bitwiseAND(0xFFFFFF)).cast("double") / float(1 << 24)
    got = rows.where(u < part).select("lang", v.alias("u"), "text").mapInArrow(_histograms, "lang string, u double, at binary, counts binary").collect()
    got.sort(key=lambda r: (r["lang"], r["u"], bytes(r["at"])))
    return train([(r["lang"], np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.uint32), r["u"]) for r in got])


def predict(df: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected (with underscores after them if df has such columns) to all columns of df."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input
    names = df.columns
    where = names.index(text_column)
    made = [free_name(c, names) for c in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(where)
            pred, score, reject = [], [], []
            _, all_offsets = utf8(texts)
            for a, b in steps(np.diff(all_offsets).tolist(), STEP_CHARS):
                part = texts.slice(a, b - a)
                raw, offsets = utf8(part)
                best, p, odd = m.score(raw, offsets) if m else (np.zeros(b - a, int), np.zeros(b - a), np.ones(b - a, bool))
                for i, text in enumerate(part.to_pylist()):
                    known = bool(m) and text is not None and LETTER.search(text) is not None
                    pred.append(m.languages[best[i]] if known else "und")
                    score.append(float(p[i]) if known else 0.0)
                    reject.append(not known or bool(odd[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())], names=[*names, *made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, `{made[0]}` string, `{made[1]}` double, `{made[2]}` boolean")


def identify(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    model = fit(df, id_column=id_column, text_column=text_column, lang_column=lang_column)
    scored = predict(df.select(id_column, text_column), model, text_column)
    return scored.select(id_column, held_out(id_column).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(df: DataFrame) -> DataFrame:
    """The rows of documents whose language is not rejected, with their columns."""
    said = predict(df, fit(df))
    return said.where(~F.col(f"`{said.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in df.columns])
