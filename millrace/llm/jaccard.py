"""Operator 8: exact n-gram Jaccard self-join by universe partitioning.

A text's set holds its distinct word shingles (64-bit hashes). Texts of equal
sets form a class, and everything below works on classes, so copies cost
nothing. Sizes are cut into bands. In a band two sets of the wanted similarity
differ in at most H tokens, so if the hash universe is cut into segments whose
allowances sum to more than H, they agree within the allowance in one segment
at least (pigeonhole). A segment of allowance 0 is indexed by its subset; one
of allowance 1 takes up two units and is indexed by its subset and the
neighbourhood of one deletion. Chance agreements are those of empty segments,
so a band may have spare segments instead: a set with no more empty segments
than spare ones gives its empty ones no allowance (-1) and does not index them,
and still two such sets agree in one that is not empty. Allowances of a band are
chosen by cost: keys written against the chance agreements expected from the
number of sets in the band. A set indexes its own band, and the lower bands in
which a set of the wanted similarity may lie.

Keys are shuffled once and sorted; a key's classes stream by. They are joined
in a star about one class, another for each key by a hash, and linked if
similar. Pairs of other classes of a key that are not yet in one component
after that are compared in blocks. Both times
parity sketches come first, whose distance never exceeds that of the sets, and
what they cannot rule out is verified exactly on whole sets. So every candidate
pair is ruled out, verified, or known to be connected, and no group is ever
expanded into all its pairs.

Null and empty texts and texts without words have empty sets and link with
nothing; a text of fewer words than a shingle has its whole sequence as one
shingle. A null id links with nothing and is its own null component. Repeated
rows are copies: their set is made once. Shingles and classes are known by 64-bit
hashes alone, so of 10^9 distinct sets some pair is taken for equal with a chance
of a few hundredths. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import components

from .common import Scratch, mix64, small_batches, steps, utf8
from .shingles import shingles

#: Bytes of text that one numpy step handles.
STEP_BYTES = 200_000
BAND_RATIO = 1.5
#: Cost of a chance pair in units of a written key.
PAIR_COST = 4.0
#: Spare segments that a band may have, in parts of those it needs.
SPARES = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)
#: Classes of a key that are compared at once.
BLOCK = 1024


class Similarity:
    """Jaccard similarity of at least part/whole, its size bands and their segments."""

    def __init__(self, part: int, whole: int) -> None:
        self.part, self.whole = part, whole
        low = whole - part
        # below this size, the wanted similarity means equality
        self.least = -(-part // low) if low else 1 << 62
        bounds = [self.least]
        while low and bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, int(bounds[-1] * BAND_RATIO)))
        self.bounds = np.array(bounds, dtype=np.int64)
        self.segments: list[tuple[int, int, int]] = []  # of each band: allowance 0, allowance 1, spare ones among the former

    def most_apart(self, smaller: int) -> int:
        """How many tokens a set of this size and one at least as large may differ in."""
        return smaller * (self.whole - self.part) // self.part

    def band(self, sizes: np.ndarray) -> np.ndarray:
        """Band of each size; -1 where similarity means equality."""
        return np.searchsorted(self.bounds, sizes, side="right") - 1

    def allocate(self, sets_by_band: dict[int, int]) -> None:
        """Choose each band's segments by cost."""
        self.segments = []
        for b in range(len(self.bounds) - 1):
            high, low = int(self.bounds[b + 1]) - 1, int(self.bounds[b])
            n, units = sets_by_band.get(b, 0), self.most_apart(high) + 1
            best = None
            choices = [(units - 2 * (units // 2 * k // 4), units // 2 * k // 4, 0) for k in range(5)] + [(units + int(units * x), 0, int(units * x)) for x in SPARES]
            for zeros, ones, spare in sorted(set(choices)):
                mean = low / (zeros + ones)  # tokens in a segment
                empty = math.exp(-mean)
                keys = zeros + ones * (2 + high / (zeros + ones))
                chance = zeros * empty**2 + ones * empty**2 * (1 + 2 * mean + mean * mean)
                if spare:  # only sets of more empty segments than spare ones index these
                    expected = zeros * empty
                    chance *= (0.5 * math.erfc((spare + 0.5 - expected) / math.sqrt(2 * expected + 1e-12))) ** 2
                cost = n * keys + PAIR_COST * n * n / 2 * chance
                if best is None or cost < best[0]:
                    best = (cost, zeros, ones, spare)
            self.segments.append(best[1:])


def text_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of a batch: first row, tokens, their row (in the step), sizes, class hashes."""
    _, offsets = utf8(column)
    for a, b in steps(np.diff(offsets).tolist(), STEP_BYTES):
        raw, at = utf8(column.slice(a, b - a))
        tokens, owner, sizes = shingles(raw, at, k)
        yield a, tokens, owner, sizes, mix64(sums(mix64(tokens), owner, len(sizes)) + sizes.astype(np.uint64)).view(np.int64)


def sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums modulo 2**64 by group; halves are summed exactly in doubles."""
    low = np.bincount(group, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=groups)
    high = np.bincount(group, weights=(values >> np.uint64(32)).astype(np.float64), minlength=groups)
    return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def class_rows(df: DataFrame, k: int) -> DataFrame:
    """id, size and class of every row of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes = [], []
            for _, _, _, n, c in text_sets(batch.column(1), k):
                sizes.append(n)
                classes.append(c)
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64)), pa.array(np.concatenate(classes))], names=["id", "n", "class"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, n long, class long")


def index_keys(df: DataFrame, k: int, similarity: Similarity) -> DataFrame:
    """(key, class) for every segment key of every class that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, segments = similarity.bounds, similarity.segments
        met: set[int] = set()
        for batch in batches:
            for _, tokens, owner, sizes, classes in text_sets(batch.column(1), k):
                if len(met) > 1_000_000:
                    met.clear()
                new = np.zeros(len(sizes), dtype=bool)
                for i, c in enumerate(classes.tolist()):
                    if c not in met and sizes[i] >= similarity.least:
                        met.add(c)
                        new[i] = True
                first = np.cumsum(sizes) - sizes
                own = similarity.band(sizes)
                lowest = similarity.band(np.maximum(-(-sizes * similarity.part // similarity.whole), similarity.least))
                keys, names = [], []
                for i in np.flatnonzero(new).tolist():
                    mine = tokens[first[i] : first[i] + sizes[i]]
                    for b in range(int(lowest[i]), int(own[i]) + 1):
                        zeros, ones, spare = segments[b]
                        count = zeros + ones
                        mixed = mix64(mine + np.uint64(0xA24BAED4963EE407 * (b + 1) & 0xFFFFFFFFFFFFFFFF))
                        place = (mixed % np.uint64(count)).astype(np.int64)
                        whole = sums(mixed, place, count)
                        salt = mix64(np.arange(count, dtype=np.uint64) + np.uint64((b + 1) << 32))
                        found = [mix64(whole ^ salt)]
                        if spare:
                            filled = np.bincount(place, minlength=count) > 0
                            if count - filled.sum() <= spare:
                                found = [found[0][filled]]
                        if ones:
                            shrunk = place < ones
                            found.append(mix64((whole[place[shrunk]] - mixed[shrunk]) ^ salt[place[shrunk]]))
                        keys.extend(found)
                        names.extend([i] * sum(len(f) for f in found))
                if keys:
                    flat = np.concatenate(keys).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(classes[np.array(names, dtype=np.int64)])], names=["key", "class"])

    return df.mapInArrow(run, "key long, class long")


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, equal classes together: those of keys with two classes or more, with the key's first class."""
    carry: tuple[int, int, int, bool] | None = None  # key, first class, last class, whether the last is written
    for batch in batches:
        key, cls = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(key):
            continue
        if carry:
            key, cls = np.concatenate([[carry[0]], key]), np.concatenate([[carry[2]], cls])
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[fresh], cls[fresh]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(start, len(key)))
        pivot = cls[start]
        many = length > 1
        if carry:
            pivot[0] = carry[1]
            many[0] |= carry[3]
        keep, first = np.repeat(many, length), np.repeat(pivot, length)
        if carry and carry[3]:
            keep[0] = False
        carry = (int(key[-1]), int(pivot[-1]), int(cls[-1]), bool(many[-1]))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cls[keep]), pa.array(first[keep])], names=["key", "class", "pivot"])


def sketch_bits(size: int) -> int:
    return 1 << min(16, max(8, (4 * size - 1).bit_length()))


def set_rows(df: DataFrame, k: int) -> DataFrame:
    """class, n, tokens and parity sketch of the rows of (id, text); of equal rows of a step one only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, tokens, owner, sizes, classes in text_sets(batch.column(1), k):
                _, once = np.unique(classes, return_index=True)
                if len(once) < len(classes):
                    stays = np.zeros(len(classes), dtype=bool)
                    stays[once] = True
                    tokens, sizes, classes = tokens[stays[owner]], sizes[stays], classes[stays]
                sketches, at = [], 0
                for n in sizes.tolist():
                    bits = sketch_bits(n)
                    odd = np.bincount((tokens[at : at + n] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
                    at += n
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(classes), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.view(np.int64))), pa.array(sketches, pa.binary())], names=["class", "n", "tokens", "sketch"])

    return df.mapInArrow(run, "class long, n long, tokens array<long>, sketch binary")


def one_of_each(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The table of sets with one row for each class; sets move only where rows of one id repeat."""
    twice = sets.groupBy("class").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("class")
    if twice.isEmpty():
        return sets
    once = scratch.save(sets.join(twice, "class", "left_anti").unionByName(sets.join(twice, "class", "left_semi").dropDuplicates(["class"])), "sets")
    scratch.drop(sets)
    return once


def verify(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs (a, b) of classes whose sets have the wanted similarity."""
    a = sets.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    near = F.least("na", "nb") * similarity.whole >= F.greatest("na", "nb") * similarity.part
    joined = pairs.join(a, "a").join(b, "b").where(near)
    return joined.where(both * similarity.whole >= (F.col("na") + F.col("nb") - both) * similarity.part).select("a", "b")


def not_ruled_out(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs (a, b) whose parity sketches, a small part of the sets' size, allow the wanted similarity."""
    part, whole = similarity.part, similarity.whole
    sketches = sets.select("class", "n", "sketch")
    a, b = (sketches.toDF(x, f"n{x}", f"s{x}") for x in "ab")
    near = F.least("na", "nb") * whole >= F.greatest("na", "nb") * part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (whole - part)
            stay = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                words = min(len(x), len(y)) // 8
                stay.append(int(np.bitwise_count(_fold(x, words) ^ _fold(y, words)).sum()))
            keep = pa.array(np.array(stay, dtype=np.int64) * (whole + part) <= size)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _fold(sketch: bytes, size: int) -> np.ndarray:
    words = np.frombuffer(sketch, dtype=np.uint64)
    while len(words) > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def compare_blocks(similarity: Similarity):
    """For rows sorted by (key, i, j): pairs of the blocks i and j that the sketches cannot rule out."""
    part, whole = similarity.part, similarity.whole

    def compare(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        cls, n, label, block = (rows.column(c).to_numpy() for c in ("class", "n", "label", "block"))
        sketches = rows.column("sketch").to_pylist()
        size = min(len(s) for s in sketches) // 8
        words = np.stack([_fold(s, size) for s in sketches])
        left = np.flatnonzero(block == i)
        right = np.flatnonzero(block == j)
        found = []
        for x in left.tolist():
            other = right[right > x] if i == j else right
            low, high = np.minimum(n[x], n[other]), np.maximum(n[x], n[other])
            other = other[(label[other] != label[x]) & (low * whole >= high * part)]
            if len(other):
                apart = np.bitwise_count(words[other] ^ words[x]).sum(axis=1).astype(np.int64)
                for y in other[apart * (whole + part) <= (n[other] + n[x]) * (whole - part)].tolist():
                    found.append((x, y))
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        return cls[at].max(axis=1), cls[at].min(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(tables).combine_chunks()
            mark = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
            start = np.flatnonzero(np.concatenate([[True], (mark[:, 1:] != mark[:, :-1]).any(axis=0)])).tolist()
            for a, b in zip(start, [*start[1:], table.num_rows], strict=True):
                if b - a > 1:
                    high, low = compare(table.slice(a, b - a))
                    if len(high):
                        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(low)], names=["a", "b"])

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "i", "j")])
            same = (mark == mark[:, -1:]).all(axis=0)
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last == 0 and waiting:
                w = waiting[-1]
                if all(w.column(w.schema.get_field_index(c))[-1].as_py() == int(m) for c, m in zip(("key", "i", "j"), mark[:, 0], strict=True)):
                    waiting.append(batch)
                    continue
            yield from emit([*waiting, batch.slice(0, last)])
            waiting = [batch.slice(last)]
        if waiting:
            yield from emit(waiting)

    return run


def jaccard_join(df: DataFrame, k: int = 3, part: int = 90, whole: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of df: the id, n_shingles and component_id (smallest id reachable by links)."""
    spark = df.sparkSession
    small_batches(spark)
    scratch, similarity = Scratch(spark, "jaccard"), Similarity(part, whole)
    texts = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    rows = scratch.save(class_rows(texts, k), "rows")
    classes = scratch.save(rows.where("n > 0 AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("id"), F.min("n").alias("n")), "classes")

    # how many sets each band has: a row for each band, of which there are fewer than a hundred
    number = F.lit(-1)
    for b, bound in enumerate(similarity.bounds.tolist()[:-1]):
        number = F.when(F.col("n") >= bound, F.lit(b)).otherwise(number)
    counted = classes.groupBy("n").count().withColumn("band", number).groupBy("band").agg(F.sum("count").alias("sets"))
    similarity.allocate({r["band"]: r["sets"] for r in counted.collect()})

    keys = index_keys(texts.where(F.col("id").isNotNull()), k, similarity)
    shared = scratch.save(keys.repartition("key").sortWithinPartitions(F.col("key"), F.xxhash64("key", "class"), F.col("class")).mapInArrow(shared_keys, "key long, class long, pivot long"), "shared")
    wanted = shared.select("class").distinct().join(classes, "class").select("id")
    sets = one_of_each(scratch.save(set_rows(texts.join(wanted, "id", "left_semi"), k), "sets"), scratch)

    stars = shared.where("class != pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b")).distinct()
    likely = scratch.save(not_ruled_out(stars, sets, similarity), "likely")
    links = scratch.save(verify(likely, sets, similarity), "links")
    labels = scratch.save(components(links, scratch), "labels")

    # keys whose classes are not yet all in one component; the pivot was compared with all others of its key
    labelled = scratch.save(shared.where("class != pivot").select("key", "class").join(labels.withColumnRenamed("node", "class"), "class", "left").select("key", "class", F.coalesce("component", "class").alias("label")), "labelled")
    counts = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("g")).where("x != y").select("key", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks"))
    open_keys = scratch.save(counts, "open")
    sketches = sets.select("class", "n", "sketch")
    blocks = labelled.join(open_keys, "key").join(sketches, "class").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "n", "label", "block", "sketch")
    more = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare_blocks(similarity), "a long, b long").distinct()
    pairs = scratch.save(more, "pairs")
    more_links = scratch.save(verify(pairs, sets, similarity), "links")
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    all_labels = scratch.save(components(more_links.unionByName(known), scratch), "labels")

    joined = all_labels.withColumnRenamed("node", "class").join(classes, "class")
    smallest = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = joined.join(smallest, "component").select("class", "component_id")
    final = scratch.save(classes.join(linked, "class", "left").select("class", F.coalesce("component_id", "id").alias("component_id")), "final")
    scratch.drop(classes, shared, sets, likely, links, labels, labelled, open_keys, pairs, more_links, all_labels)
    return rows.join(final, "class", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one(df: DataFrame, k: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """The documents that represent their group: the smallest doc_id of each component, and one of its repeated rows.

    Rows of one id repeat if their texts are equal; an id of several different texts stays with all of them unless each
    has an earlier copy. Rows without id stay.
    """
    found = jaccard_join(df, k, part, whole).where("doc_id IS NOT NULL")
    ids = found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    ids = Scratch(df.sparkSession, "keep-one").save(ids.where("NOT stays OR rows > 1"), "ids")
    names = [F.col(f"`{c}`") for c in df.columns]
    single = df.join(ids.select("doc_id"), "doc_id", "left_anti").select(*names)
    repeated = df.join(ids.where("stays").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*names)
    return single.unionByName(repeated)
