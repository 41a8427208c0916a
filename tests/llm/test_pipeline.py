"""The pipeline against plain versions of its stages."""

import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_texts import brute_components, brute_substring
from tokenizers import Tokenizer

from millrace.llm import langid
from millrace.llm.queries import VOCABULARY


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    said = langid.predict(docs, langid.fit(docs))
    kept = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert kept.columns == names and kept.count() == said.where("NOT rejected").count() >= docs.count() - 2
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    single = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    want = {i for i, (_, c) in brute_components(texts, 5, 80, 100).items() if c == i}
    assert single.columns == names and {r["doc_id"] for r in single.collect()} == want
    cut = corpus_pipeline.substring_dedup(spark, single, sf_dir)
    rows = cut.collect()
    assert cut.columns == names and all(r["n_chars"] == len(r["text"]) or r["text"] == texts[r["doc_id"]] for r in rows)
    seen: dict[tuple, int] = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        words = r["text"].split()
        for j in range(len(words) - 49):
            part = tuple(words[j : j + 50])
            if len(set(part)) > 25:  # not one word over and over
                assert seen.setdefault(part, r["doc_id"]) == r["doc_id"]
    left = brute_substring({i: texts[i] for i in want})
    left = {i: t for i, t in left.items() if t or not texts[i]}
    assert {r["doc_id"]: r["text"] for r in rows} == left
    # the run as a whole: pieces of these texts, whole and in order, packed without gaps or overlaps
    tokens = Tokenizer.from_file(VOCABULARY)
    pieces, bins = {}, {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(left)
    for i, own in pieces.items():
        ids = np.array([*tokens.encode(left[i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_entry_leaves_nothing_out():
    import __spark_entry__

    queries = __spark_entry__.queries()
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {q.split("_")[0] for q in queries}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "packing"]


def test_stages_of_odd_documents(spark, odd_documents, no_documents):
    """Nulls in any column, empty and long texts, repeated rows, extra columns of clashing names, empty tables."""
    for docs in (odd_documents, no_documents, odd_documents.drop("n_chars"), odd_documents.withColumn("doc_id", F.when(F.col("doc_id") < 5, F.col("doc_id")))):
        names = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == names
        assert corpus_pipeline.packing(spark, docs, "").where("length < 1 OR length > 2048").count() == 0
