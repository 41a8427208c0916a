import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer as Reference

from millrace.llm.bpe import Tokenizer, encode_decode
from millrace.llm.packing import OpenBins, best_fit_pack, cut, fast_merge

PARTS = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\n\n", "\t", " \n", "a", "bc", "é", "1", "23", "½", "²", "!", "?!", "<|endoftext|>", " ", "　", "\x1c", "\x85", "日本", "😀", "ſ", "don't", " 've", "'LL", "\0", "x" * 90]


@pytest.fixture(scope="module")
def reference(vocabulary):
    return Reference.from_file(vocabulary)


@pytest.mark.parametrize("how", ["heap", "fast"])
def test_ids_equal_the_reference(vocabulary, reference, how):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [""]
    own = Tokenizer(vocabulary)
    ids, counts = own.encode(texts, own.merge if how == "heap" else fast_merge(vocabulary))
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        got = ids[at : at + n].tolist()
        at += n
        assert got == reference.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(got) == reference.decode(got, skip_special_tokens=False)


def test_query_digests(spark, odd_documents, no_documents, vocabulary, reference):
    rows = encode_decode(odd_documents, vocabulary).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    assert len(rows) == 8
    for r in rows:
        ids = reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["round_trip"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert encode_decode(no_documents, vocabulary).count() == 0


def test_cut():
    assert cut(5, 4) == [(0, 1), (1, 4)] and cut(8, 4) == [(0, 4), (4, 4)] and cut(3, 4) == [(0, 3)]


def test_bins_are_bounded_and_best_fit():
    b = OpenBins(10, 2)
    assert b.put(6) == (0, 0) and b.put(7) == (1, 0)
    assert b.put(3) == (1, 7)  # the fuller of both, which is then full
    assert b.put(9) == (2, 0) and b.put(8) == (3, 0)  # three would be open: the fullest, 2, closes
    assert b.put(1) == (3, 8) and b.open <= 2


def test_packing(spark, odd_documents, no_documents, vocabulary, reference):
    rows = best_fit_pack(odd_documents, vocabulary, most=512).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_documents.collect()}
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(pieces[6]) == 2  # repeated rows are packed each
    for doc, got in pieces.items():
        if doc == 6:
            continue
        ids = np.array([*reference.encode(texts[doc], add_special_tokens=False).ids, 0], dtype="<u4")
        got.sort(key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in got] == cut(len(ids), 512)
        assert [r["ids_crc32"] for r in got] == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in cut(len(ids), 512)]
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 512) + 3
    assert best_fit_pack(no_documents, vocabulary).count() == 0
