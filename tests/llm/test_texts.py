import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import jaccard, langid, licenses, substring
from millrace.llm.common import utf8
from millrace.llm.shingles import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute_components(texts, k, part, whole):
    sets, parent = word_sets(texts, k), {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if both * whole >= part * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def corpus(seed, groups, words=(3, 60)):
    """Texts with near copies at all distances, so that many pairs lie on both sides of a threshold."""
    rng, texts = random.Random(seed), {}
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(*words))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 99)}"
            texts[len(texts)] = " ".join(own)
    return texts


@pytest.mark.parametrize(("k", "part", "seed"), [(3, 90, 1), (5, 80, 2), (1, 80, 3)])
def test_jaccard_equals_brute_force(spark, k, part, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    texts = corpus(seed, 60, (3, 90)) | {9001: None, 9002: "", 9003: " \n", 9004: "one", 9005: "One", 9006: "two words"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("class", F.lit(1)).repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df, k, part, 100).collect()}
    assert got == brute_components(texts, k, part, 100)


def test_pigeonhole_allocations_cover_the_distance():
    s = jaccard.Similarity(90, 100)
    for sets in (10, 10**5, 10**9):
        s.allocate({b: sets for b in range(20)})
        for b, (zeros, ones, spare) in enumerate(s.segments[:20]):
            assert zeros + 2 * ones - spare > s.most_apart(int(s.bounds[b + 1]) - 1)
        assert sets < 10**9 or any(x[2] or x[1] for x in s.segments[:10])


def test_one_deletion_neighbourhoods_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_COST", 1e12)
    monkeypatch.setattr(jaccard, "SPARES", ())
    texts = corpus(4, 40, (12, 60))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df, 3, 90, 100).collect()}
    assert got == brute_components(texts, 3, 90, 100)


def test_spare_segments_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_COST", 1e4)
    texts = corpus(8, 50, (8, 70))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df, 2, 80, 100).collect()}
    assert got == brute_components(texts, 2, 80, 100)


def test_jaccard_edges(spark, odd_documents, no_documents):
    rows = jaccard.jaccard_join(odd_documents).collect()
    assert len(rows) == 8 and all(r["component_id"] == r["doc_id"] for r in rows)
    assert jaccard.jaccard_join(no_documents).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.jaccard_join(nulls).collect()) == [(0, 0), (1, 1), (2, 1)]
    # one of the two rows of document 6 goes
    assert jaccard.keep_one(odd_documents).columns == odd_documents.columns and sorted(r["doc_id"] for r in jaccard.keep_one(odd_documents).collect()) == list(range(1, 8))


def test_jaccard_of_repeated_rows(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(base), 2: " ".join([*base[:-1], "other"]), 3: "far away from all of them " * 9}
    rows = [(i, texts[i]) for i in (1, 2) for _ in range(500)] + [(3, texts[3]), (4, texts[1] + " x"), (4, texts[3]), (None, texts[1]), (None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(df, 3, 90, 100).collect()}
    assert {(i, c) for i, _, c in got} == {(1, 1), (2, 1), (3, 3), (4, 1), (4, 3), (None, None)}
    # near copies of 1 go, rows repeat once at most, rows without id stay
    assert sorted((r["doc_id"] or 0) for r in jaccard.keep_one(df, 3, 90, 100).collect()) == [0, 0, 1, 3]


def test_shingles_of_batches():
    texts = ["A b  c\nd", "", "a B", " x ", "a b c d"]
    raw, at = utf8(pa.array(texts))
    values, owner, counts = shingles(raw, at, 3)
    assert counts.tolist() == [2, 0, 1, 1, 2]
    assert values[owner == 0].tolist() == values[owner == 4].tolist()


def test_chunks_cover_texts_and_resist_insertions():
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200))
    texts = [passage, "inserted here " + passage, "x" * 3000, "", "日" * 2000]
    raw, at = utf8(pa.array(texts))
    start, end, owner, digest, words = substring.chunks(raw, at)
    assert start[0] == 0 and (start[1:] == end[:-1]).all() and end[-1] == len(raw)
    assert len(set(digest[owner == 0]) - set(digest[owner == 1])) <= 3
    assert words[owner == 0].sum() == 200
    for s, e in zip(start, end, strict=True):
        raw[s:e].tobytes().decode()


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x5200))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_substring_dedup_of_text_without_spaces(spark, letters):
    rng = random.Random(7)
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passage = fresh(1500)
    texts = {1: fresh(400) + passage + fresh(300), 2: fresh(401) + passage + fresh(300), 3: "x" + passage, 4: fresh(2000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    out = {r["doc_id"]: r["text"] for r in substring.dedup_substrings(df).collect()}
    core = passage[200:1300]
    assert core in out[1] and out[1] == texts[1] and out[4] == texts[4]
    for i in (2, 3):
        assert not any(core[at : at + 20] in out[i] for at in range(0, len(core) - 20))
        head, tail = texts[i].split(passage)
        assert out[i].startswith(head) and out[i].endswith(tail)


def test_substring_dedup(spark, odd_documents, no_documents):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    passage = fresh(80)
    texts = {i: f"{fresh(30)} {passage} {fresh(30)}" for i in range(1, 6)} | {10: fresh(100), 11: fresh(12)}
    texts |= {20: texts[10]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("removed_chars", F.lit("x")).repartition(5)
    out = {r["doc_id"]: r for r in substring.dedup_substrings(df).collect()}
    core = " ".join(passage.split()[20:60])
    assert [i for i in texts if core in out[i]["text"]] == [1]
    assert out[10]["text"] == texts[10] and out[11]["text"] == texts[11] and out[1]["text"] == texts[1]
    assert out[20]["text"] == "" and out[20]["removed"][0]["end"] == len(texts[20])
    for i in range(2, 6):
        head, tail = texts[i].split(passage)
        assert out[i]["text"].startswith(head.strip()) and out[i]["text"].endswith(tail.strip())
        kept, at = "", 0
        for span in out[i]["removed"]:
            kept, at = kept + texts[i][at : span["start"]], span["end"]
        assert (kept + texts[i][at:]).rstrip() == out[i]["text"]
    same = {(r["doc_id"], r["text"]) for r in substring.dedup_substrings(odd_documents).collect()}
    assert len(same) == 7 and (2, None) in same and (3, "") in same
    assert substring.dedup_substrings(no_documents).count() == 0
    assert substring.keep_new(odd_documents).columns == odd_documents.columns and substring.keep_new(odd_documents).count() == 8
    assert substring.keep_new(df.withColumn("n_chars", F.lit(1).cast("long"))).count() == 7


def test_substring_dedup_leaves_words_that_repeat_apart(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts = {i: " ".join(words[10 * i : 10 * i + 10]) + f" and word {i} alone" for i in range(30)}
    texts[99] = " ".join(words)  # each tenth of it stands in another document, no twenty words do
    df = spark.createDataFrame([*texts.items(), (None, texts[99] + " a"), (None, texts[99] + " a")], "doc_id long, text string").repartition(3)
    out = substring.dedup_substrings(df).collect()
    assert {r["doc_id"]: r["text"] for r in out if r["doc_id"] is not None} == texts
    assert all(len(r["text"]) < 60 for r in out if r["doc_id"] is None)  # after all others
    assert substring.keep_new(df).columns == ["doc_id", "text"]


def brute_substring(texts):
    """What is left of each text if every stretch of 20 words that an earlier text or place holds is cut, chunk by chunk."""
    seen, left = {}, {}
    for i in sorted(texts):
        raw, at = utf8(pa.array([texts[i] or ""]))
        start, end, _, _, words = substring.chunks(raw, at)
        pieces = [raw[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        sizes = [(int(n), len(p)) for n, p in zip(words, pieces, strict=True)]
        enough = lambda a, b: sum(x for x, _ in sizes[a:b]) >= substring.SHORTEST_RUN_WORDS or sum(y for _, y in sizes[a:b]) >= substring.SHORTEST_RUN_BYTES  # noqa: E731, B023
        gone, runs = set(), set()
        for a in range(len(pieces)):
            runs |= {next(((a, b) for b in range(a + 1, len(pieces) + 1) if enough(a, b)), None), next(((b, a + 1) for b in range(a, -1, -1) if enough(b, a + 1)), None)}
        for a, b in sorted(runs - {None}):
            if seen.setdefault(tuple(pieces[a:b]), (i, a)) != (i, a):
                gone |= set(range(a, b))
        kept = b"".join(p for k, p in enumerate(pieces) if k not in gone).decode()
        left[i] = kept.rstrip() if gone else texts[i]
    return left


def test_substring_query_equals_brute_force(spark):
    from millrace.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["text"] for r in QUERIES["op4_substring"](spark, sf_dir).collect()} == brute_substring(texts)


def license_brute(texts):
    """Matches by plain sets of word triples, every window of every text tried; the best of those that overlap."""
    split = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    triples = lambda w: list(zip(w, w[1:], w[2:], strict=False))
    found = set()
    for i, t in texts.items():
        own, hits = triples(split(t or "")), []
        for number, (name, template) in enumerate(licenses.TEMPLATES.items()):
            all_of_it = triples(split(template))
            wanted, window = set(all_of_it), 2
            while window * 3 < len(all_of_it) * 4:
                window *= 2
            best = (0, 0, 0)
            for s in range(len(own)):
                at = [k for k in range(s, min(len(own), s + window)) if own[k] in wanted]
                n = len({own[k] for k in at})
                if n > best[0]:
                    last = next(k for k in at if len({own[x] for x in at if x <= k}) == n)
                    best = (n, at[0], last)
            if best[0] >= licenses.CONTAINMENT * len(wanted):
                hits.append((-(2 * best[0] - len(wanted)), number, name, round(best[0] / len(wanted), 9), best[1], best[2]))
        kept = []
        for hit in sorted(hits):
            if not any(hit[4] <= k[5] and k[4] <= hit[5] for k in kept):
                kept.append(hit)
                found.add((i, hit[2], hit[3]))
    return found


def test_licenses_equal_brute_force(spark, odd_documents, no_documents):
    rng, texts = random.Random(7), {}
    for name, template in licenses.TEMPLATES.items():
        for damage in (0, 1, 3):
            words = template.split()
            for _ in range(damage):
                words[rng.randrange(len(words))] = "changed"
            pad = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 40))) for _ in "ab"]
            texts[len(texts)] = f"{pad[0]}\n{' '.join(words)} {pad[1]}"
    texts[999] = "licensed under nothing at all, released under no license"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = licenses.scan(df).collect()
    assert {(r["doc_id"], r["license"], round(r["containment"], 9)) for r in rows} == license_brute(texts)
    exact = [r for r in rows if r["license"] == "mit-statement" and r["containment"] == 1][0]
    assert texts[exact["doc_id"]][exact["start"] : exact["end"]] == "Released under the MIT License"
    two = [licenses.TEMPLATES[x] for x in ("bsd-2-clause", "bsd-3-clause")]
    assert [r["license"] for r in licenses.scan(spark.createDataFrame([(1, two[0]), (2, two[1])], "doc_id long, text string")).orderBy("doc_id").collect()] == ["bsd-2-clause", "bsd-3-clause"]
    short = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.sha2(F.col("id").cast("string"), 256), F.lit(" here. All rights reserved, and more "), F.col("id").cast("string")).alias("text"))
    assert licenses.scan(short).where("license = 'all-rights-reserved'").count() == 1500
    assert licenses.scan(odd_documents).count() == 0 and licenses.scan(no_documents).count() == 0


def test_language_id(spark, odd_documents, no_documents):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert sum(r["rejected"] for r in out) <= 5
    # labels of the held-out fold are not looked at
    blind = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "xx").otherwise(F.col("lang")))
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(blind).collect()}
    assert all(again[r["doc_id"]] == (r["lang_pred"], r["score"]) for r in out)
    odd = {r["doc_id"]: r for r in langid.identify(odd_documents).collect()}
    for i in (2, 3, 5, 7):
        assert odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"]
    assert langid.identify(no_documents).count() == 0
    assert langid.keep_identified(odd_documents).columns == odd_documents.columns
    assert {r["doc_id"] for r in langid.keep_identified(odd_documents).collect()} <= {1, 4, 6}
    # scores of the whole table by plain loops over n-grams
    model = langid.fit(df)
    folded = bytes(langid.FOLDED.tolist())
    by_id = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in out[::5]:
        text = (by_id[r["doc_id"]] or "").encode().translate(folded)
        grams = [text[i : i + g] for g in langid.GRAMS for i in range(len(text) - g + 1)]
        if r["lang_pred"] == "und" or not grams:
            continue
        total = np.zeros(len(model.languages))
        for g in grams:
            total += model.logits[(int.from_bytes(g, "little") * 2654435761 + len(g) * 40503 & 0xFFFFFFFF) >> 16]
        z = (total / len(grams) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert model.languages[int(p.argmax())] == r["lang_pred"] and abs(p.max() - r["score"]) < 1e-9
    noise = "".join(random.Random(1).choice("zqxjkvwy") for _ in range(3000))
    strange = spark.createDataFrame([(1, noise)], "doc_id long, text string")
    assert langid.predict(strange, langid.fit(df)).first()["rejected"]
