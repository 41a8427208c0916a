import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat, near_vectors
from millrace.llm.chat import CONTROL, escape, format_chats, read_back, read_turns, unescape
from millrace.llm.html_extract import extract, main_text
from millrace.llm.near_vectors import near_duplicates
from millrace.llm.topk import top_k

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="home"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies, all of them, more than you would like to know about.</p></div>
<div class="layout"><aside><p>Side, bar, text, with many, commas, and so on, and so forth.</p></aside>
<div class="content"><h2>Title &amp; more</h2><div><p>First   paragraph, long enough&nbsp;to count,
with commas.</div><p>Short.<blockquote>Quote, with words, and so.</blockquote><ul><li>one<li>two</ul>
<form><p>Subscribe, now, please, enter, mail, and go</p></form><div class="advert">Buy, buy, buy</div></div></div>
<section id="comments"><article class="comment"><p>Comment, longer than the article, so, many, commas, here, we, go, on, and, on.</p></article></section>
<footer>foot</footer></body></html>"""


def test_main_text():
    want = ["Title & more", "First paragraph, long enough to count, with commas.", "Short.", "Quote, with words, and so.", "one", "two"]
    assert main_text(PAGE) == "\n\n".join(want)
    assert main_text(None) == main_text("") == "" and main_text("plain words") == "plain words"
    assert main_text("<div>" * 5000 + "deep, text" + "</div>" * 5000) == "deep, text"
    assert main_text("<article><h1>A</h1><p>x<script>y</script>z</article>") == "A\n\nxz"


def random_page(rng):
    """A page of random parts around an article, and the article's blocks."""
    word = lambda n: " ".join(rng.choice(["alpha", "beta,", "gamma", "delta", "naïve", "words,", "omega"]) for _ in range(n))
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">{word(2)}</a></li>' for i in range(n)) + "</ul>"
    blocks, body = [], ""
    for k in range(rng.randint(3, 9)):
        said = word(rng.randint(20, 60))
        blocks.append(f"{said} & {k}")
        open_tag, close_tag = rng.choice([("<p>", "</p>"), ("<p class='x'>", ""), ("<blockquote>", "</blockquote>"), ("<p>", "</p>")])
        body += f"{open_tag}{said.replace(' ', rng.choice([' ', chr(10) + '  ']), 3)} &amp; <b>{k}</b>{close_tag}"
        body += rng.choice(["", "<!-- note -->", "<script>var x = '<p>no</p>';</script>", '<div class="advert">Buy now, buy more, buy it all</div>', "<form><p>Name, please</p><input></form>", "<![CDATA[ hidden, words ]]>"])
    wrap = rng.choice(["<article>{}</article>", '<div id="content"><div>{}</div></div>', "<main>{}</main>", '<section class="post-body">{}</section>'])
    around = [f"<nav>{links(6)}</nav>", f"<header>{word(6)}</header>", f'<aside><p>{word(25)}</p></aside>', f'<div class="sidebar">{links(5)}<p>{word(30)}</p></div>', f'<div class="cookie-notice"><p>{word(20)}</p></div>']
    after = [f"<footer>{word(8)}</footer>", f'<div id="comments"><p>{word(80)}</p></div>', f'<div class="related">{links(4)}</div>']
    rng.shuffle(around)
    return f"<html><head><title>{word(3)}</title></head><body>{''.join(around[: rng.randint(1, 5)])}{wrap.format(body)}{''.join(after)}</body></html>", blocks


def test_articles_of_random_pages():
    rng = random.Random(12)
    for _ in range(200):
        page, blocks = random_page(rng)
        assert main_text(page) == "\n\n".join(blocks)


def test_long_deep_and_tied_pages():
    long = "word, " * 200_000
    assert main_text(f"<body><nav><a href='/'>x</a></nav><article><p>{long}</p></article></body>") == long.strip()
    deep = "<div>" * 30 + "<p>" + "deep words, and more of them, " * 20 + "</p>" + "</div>" * 30
    assert main_text(deep + "<nav><p>menu, menu, menu, menu, menu</p></nav>").startswith("deep words")
    twin = "<div><p>" + "the same, words, " * 9 + "</p></div>"
    assert main_text(f"<body><section>{twin}{twin}</section></body>").count("the same") == 18
    assert main_text("<article><p>a <![CDATA[<b>not this</b>]]> z</p></article>") == "a z"


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "", 7)], "page_id long, url string, html string, text int")
    rows = extract(df).collect()
    assert len(rows) == 4 and sum(r["n_chars"] > 0 for r in rows) == 2
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert extract(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*CONTROL, "\\", "\n", "a", "<", "[", "/", "é"]), max_size=12).map("".join))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROL)


def test_chats(spark):
    rng = random.Random(2)
    bits = [*CONTROL, "\\", "\n", "é😀", "word ", "\\n", "</", "s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd\nrole</s>", None]), rng.choice([None, "", "".join(rng.choice(bits) for _ in range(9))])) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(7, 99, "assistant", "x" * 50_000)] + [(c, 0, "user", "again") for c in (None, 3, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(5)
    chats = {r["conv_id"]: r["formatted"] for r in format_chats(df).collect()}
    want = {}
    for c, t, role, said in rows:
        want.setdefault(c, []).append((t, role is not None, role or "", said is not None, said or "", role))
    for c, turns in want.items():
        turns.sort(key=lambda x: x[:5])
        assert read_turns(chats[c]) == [(x[2], x[4]) for x in turns]
    for r in read_back(format_chats(df)).collect():
        turns = want[r["conv_id"]]
        loss = "".join(x[4] for x in turns if x[5] == "assistant")
        whole = "".join(f"{x[2]}\n{x[4]}\n" for x in turns)
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(loss), len(chats[r["conv_id"]]))
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
    assert format_chats(df.limit(0)).count() == 0


def test_batches_of_long_chats_are_split(spark, monkeypatch):
    monkeypatch.setattr(chat, "MOST_BYTES", 500)
    df = spark.createDataFrame([(c, t, "assistant", f"text {c} {t} " * 9) for c in range(30) for t in range(4)], "conv_id long, turn long, role string, text string")
    for r in read_back(format_chats(df)).collect():
        assert r["n_turns"] == 4 and r["loss_sha256"] == hashlib.sha256("".join(f"text {r['conv_id']} {t} " * 9 for t in range(4)).encode()).hexdigest()


@pytest.fixture(scope="module")
def vectors(spark):
    rng, rows = np.random.default_rng(3), []
    for _ in range(120):
        base = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 1, 3, 8]))):
            rows.append((base + rng.normal(scale=rng.choice([0.0, 0.05, 0.2]), size=16)).astype(np.float32).tolist())
    data = [(i, v, 0) for i, v in enumerate(rows)]
    data += [(10_000, None, 1), (10_001, [0.0] * 16, 1), (10_002, [float("nan")] + [1.0] * 15, 1), (10_003, [None] + [1.0] * 15, 1), (10_004, [float("inf")] * 16, 1), (10_005, [], 1)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, n_links int"), np.array(rows, dtype=np.float64)


def test_near_vectors_equal_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 4)
    df, x = vectors
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    rows = {r["vec_id"]: r for r in near_duplicates(df.repartition(3)).collect()}
    assert len(rows) == len(x) + 6
    for i in range(len(x)):
        assert (rows[i]["n_links"], rows[i]["component_id"], rows[i]["kept"]) == (near[i].sum(), label[i], label[i] == i)
    for i in range(10_000, 10_006):
        assert (rows[i]["n_links"], rows[i]["component_id"], rows[i]["kept"]) == (0, i, True)
    assert near_duplicates(df.limit(0)).count() == 0


def isolated_pairs(n, dims, shared, seed=4):
    """n vectors of mean cosine `shared`; rows 2i and 2i + 1 of the first tenth have cosine 0.9, no others 0.9 or more."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims - 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = x[0 : n // 10 : 2], x[1 : n // 10 : 2]
    b = b - (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 1 - (0.1 - 1e-6) / (1 - shared)
    x[1 : n // 10 : 2] = c * a + np.sqrt(1 - c * c) * b
    return np.hstack([np.sqrt(1 - shared) * x, np.full((n, 1), np.sqrt(shared))])


@pytest.mark.parametrize("shared", [0.0, 0.6])
def test_near_vectors_find_isolated_pairs(spark, shared):
    n = 12_000
    df = spark.createDataFrame([(i, v) for i, v in enumerate(isolated_pairs(n, 64, shared).tolist())], "vec_id long, embedding array<double>")
    rows = near_duplicates(df.repartition(4)).where(f"vec_id < {n // 10}").collect()
    assert sum(r["n_links"] == 1 and r["component_id"] == r["vec_id"] // 2 * 2 for r in rows) >= 0.995 * n // 10


def test_windows_do_not_end_at_borders_of_partitions(spark):
    ids = list(range(400))
    hashed = spark.createDataFrame([(0, i, i, [1.0, i / 1000]) for i in ids], "pass int, hash long, id long, v array<double>")
    links = near_vectors.window_links(hashed, 2, 3, 0.9, near_vectors.Scratch(spark, "borders"), 8)
    pairs, label = links.collect(), {i: i for i in ids}
    for _ in ids:
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    assert set(label.values()) == {0}


def test_top_k_equals_brute_force(spark, vectors):
    df, x = vectors
    q = np.floor(x * 256).astype(np.int64)
    want = []
    for i in range(0, len(x), 10):
        score = q @ q[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != i][:5]
        want += [(i, k, int(j), int(score[j])) for k, j in enumerate(order, 1)]
    got = top_k(df.repartition(4), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want
    ties = spark.createDataFrame([(i, [1.0]) for i in (50, 3, 9, 7)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in top_k(ties, F.col("vec_id") == 50, 2).orderBy("rank").collect()] == [3, 7]
    assert top_k(ties.where("vec_id = 50"), F.col("vec_id") == 50).count() == 0
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
