"""Reruns, hostile input, low switches and clashing names."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import chat, html, mixing, packing, quality, simhash, toxicity, warc


def documents(spark, n=400):
    rng = random.Random(11)
    rows = [(k % 350, "w " * rng.randint(0, 60) + str(k % 350), rng.choice(["a", "b", "b", None])) for k in range(n)]
    rows += [(7, "same text of many rows", "b")] * 150
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_the_mix_does_not_depend_on_where_rows_lie(spark, tmp_path, broadcast):
    docs = documents(spark)
    taken = lambda df: sorted((r["key"], r["size"], r["copies"]) for r in mixing.mix_rows(mixing.sized_rows(df), broadcast=broadcast).collect())
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "a"))
    docs.repartition(11).write.parquet(str(tmp_path / "b"))
    first = taken(docs)
    assert taken(spark.read.parquet(str(tmp_path / "a"))) == first and taken(spark.read.parquet(str(tmp_path / "b"))) == first
    rows = lambda df: sorted(map(tuple, mixing.mix(df, broadcast=broadcast).collect()), key=repr)
    assert rows(docs) == rows(docs.repartition(5))


def test_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "some words of a text that is long enough to stay here", "a", 5, 6, 7), (2, None, None, 1, 2, 3)], "doc_id long, text string, source string, _row int, copies int, _Q int")
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs).count() == 2
    assert mixing.mix(docs).columns == docs.columns
    out = quality.assess(docs)
    assert set(docs.columns) < set(out.columns) and sorted(r["_Q"] for r in out.collect()) == [3, 7]
    pages = spark.createDataFrame([(1, "<article><p>Hello there, you.</p></article>", "x", 4)], "page_id long, html string, Text string, N_CHARS int")
    got = html.extract(pages).collect()
    assert got[0]["html"].startswith("<article>") and html.extract(pages).columns == ["page_id", "html", "text", "n_chars"]


def test_empty_tables(spark):
    docs = documents(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert simhash.keep_one(docs).count() == 0
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == 0 and 0 <= model.score(None) <= 1
    assert quality.assess(docs).count() == 0


def test_long_names_in_tags_take_linear_time():
    html.parse("<p " + "a" * 200_000 + ">x")
    began = time.process_time()
    page = html.parse("<p " + "a" * 1_000_000 + ">x</p><p " + "b c " * 200_000 + "class=x id='y'>z</p>")
    assert time.process_time() - began < 5 and page.nodes[2].words == ("x", "y")


@pytest.mark.parametrize("piece", ["<h2>", "<span>", "<li><b>", "<p><div>", "<td>", "<dt>x<dd>y", "</p>", "<a \"", "<svg/>"])
def test_tags_that_never_end_take_linear_time(piece):
    model = html.TreeModel([html.parse('<div class="a"><p data-label="1">x</p></div>')])
    took = []
    for n in (60_000, 240_000):
        text = piece * (n // len(piece)) + "</x>" * (n // 40)
        start = time.process_time()
        html.main_text(text, model)
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 0.2


def test_optional_ends():
    page = html.parse("<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>e<p>f<div>g</div><table><tr><td>h<td>i<tr><td>j</table>")
    parent = [page.nodes[n.parent].tag for n in page.nodes[1:]]
    assert [(n.tag, p) for n, p in zip(page.nodes[1:], parent, strict=True)] == [
        ("ul", "#root"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul"), ("li", "ul"), ("p", "#root"), ("p", "#root"), ("div", "#root"),
        ("table", "#root"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr"),
    ]


ARTICLE = "<h1>The title</h1><p>One sentence &amp; more of it.</p><ul><li>A first thing to do.</li></ul><p>Last words <b>of</b> it.</p>"
GOLD = "The title\nOne sentence & more of it.\nA first thing to do.\nLast words of it."


@pytest.mark.parametrize("page", [
    "<nav><ul><li><a href=a>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article>{}</article><footer>Copyright us</footer>",
    "<header><p>The site</p></header><main><div class='content'>{}</div></main><aside class='sidebar'><h3>Related</h3><ul><li><a href=b>x</a></li></ul></aside>",
    "<div class='cookie-notice'><p>We use cookies here.</p><button>OK</button></div><div class='post'>{}</div><section class='comments'><div class='comment'><p>Nice one.</p></div></section>",
    "<form><label>Search</label><input></form><article class='story'>{}</article><div class='footer'>About us. <a href=c>Terms</a></div><script>var a = '<p>';</script>",
    "<div class='story'>{}<div class='ad-box'><p>Only today.</p></div></div><!-- <p>no</p> --><style>p{{}}</style>",
])
def test_layouts_give_their_gold_text(page):
    assert html.main_text(f"<html><body>{page.format(ARTICLE)}</body></html>", html.trained()) == GOLD


def naive_kernel(a, b):
    """Sums over all pairs of equal subsequences of two and three characters, words with borders; a skipped character costs DECAY."""

    def parts(word):
        codes, out = toxicity.encode(word)[: len(word) + 2].tolist(), {}
        n = len(codes)
        for i in range(n):
            for d in toxicity.PAIRS:
                if i + d < n:
                    key = (codes[i], codes[i + d])
                    out[key] = out.get(key, 0) + toxicity.PAIR_WEIGHT * toxicity.DECAY ** (d - 1)
            for j in range(i + 1, n):
                for k in range(j + 1, min(n, i + 6)):
                    key = (codes[i], codes[j], codes[k])
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i - 2)
        scale = toxicity.sizes(np.array([len(word)]))[0]
        return {k: v / scale for k, v in out.items()}

    x, y = parts(a), parts(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_the_kernel_is_that_of_the_naive_sum():
    words, marks = ["idiot", "idxiot", "abc", "gardens", "aabbaabb"], ["idiot", "garden", "abab"]
    expected = np.array([[naive_kernel(w, m) for m in marks] for w in words])
    assert np.allclose(toxicity.kernel(words, marks), expected, atol=1e-4)


def test_the_machine_learns_from_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bcdfgklmnprst") for _ in range(rng.randint(1, 4)))
    bad = ["zorkwad", "plimgit", "xuffhead"]
    spell = lambda w: w if rng.random() < 0.6 else w[:3] + rng.choice("xz.") + w[3:]

    def text(y):
        words = [word() for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(1, 3) if y else 0):
            words.insert(rng.randrange(len(words)), spell(rng.choice(bad)))
        return " ".join(words)

    y = [k % 2 for k in range(800)]
    model = toxicity.train([text(v) for v in y], y)
    fresh = [k % 2 for k in range(200)]
    got = [model.score(text(v)) >= 0.7 for v in fresh]
    assert sum(g for g, v in zip(got, fresh, strict=True) if v) >= 95 and sum(g for g, v in zip(got, fresh, strict=True) if not v) <= 3


def test_the_training_sample_is_bounded_and_repeats(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(300)] + [(1, "text 1"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    take = lambda d: [tuple(r) for r in toxicity.training_rows(d, labels, rows=20).collect()]
    first = take(docs)
    assert len(first) == 40 and sum(y for _, y in first) == 20 and take(docs.repartition(7)) == first
    assert all(zlib.crc32(t.split()[1].encode()) % 3 != 1 for t, _ in first)


@pytest.mark.parametrize("low", [1, 2000, 64 << 20])
def test_pieces_are_those_of_the_library(spark, low):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["one", "two\n", "<|endoftext|>", "é", "don't", "  "]) for _ in range(rng.randint(0, 1500)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = packing.pack(docs, broadcast_bytes=low).toPandas()
    for k, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == k].sort_values("start")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and (mine.doc_tokens == len(ids)).all()
        assert np.frombuffer(b"".join(map(bytes, mine.ids)), "<u4").tolist() == ids
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024


def test_counts_meet_the_conditions_of_the_least_squares():
    rng = np.random.default_rng(4)
    window = 24
    h = rng.integers(0, 60, window)
    h[0] = 0
    combos = packing.combinations(window, np.nonzero(h)[0])
    x = packing.solve_counts(combos, h)
    a = np.zeros((window, len(combos)))
    for k, c in enumerate(combos):
        for v in c[c >= 0]:
            a[v, k] += 1
    gradient = a.T @ (h - a @ x)
    assert (x >= 0).all() and gradient.max() < 1e-3 * h.sum() and np.abs(gradient[x > 1e-6]).max() < 1e-3


def test_long_turns_are_copied_without_indices(spark):
    text = ("é<|" * 10 + "x") * 20_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 2, "assistant", "short"), (2, 0, "user", text)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert got[1]["loss_chars"] == len(text) + 5 and got[1]["loss_sha256"] == hashlib.sha256((text + "short").encode()).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(f"user\n{text}\n".encode()).hexdigest()


@pytest.mark.parametrize("low", [0, 64 << 20])
def test_archives_hold_bytes_and_records_of_their_own(spark, tmp_path, low):
    body = bytes(range(256)) * 20
    rows = [(k, f"u{k}", body if k % 3 == 0 else b"x" * k) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html binary").repartition(4)
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.write_arcs(df, arc, archive_bytes=4000)
    warc.convert(spark, arc, out, archive_bytes=4000, broadcast_bytes=low)
    got = {r["key"]: r for r in warc.records(spark, out).collect()}
    assert len(got) == 40 and bytes(got[39]["payload"]) == body and got[0]["refers_to"] == 39 and bytes(got[38]["payload"]) == b"x" * 38
    ids, members = [], 0
    for r in spark.read.format("binaryFile").load(out).collect():
        members += bytes(r["content"]).count(b"\x1f\x8b\x08")
        ids += [f["WARC-Record-ID"] for f, _ in warc.read_warc(warc.inflate(bytes(r["content"])))]
    assert len(set(ids)) == len(ids) > 41 and members >= len(ids)


def test_near_duplicates_stay_whole_in_a_hot_group(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(60)], []
    for k in range(400):  # near copies of one text, and texts that share much of it
        words = list(base) if k % 2 else [*base[:40], *[word() for _ in range(20)]]
        words[rng.randrange(len(words))] = word()
        rows.append((k, " ".join(words)))
    sets = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(k) for k in sets})


def test_very_long_texts(spark):
    long = "some words of a very long text " * 60_000
    docs = spark.createDataFrame([(1, long, "a"), (2, long, "a"), (3, "short one", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3
    assert {r["key"]: r["size"] for r in mixing.mix_rows(mixing.sized_rows(docs)).collect()} == {1: 420_000, 2: 420_000, 3: 2}
    row = quality.assess(docs).filter("doc_id = 1").first()
    assert row["n_words"] == 420_000 and row["n_repeat_words"] == 420_000 and not row["kept"]
    assert math.isfinite(toxicity.train(["a b"], [0]).score(long))
