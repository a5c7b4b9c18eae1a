"""Pages, archives, chats and toxicity."""

import base64
import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import chat, html, toxicity, warc


@pytest.fixture(scope="module")
def model():
    return html.trained(300)


def test_marginals_are_exact(model):
    """Sum-product against the sum over all labellings of a small tree."""
    page = html.parse('<div class="post"><p>Some text here.</p><a href="x">more</a></div><nav><a>b</a></nav>')
    nodes = page.nodes
    n = len(nodes)
    odds = [0.0] + [sum(model.odds.get(o, 0.0) for o in html.observed(x)) for x in nodes[1:]]
    total, mass = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> k & 1 for k in range(n)]
        w = 1e-6 if y[0] else 1.0
        for k in range(1, n):
            w *= model.move(nodes[k])[y[nodes[k].parent]][y[k]] * (np.exp(max(-12, min(12, odds[k]))) if y[k] else 1.0)
        total += w
        mass += w * np.array(y)
    assert np.allclose(model.marginals(page), mass / total, atol=1e-9)


def test_held_out_pages(model):
    rng = random.Random(5)
    wrong = seen = 0
    for _ in range(150):
        page = html.parse(html.labelled_page(rng))
        for node, p in zip(page.nodes[1:], model.marginals(page)[1:], strict=True):
            if node.own:
                seen, wrong = seen + 1, wrong + ((p >= 0.5) != (node.label == 1))
    assert wrong / seen < 0.03


def test_text_of_a_page(model):
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy it.</div><article><h1>A &amp; B</h1><p><b>One\n  two.<br><p>Three &lt;x&gt; &eacute;.<script>var a="</p>";</script></article><div id="comments"><div class="comment"><p>Nice post.</p></div></div><footer>&copy; me</footer>'
    assert html.main_text(page, model) == "A & B\nOne two.\nThree <x> é."


@pytest.mark.parametrize("broken", ["", "<", "<p", "a<b & c", "<div class='x>foo", "</p></p>text", "<script>", "<!-- x", "&#xD800; &#0; &bogus;", "<article>" * 3000 + "x", "\0", "<p>" + "y " * 50_000])
def test_broken_pages_give_something(model, broken):
    assert isinstance(html.main_text(broken, model), str)


def test_extract_keeps_rows(spark, model):
    df = spark.createDataFrame([(1, "u", None, 9), (2, None, "", 9), (3, "v", "<article><p>Hi there you.</p></article>", 9), (3, "v", "<article><p>Hi there you.</p></article>", 9)], "page_id long, url string, html string, n_chars int")
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df, model=model).collect()}
    assert got == {(1, "", 0), (2, "", 0), (3, "Hi there you.", 13)}
    assert html.extract(df.limit(0), model=model).count() == 0


PAGES = [(1, "u", None), (2, None, ""), (3, "a b", "x\r\n\r\ny é"), (3, "a b", "x\r\n\r\ny é"), (7, "n", "x\r\n\r\ny é"), (8, "m", "WARC/1.1\r\n\r\n\nhttp://x 0.0.0.0 2024 text/html 3\nabc"), (None, "k", "zz")]


@pytest.mark.parametrize("least", [0, 5, 100])
def test_archives_come_back(spark, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, key string")
    got = warc.archive_pages(df, least).collect()
    assert len(got) == len(PAGES)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((r["key"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((p or 0, len((t or "").encode()), digest(t)) for p, _, t in PAGES)
    long = [r for r in got if r["payload_bytes"] >= least and r["payload_digest"] == digest(PAGES[2][2])]
    if least <= 9:
        assert sorted((r["key"], r["record_type"], r["refers_to"]) for r in long) == [(3, "revisit", 7), (3, "revisit", 7), (7, "response", None)]
    else:
        assert all(r["record_type"] == "response" for r in got)
    assert warc.archive_pages(df.limit(0)).count() == 0 if least == 0 else True


def test_arc_versions_and_damage():
    block = b"HTTP/1.1 200 OK\r\n\r\nhi\nthere"
    for version in (1, 2):
        text = warc.arc_head("n", version, "20240102") + "\n" + warc.arc_line(version, "http://a b", "20240102", 0, "n", block) + "\n"
        found = list(warc.read_arc(text.encode() + block + b"\n"))
        assert [(c.version, c.url, c.block) for c in found] == [(version, "http://a%20b", block)]
        with pytest.raises(ValueError, match="ends after"):
            list(warc.read_arc(text.encode() + block[:-2]))
    with pytest.raises(ValueError, match="unknown ARC version"):
        list(warc.read_arc(b"filedesc://n 0.0.0.0 2024 text/plain 10\n9 0 x\nURL\n"))
    assert warc.warc_date("20240102") == "2024-01-02T00:00:00Z"


TURNS = [(1, 0, "user", "a<|end|>\n<\\|b<\\\\|"), (1, 1, "assistant", None), (1, 1, "assistant", ""), (1, 2, "we|ird role<|", "<<||"), (None, 0, None, "x"), (1, 3, "assistant", "é<|turn:user|>"), (2, 5, "assistant", "日本" * 10), (2, None, "system", "\\### x </turn>")]


def test_chats_read_back(spark, monkeypatch):
    df = spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id long, turn long, role string, text string, piece string")
    for size in (1 << 22, 1):
        monkeypatch.setattr(chat, "PIECE_BYTES", size)
        pieces = chat.format_chats(df)
        got = {r["conv_id"]: r for r in chat.digests(pieces).collect()}
        order = sorted(TURNS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        for conv in {t[0] for t in TURNS}:
            own = [t for t in order if t[0] == conv]
            everything = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
            loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
            r = got[conv]
            assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(everything.encode()).hexdigest())
            assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_the_folded_machine_is_the_kernel():
    words, marks = ["idiot", "idxiot", "hello", "réeuxle"], ["idiot", "worthless", "réeux"]
    beta = np.array([0.7, -0.2, 0.4])
    folded = toxicity.apply(words, (toxicity.basis_of(marks) @ beta)[:, None].astype(np.float32))[:, 0]
    assert np.allclose(folded, toxicity.kernel(words, marks) @ beta, atol=1e-5)
    k = toxicity.kernel(["idiot", "idxiot", "gardens"], ["idiot"])[:, 0]
    assert k[0] > k[1] > 3 * max(k[2], 0.01)


def test_training_finds_insults_and_their_spellings():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bdfgklmnprtv") + rng.choice("aeou") for _ in range(rng.randint(1, 4)))
    bad = ["worthless", "pathetic", "scumbag"]

    def text(toxic):
        words = [word() for _ in range(rng.randint(20, 80))]
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        return " ".join(words)

    y = [int(k % 3 == 0) for k in range(300)]
    model = toxicity.train([text(t) for t in y], y)
    held = [(text(t), t) for t in (0, 1) * 60]
    assert np.mean([(model.score(x) >= 0.7) == bool(t) for x, t in held]) > 0.95
    odd = "mada w.o.r.t.h.l.e.s.s nole PATHHETIC rabu s c u m b a g lane"
    assert model.score(odd) > model.score("mada nole rabu lane vedo")
    assert 0 <= model.score(None) <= 0.5 and model.score("") == model.score("  \n") and model.score("x " * 300_000) <= 1


def test_scores_of_a_table(spark):
    model = toxicity.train(["a b c"], [0])
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (2, "", 3)], "doc_id long, text string, score int")
    assert [0 <= r["score"] <= 1 for r in toxicity.score(df, model).collect()] == [True] * 3
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(df, labels).count() == 0


def test_label_attributes_of_real_pages_are_text_like_any_other(model):
    page = '<article><p data-label="Price">Some text of the page, and more of it.</p><table><tr><td data-label="">Cell.</td></tr></table></article>'
    assert "Some text of the page" in html.main_text(page, model)
    assert [n.label for n in html.parse('<p data-label="1"><b data-label="x">').nodes[1:]] == [1, -1]
    assert all(n.label == -1 for n in html.parse('<p data-label="1">', labelled=False).nodes)
