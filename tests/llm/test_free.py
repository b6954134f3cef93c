"""The other operators against the libraries, brute force, exact round trips and planted damage."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

from reamwork.llm import bpe_codec, html_extract, jaccard_join, lm_scoring, token_counts, warc
from reamwork.llm.queries import TOKENIZERS

DOCS = "doc_id bigint, text string, token string, id string"
BYTES, WORDS = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"


def odd_texts(n, seed=1):
    dice = random.Random(seed)
    pools = [lambda: chr(dice.randrange(1, 0xD800)), lambda: dice.choice("abcAB'sS dt0123 \n\t  !?.,"),
             lambda: dice.choice(["<|endoftext|>", "<|startoftext|>", "'ll", "ΑΣ ", " \n ", "<|endof", "\x1c", "\x85", "　", "́", "꟏"])]
    return [None, "", "a" * 40_000] + ["".join(dice.choice(pools)() for _ in range(dice.randrange(60))) for _ in range(n)]


def docs(frame, texts):
    return frame([(i, t, "t", "i") for i, t in enumerate(texts)], DOCS)


@pytest.mark.skipif(not Path(BYTES).exists(), reason="no vocabulary files")
def test_tokens_equal_the_library(frame):
    from tokenizers import Tokenizer

    texts = odd_texts(2_000)
    table, plain = docs(frame, texts), [t or "" for t in texts]
    library = Tokenizer.from_file(BYTES)
    ids = [e.ids for e in library.encode_batch(plain, add_special_tokens=False)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in bpe_codec.round_trip(table, BYTES).collect()}
    for i, x in enumerate(ids):
        want = (i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False)))
        assert tuple(got[i]) == want, repr(texts[i])
    encoded = bpe_codec.encode(table, BYTES)
    assert {r.doc_id: r.ids for r in encoded.collect()} == dict(enumerate(ids))
    assert {r.doc_id: r.text for r in bpe_codec.decode(encoded, BYTES).collect()} == dict(enumerate(plain))
    counts = [len(e.ids) for e in Tokenizer.from_file(WORDS).encode_batch(plain, add_special_tokens=False)]
    have = {r.doc_id: tuple(r) for r in token_counts.token_counts(table, WORDS, 10).collect()}
    assert have == {i: (i, len(plain[i].encode()), n, n > 10) for i, n in enumerate(counts)}
    assert bpe_codec.round_trip(table.limit(0), BYTES).count() == token_counts.token_counts(table.limit(0), WORDS, 10).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, label))]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(frame, seed):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "Only four words here", "only FOUR words\nhere", "five words are just enough"]
    passage = " ".join(dice.choices(vocabulary, k=30))
    for _ in range(6):
        base = dice.choices(vocabulary, k=dice.choice([12, 60, 150]))
        for _ in range(8):
            copy = list(base)
            for _ in range(dice.randrange(5)):
                copy[dice.randrange(len(copy))] = dice.choice(vocabulary)
            texts.append(" ".join(copy[dice.randrange(3):]))
        texts.append(passage + " " + " ".join(dice.choices(vocabulary, k=40)))
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs(frame, texts)).collect())
    assert got == brute_components(texts)
    kept = jaccard_join.keep_first(docs(frame, texts))
    assert kept.columns == ["doc_id", "text", "token", "id"] and {r.doc_id for r in kept.collect()} == {c for _, _, c in got}


def test_a_node_does_not_prune_what_its_members_need(frame):
    """Whatever pair of members may link by its own first tokens, the nodes they stand in may link."""
    node = "struct<low: bigint, high: bigint>"
    least = lambda n: -(-75 * n // 100)
    rows = [(3, (26, 26), (27, 28))]
    for high in range(20, 61):
        for n in (high - 1, high):
            for m in range(least(n), n * 100 // 75 + 1):
                times = next(k for k in range(1, 99) if any(
                    (k + least(a) - 1) * 175 >= (n + m) * 75 for a in (n, m)))
                rows += [(times, (high - 1, high), (m, m)), (times, (m, m), (high - 1, high)), (times, (high - 1, high), (m, m + 1))]
    df = frame(rows, f"times bigint, a {node}, b {node}")
    assert df.filter(~jaccard_join._enough("times", "a", "b", 75)).collect() == []
    single = frame([(3, (28, 28), (26, 26))], f"times bigint, a {node}, b {node}")
    assert single.filter(jaccard_join._enough("times", "a", "b", 75)).isEmpty()


def test_jaccard_join_of_nothing(frame):
    assert jaccard_join.jaccard_components(docs(frame, []).limit(0)).count() == 0
    rows = frame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard_join.jaccard_components(rows).collect()), key=str)
    assert got == [(3, 2, 3), (3, 2, 3), (None, 2, None)]


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><a href="/">Home</a></header>
<nav><ul><li><a href=x>Menu</a><li><a href=y>More</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="main"><article><h1>Head &amp; line</h1><p>First <b>bo</b>ld&nbsp;text of a paragraph that goes on.<p>Second<br>line, with <a href=z>a link</a>.
<form><input value=q>Search</form></article><section class="comments"><p>Nice article, thank you for it!</p></section></div>
<aside>Side</aside><footer>Foot</footer></body></html>"""


def test_html(frame):
    want = "Head & line First bold text of a paragraph that goes on. Second line, with a link."
    assert html_extract.main_text(PAGE) == want
    assert [html_extract.main_text(x) for x in (None, "", "<p>", "<nav>x</nav>", "plain &lt;text", "<p>a<p>b")] == ["", "", "", "", "plain <text", "a b"]
    deep = "<div>" * 3000 + "<p>deep text</p>" + "<p>more text</p>"
    assert html_extract.main_text(deep) == "deep text more text"
    rows = frame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x")], "page_id bigint, url string, html string, text string")
    assert sorted(tuple(r) for r in html_extract.extract_text(rows).fillna("").collect()) == [(1, "u", want, len(want))] * 2 + [(2, "", "", 0)]


LONG = "A sentence of the main text with a good number of words in it, and some more of them. " * 3


def test_html_without_an_article_element():
    nav = '<nav><a href=x>Menu</a></nav><div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div>'
    text, more = f"<p>{LONG}1<p>{LONG}2", f"<p>{LONG}3<p>{LONG}4<p>{LONG}5"
    flat = lambda *x: " ".join(" ".join(x).split())
    heading = f"<body>{nav}<div id=content><h1>Title</h1><div class=text>{text}</div></div><footer>f</footer></body>"
    assert html_extract.main_text(heading) == flat("Title", LONG + "1", LONG + "2")
    parts = f"<body>{nav}<div id=content><h1>Title</h1><div>{text}</div><blockquote>Quote.</blockquote><div>{more}</div></div></body>"
    want = flat("Title", LONG + "1", LONG + "2", "Quote.", LONG + "3", LONG + "4", LONG + "5")
    assert html_extract.main_text(parts) == want


def test_html_in_layout_wrappers():
    want = " ".join(LONG.split())
    for name in ("content has-sidebar", "content-sidebar-wrap", "post social-enabled", "widget"):
        for tag in ("article", "div"):
            page = f"<body><div class='{name}' id=x><{tag}><p>{LONG}</p></{tag}><div class='sidebar'>Side text</div></div></body>"
            assert html_extract.main_text(page) == want, (name, tag)
    page = f"<body><article><p>{LONG}</p><div class='related-posts'><article>Teaser</article></div></article><div class=comments><p>{LONG * 9}</p></div></body>"
    assert html_extract.main_text(page) == want


def test_warc_round_trip_and_salvage(spark, frame, tmp_path):
    rows = [(1, "http://a/é b", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\nnot a record"), (6, "u", "é" * 9_000_000)]
    pages = frame([(*r, "x") for r in rows], "page_id bigint, url string, html string, payload string").repartition(2)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    got = {r.page_id: tuple(r) for r in warc.records(warc.read_archives(spark, path)).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        later = {1: 2, 3: 4}.get(i)
        assert got[i] == (i, len(body), digest, "revisit" if later else "response", later)
    files = sorted(Path(path).glob("part-*"))
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)  # members in a row: an ordinary .gz
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == 6
    members = [warc.member(warc.record(i, "u", b"p%d" % i, None, "d"), 6) for i in range(5)]
    damaged = bytearray(b"".join(members))
    at = len(members[0]) + 20
    damaged[at] ^= 0xFF
    found = list(warc.salvage(bytes(damaged)))
    assert [(x.get("page_id"), bool(x.get("gap"))) for x in found] == [(0, False), (None, True), (2, False), (3, False), (4, False)]
    assert (found[1]["start"], found[1]["length"]) == (len(members[0]), len(members[1]))
    plain = b"".join(warc.record(i, "u", b"p%d" % i, None, "d") for i in range(3))
    cut = plain[:60] + plain[70:]
    assert [x.get("page_id") for x in warc.salvage(cut)] == [None, 1, 2] and list(warc.salvage(b"")) == []
    assert warc.read_archives(spark, path).filter("gap is not null").count() == 0


def test_language_model(frame):
    dice = random.Random(3)
    chain = {w: dice.choices([f"w{i}" for i in range(40)], k=2) for w in [f"w{i}" for i in range(40)]}

    def text():
        w, out = "w0", []
        for _ in range(dice.randrange(5, 80)):
            w = dice.choice(chain[w])
            out.append(w)
        return " ".join(out)

    texts = [None, "", "Never SEEN words"] + [text() for _ in range(400)]
    got = {r.doc_id: r for r in lm_scoring.lm_score(docs(frame, texts)).collect()}
    folds = lm_scoring.held_out(range(len(texts)))
    from collections import Counter
    c = Counter(t for i, x in enumerate(texts) if not folds[i] for t in lm_scoring.tokens(x))
    n, v = sum(c.values()), len(c)
    for i, x in enumerate(texts):
        found = lm_scoring.tokens(x)
        want = sum(np.log10((c[t] + 1) / (n + v + 1)) for t in found)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (folds[i], len(found), sum(t in c for t in found), n)
        assert abs(r.base_score - want) < 1e-9 * max(1, abs(want)) and r.score < 0
    out = [r for i, r in got.items() if folds[i]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # a chain of words is better than their counts
    assert lm_scoring.lm_score(docs(frame, []).limit(0)).count() == 0


def test_gradients_and_states():
    small = {"STATE": 5, "CLASSES": 4, "CLASS_SIZE": 6, "VOCABULARY": 24, "WINDOW": 3}
    before = {k: getattr(lm_scoring, k) for k in small}
    try:
        vars(lm_scoring).update(small)
        dice = np.random.default_rng(0)
        w = {k: dice.standard_normal(s) * .5 for k, s in lm_scoring.shapes().items()}
        x, y, mask = dice.integers(0, 24, (3, 4)), dice.integers(0, 24, (3, 4)), dice.random((3, 4)) > .2
        _, grads = lm_scoring.gradients(w, x, y, mask)
        for k in w:
            i = tuple(dice.integers(0, d) for d in w[k].shape)
            old, ends = w[k][i], []
            for e in (1e-5, -1e-5):
                w[k][i] = old + e
                ends.append(lm_scoring.gradients(w, x, y, mask)[0])
            w[k][i] = old
            assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][i]) < 1e-7
        # Documents of several windows score as token after token does.
        lengths = [1, 8, 3, 7]
        ids = dice.integers(1, 24, sum(lengths))
        starts = np.concatenate([[0], np.cumsum(lengths)])
        for got, a, b in zip(lm_scoring.score(w, ids, starts, 2), starts, starts[1:]):
            h, last, want = np.zeros((1, 5)), 2, 0.0
            for t in ids[a:b]:
                h = lm_scoring.step(w, np.array([last]), h)[0]
                want += lm_scoring.log_probs(w, h, np.array([t]))[0]
                last = t
            assert abs(got - want) < 1e-4
    finally:
        vars(lm_scoring).update(before)


def test_training_sees_every_token_and_carries_the_state(frame, monkeypatch):
    """Every target of the training documents is trained on once, and windows begin with the state of the one before."""
    size = 70_000
    texts = ["", "a b c", " ".join(f"v{k % 50}" for k in range(200)), " ".join(f"u{k % 70}" for k in range(size))] * 4
    rows = frame([(i, str(i), t) for i, t in enumerate(texts)], "doc_id bigint, doc_key string, text string")
    entry = {w: i + 1 for i, w in enumerate([lm_scoring.END, *(f"{c}{k}".encode() for c in "uv" for k in range(70)), b"a", b"b", b"c"])}
    runs = {r.doc_key: r for r in lm_scoring._runs(rows, entry).collect()}
    folds = lm_scoring.held_out([str(i) for i in range(len(texts))])
    assert set(runs) == {str(i) for i in range(len(texts)) if not folds[i]} and 0 < folds.sum() < len(texts)
    for i in np.flatnonzero(~folds):
        own, found = np.frombuffer(runs[str(i)].run, "<u2"), lm_scoring.tokens(texts[i])
        assert own.tolist() == [entry[t] for t in [lm_scoring.END, *found]] and runs[str(i)].n == -(-len(found) // lm_scoring.WINDOW)

    inner, steps = lm_scoring.sparse_gradients, []

    def watched(w, x, y, mask, states):
        before = states.copy()
        out = inner(w, x, y, mask, states)
        steps.append((before, states.copy(), [y[i][mask[i]].tolist() for i in range(len(y))]))
        return out

    monkeypatch.setattr(lm_scoring, "sparse_gradients", watched)
    monkeypatch.setattr(lm_scoring, "BATCH", 2)
    weights = lm_scoring.start(np.ones(lm_scoring.VOCABULARY))
    lm_scoring.train(weights, [np.arange(1, 102), np.arange(101, 301), np.arange(301, 304)])
    assert sorted(t for *_, ys in steps for y in ys for t in y) == [*range(2, 102), *range(102, 301), 302, 303]
    assert not steps[0][0].any() and steps[0][1].all()
    assert (steps[1][0] == steps[0][1]).all() and (steps[2][0] == steps[1][1]).all()
    # the longest run has the first lane; the shortest takes over the second
    assert steps[4][2][1] == [302, 303] and not steps[4][0][1].any() and (steps[4][0][0] == steps[3][1][0]).all()


def test_sparse_steps_equal_dense_ones(monkeypatch):
    """Weights whose gradient is zero stay as they are, to the bit."""
    dice = np.random.default_rng(3)
    start, run = lm_scoring.start(np.ones(lm_scoring.VOCABULARY)), dice.integers(0, 300, 90)
    got = lm_scoring.train(start, [run])
    want, seen, states = {k: v.copy() for k, v in start.items()}, {k: np.full(v.shape, lm_scoring.SEEN, v.dtype) for k, v in start.items()}, np.zeros((1, lm_scoring.STATE), np.float32)
    for a in range(0, 89, lm_scoring.WINDOW):
        b = min(a + lm_scoring.WINDOW, 89)
        _, grads = lm_scoring.gradients(want, run[None, a:b], run[None, a + 1:b + 1], np.ones((1, b - a), bool), states)
        for k, g in grads.items():
            seen[k] += g * g
            want[k] -= np.float32(lm_scoring.RATE) * g / np.sqrt(seen[k])
    assert all((got[k] == want[k]).all() for k in got)


def test_the_network_beats_word_counts(spark):
    """On held-out texts of a language with an order, the network's score is above the base score."""
    texts = [" ".join(f"w{(s + 3 * k) % 40}" for k in range(60)) for s in range(40)] * 12
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = lm_scoring.lm_score(rows).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.9 * got["sum(base_score)"]


def test_gradients_from_a_carried_state():
    dice = np.random.default_rng(4)
    w = {k: dice.standard_normal(s) * .3 for k, s in lm_scoring.shapes().items()}
    x, y, h = dice.integers(0, 99, (3, 4)), dice.integers(0, 99, (3, 4)), dice.standard_normal((3, lm_scoring.STATE))
    mask = np.ones((3, 4), bool)
    _, grads = lm_scoring.gradients(w, x, y, mask, h.copy())
    for k, i in [("state", (2, 5)), ("candidate", (3,)), ("inputs", (x[1, 2], 7))]:
        ends = []
        for e in (1e-5, -1e-5):
            w[k][i] += e
            ends.append(lm_scoring.gradients(w, x, y, mask, h.copy())[0])
            w[k][i] -= e
        assert abs((ends[0] - ends[1]) / 2e-5 - grads[k][i]) < 1e-7
