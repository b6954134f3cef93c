"""Whitening, ranked search and personal data against numpy, plain loops and the patterns themselves; pages and archives as others write them."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from reamwork.llm import html_extract, private_data, quality_rules, ranked_search, warc, whitening

VECTORS = "vec_id bigint, embedding array<float>, component string, x int"


def vectors(frame, rows):
    return frame([(i, v, "c", 1) for i, v in rows], VECTORS)


def by_eigh(rows, k):
    """Ids, deviations, projections up to sign, shares: from the whole covariance matrix."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(0)
    off = n * x - sums
    centred = off.astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return [i for i, _ in kept], [int(s) for s in (off ** 2).sum(1)], centred @ axes / np.sqrt(values), values / (centred ** 2).sum() * n


@pytest.mark.parametrize("d, k", [(5, 3), (40, 8), (90, 4)])
def test_whitening_equals_the_eigenvectors(frame, d, k):
    dice = np.random.default_rng(d)
    x = (dice.standard_normal((300, d)) * np.linspace(3, .2, d)) @ np.linalg.qr(dice.standard_normal((d, d)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)] + [
        (900, None), (901, []), (902, [float("nan")] * d), (903, [None] * d), (904, [float("inf")] * d), (905, [1.0]), (None, [0.5] * d), (7, [0.25] * d)]
    good = [r for r in rows if r[1] and len(r[1]) == d]
    ids, deviations, want, shares = by_eigh(good, k)
    got = whitening.whiten(vectors(frame, rows), components=k).collect()
    assert len(got) == len(ids) * k and {r.n for r in got} == {len(ids)}
    assert max(r.identity_error for r in got) < 1e-9
    per = {}
    for r in got:
        per.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    for c in range(k):
        have = np.array([per[i, s][c + 1].whitened for i, s in zip(ids, deviations)])
        assert min(np.abs(have - want[:, c]).max(), np.abs(have + want[:, c]).max()) < 1e-6
        assert abs(per[ids[0], deviations[0]][c + 1].explained - shares[c]) < 1e-9


def test_whitening_of_few_directions(frame):
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    got = whitening.whiten(vectors(frame, line)).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and abs(sum(r.whitened ** 2 for r in got) / 9 - 1) < 1e-9
    assert whitening.whiten(vectors(frame, [(1, [2.0, 2.0])] * 4)).count() == 0
    assert whitening.whiten(vectors(frame, [(1, None)])).count() == whitening.whiten(vectors(frame, [])).count() == 0


def test_block_grows_where_the_spectrum_has_no_gap():
    dice = np.random.default_rng(1)
    axes = np.linalg.qr(dice.standard_normal((120, 120)))[0]
    spectrum = np.concatenate([[9, 8, 7], np.full(117, 1.0) + np.linspace(0, 1e-9, 117)])
    matrix = axes * spectrum @ axes.T
    values, found = whitening.leading(lambda q: matrix @ q, 120, 5)
    assert np.allclose(values, [9, 8, 7, 1, 1], atol=1e-8) and np.abs(matrix @ found - found * values).max() < 1e-11


def test_lower_bound_is_below_the_spectrum():
    dice = np.random.default_rng(2)
    axes = np.linalg.qr(dice.standard_normal((60, 60)))[0]
    matrix = axes * np.linspace(3, 20, 60) @ axes.T
    lanczos = whitening.Lanczos(dice.standard_normal(60))
    for _ in range(12):
        lanczos.step(matrix @ lanczos.basis[-1])
    assert 2 < lanczos.lower_bound() <= 3.05


# --- ranked search -------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k=10):
    fold = lambda t: TERM.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    counted = [(i, Counter(fold(t))) for i, t in docs if fold(t)]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in set(items):
        scores = []
        for doc, c in counted:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in fold(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc))
        out |= {(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores)[:k], 1)}
    return out


def corpus(seed, n):
    dice = random.Random(seed)
    words = ["the", "The", "a", "É", "x-1", "sélé", "42", "", "rare"] + [f"w{int(dice.paretovariate(.6))}" for _ in range(300)]
    texts = [" ".join(dice.choice(words) for _ in range(dice.randrange(1, 60))) for _ in range(n)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, "--- !"), (None, texts[0]), (5, texts[5]), (n + 3, texts[0]), (n + 4, "long " * 3000)]
    items = [(i, " ".join(dice.choice(words) for _ in range(dice.randrange(1, 25)))) for i in range(25)] + [(90, None), (91, "?"), (92, "nowhere"), (1, "the"), (93, "the the A")]
    return docs, items + items[:3]


@pytest.mark.parametrize("seed, n, settings", [
    (1, 400, {}), (2, 40, {"term_bytes": 0}), (3, 150, {"broadcast_bytes": 0}), (4, 700, {"k": 3}),
])
def test_ranked_search_equals_plain_scores(frame, monkeypatch, seed, n, settings):
    monkeypatch.setattr(ranked_search, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 2_000)
    docs, items = corpus(seed, n)
    table = frame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, rank int, item_id string").repartition(3)
    asked = frame([(i, t, 9) for i, t in items], "item_id bigint, text string, doc_id int")
    got = ranked_search.ranked_search(table, asked, **settings).collect()
    want = plain_search(docs, items, settings.get("k", 10))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_search_of_empty_tables_and_text_ids(frame):
    docs = frame([("d1", "a b"), ("d2", "a")], "doc_id string, text string")
    asked = frame([("q", "a")], "item_id string, text string")
    assert {(r.item_id, r["rank"], r.doc_id) for r in ranked_search.ranked_search(docs, asked).collect()} == {("q", 1, "d2"), ("q", 2, "d1")}
    assert ranked_search.ranked_search(docs.limit(0), asked).count() == ranked_search.ranked_search(docs, asked.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_of_shard_against_dense_sums(seed, monkeypatch):
    monkeypatch.setattr(ranked_search, "STRIDE", 16)
    dice = np.random.default_rng(seed)
    for _ in range(40):
        n, dense, lists = 500, np.zeros(500, np.int64), []
        for _ in range(dice.integers(1, 12)):
            docs = np.flatnonzero(dice.random(n) < dice.choice([.005, .02, .2, .9]))
            scores = dice.integers(1, dice.choice([3, 1000]), len(docs))
            dense[docs] += scores
            lists.append((docs.astype(np.int64), scores.astype(np.int64)))
        docs, scores = ranked_search.best_of_shard(lists, n, 10)
        least = max(1, np.sort(dense)[-10])
        assert sorted(zip(docs.tolist(), scores.tolist())) == [(i, int(s)) for i, s in enumerate(dense) if s >= least]


# --- personal data -------------------------------------------------------------------------------------

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(only(m.group())) <= 19 and private_data.luhn(only(m.group()))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(only(m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    dice = random.Random(1)
    parts = ["a", "@", "a.b", ".", "1", "23", "255", "0256", "4565410125667261", "4565 4101 2566 7261", " ", "-", "+", "(", "é", "\n", "1.2.3.4", "%", "+1 (988) 555-2485"]
    for _ in range(20_000):
        text = "".join(dice.choice(parts) for _ in range(dice.randrange(14)))
        assert private_data.base_spans(text) == plain_spans(text), text


def test_hostile_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1 " * 100_000, "@" * 300_000, "1 " * 150_000, "+1" + " " * 300_000):
        field = private_data.Field()
        field.add(text, private_data.base_spans(text))


def training_texts():
    dice = random.Random(8)
    number = lambda: "".join(dice.choice("0123456789") for _ in range(15))
    cards = []
    while len(cards) < 60:
        n = "4" + number()
        if private_data.luhn(n):
            cards.append(n)
    pick = [lambda: f"mail {dice.choice(['bo', 'ana.li', 'x7'])}.{dice.randrange(99)}@mail{dice.randrange(9)}.example.com",
            lambda: ".".join(str(dice.randrange(1, 255)) for _ in range(4)), lambda: dice.choice(cards),
            lambda: f"+1 ({dice.randrange(200, 999)}) 555-{dice.randrange(1000, 9999)}", lambda: f"version {dice.randrange(9)}.{dice.randrange(9)}",
            lambda: f"in {dice.randrange(1900, 2030)}", lambda: "AKIA" + number()]
    words = "the and of with some then plain words go on here".split()
    return [" ".join(dice.choice(words) if dice.random() < .8 else dice.choice(pick)() for _ in range(40)) for _ in range(250)], cards


def test_the_field_finds_what_the_patterns_miss(frame):
    texts, cards = training_texts()
    card = cards[0]
    probes = [
        f"call +1 (359) 555-3724 {card} now",  # two numbers that the patterns take for one
        f"paid {card} 73.201.118.2 then", "call +1 (988) 555-2485 or (988) 555-2485 here",
        "see version 3.1 in 1999 with 25 words", "plain words", "", None, f"and {card[:-1]}{(int(card[-1]) + 1) % 10} of"]
    rows = [(i, t, "x") for i, t in enumerate([*probes, *texts])] + [(None, probes[0], "x"), (2, probes[2], "x")]
    table = frame(rows, "doc_id bigint, text string, spans string")
    found = {}
    for r in private_data.private_spans(table).collect():
        found.setdefault(r.doc_id, []).append(r)
    kinds = lambda r, text: [(s.kind, text[s.start:s.end]) for s in r.spans if s.added]
    assert kinds(found[0][0], probes[0]) == [("card", card), ("phone", "+1 (359) 555-3724")]
    assert found[0][0].redacted == "call [PHONE] [CARD] now" and found[None][0].spans == found[0][0].spans
    assert kinds(found[1][0], probes[1]) == [("card", card)] and kinds(found[2][0], probes[2]) == [("phone", "(988) 555-2485")] and len(found[2]) == 2
    assert all(not found[i][0].spans and found[i][0].redacted == probes[i] for i in (3, 4, 5, 6, 7))
    digest = {(r.doc_id, r.n_phone): r for r in private_data.private_digest(table).collect()}
    for i, text in enumerate([*probes, *texts]):
        base = plain_spans(text or "")
        listed = ",".join(f"{private_data.KINDS[k]}:{a}:{b}" for k, a, b in base)
        r = digest[i, sum(k == 3 for k, *_ in base)]
        assert (r.n_email, r.n_ip, r.n_card) == tuple(sum(k == j for k, *_ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_no_texts_and_no_numbers(frame):
    empty = frame([], "doc_id bigint, text string")
    assert private_data.private_digest(empty).count() == 0
    only = private_data.private_digest(frame([(1, "no numbers"), (2, "just 5")], "doc_id bigint, text string")).collect()
    assert all((r.spans, r.n_added, r.n_ip) == ("", 0, 0) for r in only)


def test_beliefs_equal_all_labellings():
    """On a chain, loopy propagation is exact."""
    dice = np.random.default_rng(5)
    own, pair = dice.standard_normal((3, private_data.LABELS)), dice.standard_normal((2, private_data.LABELS, private_data.LABELS))
    edges = np.array([(0, 1), (1, 2)])
    got = np.exp(private_data.beliefs(own, edges, np.array([0, 1]), pair)[0])
    whole = np.exp(own[0][:, None, None] + own[1][None, :, None] + own[2][None, None, :] + pair[0][:, :, None] + pair[1][None, :, :])
    whole /= whole.sum()
    assert np.allclose(got, [whole.sum((1, 2)), whole.sum((0, 2)), whole.sum((0, 1))])


# --- the salvaging reader, the article finder -----------------------------------------------------------


def a_record(headers, block, version="WARC/1.0"):
    lines = [version, *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_valid_records_of_other_writers_are_kept():
    http = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nbody"
    sha = hashlib.sha256(b"body").hexdigest()
    one = hashlib.sha1(b"body")
    b32 = base64.b32encode(one.digest()).decode()
    kinds = [f"sha256:{sha}", f"SHA1:{b32}", f"sha1:{b32.lower()}", f"sha-1:{one.hexdigest()}", "blake3:abc", f"md5:{hashlib.md5(b'body').hexdigest()}"]
    records = [a_record(["WARC-Type: response", f"WARC-Record-ID: <urn:page:{i}>", f"WARC-Payload-Digest: {k}"], http, "WARC/0.18" if i % 2 else "WARC/1.1")
               for i, k in enumerate(kinds)]
    records += [a_record(["WARC-Type: revisit", "WARC-Record-ID: <urn:page:6>", "WARC-Refers-To: <urn:page:1>", f"WARC-Payload-Digest: sha1:{one.hexdigest()}"], b""),
                a_record(["WARC-Type: response", "WARC-Record-ID: <urn:page:7>", "Content-Type: text/dns"], b"no headers here"),
                a_record(["WARC-Type: warcinfo"], b"software: x\r\n")]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records[:4])) + b"".join(records[4:])):
        found = list(warc.salvage(data))
        assert [r.get("page_id") for r in found] == [*range(8), None] and not any(r.get("gap") for r in found)
        assert {r["payload_digest"] for r in found[:7]} == {b32} and found[6]["payload_bytes"] is None and found[7]["payload"] == b"no headers here"
        assert sum(r["length"] for r in found) == len(data)
    wrong = a_record(["WARC-Type: response", "WARC-Payload-Digest: sha256:" + "0" * 64], http)
    inside = list(warc.salvage(gzip.compress(records[0] + wrong + records[1])))
    assert [(r.get("page_id"), bool(r.get("gap"))) for r in inside] == [(0, False), (None, True), (1, False)]
    assert [bool(r.get("gap")) for r in warc.salvage(wrong + records[0])] == [True, False]


def test_search_after_damage_is_linear():
    for data in (b"WARC/1.0\r\n" * 60_000, b"WARC/1.0\r\nContent-Length: 99999999\r\n\r\n" * 30_000, warc.MAGIC * 60_000, (b"WARC/1.0\r\n" + warc.MAGIC) * 30_000):
        began = time.process_time()
        found = list(warc.salvage(data))
        assert [r["length"] for r in found] == [len(data)] and time.process_time() - began < 20


TEXT = "A sentence of the main text with a good number of words in it, and some more of them. " * 3
FLAT = " ".join(TEXT.split())


@pytest.mark.parametrize("page, want", [
    (f"<form><article><h1>T</h1><p>{TEXT}</p></article></form>", f"T {FLAT}"),
    (f"<body><form id=form1><input><div><p>{TEXT}</p><p>{TEXT}</p></div></form><div>foot</div></body>", f"{FLAT} {FLAT}"),
    (f"<dialog open><article><p>{TEXT}</p></article></dialog>", FLAT), (f"<div aria-hidden=true><p>{TEXT}</p></div>", FLAT),
    (f"<div role=form><main><p>{TEXT}</p></main></div>", FLAT),
    (f"<body><div id=main><header><h1>Title</h1></header><p>{TEXT}</p><p>{TEXT}</p></div></body>", f"Title {FLAT} {FLAT}"),
    (f"<article><p>{TEXT}</p></article><form><p>{TEXT * 4}</p></form>", FLAT), (f"<p>{TEXT}</p><form><p>Sign in</p></form>", FLAT),
    ("<form><label>User</label><input></form>", ""), (f"<header><p>{TEXT}</p></header><p>{TEXT}</p>", FLAT),
])
def test_pages_inside_forms_and_dialogs(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize("make", [
    lambda n: "<a " * n, lambda n: "<div>" * n + "</span>" * n, lambda n: "<ul>" * n, lambda n: "<header>" * n, lambda n: f"<a {'b' * n}>", lambda n: '<a "' * n,
    lambda n: "<script>" + "</script " * n, lambda n: "<p><div>" * n, lambda n: "<dd><dl>" * n + "<dt>" * n, lambda n: f"<a {'b=' * n}>", lambda n: "<form>" * n])
def test_hostile_pages_take_linear_time(make):
    began = time.process_time()
    html_extract.main_text(make(50_000))
    assert time.process_time() - began < 10


def test_density_sums_equal_a_plain_recursion():
    dice = random.Random(4)

    def grow(depth):
        return "".join(dice.choice(["word " * dice.randrange(9), f"<a>{'link ' * dice.randrange(3)}</a>", f"<div>{grow(depth + 1)}</div>" if depth < 5 else "x"])
                       for _ in range(dice.randrange(5)))

    for _ in range(60):
        tree = html_extract.read_tree(f"<body>{grow(0)}</body>")
        n = len(tree.tag)
        children = [[i for i in range(1, n) if tree.parent[i] == p] for p in range(n)]
        under = lambda i: [i, *(k for c in children[i] for k in under(c))]  # noqa: B023, E731
        linked = lambda i: i > 0 and (tree.tag[i] == "a" or linked(tree.parent[i]))  # noqa: B023, E731
        size = lambda i, only: sum(len("".join(t.split())) for k, t in tree.shown if t and k in set(under(i)) and (not only or linked(k)))  # noqa: B023, E731
        whole, links = max(size(0, False), 1), size(0, True)

        def density(i):
            c, lc, below = size(i, False), size(i, True), under(i)[1:]  # noqa: B023
            t, lt = max(len(below), 1), max(sum(tree.tag[k] == "a" for k in below), 1)  # noqa: B023
            if not c:
                return 0.0
            base = math.log(c / max(c - lc, 1) * lc + links / whole * c + math.e)  # noqa: B023
            inner = c / max(lc, 1) * t / lt
            return c / t * (math.log(inner) / math.log(base) if base > 1.0001 and inner > 1 else 1.0)

        got, total, *_ = html_extract.densities(tree)
        assert got[1:] == pytest.approx([density(i) for i in range(1, n)]) and total == pytest.approx([sum(map(density, c)) for c in children])


def test_no_language_is_thrown_out_for_its_words(frame):
    polish = "Wczoraj wieczorem spotkaliśmy dawnych przyjaciół przy starym moście obok rzeki i rozmawialiśmy długo o podróżach, książkach, muzyce oraz pogodzie nad morzem"
    russian = "Вчера вечером мы встретили старых друзей у моста возле реки и долго говорили о книгах, музыке, поездках, детстве, море и погоде в нашем городе"
    junk = " ".join(f"qx{i}zt" for i in range(40))
    rows = [(1, polish, "pl"), (2, russian, "ru"), (3, junk, "en"), (4, junk, "EN-gb"), (5, polish, None), (6, junk, "xx")]
    table = frame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(table).collect()}
    assert [got[i].kept for i in range(1, 7)] == [True, True, False, False, True, True] and all(got[i].few_stop_words for i in (2, 3, 4, 6))
    assert {r.doc_id for r in quality_rules.keep_good(table).collect()} == {1, 2, 5, 6}
    assert quality_rules.keep_good(table.drop("lang")).count() == 6 and quality_rules.keep_good(table.drop("lang")).columns == ["doc_id", "text"]
