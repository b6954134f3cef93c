"""Personal data in texts: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Patterns give the base spans (e-mail, IP address, card, phone), which always stay. The field then labels all words with a digit or an at
sign ("candidates"); other words are outside by definition, which cuts a text's field into small pieces. Labels are
"outside", and "begins" and "goes on" for each kind. Potentials:

* of a candidate: its shape, digits, check sum, at sign and neighbouring words, hashed to ``FEATURES`` entries;
* of neighbours: candidates with nothing but white space between them;
* of distant candidates that repeat or resemble each other (``likeness``: equal last seven digits, equal name before the at sign,
  else equal words). Each is joined to the next one like it, so a group of n costs n - 1 edges.

Words of base spans are observed with their labels. Loopy belief propagation (``SWEEPS`` rounds of all messages) carries them to the
others: a number that stands beside its country code in one place is found without it in another. A candidate is added with a
belief of ``CERTAIN`` or more; added spans never touch base ones.

The field is trained on the base spans of at most about ``SAMPLE`` texts, chosen by a hash among those with a candidate (a bounded sample, so
that the fit runs in one task; repeated texts count once), by the gradient of the likelihood under the same beliefs. Each text
is given as it is, and followed by itself with its spans written otherwise (no country code, other separators, a bare host, another span or a number
with a wrong check sum beside it) and half of the shapes hidden: so the field learns from neighbours and distant likes. Words of matches that fail for too many digits, as
they may hold two numbers, and words like those of a span are left out; it is those that the field is asked about later. Only the weights reach the driver. Labelling is one pass over the whole table without a shuffle.

Memory of a task is bounded by the candidates of the longest text; patterns and words are found in linear time.

Defined results: null and empty texts have no spans; repeated rows have their own results; null ids stay; an empty table gives an empty one; without any
base span in the table the field stays unused; positions are code points, ends exclusive; further columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2_000
FEATURES = 1 << 12
SWEEPS = 12
STEPS = 80
RATE = 0.3
DECAY = 1e-3
CERTAIN = 0.8
NODES = 20_000
EDGE_ROWS = 1 << 15
NOWHERE = -50.0
SEED = 3

LABELS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k goes on

# --- patterns ---------------------------------------------------------------------------------------------

#: The patterns of the base spans. A look behind keeps a long run of digits from being tried at each of them.
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_DIGITS = re.compile(r"[0-9]+")
_EDGES = "\"'<>[]{},;:!?."


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        if host:
            start = at
            while start > done and not _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                yield start, host.end()
                done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind and start."""
    if not _HINT.search(text):
        return []
    spans = [(0, *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
            spans.append((3, m.start(), m.end()))
    return spans


# --- the field of a text ------------------------------------------------------------------------------


def _shape(word: str) -> str:
    short = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", word[:64])
    return re.sub(r"[^\W\d_]+", "a", short)


def _neighbour(text: str, at: int, step: int) -> str:
    """The letters of the word before or after a place."""
    piece = text[max(0, at - 24):at] if step < 0 else text[at:at + 24]
    words = piece.split()
    return words[0 if step > 0 else -1].strip(_EDGES).lower() if words else ""


def _parts(word: str) -> str:
    """How many numbers of at most 255 stand between dots, if the word is nothing else."""
    parts = word.split(".")
    return str(min(len(parts), 5)) if len(parts) > 1 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts) else ""


def likeness(word: str) -> str | None:
    """What distant candidates must share to be joined; None where a word is too short to tell."""
    if "@" in word:
        return word.split("@")[0].lower() or None
    digits = "".join(_DIGITS.findall(word))
    if len(digits) >= 7:
        return digits[-7:]
    return word.lower() if len(word) >= 5 else None


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Places of the words with a digit or an at sign, marks at their ends left out."""
    for m in _WORD.finditer(text):
        start, end = m.start(), m.end()
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        if start < end:
            yield start, end


def doubtful(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Parts that nothing can be learned from: matches that fail because they may hold more than one number, and words
    that are like one of a span and stand in none."""
    parts = [m.span() for m in _CARD.finditer(text) if not m.group().isdigit() and sum(map(str.isdigit, m.group())) > 16] + [
        m.span() for m in _PHONE.finditer(text) if sum(map(str.isdigit, m.group())) > 15]
    inside, outside, at = set(), [], 0
    covered = sorted((a, b) for _, a, b in spans)
    for start, end in candidates(text):
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        like = likeness(text[start:end])
        if any(a < end and start < b for a, b in covered[at:at + 4]):
            inside.add(like)
        elif like is not None:
            outside.append((like, start, end))
    return parts + [(start, end) for like, start, end in outside if like in inside]


def rewritten(
    text: str, spans: list[tuple[int, int, int]], unsure: list[tuple[int, int]], others: list[tuple[int, str]], dice: np.random.Generator,
) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The text, and once more with its spans written as the patterns do not know them, some of them next to spans of
    earlier texts (``others``, kind and words); the spans of both, and the parts of both that nothing can be learned from."""
    out, kept, left, at, length = [text, "\n"], list(spans), list(unsure), 0, len(text) + 1

    def put(words: str, kind: int | None = None) -> None:
        nonlocal length
        out.append(words)
        if kind is not None:
            kept.append((kind, length, length + len(words)))
        length += len(words)

    for start, end, kind in sorted([(a, b, k) for k, a, b in spans] + [(a, b, -1) for a, b in unsure]):
        if start < at:
            continue
        put(text[at:start])
        found, at = text[start:end], end
        if kind < 0:
            left.append((length, length + len(found)))
            put(found)
            continue
        digits, form = "".join(_DIGITS.findall(found)), dice.integers(4)
        if kind == 0 and form:
            name, _, host = found.partition("@")
            put(f"{name}@{host.split('.')[0]}", kind)
        elif kind == 2 and form:
            put((" ", "", ".", "/")[form].join(digits[i:i + 4] for i in range(0, len(digits), 4)), kind)
        elif kind == 3 and form < 2:
            put(re.sub(r"^\+[0-9]+[^0-9(]*", "", found), kind)
        elif kind == 3:
            own = digits[-10:]
            put((".", "-")[form % 2].join(filter(None, [own[:-7], own[-7:-4], own[-4:]])), kind)
        else:
            put(found, kind)
        if others and dice.integers(3) == 0:
            other, words = others[dice.integers(len(others))]
            put(" ")
            put(words, other)
        others.append((kind, found))
        if kind in (1, 2) and dice.integers(3) == 0:  # looks like one and is none
            put(" x " + (re.sub("[0-9]+$", lambda m: str(256 + int(m.group())), found) if kind == 1 else f"{digits[:-1]}{(int(digits[-1]) + 1) % 10}"))
    return "".join([*out, text[at:]]), kept, left


class Field:
    """Candidates of texts as one graph: places, features, edges (neighbours first, then distant ones), observed labels."""

    def __init__(self) -> None:
        self.places, self.features, self.seen, self.near, self.far = [], [], [], [], []

    def add(self, text: str, spans: list[tuple[int, int, int]], unsure: list[tuple[int, int]] = (), hidden: np.random.Generator | None = None) -> None:
        """The candidates of a text but for those within ``unsure`` parts. With a source of dice, half of the shapes are hidden."""
        starts, covered = set(), sorted((a, b, k) for k, a, b in spans)
        last_end, last_like, at = -1, {}, 0
        for start, end in candidates(text):
            word, label = text[start:end], 0
            while at < len(covered) and covered[at][1] <= start:
                at += 1
            if any(a <= start and end <= b for a, b in unsure):
                continue
            over = [c for c in covered[at:at + 4] if c[0] < end and start < c[1]]
            if over:
                first = min(over, key=lambda c: (c[2], c[0]))
                label = 1 + 2 * first[2] + (first in starts)
                starts.add(first)
            digits = "".join(_DIGITS.findall(word))
            node = len(self.places)
            whole = hidden is None or hidden.random() < 0.5
            near = bool(last_end >= 0) and start - last_end <= 2 and text[last_end:start].isspace()
            kinds = [
                "", f"s{_shape(word)}" if whole else "", f"d{min(len(digits), 20)}", f"l{len(digits)}{luhn(digits)}" if 13 <= len(digits) <= 19 else "",
                f"@{word.count('@')}{'.' in word.partition('@')[2]}", f"p{_neighbour(text, start, -1)}", f"n{_neighbour(text, end, 1)}",
                f"c{near}{any(map(str.isalpha, word))}", f"i{_parts(word)}", f"x{len(_DIGITS.findall(word))}{sorted(set(re.sub('[0-9]', '', word)))[:4]}",
            ]
            self.features.append([zlib.crc32(f"{i}{k}".encode()) % FEATURES for i, k in enumerate(kinds)])
            self.places.append((start, end))
            self.seen.append(label if over else -1)
            if near:
                self.near.append((node - 1, node))
            like = likeness(word)
            if like is not None:
                if like in last_like and last_like[like] != node - 1:
                    self.far.append((last_like[like], node))
                last_like[like] = node
            last_end = end


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def beliefs(own: np.ndarray, edges: np.ndarray, kinds: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log beliefs of the nodes, and what each end of an edge tells without it, after ``SWEEPS`` rounds.

    ``own``: log potentials (nodes, labels); ``edges``: (a, b); ``kinds``: which table of ``pair`` holds for an edge.
    """
    total = own.copy()
    a, b = edges[:, 0], edges[:, 1]
    to_a, to_b = np.zeros((len(edges), LABELS)), np.zeros((len(edges), LABELS))
    for _ in range(SWEEPS if len(edges) else 0):
        from_a, from_b = total[a] - to_a, total[b] - to_b
        for lo in range(0, len(edges), EDGE_ROWS):
            s = slice(lo, lo + EDGE_ROWS)
            table = pair[kinds[s]]
            new_b = _log_sum(from_a[s][:, :, None] + table, 1)
            new_a = _log_sum(from_b[s][:, None, :] + table, 2)
            to_b[s] = new_b - _log_sum(new_b, 1)[:, None]
            to_a[s] = new_a - _log_sum(new_a, 1)[:, None]
        total = own.copy()
        np.add.at(total, a, to_a)
        np.add.at(total, b, to_b)
    return total - _log_sum(total, 1)[:, None], total[a] - to_a, total[b] - to_b


def _graph(field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    features = np.array(field.features, np.int64)
    edges = np.array(field.near + field.far, np.int64).reshape(-1, 2)
    kinds = np.repeat([0, 1], [len(field.near), len(field.far)])
    return features, edges, kinds, np.array(field.seen, np.int64)


def observed(own: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Potentials that leave observed nodes only their label."""
    own = own.copy()
    known = np.flatnonzero(seen >= 0)
    own[known] = NOWHERE
    own[known, seen[known]] = 0
    return own


def train(field: Field) -> np.ndarray:
    """Weights (features, then two tables of label pairs) by adaptive gradient ascent of the likelihood under loopy beliefs."""
    w = np.zeros((FEATURES + 2 * LABELS, LABELS))
    if not field.places:
        return w
    features, edges, kinds, seen = _graph(field)
    truth, n = np.maximum(seen, 0), len(seen)
    squares = np.full(w.shape, 1e-6)
    for _ in range(STEPS):
        pair = w[FEATURES:].reshape(2, LABELS, LABELS)
        own = w[features].sum(1)
        total, from_a, from_b = beliefs(own, edges, kinds, pair)
        error = -np.exp(total)
        error[np.arange(len(truth)), truth] += 1
        slope = np.zeros_like(w)
        for column in features.T:
            np.add.at(slope, column, error)
        for lo in range(0, len(edges), EDGE_ROWS):
            s = slice(lo, lo + EDGE_ROWS)
            both = (from_a[s][:, :, None] + pair[kinds[s]] + from_b[s][:, None, :]).reshape(-1, LABELS * LABELS)
            both = -np.exp(both - _log_sum(both, 1)[:, None])
            e = edges[s]
            both[np.arange(len(e)), truth[e[:, 0]] * LABELS + truth[e[:, 1]]] += 1
            for kind in (0, 1):
                slope[FEATURES + kind * LABELS:FEATURES + (kind + 1) * LABELS] += both[kinds[s] == kind].sum(0).reshape(LABELS, LABELS)
        slope = slope / n - DECAY / n * w
        squares += slope * slope
        w += RATE * slope / np.sqrt(squares)
    return w


def added_spans(field: Field, weights: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first node, kind, start, end) of the spans that the field adds, in order."""
    if not field.places:
        return []
    features, edges, kinds, seen = _graph(field)
    own = observed(weights[features].sum(1), seen)
    belief = np.exp(beliefs(own, edges, kinds, weights[FEATURES:].reshape(2, LABELS, LABELS))[0])
    sure = belief[:, 1::2] + belief[:, 2::2]
    kind = sure.argmax(1)
    goes_on = belief[np.arange(len(seen)), 2 + 2 * kind] > belief[np.arange(len(seen)), 1 + 2 * kind]
    chained = np.zeros(len(seen), bool)
    chained[[b for _, b in field.near]] = True
    out, last = [], -2
    for node in np.flatnonzero((seen < 0) & (sure.max(1) >= CERTAIN)).tolist():
        start, end = field.places[node]
        if last == node - 1 and chained[node] and goes_on[node] and out[-1][1] == kind[node]:
            out[-1] = (*out[-1][:3], end)
        else:
            out.append((node, int(kind[node]), start, end))
        last = node
    return out


# --- the corpus -------------------------------------------------------------------------------------------


def fit(texts: DataFrame) -> np.ndarray | None:
    """Weights from the base spans of a bounded sample of the texts (``text``); None where there are none."""
    import pyarrow as pa

    hinted = texts.filter(F.col("text").rlike("[0-9@]"))
    n = hinted.count()
    if not n:
        return None
    slots = 1 << 40
    share = min(slots, SAMPLE * slots // n)
    sample = hinted.filter(F.pmod(F.xxhash64("text"), F.lit(slots)) < share).select("text").distinct().withColumn("fit", F.lit(0))

    def of_sample(group: pa.Table) -> pa.Table:
        field, dice, found, others = Field(), np.random.default_rng(SEED), 0, []
        for text in sorted(group["text"].to_pylist()):
            spans = base_spans(text)
            found += len(spans)
            unsure = doubtful(text, spans)
            field.add(text, spans, unsure)
            field.add(*rewritten(text, spans, unsure, others, dice), dice)
        return pa.table({"w": pa.array([train(field).tobytes()] if found else [], pa.binary())})

    got = sample.groupBy("fit").applyInArrow(of_sample, "w binary").collect()
    return np.frombuffer(got[0]["w"]).reshape(-1, LABELS) if got else None


def private_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``doc_id, spans, redacted``: spans (kind, start, end, added) by kind and start, and the text with
    each run of touching spans replaced by the kind in capitals in brackets; null texts stay null."""
    import pyarrow as pa

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    weights = fit(rows)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())])

    def redact(value: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
        if not spans:
            return value
        out, at = [], 0
        for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [value[at:a], f"[{KINDS[kind].upper()}]"]
            at = max(at, b)
        return "".join([*out, value[at:]])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            spans: list[list[tuple[int, int, int, bool]]] = []
            field, owner = Field(), []

            def settle_field() -> None:
                for node, kind, a, b in added_spans(field, weights) if weights is not None else ():  # noqa: B023
                    spans[owner[node]].append((kind, a, b, True))  # noqa: B023

            for i, value in enumerate(texts):
                value = value.as_py() or ""
                found = base_spans(value)
                spans.append([(*s, False) for s in found])
                if weights is not None and _HINT.search(value):
                    field.add(value, found)
                    owner += [i] * (len(field.places) - len(owner))
                    if len(owner) >= NODES:
                        settle_field()
                        field, owner = Field(), []
            settle_field()
            ordered = [sorted(s) for s in spans]
            cells = [[{"kind": KINDS[k], "start": a, "end": b, "added": new} for k, a, b, new in s] for s in ordered]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cells, pa.list_(span)), pa.array([redact(t.as_py(), s) if s else t.as_py() for t, s in zip(texts, ordered)], pa.string())],
                ["doc_id", "spans", "redacted"])

    return rows.mapInArrow(
        of_task, f"doc_id {id_type}, spans array<struct<kind:string,start:int,end:int,added:boolean>>, redacted string")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def private_digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: numbers of base spans by kind, the hash of their list, all spans as text, and how many were added."""
    base = F.filter("spans", lambda s: ~s["added"])
    counts = [_number(base, k).alias(f"n_{k}") for k in KINDS]
    return private_spans(df, doc_id, text).select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["added"])).cast("bigint").alias("n_added"))
