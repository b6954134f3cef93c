"""Join of documents whose sets of word shingles are alike, by signature trees.

A document's set holds the hashes of its distinct n-grams of words. Two documents link when their sets'
Jaccard similarity reaches the threshold; the result names the component of every document.

1. Sets with equal content are one class, found by a 128-bit digest; its least document stands for it.
2. A linking pair shares a token among the first ``n - ceil(t n) + 1`` of both sets in any order common to all.
   The order is: tokens that are frequent in a sample of the sets last, else by hash. The sample only makes
   the order good; the result does not depend on it. Each shared token is the root of a signature tree.
3. First links, in rounds: every set is held against that set at an end of its roots with which it shares most of them,
   if it shares enough. Verified links make components, so that near copies by the thousand are one node from then on.
4. Signature trees: below a root stand nodes, the components met there, each with the OR of its members' token bitmaps, their
   range of sizes and their greatest slack (tokens minus bits); below a node its members, with their own. The trees of all
   roots are traversed together: nodes with nodes, then the members of the smaller node with the other node, then those that
   are left with its members. A pair goes on only if its sizes can meet the threshold, the bits both have, plus the lesser
   slack, reach the overlap that the least sizes need, and so does what the number of their common roots allows (nodes, and
   pairs of members at the end). Two nodes meet once, not once a root. Pairs inside one component need no look. A node is a
   partial aggregate, however many members it has.
5. Pairs of members that are left are verified on the sets themselves; their links join components.

No link between different sets is lost: a pruned pair can't reach the threshold, and every other pair that shares a root
is verified or already connected. Text is never shuffled; it is read again for the sets that are verified. A list of ids is
broadcast only up to ``BROADCAST_ROWS`` by count; beyond it the join is an ordinary one.

Defined results: a null or empty text, or one without words, has the empty set and is alone in its component; with fewer words
than a shingle the whole sequence is the one member; null ids take part in nothing and have no component; rows of one id
must be the same document and each get its result; equal texts link; an empty table gives an empty table; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

SHINGLE_WORDS = 5
PERCENT = 75
BITMAP_LONGS = 16
#: One set in so many is looked at for frequent tokens; a token is frequent from so many sets of these on,
#: and the most frequent ones, so many at most, go last in the order.
SAMPLE = 16
FREQUENT = 2
FREQUENT_TOKENS = 1_000_000
BROADCAST_ROWS = 2_000_000
#: Rounds of first links. They only save work: what they leave open, the trees decide.
FIRST_ROUNDS = 2
WORD_CACHE = 400_000

BITS = [f"b{i}" for i in range(BITMAP_LONGS)]
_STEPS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class WordHashes(dict):
    """64-bit hashes of words; a full cache is emptied."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: multiples of its words' hashes, added and mixed."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    take = min(size, n)
    total = np.full(n - take + 1, take, np.uint64)
    for j in range(take):
        step = np.uint64(_STEPS[j % len(_STEPS)] + 2 * (j // len(_STEPS)))
        total += (hashes[j:n - take + 1 + j] ^ (hashes[j:n - take + 1 + j] >> np.uint64(29))) * step
    total ^= total >> np.uint64(32)
    total *= np.uint64(_STEPS[0])
    total ^= total >> np.uint64(29)
    return np.unique(total.view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * BITMAP_LONGS, np.uint8)
    bits[(tokens.view(np.uint64) >> np.uint64(7)) % np.uint64(len(bits))] = 1
    return np.packbits(bits).view(np.int64)


def _near(df: DataFrame) -> DataFrame:
    """For a join: a table of at most BROADCAST_ROWS short rows is broadcast."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """``id, tokens`` of documents (``id, text``)."""
    import pyarrow as pa

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                sets = [shingles(t.as_py(), size) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "tokens"])

    return rows.mapInArrow(made, "id bigint, tokens array<bigint>")


def frequent_tokens(rows: DataFrame, size: int) -> np.ndarray:
    """Tokens of several texts in a sample by text hash, for the order only."""
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    distinct = sample.groupBy("text").agg(F.min("id").alias("id")).select("id", "text")
    counted = _sets(distinct, size).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counted.filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).select("token")
    return np.sort(top.toPandas()["token"].to_numpy(np.int64))


def _described(rows: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``id, n, digest, prefix, bits`` of documents."""
    import pyarrow as pa

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                n, digests, prefixes, bits = [], [], [], []
                for t in part.column(1):
                    tokens = shingles(t.as_py(), size)
                    n.append(len(tokens))
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                    last = np.zeros(len(tokens), bool)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                        last = frequent[at] == tokens
                    ordered = np.concatenate([tokens[~last], tokens[last]])
                    prefixes.append(ordered[:prefix_length(len(tokens), percent)] if len(tokens) else tokens)
                    bits.append(bitmap(tokens))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())),
                     pa.array(bits, pa.list_(pa.int64()))], ["id", "n", "digest", "prefix", "bits"])

    return rows.mapInArrow(made, "id bigint, n bigint, digest binary, prefix array<bigint>, bits array<bigint>")


def components(edges: DataFrame, label: str) -> DataFrame:
    """``v, c``: the least vertex that each vertex of ``a, b`` reaches: labels of neighbours and
    pointer jumping, each round written to the shared folder."""
    both = settle(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")).distinct(), f"{label}-edges")
    labels = settle(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("c")), f"{label}-0")
    number = 0
    while True:
        number += 1
        seen = both.join(labels.select(F.col("v").alias("w"), "c"), "w").groupBy("v").agg(F.min("c").alias("near"))
        lower = labels.join(seen, "v").select("v", "c", F.least("c", "near").alias("d"))
        # The label of a label; it is a vertex, with a label of the last round.
        jumped = lower.join(labels.select(F.col("v").alias("d"), F.col("c").alias("e")), "d")
        new = settle(jumped.select("v", F.least("d", "e").alias("d"), "c"), f"{label}-{number}")
        labels = new.select("v", F.col("d").alias("c"))
        if new.filter("c <> d").isEmpty():
            return labels


def _bound(a: str, b: str, percent: int) -> Column:
    """Whether two nodes (or sets, as nodes of one) can hold a linking pair."""
    shared = sum((F.bit_count(F.col(f"{a}.{x}").bitwiseAND(F.col(f"{b}.{x}"))) for x in BITS[1:]),
                 F.bit_count(F.col(f"{a}.{BITS[0]}").bitwiseAND(F.col(f"{b}.{BITS[0]}"))))
    most = shared + F.least(F.col(f"{a}.slack"), F.col(f"{b}.slack"))
    return (
        (F.col(f"{a}.high") * 100 >= F.col(f"{b}.low") * percent) & (F.col(f"{b}.high") * 100 >= F.col(f"{a}.low") * percent)
        & (most * (100 + percent) >= (F.col(f"{a}.low") + F.col(f"{b}.low")) * percent)
    )


def _enough(times: str, a: str, b: str, percent: int) -> Column:
    """Whether two nodes can hold a linking pair if their members share so many first tokens at most.

    Where the first tokens of one of two sets end, it has only its other tokens left to share, ``ceil(t n) - 1``. That drops by
    almost one against ``t n`` from size to size, so for a node of several sizes ``t n`` stands for it: then the bound is the
    widest for the greatest size of one node and the least size of the other that can still link with it.
    """
    def widest(large: str, small: str) -> Column:
        n = F.col(f"{large}.high")
        m = F.least(n, F.greatest(F.col(f"{small}.low"), F.ceil(n * percent / 100)))
        rest = F.when(F.col(f"{large}.low") == n, (F.ceil(n * percent / 100) - 1) * 100).otherwise(n * percent)
        return (F.col(times) * 100 + rest) * (100 + percent) >= (n + m) * percent * 100

    return widest(a, b) | widest(b, a)


def _placed(met: DataFrame, near: DataFrame | None) -> DataFrame:
    """``token, id, node``: the component of every member of a root."""
    if near is None:
        return met.select("token", "id", F.col("id").alias("node"))
    return met.join(near.withColumnRenamed("v", "id"), "id", "left").select("token", "id", F.coalesce("c", "id").alias("node"))


def _first_pairs(met: DataFrame, near: DataFrame | None, leaves: DataFrame, percent: int, label: str) -> DataFrame:
    """For every set the other with which it shares most roots, of those that stand at the ends of a root:
    the member of its least component and that of its greatest."""
    placed = _placed(met, near)
    ends = placed.groupBy("token").agg(
        F.min(F.struct("node", "id")).alias("low"), F.max(F.struct("node", "id")).alias("high")).filter("low.node <> high.node")
    other = F.when(F.col("node") == F.col("low.node"), F.col("high.id")).otherwise(F.col("low.id"))
    often = placed.join(ends, "token").select("id", other.alias("other")).groupBy("id", "other").agg(F.count(F.lit(1)).alias("times"))
    best = often.groupBy("id").agg(
        F.max_by("other", F.struct("times", -F.col("other"))).alias("other"), F.max("times").alias("times"))
    pairs = best.groupBy(F.least("id", "other").alias("b"), F.greatest("id", "other").alias("a")).agg(F.max("times").alias("times"))
    return settle(
        pairs.join(leaves.alias("x"), F.col("a") == F.col("x.id")).join(leaves.alias("y"), F.col("b") == F.col("y.id"))
        .filter(_bound("x", "y", percent) & _enough("times", "x", "y", percent)).select("a", "b"), label)


def _verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets link."""
    def sets_of(side: str) -> DataFrame:
        wanted = pairs.select(F.col(side).alias("id")).distinct()
        return _sets(rows.join(_near(wanted), "id", "left_semi"), size)

    left = pairs.join(sets_of("a").select(F.col("id").alias("a"), F.col("tokens").alias("s")), "a")
    both = left.join(sets_of("b").select(F.col("id").alias("b"), F.col("tokens").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t"))
    return both.select("a", "b", shared.alias("i"), (F.size("s") + F.size("t")).alias("sum")).filter(
        F.col("i") * (100 + percent) >= F.col("sum") * percent).select("a", "b").distinct()


def jaccard_components(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """Per document: size of its set and component (the least id that links reach)."""
    rows = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    described = settle(_described(rows, size, percent, frequent_tokens(rows, size)), "join-sets")
    base = described.select("id", "n", "digest")
    classes = settle(base.filter("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "join-classes")
    copies = base.filter("n > 0").join(classes, "digest").filter("id <> rep").select("id").distinct()
    reps = described.filter("n > 0 and id is not null").join(_near(copies), "id", "left_anti").dropDuplicates(["id"])
    leaf_columns = [F.col("n").alias("low"), F.col("n").alias("high"), *[F.get("bits", F.lit(i)).alias(b) for i, b in enumerate(BITS)]]
    leaves = reps.select("id", *leaf_columns).withColumn("slack", F.col("low") - sum(
        (F.bit_count(F.col(b)) for b in BITS[1:]), F.bit_count(F.col(BITS[0]))))

    tokens = described.filter("n > 0 and id is not null").join(_near(copies), "id", "left_anti").select("id", F.explode("prefix").alias("token"))
    roots = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token")
    met = settle(tokens.join(roots, "token").select("token", "id"), "join-met")

    near = None
    for k in range(FIRST_ROUNDS):
        pairs = _first_pairs(met, near, leaves, percent, f"join-first-{k}")
        links = _verified(pairs, rows, size, percent)
        links = settle(links if near is None else links.union(near.filter("v <> c").select(F.col("v").alias("a"), F.col("c").alias("b"))), f"join-links-{k}")
        near = components(links, f"join-near-{k}")

    # Signature trees over the components that meet under a root.
    placed = _placed(met, near)
    mixed = placed.groupBy("token").agg(F.min("node").alias("p"), F.max("node").alias("q")).filter("p <> q").select("token")
    under = settle(placed.join(mixed, "token").select("token", "node", "id"), "join-members")
    members = settle(under.select("node", "id").distinct().join(leaves, "id"), "join-leaves")
    nodes = settle(members.groupBy("node").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("slack").alias("slack"), F.count(F.lit(1)).alias("m"),
        *[F.bit_or(b).alias(b) for b in BITS]), "join-nodes")
    stands = under.select("token", "node").distinct()
    meet = stands.select("token", F.col("node").alias("p")).join(stands.select("token", F.col("node").alias("q")), "token").filter("p < q")
    met_nodes = settle(meet.groupBy("p", "q").agg(F.count(F.lit(1)).alias("times")), "join-meet")
    # The node with fewer members, p, is opened first; then its members meet those of q.
    few = F.struct("a.m", "a.node") < F.struct("b.m", "b.node")
    open_nodes = settle(
        met_nodes.join(nodes.alias("a"), F.col("p") == F.col("a.node")).join(nodes.alias("b"), F.col("q") == F.col("b.node"))
        .filter(_enough("times", "a", "b", percent) & _bound("a", "b", percent))
        .select(F.when(few, F.col("p")).otherwise(F.col("q")).alias("p"), F.when(few, F.col("q")).otherwise(F.col("p")).alias("q")), "join-open")
    half_open = open_nodes.join(members.alias("x"), F.col("p") == F.col("x.node")).join(
        nodes.alias("n"), (F.col("q") == F.col("n.node")) & _bound("x", "n", percent))
    found = settle(half_open.join(members.alias("y"), (F.col("q") == F.col("y.node")) & _bound("x", "y", percent)).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b"), "p", "q"), "join-found")
    firsts = reps.select("id", F.col("n").alias("low"), F.col("n").alias("high"), "prefix")
    pairs = settle(
        found.join(firsts.alias("x"), F.col("a") == F.col("x.id")).join(firsts.alias("y"), F.col("b") == F.col("y.id"))
        .withColumn("times", F.size(F.array_intersect("x.prefix", "y.prefix")))
        .filter(_enough("times", "x", "y", percent)).select("a", "b", "p", "q"), "join-pairs")
    links = _verified(pairs.select("a", "b"), rows, size, percent).join(pairs, ["a", "b"])
    far = components(links.select(F.col("p").alias("a"), F.col("q").alias("b")), "join-far")

    named = classes.join(near.select(F.col("v").alias("rep"), F.col("c").alias("near")), "rep", "left").select(
        "digest", F.coalesce("near", "rep").alias("near"))
    named = named.join(far.select(F.col("v").alias("near"), F.col("c").alias("far")), "near", "left").select(
        "digest", F.coalesce("far", "near").alias("component"))
    return base.join(named, "digest", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_first(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one it is named by; with the columns they came with."""
    found = jaccard_components(df, doc_id, text)
    others = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__copy_id")).distinct()
    return df.join(_near(others), F.col(doc_id) == F.col("__copy_id"), "left_anti")
