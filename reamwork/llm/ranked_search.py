"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time over the long ones.

Every document is scored for every item of a query table; integer scores, so that results do not depend on the order of additions.

Work on Spark:

* Index: tasks read whole texts and give shards of about ``SHARD_BYTES`` of text, one row each: document ids and
  lengths, the terms, and their posting lists (documents, counts) packed. Only terms of the items are kept
  where those have at most ``TERM_BYTES``; beyond that all terms are, with the same results.
* The numbers of documents and terms and the document frequencies are aggregates over the shards; the items' terms meet the frequencies
  by a join. Items are dealt into blocks of about ``BLOCK_BYTES``.
* Each shard meets each block. Blocks of at most ``BROADCAST_BYTES`` in all are broadcast; more of them are dealt with the shards
  by (block, salt). A task gives the best ``k`` documents of its shard for each item, and a ranking window, which cuts to k before it shuffles, the best of all.

Search in a shard, per item: posting lists of at most a ``SHORT``th of the shard's documents are summed into accumulators, a
sorted list of documents with sums. From there on that list is one iterator like the long lists, bounded by its largest sum.
The k-th largest accumulator is the first threshold. Iterators are ordered by their bounds; those whose bounds together
stay below the threshold cannot make a result on their own and are only looked into for documents that the others name, with
a binary search that skips what lies between. Documents go by in order, ``STRIDE`` at a time; a document is dropped once its
sum and the bounds of the lists not yet looked at stay below the threshold, which rises with the documents found.

Defined results: null and empty texts have no terms, are not counted as documents and never found; items without terms, or without a
document that has one, give no rows; equal rows (item, text) of the items are one item, equal ids with other texts are items each; repeated documents
are documents each; equal scores go by ascending document id, null ids last; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: What separates terms, as a regular expression class; everything else makes terms.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BEST = 10
SHARD_BYTES = 32 << 20
PIECE_BYTES = 4 << 20
TERM_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
BROADCAST_BYTES = 32 << 20
SHORT = 32
STRIDE = 2_048

_KEPT = (string.ascii_letters + string.digits).encode()
_LOWER = bytes(b if b >= 128 else ord(chr(b).lower()) if b in _KEPT else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """The terms of a text in UTF-8 with their counts, piece by piece."""
    counts, at, plain = Counter(), 0, text.translate(_LOWER)
    while at < len(plain):
        end = plain.find(b" ", at + PIECE_BYTES)
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


def terms_of(text: Column) -> Column:
    """The terms of a text with repeats, as an expression."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS + "+"), "")


def build_index(docs: DataFrame, wanted: set[bytes] | None, doc_id: str, text: str) -> DataFrame:
    """Shards: ``ids, lengths, n_docs, n_terms, terms, sizes, docs, counts``; only the terms ``wanted`` unless that is None."""
    import pyarrow as pa

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, lists, held = [], [], {}, 0

        def shard() -> pa.RecordBatch:
            terms = sorted(lists)
            pairs = [np.array(lists[t], np.uint32).reshape(-1, 2) for t in terms]
            flat = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.uint32)
            return pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)),
                pa.array([np.array(lengths, np.int64).tobytes()], pa.binary()),
                pa.array([len(lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64()),
                pa.array([terms], pa.list_(pa.binary())), pa.array([[len(p) for p in pairs]], pa.list_(pa.int64())),
                pa.array([flat[:, 0].tobytes()], pa.binary()), pa.array([flat[:, 1].tobytes()], pa.binary()),
            ], ["ids", "lengths", "n_docs", "n_terms", "terms", "sizes", "docs", "counts"])

        for batch in batches:
            kept = []
            for i, value in enumerate(batch.column(1)):
                value = value.as_py()
                counts = term_counts(value) if value else None
                if not counts:
                    continue
                place = len(lengths)
                for t in counts if wanted is None else counts.keys() & wanted:
                    lists.setdefault(t, []).extend((place, counts[t]))
                lengths.append(counts.total())
                kept.append(i)
                held += len(value)
                if held >= SHARD_BYTES:
                    ids.append(batch.column(0).take(pa.array(kept, pa.int64())))
                    yield shard()
                    ids, lengths, lists, held, kept = [], [], {}, 0, []
            ids.append(batch.column(0).take(pa.array(kept, pa.int64())))
        if lengths:
            yield shard()

    return rows.mapInArrow(of_task, (
        f"ids array<{id_type}>, lengths binary, n_docs bigint, n_terms bigint, terms array<binary>, sizes array<bigint>, docs binary, counts binary"))


# --- search in a shard -----------------------------------------------------------------------------------


def _sums(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct documents, ascending, and the sums of their scores."""
    if not len(docs):
        return docs, scores
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[first], np.add.reduceat(scores[order], first)


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 1 where there are fewer: only scores above 0 count."""
    return max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(scores) >= k else 1


def best_of_shard(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents whose score is at least the k-th best (more than k with ties, fewer where fewer match), and their scores.

    ``lists`` are (ascending documents, scores above 0) of each term.
    """
    short = [x for x in lists if len(x[0]) * SHORT <= n_docs]
    iterators = [x for x in lists if len(x[0]) * SHORT > n_docs]
    least = 1
    if short:
        summed = _sums(np.concatenate([d for d, _ in short]), np.concatenate([s for _, s in short]))
        least = _kth(summed[1], k)
        iterators.append(summed)
    iterators = sorted(((int(s.max()), d, s) for d, s in iterators if len(d)), key=lambda x: x[0])
    bounds = np.cumsum([high for high, _, _ in iterators])
    found_docs, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, places = 0, [0] * len(iterators)
    while True:
        naming = int(np.searchsorted(bounds, least))  # the first iterator that names documents
        ahead = []
        for i in range(naming, len(iterators)):
            docs = iterators[i][1]
            places[i] += int(np.searchsorted(docs[places[i]:], at))
            if places[i] < len(docs):
                ahead.append(int(docs[places[i]]))
        if not ahead:
            break
        until = min(ahead) + STRIDE
        named_docs, named = [], []
        for i in range(naming, len(iterators)):
            _, docs, scores = iterators[i]
            a, b = places[i], places[i] + int(np.searchsorted(docs[places[i]:], until))
            named_docs.append(docs[a:b])
            named.append(scores[a:b])
        at = until
        docs, sums = _sums(np.concatenate(named_docs), np.concatenate(named))
        for i in range(naming - 1, -1, -1):
            alive = sums + bounds[i] >= least
            docs, sums = docs[alive], sums[alive]
            if not len(docs):
                break
            _, other, scores = iterators[i]
            spots = np.minimum(np.searchsorted(other, docs), len(other) - 1)
            sums = sums + np.where(other[spots] == docs, scores[spots], 0)
        alive = sums >= least
        found_docs, found = np.concatenate([found_docs, docs[alive]]), np.concatenate([found, sums[alive]])
        least = max(least, _kth(found, k))
        alive = found >= least
        found_docs, found = found_docs[alive], found[alive]
    return found_docs, found


def _impacts(counts: np.ndarray, docs: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = np.array([25 + 75 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    counts = counts.astype(np.int64)
    return 1_000_000_000 * counts // (1_000 * counts + 8 * m[docs])


def _search(pairs: DataFrame, n_docs: int, n_terms: int, k: int, shape: str) -> DataFrame:
    """The best k of each (shard, block) pair: ``item, item_id, doc_id, score``."""
    import pyarrow as pa

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name, i: batch.column(batch.schema.get_field_index(name))[i]  # noqa: B023, E731
            for i in range(batch.num_rows):
                packed = lambda name, kind: np.frombuffer(get(name, i).as_buffer(), kind)  # noqa: B023, E731
                docs, lengths, ids = packed("docs", np.uint32).astype(np.int64), packed("lengths", np.int64), get("ids", i).values
                impacts = _impacts(packed("counts", np.uint32), docs, lengths, n_docs, n_terms)
                ends = np.cumsum(get("sizes", i).values.to_numpy())
                place = {t: e for e, t in enumerate(get("terms", i).as_py())}
                out = []
                items = get("items", i).values
                for item, key, terms in zip(items.field("item").to_pylist(), items.field("item_id"), items.field("terms").to_pylist()):
                    lists = []
                    for t in terms:
                        if t["weight"] > 0 and (e := place.get(t["term"])) is not None:
                            span = slice(ends[e - 1] if e else 0, ends[e])
                            lists.append((docs[span], t["weight"] * impacts[span]))
                    where, scores = best_of_shard(lists, len(lengths), k)
                    rows = sorted(zip((-scores).tolist(), ids.take(pa.array(where)).to_pylist()), key=lambda r: (r[0], r[1] is None, r[1]))
                    out += [(item, key.as_py(), doc, -score) for score, doc in rows[:k]]
                columns = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], pa.int64()), pa.array(columns[1], items.type.field("item_id").type), pa.array(columns[2], ids.type),
                    pa.array(columns[3], pa.int64())], ["item", "item_id", "doc_id", "score"])

    return pairs.mapInArrow(of_task, shape)


def ranked_search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = BEST,
    term_bytes: int = TERM_BYTES, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item."""
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    asked = settle(asked.withColumn("item", F.monotonically_increasing_id()), "search-items")
    used = asked.select("item", "item_id", F.explode(terms_of(F.col("text")).cast("array<binary>")).alias("term"))
    used = settle(used.groupBy("item", "item_id", "term").agg(F.count("*").alias("copies")), "search-item-terms")
    distinct = used.select("term").distinct()
    size = distinct.agg(F.sum(F.length("term") + 64)).first()[0] or 0
    wanted = {bytes(r["term"]) for r in distinct.toLocalIterator()} if size <= term_bytes else None
    index = settle(build_index(docs, wanted, doc_id, text), "search-index")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    shards = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t"))
    frequency = shards.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    weight = F.floor(1_000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighted = used.join(frequency, "term").select("item", "item_id", F.struct("term", (F.col("copies") * weight).alias("weight")).alias("t"))
    total = used.agg(F.sum(F.length("term") + 32)).first()[0] or 0
    n_blocks = max(1, math.ceil(total / BLOCK_BYTES))
    per_item = weighted.groupBy("item", "item_id").agg(F.collect_list("t").alias("terms"))
    blocks = settle(per_item.groupBy(F.pmod(F.xxhash64("item"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("item", "item_id", "terms")).alias("items")), "search-blocks")
    upto = lambda n: F.explode(F.expr(f"sequence(0L, {n - 1}L)"))
    dealt = index.withColumn("block", upto(n_blocks))
    if total <= broadcast_bytes:
        pairs = dealt.join(F.broadcast(blocks), "block")
    else:  # as many salts as there are shards at most, so that no key holds many of them
        salts = max(1, min(index.count(), 1_024))
        pairs = dealt.withColumn("salt", F.pmod(F.xxhash64("lengths", "docs"), F.lit(salts))).join(
            blocks.withColumn("salt", upto(salts)), ["block", "salt"])
    types = [asked.schema["item_id"].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()]
    found = _search(pairs, int(n_docs), int(n_terms), k, f"item bigint, item_id {types[0]}, doc_id {types[1]}, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term, n_docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
