"""Benchmark decontamination by winnowing.

Of every ten words in a row, six 5-grams begin and end inside; winnowing keeps the one with the least hash.
Documents and benchmark items are winnowed alike, so any ten words that both hold give both the same
fingerprint. Fingerprints are joined, and every hit is extended along its diagonal (document position
minus item position): the item's words are laid over the document's and compared word for word, and runs
of ten equal words or more are hits. An item of fewer than ten words is one window: documents give the
hashes of all their n-grams of the lengths such items have, and the extension is the same.

The side of the benchmark is broadcast only if its measured row count is below ``BROADCAST_ROWS``
(16 bytes a row); else both sides are shuffled by hash and adaptive execution splits hot fingerprints.
Only matching fingerprints leave the row of their document. Hits are grouped per document, as distinct
(item, diagonal) pairs, and brought to the text by one join on the document id.

Defined results: a null or empty text has no words, no hits and the digest of the empty list; equal
hashes of different words are thrown out by the comparison; rows that repeat a document id must hold the
same document and each get its result; a null id is an id like others; items with the same words all count,
each with its id; an item without words never occurs; empty tables give clean documents or no rows;
further columns, whatever their names, are kept by ``keep_clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, field, first_n, rows_where, unboxed

WINDOW = 10
GRAM = 5
PER_WINDOW = WINDOW - GRAM + 1
BROADCAST_ROWS = 200_000
#: Fixed value: what separates words, after A-Z became a-z: ASCII other than digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAP), "")


def _grams(hashes: str, length: int) -> Column:
    return F.transform(
        first_n(F.size(hashes) - F.lit(length - 1)), lambda i: F.xxhash64(F.slice(hashes, i, length)))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def winnow(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, h, p``: the fingerprints of the texts in ``words``, with their positions from zero.

    Of equal least hashes in a window the leftmost stands; any choice finds the same hash. From window to window the place
    of the least hash never goes back, so a fingerprint is new where it differs from the window before.
    """
    grams = _hashed(rows).select(*keep, _grams("hashes", GRAM).alias("grams"))
    part = lambda i: F.slice("grams", i, PER_WINDOW)
    placed = grams.withColumn("places", F.transform(
        first_n(F.size("grams") - F.lit(PER_WINDOW - 1)), lambda i: i.cast("bigint") + F.array_position(part(i), F.array_min(part(i))) - 2))
    fresh = placed.withColumn("places", F.filter(
        "places", lambda p, i: (i == 0) | (p != F.get("places", F.greatest(i - 1, F.lit(0))))))
    each = fresh.select(*keep, F.explode_outer(F.transform("places", lambda p: F.struct(
        F.get("grams", p.cast("int")).alias("h"), p.cast("int").alias("p")))).alias("f")).filter(F.col("f").isNotNull())
    return each.select(*keep, "f.h", "f.p")


def whole_grams(rows: DataFrame, keep: list[str], length: int) -> DataFrame:
    """``keep, h, p``: all n-grams of one length."""
    each = _hashed(rows).select(*keep, F.posexplode_outer(_grams("hashes", length)).alias("p", "h"))
    return each.filter(F.col("h").isNotNull()).select(*keep, "h", "p")


def _match(found: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (document, item, diagonal) of equal fingerprints."""
    items = items.select(F.col("h").alias("ih"), F.col("p").alias("ip"), "item")
    if items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        items = F.broadcast(items)
    return found.join(items, found["h"] == items["ih"]).select("id", "item", (F.col("p") - F.col("ip")).alias("diagonal")).distinct()


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``id, item, diagonal`` of all fingerprint hits. ``docs``: id, words; ``items``: item, words."""
    long_items = items.filter(F.size("words") >= WINDOW)
    hits = _match(winnow(docs, ["id"]), winnow(long_items, ["item"]))
    short = items.filter((F.size("words") > 0) & (F.size("words") < WINDOW))
    # At most WINDOW - 1 lengths.
    for row in short.select(F.size("words").alias("n")).distinct().orderBy("n").collect():
        same = short.filter(F.size("words") == row["n"])
        hits = hits.union(_match(whole_grams(docs, ["id"], row["n"]), whole_grams(same, ["item"], row["n"])))
    return hits


def _equal(hit: Column) -> Column:
    """Whether each word of a hit's item equals the word of the document (``words``) on its diagonal."""
    return F.transform(hit["words"], lambda w, j: F.coalesce(
        (hit["diagonal"] + j >= 0) & (F.get("words", F.greatest(hit["diagonal"] + j, F.lit(0))) == w), F.lit(False)))


def _covered(x: Column) -> Column:
    """Positions of the document's words inside windows whose words are all equal."""
    starts = F.filter(
        first_n(F.size(x["equal"]) - x["need"] + 1), lambda j: ~F.array_contains(F.slice(x["equal"], j, x["need"]), False))
    places = lambda j: F.sequence(x["diagonal"] + j - 1, x["diagonal"] + j + x["need"] - 2)
    return F.array_distinct(F.flatten(F.transform(starts, places)))


def mark_hits(
    df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The input boxed as ``row`` with its ``words``, ``hit`` positions and ids of ``items`` that occur."""
    docs = boxed(df).select(field(doc_id).alias("id"), item_words(field(text)).alias("words"))
    items = boxed(benchmark).select(
        F.struct(field(item_id).alias("item_id"), F.xxhash64(field(item_text)).alias("text")).alias("item"),
        item_words(field(item_text)).alias("words"))
    hits = candidates(docs, items)
    with_words = hits.join(items.dropDuplicates(["item"]), "item").groupBy("id").agg(F.collect_set(
        F.struct(F.col("item.item_id").alias("item_id"), "diagonal", "words")).alias("hits"))
    texts = boxed(df).withColumn("id", field(doc_id))
    joined = texts.join(with_words, texts["id"].eqNullSafe(with_words["id"]), "left").select("row", "hits")
    split = joined.select("row", "hits", item_words(field(text)).alias("words"))
    laid = split.select("row", F.size("words").alias("n_words"), F.transform("hits", lambda hit: F.struct(
        hit["item_id"].alias("item_id"), hit["diagonal"].alias("diagonal"), _equal(hit).alias("equal"),
        F.least(F.lit(WINDOW), F.size(hit["words"])).alias("need"))).alias("laid"))
    extended = laid.select("row", "n_words", F.filter(F.transform("laid", lambda x: F.struct(
        x["item_id"].alias("item_id"), _covered(x).alias("covered"))), lambda x: F.size(x["covered"]) > 0).alias("spans"))
    none = F.array()
    return extended.select(
        "row", F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce(F.array_distinct(F.flatten(F.transform("spans", lambda x: x["covered"]))), none.cast("array<int>")).alias("hit"),
        F.coalesce(F.sort_array(F.array_distinct(F.transform("spans", lambda x: x["item_id"].cast("string")))), none.cast("array<string>")).alias("items"),
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """Per document: words, words hit, and the items that occur in it."""
    return mark_hits(df, benchmark, **names).select(
        field(names.get("doc_id", "doc_id")).alias("doc_id"), "n_words", F.size("hit").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def keep_clean(df: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The documents without a hit, with the columns they came with."""
    return unboxed(rows_where(mark_hits(df, benchmark, **names), F.size("hit") == 0), df.columns)


#: DuckDB SQL over {docs} and the table benchmark, without fingerprints.
SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM {docs}),
bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
bp AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM bw WHERE len(ws) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM bp),
lengths AS (SELECT DISTINCT n FROM bwin),
dp AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lengths WHERE len(ws) >= n),
dwin AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM dp),
found AS (SELECT doc_id, item_id, n, i FROM dwin JOIN bwin USING (n, w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE_SQL = SQL.replace("{docs}", "documents")
