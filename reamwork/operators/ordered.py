"""Ordered-sequence building blocks that hold for sequences of any length.

A plain window over a document puts the whole document into one task. Here a sequence is cut into
chunks by position: rows work within (keys, chunk), one summary row per chunk carries state over
chunk borders (in two levels, see :func:`_carries`), and the summaries are joined back. Each task sees ``chunk_rows`` rows at most,
however large one document is. The carry table is one row per chunk after the first, so for
ordinary documents it is empty and AQE, which knows its measured size, joins it by broadcast.

Positions must be whole numbers, unique within the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_kind

CHUNK_ROWS = 65_536
PART_ROWS = 1_024
_CHUNK, _CARRY, _LOCAL = "__chunk", "__carry", "__local"


def chunk_of(pos: str | Column, rows: int) -> Column:
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.call_function("div", pos.cast("bigint"), F.lit(rows))


def unnest(df: DataFrame, keep: list, array: str | Column, pos: str, out: str) -> DataFrame:
    """Rows of an array with their positions from zero; empty and null arrays give none.

    The outer form with a test afterwards: for the plain form the optimizer tests the array's size
    in a filter below, and an array that is costly to compute would be computed again there.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, out))
    return rows.filter(F.col(pos).isNotNull())


_GROUP, _LEVELS = "__group", 36  # chunks are grouped by 4 096; group numbers have up to 36 bits
GROUP_CHUNKS = 4_096


def _carries(chunks: DataFrame, keys: list[str], value: str, combine) -> DataFrame:
    """What each chunk's rows see of the chunks before it: (keys, chunk, __carry), chunks without any left out.

    ``combine`` is an aggregate function that may be applied in any grouping: a sum, or the greatest of (position, state). Two
    levels: a window within each group of ``GROUP_CHUNKS`` chunks, and over the totals of groups a tree of partial
    sums, joined by equality. No task sees all chunks of a sequence, and a sequence without keys needs no single partition.
    A sequence within its first group, that is of less than 268 million positions, has no part in the tree.
    """
    grouped = chunks.withColumn(_GROUP, chunk_of(F.col(_CHUNK), GROUP_CHUNKS))
    order = Window.partitionBy(*keys, _GROUP).orderBy(_CHUNK)
    near = grouped.withColumn("__near", combine(F.col(value)).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    totals = grouped.groupBy(*keys, _GROUP).agg(combine(F.col(value)).alias("__total"))
    later = totals.filter(F.col(_GROUP) > 0)
    some = totals.join(later.select(*keys).distinct(), keys, "left_semi") if keys else totals
    # group g is summed up in the nodes (level, g >> level) with an even number; what is before g is one node for each bit of g
    level = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1)))
    shifted = F.expr(f"shiftright({_GROUP}, __level)")
    nodes = some.withColumn("__level", level).withColumn("__node", shifted).filter("__node % 2 = 0").groupBy(
        *keys, "__level", "__node").agg(combine(F.col("__total")).alias("__sum"))
    asked = later.select(*keys, _GROUP).withColumn("__level", level).withColumn("__node", shifted - 1).filter("__node % 2 = 0 AND __node >= 0")
    far = asked.join(nodes, [*keys, "__level", "__node"]).groupBy(*keys, _GROUP).agg(combine(F.col("__sum")).alias("__far"))
    both = near.join(far, [*keys, _GROUP], "left")
    return both.select(*keys, _CHUNK, F.expr("array(__near, __far)").alias("__parts")).select(
        *keys, _CHUNK, F.filter("__parts", lambda x: x.isNotNull()).alias("__parts")).filter(F.size("__parts") > 0)


def _join_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(carry, [*keys, _CHUNK], "left")


def carry_last(
    df: DataFrame, keys: list[str], pos: str, value: str | Column, out: str,
    inclusive: bool = True, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Last non-null ``value`` at (or, if not inclusive, strictly before) each row."""
    value = F.col(value) if isinstance(value, str) else value
    base = df.withColumn(_CHUNK, chunk_of(pos, chunk_rows))
    end = 0 if inclusive else -1
    within = Window.partitionBy(*keys, _CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, end)
    tails = (
        base.select(*keys, _CHUNK, F.col(pos).alias("__pos"), value.alias("__value"))
        .groupBy(*keys, _CHUNK)
        .agg(F.max(F.when(F.col("__value").isNotNull(), F.struct("__pos", "__value"))).alias("__tail"))
    )
    last = F.array_max("__parts")["__value"].alias(_CARRY)
    carry = _carries(tails, keys, "__tail", F.max).select(*keys, _CHUNK, last)
    local = base.withColumn(_LOCAL, F.last(value, ignorenulls=True).over(within))
    return (
        _join_carry(local, carry, keys)
        .withColumn(out, F.coalesce(_LOCAL, _CARRY)).drop(_CHUNK, _CARRY, _LOCAL)
    )


def running_total(
    df: DataFrame, keys: list[str], pos: str, value: str | Column, out: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sum of ``value`` over all rows strictly before each row."""
    value = F.col(value) if isinstance(value, str) else value
    base = df.withColumn(_CHUNK, chunk_of(pos, chunk_rows))
    within = Window.partitionBy(*keys, _CHUNK).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    sums = base.groupBy(*keys, _CHUNK).agg(F.sum(value).alias("__sum_of"))
    before = F.aggregate("__parts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias(_CARRY)
    carry = _carries(sums, keys, "__sum_of", F.sum).select(*keys, _CHUNK, before)
    local = base.withColumn(_LOCAL, F.sum(value).over(within))
    total = F.coalesce(F.col(_LOCAL), F.lit(0)) + F.coalesce(F.col(_CARRY), F.lit(0))
    return _join_carry(local, carry, keys).withColumn(out, total).drop(_CHUNK, _CARRY, _LOCAL)


def dense_positions(
    df: DataFrame, keys: list[str], pos: str, out: str, start: int = 1, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Number the rows of each sequence without gaps."""
    counted = running_total(df, keys, pos, F.lit(1).cast("bigint"), out, chunk_rows)
    return counted.withColumn(out, F.col(out) + F.lit(start))


def nested_positions(
    df: DataFrame, keys: list[str], outer: str, inner: str, out: str, start: int = 1, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Number rows without gaps by two positions, such as slide and paragraph, both without wide gaps themselves.

    Rows are numbered within their outer position, and what is before that is a running total over the counts of outer positions:
    neither many outer positions nor many rows in one of them meet a limit.
    """
    own = dense_positions(df, [*keys, outer], inner, "__own", 0, chunk_rows)
    counts = df.groupBy(*keys, outer).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = running_total(counts, keys, outer, "__rows", "__before", chunk_rows).select(*keys, outer, "__before")
    return own.join(offsets, [*keys, outer]).withColumn(out, F.col("__own") + F.col("__before") + F.lit(start)).drop("__own", "__before")


HASH_BUCKETS = 65_536


def amount_before(df: DataFrame, keys: list[str], items: list[str], amount: Column, out: str) -> DataFrame:
    """The sum of ``amount`` over the rows of a group before each row, in an order of its own: by hash bucket of the items, then by the items.

    For cutting groups of any size by what has piled up. Rows are added up within (keys, bucket), and a window over the totals of
    the buckets, ``HASH_BUCKETS`` small rows a group at most, says what is before them; a group is never in one task.
    Of many small groups the totals are as many as the rows, and the optimizer, which takes exploded rows for no more than
    their source has, would send them through the driver: the join is a merge at any size.
    """
    based = df.withColumn("__bucket", F.pmod(F.xxhash64(*items), F.lit(HASH_BUCKETS))).withColumn("__amount", amount)
    nothing = F.lit(0).cast("bigint")
    order = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = based.groupBy(*keys, "__bucket").agg(F.sum("__amount").alias("__total")).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__total").over(order), nothing).alias("__before"))
    within = Window.partitionBy(*keys, "__bucket").orderBy(*items).rowsBetween(Window.unboundedPreceding, -1)
    rows = based.withColumn("__within", F.coalesce(F.sum("__amount").over(within), nothing))
    same = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(keys):  # null keys are a group too
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.join(totals.hint("merge"), same)
    return joined.withColumn(out, F.col("__within") + F.col("__before")).drop(
        "__bucket", "__amount", "__within", "__b", "__before", *[f"__k{i}" for i in range(len(keys))])


def last_write_wins(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Of the rows with equal keys keep the one with the highest position.

    An aggregate instead of a window: map tasks already reduce each key to one row, so a key that
    is repeated a billion times costs one row per map task in the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("__row"))
    return best.select(*keys, "__row.*").select(*df.columns)


def carry_section(
    df: DataFrame, keys: list[str], pos: str = "line_no", line: str = "line", out: str = "section",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Give every line the last ``[section]`` header at or above it."""
    header = F.nullif(F.regexp_extract(line, r"^\[(.+)\]", 1), F.lit(""))
    return carry_last(df, keys, pos, header, out, chunk_rows=chunk_rows)


def list_runs(
    df: DataFrame, keys: list[str], pos: str = "line_no", line: str = "line",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Where bullet lists open and close in a table of Markdown lines.

    Adds ``kind``, ``opens`` (an opening tag goes before this line), ``closes`` (a closing tag goes
    before it) and ``closes_after`` (only on the last line, when a list is still open). A heading
    inside a list does not close it.
    """
    state = F.when(F.col("kind").isin("1", "2", "3"), None).otherwise(F.col("kind") == "B")
    base = df.withColumn("kind", line_kind(F.col(line), numbered=False)).withColumn("__state", state).withColumn(_CHUNK, chunk_of(pos, chunk_rows))
    # one row a chunk: the state it leaves behind (none: unchanged), as the greatest position with one, and its last line
    chunks = base.groupBy(*keys, _CHUNK).agg(
        F.max(F.when(F.col("__state").isNotNull(), F.struct(F.col(pos).alias("__pos"), F.col("__state").alias("__value")))).alias("__tail"))
    carry = _carries(chunks, keys, "__tail", F.max).select(*keys, _CHUNK, F.array_max("__parts")["__value"].alias(_CARRY))
    last = chunks.groupBy(*keys).agg(F.max(_CHUNK).alias(_CHUNK), F.lit(True).alias("__final"))
    marks = carry.join(last, [*keys, _CHUNK], "full")
    within = Window.partitionBy(*keys, _CHUNK).orderBy(pos)
    rows = base.withColumn(_LOCAL, F.last("__state", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "__ends", F.lead(F.lit(1)).over(within).isNull())
    in_list = F.coalesce(_LOCAL, _CARRY, F.lit(False))
    still_open = F.coalesce(F.col("__state"), in_list) & F.col("__ends") & F.coalesce(F.col("__final"), F.lit(False))
    return (
        _join_carry(rows, marks, keys)
        .withColumn("opens", (F.col("kind") == "B") & ~in_list)
        .withColumn("closes", F.col("kind").isin("T", "X") & in_list)
        .withColumn("closes_after", still_open)
        .drop(_CHUNK, _CARRY, _LOCAL, "__state", "__ends", "__final")
    )


def glue_framed(
    df: DataFrame, keys: list[str], pos: str, text: Column, head: Column, tail: Column, joiner: str = "",
    out: str = "text", part_rows: int = PART_ROWS, first: int = 1, **more: Column,
) -> DataFrame:
    """:func:`glue_parts` with ``head`` right before the first text and ``tail`` right after the last.

    The first position is the lowest that the sequence has, so a missing first row costs no head. Head
    and tail of a sequence come from one small aggregate row each, which goes to the parts of these
    positions along with the texts; no text is joined. They stand even where all texts are null.
    """
    ends = df.select(*keys, F.col(pos).alias("__pos"), head.alias("__head"), tail.alias("__tail")).groupBy(*keys).agg(
        F.min_by("__head", "__pos").alias("__head"), F.max_by("__tail", "__pos").alias("__tail"),
        F.min("__pos").alias("__low"), F.max("__pos").alias("__high"))
    none = F.lit(None).cast("string")
    # both from one pass over the aggregate
    frame = ends.select(*keys, F.inline(F.array(
        F.struct(F.col("__low").alias("__pos"), F.col("__head").alias("__head"), none.alias("__tail")),
        F.struct(F.col("__high").alias("__pos"), none.alias("__head"), F.col("__tail").alias("__tail")))))
    rows = df.select(*keys, F.col(pos).alias("__pos"), text.alias("__text"), *[c.alias(f"__{n}") for n, c in more.items()])
    every = rows.unionByName(frame, allowMissingColumns=True)
    part = chunk_of(F.col("__pos") - F.lit(first), part_rows)
    blank = F.lit("")
    return every.groupBy(*keys, part.alias("part_no")).agg(
        F.concat(F.coalesce(F.max("__head"), blank), F.coalesce(_in_order(joiner), blank), F.coalesce(F.max("__tail"), blank)).alias(out),
        *[F.sum(f"__{n}").alias(n) for n in more])


def _in_order(joiner: str) -> Column:
    quoted = joiner.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.expr(f"listagg(__text, '{quoted}') within group (order by __pos)")


def glue_parts(
    df: DataFrame, keys: list[str], pos: str, text: str | Column, joiner: str = "",
    out: str = "text", part_rows: int = PART_ROWS, first: int = 1, **more: Column,
) -> DataFrame:
    """Put the texts of a sequence together, in order.

    The result has one row per (keys, part_no): a document of up to ``part_rows`` rows is part 0
    alone, a longer one goes on in parts 1, 2, ... whose texts, joined with ``joiner``, are the
    whole. So no row and no task ever holds an unbounded document. Choose ``part_rows`` so that
    that many rows fit a cell: 1 024 pages of up to a megabyte do.
    """
    text = F.col(text) if isinstance(text, str) else text
    part = chunk_of(F.col(pos) - F.lit(first), part_rows)
    return (
        df.select(*keys, part.alias("part_no"), F.col(pos).alias("__pos"), text.alias("__text"),
                  *[c.alias(f"__{n}") for n, c in more.items()])
        .groupBy(*keys, "part_no")
        .agg(_in_order(joiner).alias(out), *[F.sum(f"__{n}").alias(n) for n in more])
    )
