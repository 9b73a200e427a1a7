"""Which of a document's ranges each of its blocks lies in, by a sweep instead of a join.

Ranges may nest and overlap. Starts, blocks and ends go by in order, and a running
sum tells what is open: the number of ranges, or one bit for each. A long document
is swept in stretches of blocks, and ranges beyond a word of bits in further words,
so no window is longer than a stretch, whatever the document, and no row carries
more than the ranges of one word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a stretch, and ranges of a word (a sum of their bits stays a positive long).
STRETCH, WORD = 4096, 62


def _part(c: Column, stretch: int) -> Column:
    return F.floor(c / stretch).cast("long")


def _pieces(blocks: DataFrame, ranges: DataFrame, start: str, end: str, by: str, pos: str, stretch: int, payload: list[str]) -> DataFrame:
    """(_by, _part, _a, _b, _range): each range's piece of every stretch that it touches, between the first and the last block of its document."""
    bounds = blocks.groupBy(F.col(by).alias("_by")).agg(F.min(pos).cast("long").alias("_first"), F.max(pos).cast("long").alias("_last"))
    carried = F.struct(*[F.col(f"`{c}`") for c in payload]) if payload else F.struct(F.lit(True).alias("_"))
    kept = ranges.select(F.col(by).alias("_by"), F.col(start).cast("long").alias("_a"), F.col(end).cast("long").alias("_b"), carried.alias("_range")).join(bounds, "_by")
    kept = kept.withColumns({"_a": F.greatest("_a", F.when(F.col("_a").isNotNull(), F.col("_first"))), "_b": F.when(F.col("_b").isNotNull(), F.least("_b", "_last"))}).filter("_a <= _b")
    kept = kept.select("_by", "_a", "_b", "_range", F.explode(F.sequence(_part(F.col("_a"), stretch), _part(F.col("_b"), stretch))).alias("_part"))
    low = F.col("_part") * stretch
    return kept.withColumns({"_a": F.greatest("_a", low), "_b": F.least("_b", low + stretch - 1)})


def _in_order(blocks: DataFrame, pieces: DataFrame, by: str, pos: str, stretch: int) -> DataFrame:
    """(_by, _part, _at, _kind, _change, _row, and what pieces have): starts (0), blocks (1) and ends (2)."""
    row = F.struct(*[F.col(f"`{c}`") for c in blocks.columns])
    own = blocks.select(F.col(by).alias("_by"), _part(F.col(pos), stretch).alias("_part"), F.col(pos).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_change"), row.alias("_row"))
    more = [c for c in pieces.columns if c not in ("_by", "_part", "_a", "_b")]
    side = lambda at, kind, change: F.struct(F.col(at).alias("_at"), F.lit(kind).alias("_kind"), F.lit(change).alias("_change"))
    both = pieces.select("_by", "_part", *more, F.inline(F.array(side("_a", 0, 1), side("_b", 2, -1))))
    return own.unionByName(both, allowMissingColumns=True)


def in_any_range(blocks: DataFrame, ranges: DataFrame, start: str = "start_pos", end: str = "end_pos", by: str = "doc_id", pos: str = "block_pos", stretch: int = STRETCH, inside: bool = True) -> DataFrame:
    """The blocks that a range of their document holds, both ends included, or with ``inside=False`` those that none does.

    Each block comes once; blocks that repeat stay. A range with a null end, or one
    that ends before it starts, holds nothing, and neither does one of a null
    document. A block without a place, or of a null document, is in none.
    """
    rows = _in_order(blocks, _pieces(blocks, ranges, start, end, by, pos, stretch, []).drop("_range"), by, pos, stretch)
    w = Window.partitionBy("_by", "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_open", F.sum("_change").over(w)).filter("_kind = 1")
    return rows.filter(F.col("_open") > 0 if inside else F.col("_open") == 0).select("_row.*")


def blocks_in_ranges(blocks: DataFrame, ranges: DataFrame, start: str = "start_pos", end: str = "end_pos", by: str = "doc_id", pos: str = "block_pos", stretch: int = STRETCH) -> DataFrame:
    """A row for each block and each range of its document that holds it: the columns of the range (without ``by``, and without those whose names the blocks have), then those of the block.

    Nulls and empty ranges as in ``in_any_range``; equal ranges, and blocks that
    repeat, each count.
    """
    payload = [c for c in ranges.columns if c not in blocks.columns]
    pieces = _pieces(blocks, ranges, start, end, by, pos, stretch, payload)
    number = F.row_number().over(Window.partitionBy("_by", "_part").orderBy("_a", "_b")) - 1
    pieces = pieces.withColumn("_k", number).select("_by", "_part", "_a", "_b", "_range", F.floor(F.col("_k") / WORD).cast("int").alias("_word"), F.expr(f"shiftleft(1L, cast(_k % {WORD} as int))").alias("_bit"))
    rows = _in_order(blocks, pieces, by, pos, stretch)
    words = F.coalesce(F.max("_word").over(Window.partitionBy("_by", "_part")), F.lit(-1))  # -1: no range touches the stretch
    rows = rows.withColumn("_words", words).filter("_words >= 0")
    rows = rows.withColumn("_word", F.explode(F.when(F.col("_kind") == 1, F.sequence(F.lit(0), "_words")).otherwise(F.array("_word"))))
    w = Window.partitionBy("_by", "_part", "_word")
    mask = F.sum(F.col("_change") * F.col("_bit")).over(w.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    listed = F.collect_list(F.when(F.col("_kind") == 0, F.struct("_bit", "_range"))).over(w)
    rows = rows.withColumns({"_open": mask, "_ranges": listed}).filter("_kind = 1 and _open <> 0")
    held = rows.select("_by", "_row", F.explode(F.filter("_ranges", lambda r: F.col("_open").bitwiseAND(r["_bit"]) != 0)).alias("_held"))
    # the document comes from the column that rows are dealt by, so that the planner knows how they lie
    alike = blocks.schema[by].dataType == ranges.schema[by].dataType
    own = [F.col("_by").alias(c) if c == by and alike else F.col(f"_row.`{c}`").alias(c) for c in blocks.columns]
    return held.select(*[F.col(f"_held._range.`{c}`").alias(c) for c in payload], *own)
