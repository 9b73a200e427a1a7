"""Merkle manifest of a dataset: a digest of every row, a root of each group, a root of all, and the proof of every row.

Digests of rows are DataFrame functions. The trees are supersteps of messages
between RDDs of vertices: a vertex stands for a run of at most ``2 ** CLIMB``
neighbours of one level; its children message their digests to it, and once all
have come it hashes the levels of the run and forwards its own. The reverse
supersteps send every child the siblings on its way to the root. A group is
spread over as many vertices as its size asks for, so no group is ever in one task.
"""

from __future__ import annotations

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merkle_nodes import complete, downward, place, top_first, upward, verified_row
from .session import ready, width, written

#: Levels of the tree that a message climbs at once: a vertex hashes a run of 64 children.
CLIMB = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(c: Column) -> Column:
    """``-`` for a null; else the length in UTF-8 bytes, a colon and the value, so that neighbouring fields can't be mistaken."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def row_digest(*fields: Column) -> Column:
    """The lowercase hex sha256 of the framed fields."""
    return F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256)


class Tree:
    """The supersteps over ``leaves``: an RDD of ((group, place), (nodes of the group, digest, carried)). ``most`` is the size of the largest group."""

    def __init__(self, leaves: RDD, most: int, parts: int, climb: int = CLIMB):
        self.parts, self.climb, self.states = parts, climb, []
        low = (1 << climb) - 1
        messages = leaves.map(lambda kv: ((kv[0][0], kv[0][1] >> climb), (kv[0][1] & low, *kv[1])))
        while True:
            state = messages.groupByKey(parts, place).map(complete(climb), preservesPartitioning=True)
            self.states.append(state)
            if most <= 1 << climb:
                break
            most = (most + low) >> climb
            messages = state.filter(lambda kv: kv[1][0] > 1 << climb).map(upward(climb))

    def tops(self) -> RDD:
        """((group, superstep), digest) of each group's top, whichever superstep reached it."""
        most, sc = 1 << self.climb, self.states[0].context
        found = [s.filter(lambda kv: kv[1][0] <= most).map(lambda kv, k=k: ((kv[0][0], k), kv[1][1][-1][0])) for k, s in enumerate(self.states)]
        return sc.union(found)

    def paths(self, above: RDD) -> RDD:
        """((group, place), (sides, siblings, top, digest, carried)) of each leaf; ``above`` has ((group, superstep), (sides, siblings, top)) of each group's top."""
        down = None
        for k in reversed(range(len(self.states))):
            here = above.filter(lambda kv, k=k: kv[0][1] == k).map(lambda kv: ((kv[0][0], 0), kv[1]))
            here = here if down is None else here.union(down.map(lambda kv: (kv[0], kv[1][:3])))
            sent = here.mapValues(lambda x: (1, x)).partitionBy(self.parts, place)
            down = self.states[k].mapValues(lambda x: (0, x)).union(sent).groupByKey(self.parts, place).flatMap(downward(self.climb))
        return down


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``place`` (from 0, in the order of its group) and ``group_size``.

    Rows are dealt by ranges and sorted, and written down once with their number
    inside the partition; what earlier partitions hold of a group is added. So the
    order of a group is never made in one task.
    """
    spread = rows.repartitionByRange(width(rows), group, *order).sortWithinPartitions(group, *order)
    numbered = written(spread.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part, number = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = numbered.withColumn("_part", part).withColumn("_number", number)
    w = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = numbered.groupBy(F.col("_part").alias("_of"), F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min("_number").alias("_first"))
    counts = counts.withColumn("_before", before).withColumn("group_size", F.sum("_n").over(w))
    own = (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group"))
    return numbered.join(counts, own).withColumn("place", F.col("_before") + F.col("_number") - F.col("_first")).drop("_at", "_part", "_number", "_of", "_group", "_n", "_first", "_before")


def merkle_manifest(leaves: DataFrame, group: str, order: str, leaf: str, carry: tuple[str, ...] = (), seen: str | None = None, climb: int = CLIMB) -> DataFrame:
    """(leaf, subroot, root, sides, siblings, folded_root, and the columns of ``carry``) of every row.

    In each group rows ascend by ``order`` (nulls first), ties by ``leaf``; every
    two neighbours become one node, a last single one a node of its own, until one
    is left: ``subroot``. The subroots in the order of their groups (null first,
    then bytewise) make ``root`` the same way. ``leaf`` holds lowercase hex digests.
    ``siblings`` are the digests beside a row's way to the root, 32 bytes each, and
    ``sides`` has a letter for each level: L or R for where the sibling is, ``-``
    for none. ``folded_root`` is the root that the digest in column ``seen`` (the
    leaf itself by default, and where it is null) gives with a row's siblings: a
    row still is what it was if that is ``root``. A row that repeats is a leaf of
    its own. An empty table gives no rows. Other columns are not read.
    """
    spark = ready(leaves.sparkSession)
    carried = [F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)]
    digest = F.unhex(F.lit(None).cast("string") if seen is None else F.when(F.col(seen) != F.col(leaf), F.col(seen)))
    rows = leaves.select(F.col(group).cast("string").alias("_g"), F.col(order).alias("_o"), F.unhex(leaf).alias("_leaf"), digest.alias("_seen"), *carried)
    named = {c: leaves.schema[c].dataType for c in carry}
    schema = T.StructType([T.StructField("leaf", T.BinaryType()), T.StructField("subroot", T.BinaryType()), T.StructField("root", T.BinaryType()), T.StructField("sides", T.StringType()), T.StructField("siblings", T.BinaryType()), T.StructField("folded_root", T.BinaryType())])
    for c, kind in named.items():
        schema.add(c, kind)
    numbered = placed(rows, "_g", ["_o", "_leaf"])
    most = numbered.agg(F.max("group_size")).first()[0]
    if most is None:
        return _as_hex(spark.createDataFrame([], schema), tuple(named))
    parts = width(rows)
    columns = numbered.select("_g", "place", "group_size", "_leaf", "_seen", *(f"_c{k}" for k in range(len(carry)))).rdd
    tree = Tree(columns.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), (r[4] and bytes(r[4]), *r[5:])))), most, parts, climb)
    tops = tree.tops().sortBy(top_first, numPartitions=parts).zipWithIndex()
    groups = tops.count()
    outer = Tree(tops.map(lambda x: ((0, x[1]), (groups, x[0][1], x[0][0]))), groups, min(parts, groups), climb)
    start = outer.tops().map(lambda kv: (kv[0], (b"", b"", kv[1])))
    above = outer.paths(start).map(lambda kv: (kv[1][4], (kv[1][0], kv[1][1], (kv[1][3], kv[1][2]))))
    found = tree.paths(above).map(verified_row)
    return _as_hex(spark.createDataFrame(found, schema, verifySchema=False), tuple(named))


def _as_hex(rows: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return rows.select(*(F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")), "sides", "siblings", F.lower(F.hex("folded_root")).alias("folded_root"), *carry)


def tampering_report(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, count: str = "n_chars", every: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row: the manifest of the rows, and whether each still fits it after some were tampered with.

    Where ``every`` divides the crc32 of the decimal id, one is added to ``count``;
    a null count stays as it is, and rows of a null id are never tampered with.
    ``proof_sha256`` is of the siblings' hex digests, from the leaf upward. See
    ``merkle_manifest`` for ties, null groups, repeated rows and empty tables.
    """
    chosen = F.crc32(F.col(order).cast("string").cast("binary")) % every == 0
    tampered = [F.when(chosen, F.col(c) + 1).otherwise(F.col(c)) if c == count else F.col(c) for c in fields]
    changed = chosen & F.col(count).isNotNull()
    leaves = docs.select(
        F.col(order).cast("long").alias("doc_id"), F.col(group).alias("group"), row_digest(*map(F.col, fields)).alias("leaf"),
        F.when(changed, row_digest(*tampered)).alias("seen"),
    )
    rows = merkle_manifest(leaves, "group", "doc_id", "leaf", carry=("doc_id",), seen="seen")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("siblings")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

