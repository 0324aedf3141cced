"""Merkle manifest of a table: every row a leaf, a tree for each group, and a tree of the groups' roots.

Leaves of a group ascend by an order column; while a level has several nodes, every ``fanout`` consecutive ones (the
last run may have fewer, even one) become their digest. What remains is the group's subroot; subroots, ordered by
group, give the root in the same way. A digest is the lower-case hex SHA-256 of its inputs, concatenated.

A node's place says which parent it has and which of the parent's slots it takes. Conditional aggregates spread each
parent's children into ``fanout`` columns: concatenated they hash to the parent, and without the own slot's column
they are a node's siblings. A band of LEVELS levels is made with one shuffle, as rows are dealt by their ancestor
at its top; only that ancestor goes on to the next band. On the way back every row joins the proof of that ancestor,
so that rows of a large group never meet in one task. Places come from sorted ranges, not from a window over a group.

Defined results: a null value is ``-`` in its leaf and a null group is a group of its own, before the others. Rows
with null order come first in their group; rows with one order value are ordered by their leaves, so that equal rows
are leaves of their own with proofs of their own. A lone leaf is its group's subroot, with an empty proof; if it is
also the only group, it is the root. An empty table gives no rows. Texts count whole, whatever their length. Extra
columns are ignored, whatever their names, unless they are carried.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protospan.llm.store import materialize

#: Levels that are made from one shuffle: blocks of fanout ** LEVELS nodes.
LEVELS = 4
PROOF = "array<struct<before:string,after:string>>"


def leaf_of(values: Iterable[Column]) -> Column:
    """A row's digest: of each value its number of UTF-8 bytes, ``:`` and the value; ``-`` for null."""
    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in values]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _div(a: Column, by: int) -> Column:
    return F.call_function("div", a, F.lit(by))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_pos``, their place (from 0) in their group ``_g`` by ``_o`` and ``_h``, and ``_n``, the group's size."""
    # Ascending with the sorted partitions and the rows in them; written at once, so that it stays as it is.
    number = F.monotonically_increasing_id()
    ranged = materialize(rows.repartitionByRange("_g", "_o", "_h").sortWithinPartitions("_g", "_o", "_h").withColumn("_i", number))
    part = F.shiftright("_i", 33)
    # A row for each partition that a group reaches: their places begin where those before end.
    ends = ranged.groupBy("_g", part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), F.min("_i").alias("_first"))
    whole = Window.partitionBy("_g")
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    ends = ends.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("_n"))
    return ranged.withColumn("_part", part).join(ends, ["_g", "_part"]).withColumn("_pos", F.col("_i") + F.col("_shift")).drop("_i", "_part", "_shift")


def _lifted(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``rows`` (_g, _n, _pos, _h and others) with the digest ``_top`` and place ``_block`` of the ancestor ``levels`` up, and the ``_proof`` so far.

    ``_n`` is the number of nodes of the group's level; where it is 1, the group's root is reached and stays.
    """
    out = rows.withColumn("_block", _div(F.col("_pos"), fanout**levels)).withColumns({"_top": F.col("_h"), "_proof": F.array().cast(PROOF)})
    out = out.repartition("_g", "_block")
    for level in range(levels):
        place, several = _div(F.col("_pos"), fanout**level), F.col("_n") > fanout**level
        slot = F.pmod(place, F.lit(fanout))
        family = Window.partitionBy("_g", "_block", _div(place, fanout))
        children = [f"_c{k}" for k in range(fanout)]
        out = out.withColumn("_slot", slot).withColumns({c: F.coalesce(F.max(F.when(F.col("_slot") == k, F.col("_top"))).over(family), F.lit("")) for k, c in enumerate(children)})

        def beside(least: int, slots=children) -> Column:
            # Columns of the slots before the own one, or after it.
            return F.concat(*[F.when(F.col("_slot") > k if least else F.col("_slot") < k, F.col(c)).otherwise(F.lit("")) for k, c in enumerate(slots)])

        siblings = F.struct(beside(1).alias("before"), beside(0).alias("after"))
        out = out.withColumns({
            "_proof": F.when(several, F.concat("_proof", F.array(siblings))).otherwise(F.col("_proof")),
            "_top": F.when(several, F.sha2(F.concat(*children), 256)).otherwise(F.col("_top")),
        }).drop("_slot", *children)
    return out


def _proven(leaves: DataFrame, fanout: int, above=None) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (_g, _o, _h and others) with ``_proof`` up to their group's root ``_top``; and the roots: _g and _top.

    ``above`` may turn the roots into rows of _g and _more: what is known of them, and what follows a proof.
    """
    bands = [_placed(leaves)]
    most = bands[0].agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]
    wide = fanout**LEVELS
    while most > 1:
        # One row of each block carries its top on.
        up = _lifted(bands[-1].select("_g", "_n", "_pos", "_h"), fanout, LEVELS).filter(F.col("_pos") % wide == 0)
        bands.append(materialize(up.select("_g", _div(F.col("_n") + (wide - 1), wide).alias("_n"), F.col("_block").alias("_pos"), F.col("_top").alias("_h"))))
        most = -(-most // wide)
    roots = bands[-1].select("_g", F.col("_h").alias("_top"))
    more = roots.withColumn("_rest", F.array().cast(PROOF)) if above is None else above(roots)
    keys = ["_g", "_block"]
    if len(bands) == 1:
        return bands[0].join(more, "_g").withColumn("_proof", F.col("_rest")).drop("_rest", "_n", "_pos"), roots
    down = more.withColumn("_block", F.lit(0).cast("long"))
    for k, band in reversed(list(enumerate(bands[:-1]))):
        rows = _lifted(band, fanout, LEVELS).drop("_top").join(down, keys).withColumn("_proof", F.concat("_proof", "_rest")).drop("_rest", "_block")
        if k:
            down = materialize(rows.withColumnRenamed("_proof", "_rest").withColumnRenamed("_pos", "_block").drop("_n", "_h"))
    return rows.drop("_n", "_pos"), roots


def manifest(docs: DataFrame, leaf: Column, group: str, order: str, fanout: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """The order column, leaf, subroot, root, ``proof`` (siblings before and after the own digest, level by level to
    the root) and the columns of ``carry`` (computed from ``docs``; they may not be called as the others)."""
    carry = carry or {}
    # Null groups first, the others by their bytes.
    g = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    extra = F.struct(F.col(f"`{order}`").alias("o"), *[c.alias(n) for n, c in carry.items()])
    leaves = docs.select(g.alias("_g"), F.col(f"`{order}`").alias("_o"), leaf.alias("_h"), extra.alias("_row"))

    def groups(roots: DataFrame) -> DataFrame:
        all_roots = roots.select(F.lit("").alias("_g"), F.col("_g").alias("_o"), F.col("_top").alias("_h"))
        proven, _ = _proven(all_roots, fanout)
        return proven.select(F.col("_o").alias("_g"), F.struct(F.col("_h").alias("subroot"), F.col("_top").alias("root")).alias("_tops"), F.col("_proof").alias("_rest"))

    rows, _ = _proven(leaves, fanout, groups)
    return rows.select(
        F.col("_row.o").alias(order), F.col("_h").alias("leaf"), F.col("_tops.subroot").alias("subroot"), F.col("_tops.root").alias("root"),
        F.col("_proof").alias("proof"), *[F.col(f"_row.`{n}`").alias(n) for n in carry],
    )
