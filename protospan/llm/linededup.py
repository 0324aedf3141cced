"""Repeated runs of lines, found in a suffix order and deleted in later copies.

Every line of every document starts a suffix of that document's sequence of line ids. Prefix doubling
sorts them: ranks at length 1 follow the order of line ids, ranks at length 2 L the order of pairs of ranks
L apart, until no rank repeats. A rank that several suffixes have is an interval of the suffix order
whose common prefix has L lines; its earliest suffix, by doc_id and line number, is the copy that stays.
Suffixes whose prefix occurs once leave the table: their place in the order is settled, and no longer
prefix of theirs can repeat. An interval of a depth that is no power of two comes from two overlapping ranks.

A suffix has at least the depth of each of its intervals in common with an earlier one. In the order of
the text these common prefixes shrink by a line at most from one suffix to the next, so that their ends,
taken together, are the ends of maximal repeated runs. A line is deleted when it lies in a run of at least
``min_lines`` lines that has an earlier copy, or is itself a later copy and has at least ``min_words`` words.

Only Spark SQL functions are used. Groups for ranks are sums that tasks add up first; rows get their ranks
by joins, which the session's adaptive execution splits where one line is very common.

Defined results: null and empty texts stay as they are; an empty table gives no rows. Texts of any length
count whole. Rows that repeat both doc_id and text count as one document and all keep the same text; rows
with one doc_id and different texts are documents of their own. Null ids come first. Other columns are kept,
whatever their names, but for ``n_lines``, ``n_deleted`` and ``n_runs``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protospan.llm.store import materialize, release

KEY = ["_d", "_t"]  # a document: its id and its text's hash
AT = [*KEY, "_pos"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The document's key, its text and, in ``_row``, its columns."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64("text").alias("_t"),
        F.col("text").alias("_text"), F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_row"),
    )


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` occurs more than once, with its place ``_r`` in the order of all that do, and the earliest row ``_e``."""
    at = F.struct(*AT)
    groups = rows.groupBy(*by).agg(F.min(at).alias("_e"), F.max(at).alias("_z")).filter("_e != _z").drop("_z")
    # Ascending with the sorted partitions and the rows in them; written at once, so that it stays as it is.
    order = materialize(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_r", F.monotonically_increasing_id()))
    return rows.join(order, by)


def _further(ranks: DataFrame, shift: int) -> DataFrame:
    """Ranks of the prefixes that reach ``shift`` lines further."""
    there = Window.partitionBy(*KEY).orderBy("_pos").rangeBetween(shift, shift)
    two = ranks.select(*AT, F.col("_r").alias("_r1"), F.first("_r").over(there).alias("_r2"))
    return _ranked(two.filter("_r2 is not null"), ["_r1", "_r2"]).select(*AT, "_r", "_e")


def repeated_prefixes(docs: DataFrame, min_lines: int = 4, min_words: int = 10) -> DataFrame:
    """_d, _t, _pos (from 0), reach: the lines from _pos to before reach have an earlier copy that counts.

    From every interval of at least ``min_lines`` lines, and of one line if it has ``min_words`` words.
    """
    lines = (
        _keyed(docs).filter(F.col("_text").isNotNull())
        .select(*KEY, F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .select(*AT, F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), "_line").alias("_h2"),
                (F.size(F.split(F.trim("_line"), r"\s+")) >= min_words).alias("_long"))
    )
    # Equal rows are one document.
    one = _ranked(lines, ["_h1", "_h2"]).groupBy(*AT).agg(*[F.first(c).alias(c) for c in ("_r", "_e", "_long")])
    ranks, length = materialize(one), 1

    def later(rows: DataFrame, depth: int) -> DataFrame:
        return rows.filter(F.col("_e") != F.struct(*AT)).select(*AT, (F.col("_pos") + depth).alias("reach"))

    found = later(ranks if min_lines == 1 else ranks.filter("_long"), 1)
    while not ranks.isEmpty():
        if length < min_lines < 2 * length:
            found = found.union(later(materialize(_further(ranks, min_lines - length)), min_lines))
        last, ranks, length = ranks, materialize(_further(ranks, length)), 2 * length
        if length >= min_lines:
            found = found.union(later(ranks, length))
        elif length > 2:
            release(last)
    return found


def dedup_lines(docs: DataFrame, min_lines: int = 4, min_words: int = 10) -> DataFrame:
    """``docs`` with the text that stays, n_lines, n_deleted and n_runs (of neighbouring deleted lines)."""
    # Runs of a document: prefixes that touch or overlap, from the first line to the farthest end so far.
    before = Window.partitionBy(*KEY).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEY).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = repeated_prefixes(docs, min_lines, min_words).groupBy(*AT).agg(F.max("reach").alias("_reach"))
    spans = spans.withColumn("_far", F.max("_reach").over(before)).withColumn("_new", (F.col("_far").isNull() | (F.col("_pos") > F.col("_far"))).cast("int"))
    runs = spans.withColumn("_run", F.sum("_new").over(upto)).groupBy(*KEY, "_run").agg(F.struct(F.min("_pos").alias("at"), F.max("_reach").alias("end")).alias("_span"))
    gone = runs.groupBy(*KEY).agg(F.sort_array(F.collect_list("_span")).alias("_gone"))
    rows = _keyed(docs).join(gone, KEY, "left").withColumn("_lines", F.split("_text", "\n"))
    # What stays between runs: slices of the array of lines, joined in one go.
    starts = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda g: g["end"]))
    ends = F.concat(F.transform("_gone", lambda g: g["at"]), F.array(F.size("_lines")))
    stays = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.slice("_lines", x["a"] + 1, x["b"] - x["a"])))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(stays, "\n"))
    deleted = F.aggregate("_gone", F.lit(0), lambda n, g: n + g["end"] - g["at"])
    out = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted", "n_runs")]
    return rows.select(
        *[text.alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`").alias(c) for c in out],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).alias("n_lines"),
        F.coalesce(deleted, F.lit(0)).alias("n_deleted"),
        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_runs"),
    )
