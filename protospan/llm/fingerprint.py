"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (pieces between line feeds or sentence ends, blank ones
left out). Each piece hashes to a wide vector; a document's vector is the sum of its pieces' vectors
modulo 2**48, lane by lane. So the order of pieces does not matter, equal multisets have equal
vectors, and a piece is inserted or deleted by adding or subtracting its vector.

The upper half of a lane is a uniform 24-bit hash and makes different multisets differ. The lower half
counts the pieces whose hash has that lane's bit set; with the number of pieces (the last lane) this
gives a sum of random signs per lane, whose dot products estimate how many pieces two documents share.

Only Spark SQL functions are used. Null text counts as empty text; an empty multiset has a zero vector. Texts of any
length count whole: a vector is as long for a long text as for a short one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 64
MASK = (1 << 48) - 1
LOW = (1 << 24) - 1
BREAKS = r"\n+|(?<=[.!?])\s+"


def _mod(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def pieces(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda p: F.trim(p) != "")


def vector(text: Column) -> Column:
    """ARRAY<BIGINT>: LANES sums and the number of pieces, each modulo 2**48."""
    hashes = F.transform(pieces(text), lambda p: F.struct(F.xxhash64(p).alias("bits"), F.xxhash64(F.lit(1), p).alias("salt")))
    lanes = F.array(*[F.lit(i) for i in range(LANES)])

    def plus(acc, h):
        def lane(a, i):
            high = F.shiftleft(F.xxhash64(h["salt"], i).bitwiseAND(F.lit(LOW)), 24)
            low = F.call_function("shiftright", h["bits"], i).bitwiseAND(F.lit(1).cast("long"))
            return F.when(i < LANES, _mod(a + high + low)).otherwise(_mod(a + 1))

        return F.zip_with(acc, F.concat(lanes, F.array(F.lit(LANES))), lane)

    return F.aggregate(hashes, F.array_repeat(F.lit(0).cast("long"), LANES + 1), plus)


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the union (with multiplicity) of two multisets."""
    return F.zip_with(a, b, lambda x, y: _mod(x + y))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` after the pieces of ``b`` have been deleted."""
    return F.zip_with(a, b, lambda x, y: _mod(x - y + F.lit(MASK + 1)))


def text_of(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common pieces, 2 |A and B| / (|A| + |B|), from 0 to 1; equal vectors have 1."""
    def signs(v):
        return F.transform(F.slice(v, 1, LANES), lambda x: (2 * x.bitwiseAND(F.lit(LOW)) - F.element_at(v, LANES + 1)).cast("double"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    sa, sb = signs(a), signs(b)
    norm = dot(sa, sa) + dot(sb, sb)
    return F.when(a == b, 1.0).when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(sa, sb) / norm)))


def _literal(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"cast('{v}' as decimal(38,0))" for v in values) + ")")


def _blocks(keyed: DataFrame, block: int, ranges: int) -> tuple[Column, Column]:
    """The range ``_r`` of a row's ``_key`` and, by both, the number of its block: ascending, about ``block`` rows each.

    Some ``ranges`` ranges of keys are cut at every 16th key of a sample, drawn by hash; a range is dealt into
    equal strides of its own. So keys far off the others widen the strides of their own range alone. The driver
    holds the sample, of 16 * ``ranges`` keys on average, and each range's ends.
    """
    share = min(1.0, 16 * ranges / max(1, keyed.count()))
    sample = keyed.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 40)) < int(share * (1 << 40))).distinct()
    cut = sorted(int(r._key) for r in sample.collect())
    cut = cut[16::16] or [0]
    at = F.size(F.filter(_literal(cut), lambda k: k <= F.col("_key")))
    ends = {r._r: r for r in keyed.groupBy(at.alias("_r")).agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    lows, strides = [0] * (len(cut) + 1), [1] * (len(cut) + 1)
    for r, e in ends.items():
        lows[r] = int(e.lo)
        strides[r] = max(1, (int(e.hi) - int(e.lo) + 1) * block // int(e.n))
    low, stride = (F.element_at(_literal(v), F.col("_r") + 1) for v in (lows, strides))
    inside = F.call_function("div", F.col("_key") - low, stride)
    return at, F.shiftleft(F.col("_r").cast("long"), 48) + inside


def with_next(docs: DataFrame, block: int = 256, ranges: int = 512) -> DataFrame:
    """doc_id, text, vec and, of the next document by ascending doc_id (after the last: the first), next_text and next_vec.

    Documents are dealt into blocks of neighbours, about ``block`` rows each (see ``_blocks``), and texts are shuffled
    once. Inside a block the next row is a window's lead; the last row of a block takes the first row of the next
    block. Null ids come first; rows of one id are ordered by a hash of their text, so that a common id takes many
    blocks. An empty table gives no row; a single row is its own next.
    """
    h = F.shiftrightunsigned(F.xxhash64("text"), 4)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", h)
    # Null ids are below the least long; 60 bits of the hash follow the id.
    own = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.expr(f"cast('{-(1 << 63) - 1}' as decimal(20,0))"))
    key = (own * F.expr(f"cast('{1 << 60}' as decimal(19,0))")).cast("decimal(38,0)") + F.col("_h").cast("decimal(20,0)")
    keyed = docs.withColumn("_key", key.cast("decimal(38,0)"))
    at, number = _blocks(keyed.select("_key"), block, ranges)
    dealt = keyed.withColumn("_r", at).withColumn("_block", number).drop("_key", "_r")

    # Each block's predecessor: leads inside groups of 1024 blocks, then over the few groups.
    blocks = dealt.select("_block").distinct().withColumn("_group", F.floor(F.col("_block") / 1024))
    groups = blocks.groupBy("_group").agg(F.max("_block").alias("_last"))
    over = Window.orderBy("_group")
    groups = groups.select("_group", F.coalesce(F.lag("_last").over(over), F.last("_last").over(over.rowsBetween(0, Window.unboundedFollowing))).alias("_before"))
    before = blocks.join(groups, "_group").select("_block", F.coalesce(F.lag("_block").over(Window.partitionBy("_group").orderBy("_block")), "_before").alias("_prev"))

    order = Window.partitionBy("_block").orderBy("doc_id", "_h", "text")
    rows = dealt.select("*", F.lead("text").over(order).alias("_lead"), F.lead(F.lit(1)).over(order).isNull().alias("_end"))
    rows = rows.withColumn("vec", vector(F.col("text")))
    rows = rows.withColumn("_lead_vec", F.lead("vec").over(order))
    first = dealt.select("*", F.row_number().over(order).alias("_rn")).filter("_rn = 1")
    first = first.join(before, "_block").select(F.col("_prev").alias("_block"), F.lit(True).alias("_end"), F.col("text").alias("_first"), vector(F.col("text")).alias("_first_vec"))
    return rows.join(first, ["_block", "_end"], "left").select(
        "doc_id", "text", "vec",
        F.coalesce("_lead", "_first").alias("next_text"),
        F.coalesce("_lead_vec", "_first_vec").alias("next_vec"),
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text, of its edited form, and their likeness (see the query's contract)."""
    n = F.length("text").cast("long")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs).withColumn("n_chars", n).withColumn("edited", edited)
    rows = rows.withColumn("edited_vec", vector(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("vec")).alias("fingerprint"),
        text_of(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )
