"""Exact Jaccard self-join of documents on sets of word n-grams, by grouped prefixes.

Words are maximal runs of bytes other than white space, A-Z lowered. A document's set holds the hashes
of its distinct ``words``-grams; with fewer words, its whole sequence as one; without words, nothing. Two
documents link when ``parts`` * |A and B| >= ``least`` * |A or B|.

1. Documents with equal sets are one class, standing for all of them.
2. In an order of all n-grams that puts frequent ones last, linked sets share one of their first
   n - ceil(t n) + 1 n-grams. Which n-grams are frequent is found from all documents: tasks report those
   that two documents of a stretch of input share, and the MOST_SENT most reported go to every task.
   The order only decides how many candidates there are, never which pairs link.
3. Classes with equal prefixes and sizes make one group; candidates are pairs of groups that share an
   n-gram of their prefixes. By the first one they share, what follows it in both must allow the overlap
   that their sizes call for; as rare n-grams come first, this leaves few pairs that do not link.
   Postings of the most reported n-grams stay where they are, others meet by n-gram.
4. First, every group is tried against the least group of each n-gram it shares, and its members against
   its least member: a number of pairs that grows with the input. Verified pairs make components.
5. Where many groups of an n-gram still lie off the component that most of them lie in, as in a large group of
   near copies that are not all alike, they are tried against a few more groups of it: the components grow, at a
   cost in proportion to the postings. This goes on as long as such n-grams call for more candidates than there
   are postings, and for half as many as before at most.
6. Then all other candidates are tried: pairs of groups that do not lie in one component already,
   expanded to members of different components. What steps 4 and 5 have joined needs no further pair, so
   that a group of n copies costs some n pairs, not n^2; all other candidates are tried, so that no link
   between components is lost.

Verification compares whole sets. Many candidates do not link, so the parity of how many n-grams fall on each
of some 2n places is compared first: two sets differ in no fewer n-grams than their parities do in places. Defined results: null, empty and blank texts have size 0 and link with
nothing; rows with a null doc_id have no component. Texts of any length count whole. Equal rows share a
component; rows that repeat a doc_id with other texts are documents of their own, whose component_id is the
least doc_id that their own links reach. An empty table gives no rows. Other columns of ``docs`` are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protospan.llm import textops
from protospan.llm.components import components
from protospan.llm.store import by_tasks, materialize, python_ready, release

#: Frequent n-grams that every task gets, at most (8 bytes each).
MOST_SENT = 1 << 18
#: N-grams of a stretch of input in which shared ones are looked for.
STRETCH = 1 << 20
#: Ids of documents to verify, or pairs of them, that go to every task, at most; more are joined by a shuffle.
MOST_IDS = 1 << 18
#: N-grams reported so often have postings that do not meet in one task; the MOST_HOT most reported of them.
HOT, MOST_HOT = 5_000, 4_096
#: Where candidates between components of the n-grams with more than PIVOTS groups off the main one would be more than
#: SPREAD times the postings, components first grow by up to ROUNDS rounds of trying PIVOTS groups of each of these.
SPREAD, ROUNDS, PIVOTS = 1, 4, 24
#: Pairs that a task verifies, at least where there are fewer partitions than that calls for.
PAIRS_A_TASK = 1_000


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and hash of its distinct n-grams, by text and hash."""
    doc, w = textops.word_hashes(texts)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
    starts = np.append(0, ends[:-1])
    n = np.maximum(len(w) - words + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h = textops.mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n])
    whole = doc[:n] == doc[words - 1 : words - 1 + n]
    docs, hashes = [doc[:n][whole]], [h[whole]]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a < words:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = textops.mix(x * np.uint64(0x9E3779B97F4A7C15) + w[k] + np.uint64(1))
            docs.append(doc[a : a + 1])
            hashes.append(x)
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))
    return d[new], h[new]


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams reported as shared, the least frequent first, and how often they were reported."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def shared() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                h = shingles(textops.encoded(batch.column(0).slice(part, 512)), words)[1]
                held.append(h)
                size += len(h)
                if size >= STRETCH:
                    yield shared()
                    held, size = [], 0
        if held:
            yield shared()

    found = materialize(texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    step = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    at, least = 0, None
    for r in sorted(found.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.s):
        at += r.n
        if at > MOST_SENT:
            break
        least = r.s

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(k).to_numpy().tobytes()], pa.binary()) for k in (0, 1)], names=["h", "n"])

    top = found.filter(step >= least).mapInArrow(packed, "h binary, n binary").collect() if least is not None else []
    release(found)
    h, n = (np.frombuffer(b"".join(x), np.int64) for x in ([r.h for r in top], [r.n for r in top]))
    order = np.lexsort((h.view(np.uint64), n))
    return h.view(np.uint64)[order], n[order]


PARITY = ["q0", "q1", "q2", "q3"]


def _described(docs: DataFrame, words: int, least: int, parts: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, t, n, two hashes of the set (s1, s2), its parity at 256 places (q0 to q3), the prefix and two hashes of it (p1, p2) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((np.sort(frequent), np.argsort(frequent) + 1))

    def total(h: np.ndarray, salt: int, start: np.ndarray, stop: np.ndarray) -> pa.Array:
        sums = np.append(np.uint64(0), np.cumsum(textops.mix(h + np.uint64(salt)), dtype=np.uint64))
        return pa.array((sums[stop] - sums[start]).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = sent.value
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                b = batch.slice(part, 512)
                d, h = shingles(textops.encoded(b.column("text")), words)
                n = np.bincount(d, minlength=b.num_rows)
                start = np.cumsum(n) - n
                last = np.zeros(len(h), np.int64)
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    last = np.where(known[at] == h, place[at], 0)
                    moved = np.lexsort((h, last, d))
                    ordered = h[moved]
                else:
                    ordered = h
                take = np.where(n > 0, n - -(-least * n // parts) + 1, 0)
                ends = np.concatenate([[0], np.cumsum(take)])
                prefix = ordered[np.repeat(start - ends[:-1], take) + np.arange(ends[-1])]
                odd = np.bincount(d * 256 + (h & np.uint64(255)).astype(np.int64), minlength=256 * b.num_rows).reshape(-1, 256) & 1
                odd = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("t"), pa.array(n), *[total(h, k, start, start + n) for k in (1, 2)], *[pa.array(np.ascontiguousarray(odd[:, k])) for k in range(4)],
                     *[total(prefix, k, ends[:-1], ends[1:]) for k in (3, 4)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix.view(np.int64)))],
                    names=["doc_id", "t", "n", "s1", "s2", *PARITY, "p1", "p2", "prefix"],
                )

    return docs.mapInArrow(run, f"doc_id long, t long, n long, s1 long, s2 long, {', '.join(f'{q} long' for q in PARITY)}, p1 long, p2 long, prefix array<long>")


def _parity(h: np.ndarray) -> bytes:
    """The set's size, and for each of 2n places or more whether an odd number of n-grams falls there."""
    places = max(256, 1 << (2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.array([len(h)], "<i8").tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _may_link(x: bytes, y: bytes, least: int, parts: int) -> bool:
    n = sum(int(np.frombuffer(v, "<i8", 1)[0]) for v in (x, y))
    p, q = (np.frombuffer(v, np.uint8, offset=8) for v in sorted((x, y), key=len))
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    differ = int(np.bitwise_count(p ^ q).sum())
    return (n - differ) * (parts + least) >= 2 * least * n


def _links(x: bytes, y: bytes, least: int, parts: int) -> bool:
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and parts * shared >= least * (len(both) - shared)


NODE = "struct<d: long, t: long>"


def _that(docs: DataFrame, pairs: DataFrame, n: int, words: int, made: Callable[[np.ndarray], bytes], holds: Callable[[bytes, bytes], bool]) -> DataFrame:
    """Those of the n (distinct) pairs a, b of documents for which ``holds`` is true of what is ``made`` of their sets."""
    few = n <= MOST_IDS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                b = batch.slice(part, 512)
                d, h = shingles(textops.encoded(b.column("text")), words)
                cut = np.searchsorted(d, np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("t"), pa.array([made(h[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["d", "t", "set"])

    def side(name: str, as_: str) -> DataFrame:
        ids = sent(pairs.select(F.col(f"{name}.d").alias("d"), F.col(f"{name}.t").alias("w")).distinct())
        wanted = docs.join(ids, (docs.doc_id == F.col("d")) & (docs.t == F.col("w")), "left_semi")
        # Equal rows are one document.
        return wanted.select("doc_id", "t", "text").mapInArrow(sets, "d long, t long, set binary").select(F.struct("d", "t").alias(name), F.col("set").alias(as_))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([holds(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    # What is made of b meets its pairs where it was made, if these are few; then it goes to that of a.
    both = side("b", "y").join(sent(pairs), "b").join(side("a", "x"), "a")
    return by_tasks(both.select("a", "b", "x", "y"), n, PAIRS_A_TASK).mapInArrow(compare, f"a {NODE}, b {NODE}")


def ngram_classes(docs: DataFrame, words: int = 5, least: int = 80, parts: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text), its text's hash t, and
    whether it is the first document of its component (first; so are equal rows)."""
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    frequent, reported = _frequent(docs.select("text"), words)
    rows = materialize(_described(docs, words, least, parts, frequent))
    sig, by = ["s1", "s2", "n"], ["n", "p1", "p2"]
    full = rows.filter("n > 0 and doc_id is not null")
    gid = F.xxhash64(*by).alias("gid")
    size = rows.count()
    # A class is known by its least document.
    members = materialize(full.groupBy(*sig).agg(F.min(F.struct(F.col("doc_id").alias("d"), "t")).alias("node"), *[F.first(c).alias(c) for c in ("p1", "p2", *PARITY)]).select(*sig, "node", gid, *PARITY), size)

    def lead_of(members: DataFrame) -> DataFrame:
        return members.groupBy("gid").agg(F.min(F.struct("node", "n", *PARITY)).alias("m"), F.count(F.lit(1)).alias("of")).select("gid", F.col("m.node").alias("lead"), "m.*", "of").drop("node")

    lead = lead_of(members)
    heads = full.groupBy(*by).agg(F.first("prefix").alias("prefix")).select(gid, "n", "prefix")

    # From the first shared n-gram on, both sets need as many n-grams as the least overlap that links them.
    def fits(n, at, m, other_at):
        return F.least(F.col(n) - F.col(at), F.col(m) - F.col(other_at)) * (parts + least) >= (F.col(n) + F.col(m)) * least

    def pivoted(tokens: DataFrame, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
        shared = tokens.groupBy("token").agg(F.min(F.struct("gid", "n", "pos")).alias("p"), F.max("gid").alias("z"), F.count(F.lit(1)).alias("all")).filter("p.gid != z")
        return tokens.join(send(shared.select("token", "all", F.col("p.gid").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))), "token")

    tokens = heads.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    hot = frequent[reported >= HOT][-MOST_HOT:].view(np.int64).tolist()
    posted = pivoted((tokens.filter(~F.col("token").isin(hot)) if hot else tokens).repartition("token"), lambda df: df)
    if hot:
        posted = posted.unionByName(pivoted(tokens.filter(F.col("token").isin(hot)), F.broadcast))
    posted = materialize(posted)
    postings = posted.count()

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()

    # Sets differ in as many n-grams as their parities do in places, or more.
    def close(n, m, x, y):
        differ = sum((F.bit_count(F.col(f"{x}{q}").bitwiseXOR(F.col(f"{y}{q}"))) for q in PARITY), F.lit(0))
        return (F.col(n) + F.col(m) - differ) * (parts + least) >= (F.col(n) + F.col(m)) * (2 * least)

    def led(pairs: DataFrame, lead: DataFrame) -> DataFrame:
        of = [lead.select(F.col("gid").alias(g), F.col("lead").alias(c), F.col("n").alias(f"{c}n"), *[F.col(q).alias(c + q) for q in PARITY]) for g, c in (("pivot", "a"), ("gid", "b"))]
        return pairs.join(of[0], "pivot").join(of[1], "gid").filter(close("an", "bn", "a", "b")).select("a", "b")

    stars = led(posted.filter(fits("n", "pos", "pn", "ppos")).select("pivot", "gid").filter("pivot != gid").distinct(), lead)
    inside = members.select("node", "gid").join(lead.select("gid", "lead"), "gid").filter("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame | None:
        """Links among pairs; None if there can be none. Parities, 32 times shorter, settle most pairs that are none before whole sets meet."""
        n = pairs.count()
        if not n:
            return None
        likely = materialize(_that(docs, pairs, n, words, _parity, lambda x, y: _may_link(x, y, least, parts)), n)
        n = likely.count()
        return _that(docs, likely, n, words, np.ndarray.tobytes, lambda x, y: _links(x, y, least, parts)) if n else None

    def joined(found: DataFrame, links: DataFrame | None) -> DataFrame:
        """The components that ``found`` and the links make."""
        return found if links is None else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), rows=size)

    tried = materialize(ordered(stars.union(inside)), size)
    none = spark.createDataFrame([], f"node {NODE}, component {NODE}")
    found = joined(none, verified(tried))

    def placed(members: DataFrame, of: DataFrame, bare: DataFrame, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Members and their components; the component of a group, by its hash, if all members lie in one; postings with it."""
        at = materialize(members.select("node", "gid").join(found, "node", "left").select("node", "gid", F.coalesce("component", "node").alias("c")), size)
        span = at.groupBy("gid").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).withColumn("c", F.when(F.col("lo") == F.col("hi"), F.xxhash64("lo")))
        known = of.select("gid", *[F.when(F.col("of") == 1, F.col(q)).alias(q) for q in PARITY])  # of groups of one set
        return at, span, materialize(bare.join(span.select("gid", "c").join(known, "gid"), "gid"), rows)

    def mains(spread: DataFrame, rows: int) -> DataFrame:
        """The main component of an n-gram is the one that most of its groups lie in; n-grams whose groups all lie in it are left out."""
        mixed = (
            spread.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("all"), F.max(F.struct("k", "c")).alias("most"), F.max(F.col("c").isNull()).alias("split"))
            .filter("parts > 1 or split")
        )
        return materialize(mixed.select("token", "all", F.when(F.col("most.c").isNotNull(), F.col("most.k")).otherwise(0).alias("k"), F.col("most.c").alias("main")), rows)

    # N-grams with few groups call for few candidates each, so that only the others' groups are looked at here.
    bare = posted.select("token", "gid", "n", "pos")
    crowded = materialize(posted.filter(F.col("all") > PIVOTS).select("token", "gid", "n", "pos"))
    crowd, before = crowded.count(), float("inf")
    helpers = [crowded]
    if crowd:
        groups = materialize(crowded.select("gid").distinct(), crowd)
        theirs = members.join(F.broadcast(groups) if groups.count() <= MOST_IDS else groups, "gid", "left_semi")
        theirs = materialize(theirs, size)
        chief = materialize(lead_of(theirs), size)
        helpers += [groups, theirs, chief]
    for turn in range(ROUNDS if crowd else 0):
        at, _, spread = placed(theirs, chief, crowded, crowd)
        mixed = mains(spread, crowd)
        dense = mixed.filter(F.col("all") - F.col("k") > PIVOTS)
        many = dense.agg(F.sum(F.expr("cast((all - k) * all as double)"))).first()[0] or 0
        if many <= SPREAD * postings or 2 * many > before:
            release(at, spread, mixed)
            break
        before = many
        some = F.array(*[F.min(F.struct(F.xxhash64("gid", F.lit(turn * PIVOTS + k)).alias("h"), F.col("gid").alias("pivot"), F.col("n").alias("pn"), F.col("pos").alias("ppos"), F.col("c").alias("pc"), *[F.col(q).alias(f"p{q}") for q in PARITY])) for k in range(PIVOTS)])
        pivots = spread.join(dense.select("token"), "token", "left_semi").groupBy("token").agg(some.alias("some"))

        def plausible(p):
            differ = sum((F.bit_count(F.col(q).bitwiseXOR(p[f"p{q}"])) for q in PARITY), F.lit(0))
            room = F.least(F.col("n") - F.col("pos"), p["pn"] - p["ppos"]) * (parts + least) >= (F.col("n") + p["pn"]) * least
            alike = (F.col("n") + p["pn"] - differ) * (parts + least) >= (F.col("n") + p["pn"]) * (2 * least)
            return (F.col("gid") != p["pivot"]) & F.coalesce(F.col("c") != p["pc"], F.lit(True)) & room & F.coalesce(alike, F.lit(True))

        near = spread.join(pivots, "token").select("gid", F.explode(F.filter("some", plausible)).alias("p")).select("gid", "p.pivot")
        extra = materialize(ordered(led(near.select("pivot", "gid").distinct(), chief)).join(tried, ["a", "b"], "left_anti"), size)
        found = joined(found, verified(extra))
        release(at, spread, mixed)
        tried = tried.union(extra)
    release(*helpers)
    at, span, spread = placed(members, lead, bare, postings)
    mixed = mains(spread, postings)
    posted = spread.join(mixed.select("token", "main"), "token")
    # Every pair of groups but those that lie in the main component both: one side is always off it.
    in_main = F.coalesce(F.col("c") == F.col("main"), F.lit(False))
    off, other = (posted.select("token", in_main.alias(f"{x}_main"), *[F.col(v).alias(x + v) for v in ("gid", "n", "pos", "c", *PARITY)]) for x in "ab")
    cross = off.filter("not a_main").join(other, "token").filter(
        (F.col("b_main") | (F.col("agid") < F.col("bgid"))) & F.coalesce(F.col("ac") != F.col("bc"), F.lit(True))
        & fits("an", "apos", "bn", "bpos") & F.coalesce(close("an", "bn", "a", "b"), F.lit(True))).select(F.col("agid").alias("a"), F.col("bgid").alias("b"))
    group_pairs = ordered(cross.select("a", "b"))
    left = at.select(F.col("gid").alias("a"), F.col("node").alias("x"), F.col("c").alias("cx"))
    right = at.select(F.col("gid").alias("b"), F.col("node").alias("y"), F.col("c").alias("cy"))
    # Inside a group only members off its least component are tried against the others.
    split = span.filter("lo != hi").select(F.col("gid").alias("a"), F.col("gid").alias("b"), F.col("lo").alias("low"))
    within = split.join(left, "a").filter("cx != low").join(right, "b").filter("cx != cy").select(F.col("x").alias("a"), F.col("y").alias("b"))
    between = group_pairs.join(left, "a").join(right, "b").filter("cx != cy").select(F.col("x").alias("a"), F.col("y").alias("b"))
    rest = materialize(ordered(between.union(within)).join(tried, ["a", "b"], "left_anti"), size)
    release(spread, mixed)
    final = joined(found, verified(rest))

    release(rest)
    reps = members.select(*sig, "node").join(final, "node", "left").select(*sig, "node", F.coalesce("component", "node").alias("c"))
    linked = full.select("doc_id", "t", *sig).join(reps, sig).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("c.d").alias("component_id"), "t",
        ((F.col("node") == F.col("c")) & (F.col("doc_id") == F.col("c.d")) & (F.col("t") == F.col("c.t"))).alias("first"))
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "t", F.lit(True).alias("first"))
    return linked.union(alone)
