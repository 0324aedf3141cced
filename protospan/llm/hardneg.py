"""Hard negatives of anchors, by angles to reference directions and exact integer scores.

A row's vector becomes integers, floor(scale * x); a score is their inner product. Every row stores its norm and
its angles to the reference directions, which are those of a bounded sample of REFERENCES rows. By the triangle
inequality on the sphere the angle between an anchor and a row lies between the largest difference of their angles
to one reference and the least sum of them (2 pi less the sum, where that is less). Cosines of these ends times the
norms, rounded outwards, bound the score. Rows of a label are sorted by their nearest reference and the angle to it
and cut into windows of WINDOW rows; only windows whose bounds overlap what an anchor still looks for are scored.

Anchors and rows are dealt into blocks, and a task holds one of each. It keeps the first few rows of every anchor
and range of scores; these are merged by anchor. First the positives of each anchor are found, then, with a range of
scores for each positive, its negatives. Every pair of blocks is visited, so that nothing is missed.

Defined results: rows with a null id, a null label, a null or empty vector, a null or non-finite component, or whose
integers have a norm of 2**31 or more (their scores might not fit) take no part. Vectors of different lengths are
not compared. Repeated rows are rows of their own, and each repeated anchor gets its own results. Rows with one id
and score may come in either order. An anchor without a positive, or with none whose range holds a negative, has no
row; so has an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protospan.llm.store import materialize, python_ready

#: Rows whose directions serve as references; rows of a window.
REFERENCES, WINDOW = 16, 64
#: Anchors and rows of a block, at most; blocks of rows that a small table is dealt into, and rows of these.
ANCHORS, ROWS, LEAST_BLOCKS, LEAST_ROWS = 8192, 65536, 64, 512
#: Share of the product of two norms that roundings of angles and cosines stay well below.
SLACK = 1e-6
#: Candidates that wait before they are merged.
PENDING = 50_000
EVER = 2**62


def vectors_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of each length: which rows they are, and a matrix."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    return [(at := np.flatnonzero(lengths == d), flat[ends[at][:, None] + np.arange(d)[None, :]]) for d in np.unique(lengths)]


def angles(x: np.ndarray, norm: np.ndarray, references: list[np.ndarray]) -> np.ndarray:
    """Angles of rows to the references of their length; a zero row's are right angles."""
    own = [r for r in references if len(r) == x.shape[1]]
    if not own:
        return np.zeros((len(x), 0))
    return np.arccos(np.clip(x @ np.stack(own).T / np.where(norm > 0, norm, 1)[:, None], -1, 1))


def _stored(references: list[np.ndarray], scale: float):
    def run(batches):
        for b in batches:
            for at, x in vectors_of(b.column("e")):
                with np.errstate(over="ignore"):
                    q = np.floor(scale * x)
                    norm = np.sqrt((q * q).sum(axis=1))
                ok = norm < 2**31
                at, q, norm = at[ok], q[ok], norm[ok]
                if not len(at):
                    continue
                t = angles(q, norm, references)
                raw = q.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(pa.array(at)) for c in ("id", "label", "anchor")), pa.array(np.full(len(at), q.shape[1], np.int32)),
                     pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(norm), pa.array([r.tobytes() for r in t], pa.binary())],
                    names=["id", "label", "anchor", "dim", "q", "norm", "angles"],
                )

    return run


def score_bounds(ta, na, low_t, high_t, low_n, high_n) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each anchor with any row of each window, rounded outwards.

    ``ta``: anchors by references, ``na``: anchors' norms; ``low_t``, ``high_t``: windows by references; ``low_n``,
    ``high_n``: windows' norms.
    """
    near, far = np.zeros((len(ta), len(low_t))), np.full((len(ta), len(low_t)), np.pi)
    for r in range(ta.shape[1]):
        a = ta[:, r, None]
        np.maximum(near, np.maximum(a - high_t[None, :, r], low_t[None, :, r] - a), out=near)
        np.minimum(far, np.minimum(a + high_t[None, :, r], 2 * np.pi - a - low_t[None, :, r]), out=far)
    top, low = np.cos(near), np.cos(far)
    up, down = (na[:, None] * c * np.where(c > 0, p, q) for c, p, q in ((top, high_n[None, :], low_n[None, :]), (low, low_n[None, :], high_n[None, :])))
    slack = 1 + SLACK * na[:, None] * high_n[None, :]
    return np.floor(down - slack), np.ceil(up + slack)


def products(a: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact integer products; by floating point where no partial sum can reach 2**53."""
    if most < 2**52:
        return (a.astype(float) @ x.T.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ x.T.astype(np.int64)


class _Best:
    """The first ``k`` rows of each range of scores, by falling score and rising id."""

    def __init__(self, low: np.ndarray, k: int):
        self.k, self.least = k, low.copy()
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple] = []
        self.n = 0

    def add(self, slot, score, ident) -> None:
        self.waiting.append((slot, score, ident))
        self.n += len(slot)
        if self.n > PENDING:
            self.merge()

    def merge(self) -> None:
        slot, score, ident = (np.concatenate([own, *new]) for own, new in zip((self.slot, self.score, self.id), zip(*self.waiting, strict=True) if self.waiting else ((), (), ()), strict=True))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.k
        last = np.arange(len(slot)) - first == self.k - 1
        self.least[slot[last]] = np.maximum(self.least[slot[last]], score[last])
        self.slot, self.score, self.id = slot[keep], score[keep], ident[keep]
        self.waiting, self.n = [], 0


def _found(k: int, same: bool):
    made = pa.schema([("n", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def search(anchors: pa.Table, rows: pa.Table, dim: int) -> pa.Table:
        def matrices(t):
            return (np.frombuffer(b"".join(t.column("q").to_pylist()), "<i4").reshape(len(t), dim), np.frombuffer(b"".join(t.column("angles").to_pylist())).reshape(len(t), -1),
                    *(t.column(c).to_numpy() for c in ("norm", "label", "id", "n")))

        aq, at, an, al, _, am = matrices(anchors)
        q, t, norm, label, ident, number = matrices(rows)
        # Windows: rows of one label, side by side in the angle to their nearest reference.
        cell = t.argmin(axis=1) if t.shape[1] else np.zeros(len(t), np.int64)
        order = np.lexsort((t[np.arange(len(t)), cell] if t.shape[1] else cell, cell, label))
        q, t, norm, label, ident, number = (x[order] for x in (q, t, norm, label, ident, number))
        turns = np.flatnonzero(np.diff(label)) + 1
        starts = np.concatenate([np.arange(a, b, WINDOW) for a, b in zip([0, *turns], [*turns, len(label)], strict=True)])
        ends = np.append(starts[1:], len(label))
        low_t, high_t = np.minimum.reduceat(t, starts, axis=0), np.maximum.reduceat(t, starts, axis=0)
        low_n, high_n = np.minimum.reduceat(norm, starts), np.maximum.reduceat(norm, starts)
        down, up = score_bounds(at, an, low_t, high_t, low_n, high_n)
        # Ranges of scores, those of an anchor side by side.
        lows = anchors.column("low").to_pylist()
        owner = np.repeat(np.arange(len(lows)), [len(v) for v in lows])
        slot = np.concatenate([np.arange(len(v), dtype=np.int32) for v in lows])
        low, high = (np.array([x for v in anchors.column(c).to_pylist() for x in v], np.int64) for c in ("low", "high"))
        best = _Best(low, k)
        fits = (al[owner, None] == label[starts][None, :]) == same
        for w in np.argsort(-up.sum(axis=0), kind="stable"):
            live = np.flatnonzero(fits[:, w] & (up[owner, w] >= best.least) & (down[owner, w] <= high))
            if not len(live):
                continue
            who, place = np.unique(owner[live], return_inverse=True)
            here = slice(starts[w], ends[w])
            s = products(aq[who], q[here], float(an[who].max() * high_n[w]))[place]
            i, j = np.nonzero((s >= best.least[live, None]) & (s <= high[live, None]) & (am[owner[live], None] != number[here][None, :]))
            best.add(live[i], s[i, j], ident[here][j])
        best.merge()
        return pa.table([am[owner[best.slot]], slot[best.slot], best.id, best.score], schema=made)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        out = []
        for dim in set(group.column("dim").to_pylist()):
            own = group.filter(pc.equal(group.column("dim"), dim))
            anchors = own.filter(pc.is_valid(own.column("low")))
            rows = own.filter(pc.is_null(own.column("low")))
            if len(anchors) and len(rows):
                out.append(search(anchors, rows, dim))
        return pa.concat_tables(out) if out else made.empty_table()

    return run


def _best(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, k: int, same: bool) -> DataFrame:
    """n, slot, rank, id and score of the first ``k`` rows in every range of an anchor's scores."""
    a_blocks = max(1, -(-n_anchors // ANCHORS))
    r_blocks = max(1, -(-n_rows // ROWS), min(LEAST_BLOCKS, -(-n_rows // LEAST_ROWS)))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")
        return df.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    empty = F.lit(None).cast("array<long>")
    both = dealt(anchors, "ab", a_blocks, "rb", r_blocks).unionByName(dealt(rows.withColumns({"low": empty, "high": empty}), "rb", r_blocks, "ab", a_blocks))
    found = both.groupBy("ab", "rb").applyInArrow(_found(k, same), "n long, slot int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("n", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | str = "label", ident: str = "vec_id", vector: str = "embedding",
    scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, references: int = REFERENCES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For every anchor (a condition on ``vectors``) its first ``positives`` other rows of its label, and for each the
    first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` per cent of the positive's.
    """
    python_ready(vectors.sparkSession)
    e = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    given = vectors.select(F.col(f"`{ident}`").cast("long").alias("id"), label.cast("long").alias("label"), e.alias("e"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    given = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.coalesce(finite, F.lit(False)))
    # A few rows, by a hash of their vectors, as directions.
    sample = given.select("e", F.xxhash64("e").alias("h")).orderBy("h").limit(references).collect()
    known = [x / np.sqrt(x @ x) for x in (np.array(r.e) / max(1e-300, np.abs(r.e).max()) for r in sample) if (x != 0).any()]
    schema = "id long, label long, anchor boolean, dim int, q binary, norm double, angles binary"
    rows = materialize(given.mapInArrow(_stored(known, scale), schema).withColumn("n", F.monotonically_increasing_id()))
    count = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    asked = rows.filter("anchor").drop("anchor")
    rows = rows.drop("anchor")
    whole = asked.withColumns({"low": F.array(F.lit(-EVER)), "high": F.array(F.lit(EVER))})
    near = _best(whole, rows, count.anchors, count.rows, positives, True)
    near = materialize(near.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near")))
    # Decimals, so that ends of ranges are exact.
    def share(s, per_cent):
        return s["score"].cast("decimal(20,0)") * F.lit(Decimal(per_cent) / 100)

    least, most = F.transform("near", lambda s: F.ceil(share(s, low)).cast("long")), F.transform("near", lambda s: F.floor(share(s, high)).cast("long"))
    ranges = asked.join(near, "n").withColumns({"low": least, "high": most}).drop("near")
    hard = _best(ranges, rows, count.anchors, count.rows, negatives, False)
    names = asked.select("n", F.col("id").alias("anchor_id")).join(near, "n").select("n", "anchor_id", F.posexplode("near").alias("slot", "p"))
    return hard.join(names, ["n", "slot"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
