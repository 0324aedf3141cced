"""Registered queries of the library's own operators, with the same in DuckDB's SQL where SQL can say it.

Vectors come out as a row for each coordinate, rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protospan.functions.tables import new_folder
from protospan.functions.vectors import isclose
from protospan.operators import analysis, build, energies, experiment, pairs, prep, scores, spectral, swap
from protospan.plans.inputs import EMB, LINE, STEPS, build_steps, embeddings, lineitems, swap_steps, table
from protospan.sources.points import assemble

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    """Six digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def cells(df: DataFrame, vec: str = "features", *more: str) -> DataFrame:
    return df.select("id", *more, F.posexplode(vec).alias("pos", "v")).withColumn("v", r6("v"))


def five(pts: DataFrame) -> pairs.Prototypes:
    return pairs.prototypes(pts, [0, 1, 2, 3, 4])


CELLS = "SELECT id, (pos - 1)::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM (SELECT id, unnest(e) AS v, unnest(range(1, len(e) + 1)) AS pos FROM {t})"
FIVE = "p AS (SELECT id AS pid, e AS pe, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS slot FROM emb WHERE id < 5)"
NEAR = f"""{EMB}, {FIVE},
d AS (SELECT id, slot, list_distance(e, pe) AS d FROM emb, p),
n AS (SELECT id, slot, d, row_number() OVER (PARTITION BY id ORDER BY d, slot) AS rn FROM d),
s AS (SELECT a.id, a.slot AS near_slot, a.d AS dist, b.slot AS next_slot, b.d AS next_dist FROM n a JOIN n b USING (id) WHERE a.rn = 1 AND b.rn = 2)"""


def flagship(spark: SparkSession, d: str) -> DataFrame:
    pts = embeddings(spark, d)
    got = build.build_sampling(pts, 5, "cluster", 2, 42)
    return energies.cluster_sizes(energies.cluster_assign(pts, got.chosen))


# Preparation

@query(f"WITH {EMB}, m AS (SELECT least(0, min(list_min(e))) AS m FROM emb), t AS (SELECT id, list_transform(e, lambda x: x - m) AS e FROM emb, m) {CELLS.format(t='t')}")
def prep_shift_nonneg(spark, d):
    return cells(prep.shift_nonneg(embeddings(spark, d)))


@query(f"WITH {EMB}, m AS (SELECT max(list_max(e)) AS m FROM emb), t AS (SELECT id, list_transform(e, lambda x: x / m) AS e FROM emb, m) {CELLS.format(t='t')}")
def prep_scale_by_max(spark, d):
    return cells(prep.scale_by_max(embeddings(spark, d)))


@query(f"WITH {LINE}, t AS (SELECT id, list_transform(e, lambda x: CASE WHEN list_dot_product(e, e) > 0 THEN x / sqrt(list_dot_product(e, e)) ELSE x END) AS e FROM line) {CELLS.format(t='t')}")
def prep_l2_normalize(spark, d):
    return cells(prep.l2_normalize(lineitems(spark, d)))


_UNNEST = "c AS (SELECT id, unnest(e) AS v, unnest(range(len(e))) AS pos FROM {t})"


@query(f"WITH {EMB}, {_UNNEST.format(t='emb')}, m AS (SELECT pos, avg(v) AS m FROM c GROUP BY pos) SELECT id, pos::INTEGER AS pos, round(v - m, 6) + 0.0 AS v FROM c JOIN m USING (pos)")
def prep_center(spark, d):
    return cells(prep.center(embeddings(spark, d)))


@query(f"""WITH {EMB}, {_UNNEST.format(t='emb')}, h AS (SELECT id, pos, CASE WHEN (id + pos) % 7 = 0 THEN NULL ELSE v END AS v FROM c),
m AS (SELECT pos, avg(v) AS m FROM h GROUP BY pos) SELECT id, pos::INTEGER AS pos, round(coalesce(v, m), 6) + 0.0 AS v FROM h JOIN m USING (pos)""")
def prep_impute_mean(spark, d):
    holes = embeddings(spark, d).withColumn("features", F.transform("features", lambda x, i: F.when((F.col("id") + i) % 7 == 0, F.lit(None)).otherwise(x)))
    return cells(prep.impute_mean(holes))


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_nationkey::DOUBLE AS nation, c_mktsegment AS label FROM customer")
def assemble_customer(spark, d):
    pts = assemble(table(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment")
    return pts.select("id", F.element_at("features", 1).alias("balance"), F.element_at("features", 2).alias("nation"), "label")


_U = "(('0x' || substr(md5('{seed}:{step}:' || id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0"


@query(f"WITH {EMB} SELECT id, label FROM emb ORDER BY {_U.format(seed=42, step='sample')}, id LIMIT 100")
def sample_exact(spark, d):
    return prep.sample_exact(embeddings(spark, d), 100).select("id", "label")


@query(f"""WITH x AS (SELECT doc_id AS id, lang AS label FROM documents),
y AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_U.format(seed=42, step='stratum')}, id) AS rn FROM x) SELECT id, label FROM y WHERE rn <= 20""")
def sample_per_label(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    return prep.sample_per_label(docs, 20)


@query(f"WITH {EMB} SELECT id, label FROM emb WHERE label <> 0")
def drop_unlabeled(spark, d):
    return prep.drop_unlabeled(embeddings(spark, d)).select("id", "label")


@query(f"WITH {EMB} SELECT label, count(*) AS points, max(len(e))::INTEGER AS dimensions FROM emb GROUP BY label")
def label_summary(spark, d):
    return prep.label_summary(embeddings(spark, d))


@query(f"WITH {LINE} SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM line")
def with_position(spark, d):
    return prep.with_position(lineitems(spark, d).select("id"))


@query(f"""WITH {EMB}, o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM emb)
SELECT pos AS id, n::INTEGER AS pos, round(v, 6) + 0.0 AS v FROM (SELECT n, unnest(e) AS v, unnest(range(len(e))) AS pos FROM o)""")
def transpose(spark, d):
    return cells(prep.transpose(embeddings(spark, d)))


@query("""WITH o AS (SELECT o_orderkey // 40 AS r, row_number() OVER (PARTITION BY o_orderkey // 40 ORDER BY o_orderkey) - 1 AS c, o_totalprice AS a, o_custkey AS b FROM orders)
SELECT r * 40 + c AS id, 0 AS pos, round(a, 6) + 0.0 AS v FROM o UNION ALL SELECT r * 40 + c, 1, b::DOUBLE FROM o""")
def flatten_cube(spark, d):
    """Orders as images of a line of up to 40 columns and two bands, flattened again."""
    o = table(spark, d, "orders")
    rows = o.select(F.floor(F.col("o_orderkey") / 40).alias("r"), (F.col("o_orderkey") % 40).alias("c"), F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("v"))
    lines = rows.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("line"))
    # The tables have no image: every 40 neighbouring orders are one of a single line.
    pixels = lines.select("r", F.array("line").alias("cube"))
    return cells(prep.flatten_cube(pixels, "cube", None, by="r").select((F.col("r") * 40 + F.col("id")).alias("id"), "features"))


# Pairs

@query(f"WITH {EMB}, {FIVE} SELECT id, slot AS pos, round(list_distance(e, pe), 6) + 0.0 AS v FROM emb, p")
def distances_to(spark, d):
    pts = embeddings(spark, d)
    return cells(pairs.distances_to(pts, five(pts)), "distances")


@query(f"WITH {EMB}, {FIVE} SELECT id, slot AS pos, round(list_dot_product(e, pe), 6) + 0.0 AS v FROM emb, p")
def gram_to(spark, d):
    pts = embeddings(spark, d)
    return cells(pairs.gram_to(pts, five(pts)), "products")


@query(f"WITH {EMB} SELECT id, label FROM emb WHERE id NOT IN (0, 1, 2, 3, 4)")
def candidates(spark, d):
    pts = embeddings(spark, d)
    return pairs.candidates(pts, five(pts)).select("id", "label")


@query(f"WITH {EMB}, {FIVE} SELECT id, slot, label FROM emb JOIN p ON id = pid")
def lookup_points(spark, d):
    pts = embeddings(spark, d)
    return pairs.lookup_points(pts, five(pts)).select("id", "slot", "label")


@query(f"""WITH {EMB}, q AS (SELECT a.id, b.id AS neighbor, list_distance(a.e, b.e) AS d FROM emb a, emb b WHERE a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbor)::INTEGER AS rank FROM q) SELECT id, neighbor, round(d, 6) + 0.0 AS distance, rank FROM n WHERE rank <= 5""")
def knn_join(spark, d):
    return pairs.knn_join(embeddings(spark, d), 5).withColumn("distance", r6("distance"))


# One set of prototypes

@query(f"WITH {NEAR} SELECT id, near_slot, round(dist, 6) + 0.0 AS dist, next_slot, round(next_dist, 6) + 0.0 AS next_dist FROM s")
def cluster_assign2(spark, d):
    pts = embeddings(spark, d)
    return energies.cluster_assign2(pts, five(pts)).select("id", "near_slot", r6("dist").alias("dist"), "next_slot", r6("next_dist").alias("next_dist"))


@query(f"WITH {NEAR} SELECT near_slot, count(*) AS members, round(sum(dist), 6) + 0.0 AS cost FROM s GROUP BY near_slot")
def cluster_sizes(spark, d):
    pts = embeddings(spark, d)
    return energies.cluster_sizes(energies.cluster_assign(pts, five(pts))).withColumn("cost", r6("cost"))


@query(f"WITH {NEAR} SELECT id, round(CASE WHEN near_slot = 2 THEN next_dist ELSE dist END, 6) + 0.0 AS dist FROM s")
def cluster_leave_one_out(spark, d):
    pts = embeddings(spark, d)
    return energies.cluster_leave_one_out(energies.cluster_assign2(pts, five(pts)), 2).select("id", r6("dist").alias("dist"))


@query(f"""WITH {EMB}, {FIVE}, f AS (SELECT id, slot, list_distance(e, pe) AS d FROM emb, p WHERE slot < 4), g AS (SELECT id, min(d) AS d, arg_min(slot, d) AS slot FROM f GROUP BY id),
l AS (SELECT emb.id, list_distance(e, pe) AS d FROM emb, p WHERE slot = 4) SELECT id, CASE WHEN l.d < g.d THEN 4 ELSE g.slot END::INTEGER AS near_slot, round(least(l.d, g.d), 6) + 0.0 AS dist FROM g JOIN l USING (id)""")
def cluster_update(spark, d):
    pts = embeddings(spark, d)
    p = five(pts)
    state = energies.cluster_assign(pts, pairs.Prototypes(p.ids[:4], p.x[:4]))
    return energies.cluster_update(state, p.x[4], 4).select("id", F.col("near_slot").cast("int").alias("near_slot"), r6("dist").alias("dist"))


@query(f"WITH {NEAR} SELECT round(sum(dist), 6) + 0.0 AS p1, round(sqrt(sum(dist * dist)), 6) + 0.0 AS p2, round(pow(sum(pow(dist, 5)), 0.2), 6) + 0.0 AS p5, round(max(dist), 6) + 0.0 AS worst FROM s")
def cluster_energy(spark, d):
    pts = embeddings(spark, d)
    state = energies.cluster_assign(pts, five(pts))
    return state.agg(*[r6(energies.cost("dist", p)).alias(n) for n, p in (("p1", 1), ("p2", 2), ("p5", 5), ("worst", None))])


@query(f"WITH {EMB} SELECT round(sum(list_dot_product(e, e)), 6) + 0.0 AS total FROM emb")
def total_sum_of_squares(spark, d):
    return energies.total_sum_of_squares(embeddings(spark, d)).withColumn("total", r6("total"))


@query(f"""WITH {LINE}, c AS (SELECT id, unnest(e) AS v, unnest(range(4)) AS pos, e FROM line)
SELECT pos * 4 + k AS cell, round(sum(v * e[k + 1]), 4) + 0.0 AS value FROM c, range(4) r(k) GROUP BY ALL""")
def scatter_matrix(spark, d):
    m = energies.scatter_matrix(lineitems(spark, d))
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.ravel())], "cell long, value double")
    return rows.withColumn("value", F.round("value", 4) + F.lit(0.0))


@query()
def optimal_lowrank_curve(spark, d):
    return energies.optimal_lowrank_curve(embeddings(spark, d), 20, 2)


@query(f"""WITH {LINE}, p AS (SELECT id AS pid, e AS pe, (row_number() OVER (ORDER BY id) - 1)::INTEGER AS slot FROM line QUALIFY slot < 20),
n AS (SELECT id, slot, list_distance(e, pe) AS d, row_number() OVER (PARTITION BY id ORDER BY list_distance(e, pe), slot) AS rn FROM line, p)
SELECT slot AS near_slot, count(*) AS members, round(sum(d), 4) + 0.0 AS cost FROM n WHERE rn = 1 GROUP BY slot""")
def lineitem_clusters(spark, d):
    pts = lineitems(spark, d)
    ids = [r.id for r in pts.orderBy("id").limit(20).select("id").collect()]
    sizes = energies.cluster_sizes(energies.cluster_assign(pts, pairs.prototypes(pts, ids)))
    return sizes.withColumn("cost", F.round("cost", 4) + F.lit(0.0))


# Low rank with two prototypes, by Gram-Schmidt.
SPAN = f"""{EMB}, a AS (SELECT e AS e0 FROM emb WHERE id = 0), b AS (SELECT e AS e1 FROM emb WHERE id = 1),
q0 AS (SELECT list_transform(e0, lambda x: x / sqrt(list_dot_product(e0, e0))) AS q0 FROM a),
w1 AS (SELECT q0, list_transform(range(1, len(e1) + 1), lambda i: e1[i] - list_dot_product(e1, q0) * q0[i]) AS w FROM b, q0),
q AS MATERIALIZED (SELECT q0, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS q1 FROM w1),
r AS MATERIALIZED (SELECT id, e, list_transform(range(1, len(e) + 1), lambda i: e[i] - list_dot_product(e, q0) * q0[i] - list_dot_product(e, q1) * q1[i]) AS r FROM emb, q)"""


def two(pts: DataFrame) -> pairs.Prototypes:
    return pairs.prototypes(pts, [0, 1])


@query(f"WITH {SPAN} SELECT id, round(sqrt(list_dot_product(r, r)), 6) + 0.0 AS dist FROM r")
def lowrank_distance(spark, d):
    pts = embeddings(spark, d)
    return energies.assign(pts, two(pts), "lowrank").select("id", r6("dist").alias("dist"))


@query(f"""WITH {EMB}, z AS (SELECT a.e AS e0, b.e AS e1 FROM emb a, emb b WHERE a.id = 0 AND b.id = 1),
g AS (SELECT *, list_dot_product(e0, e0) AS aa, list_dot_product(e0, e1) AS ab, list_dot_product(e1, e1) AS bb FROM z),
h AS (SELECT id, list_dot_product(e, e0) AS x, list_dot_product(e, e1) AS y, aa, ab, bb FROM emb, g)
SELECT id, 0 AS pos, round((x * bb - y * ab) / (aa * bb - ab * ab), 6) + 0.0 AS v FROM h UNION ALL SELECT id, 1, round((y * aa - x * ab) / (aa * bb - ab * ab), 6) + 0.0 FROM h""")
def lowrank_weights(spark, d):
    pts = embeddings(spark, d)
    return cells(energies.assign(pts, two(pts), "lowrank", weights=True), "weights")


@query(f"""WITH {EMB}, p AS (SELECT (1 - id)::INTEGER AS pos, e AS pe FROM emb WHERE id < 2)
SELECT id, pos, round(sqrt(greatest(0, list_dot_product(e, e) - pow(list_dot_product(e, pe), 2) / list_dot_product(pe, pe))), 5) + 0.0 AS v FROM emb, p""")
def lowrank_leave_one_out(spark, d):
    pts = embeddings(spark, d)
    rows = energies.leave_one_out(pts, two(pts), "lowrank")
    return rows.select("id", F.posexplode("left_out").alias("pos", "v")).withColumn("v", F.round("v", 5) + F.lit(0.0))


_PAIRS = "list_dot_product(j.r, j.r) - pow(list_dot_product(c.r, j.r), 2) / list_dot_product(c.r, c.r)"


@query(f"""WITH {SPAN}, e AS (SELECT sqrt(sum(list_dot_product(r, r))) AS now FROM r),
v AS (SELECT c.id, sqrt(sum({_PAIRS})) AS value FROM r c, r j WHERE c.id > 1 GROUP BY c.id)
SELECT id, round(value, 6) + 0.0 AS value FROM v UNION ALL SELECT id, round(now, 6) + 0.0 FROM r, e WHERE id < 2""")
def lowrank_search_values(spark, d):
    pts = embeddings(spark, d)
    return scores.search_values(pts, two(pts), "lowrank", 2).withColumn("value", r6("value"))


@query(f"""WITH {SPAN}, e AS (SELECT sum(sqrt(list_dot_product(r, r))) AS now FROM r),
v AS (SELECT c.id, sum(sqrt(greatest(0, {_PAIRS}))) AS value FROM r c, r j WHERE c.id > 1 GROUP BY c.id)
SELECT id, round(value, 4) + 0.0 AS value FROM v UNION ALL SELECT id, round(now, 4) + 0.0 FROM r, e WHERE id < 2""")
def lowrank_search_values_p1(spark, d):
    pts = embeddings(spark, d)
    return scores.search_values(pts, two(pts), "lowrank", 1).withColumn("value", F.round("value", 4) + F.lit(0.0))


@query(f"""WITH {EMB}, p AS (SELECT (1 - id)::INTEGER AS slot, e AS pe FROM emb WHERE id < 2),
r AS MATERIALIZED (SELECT id, slot, list_transform(range(1, len(e) + 1), lambda i: e[i] - list_dot_product(e, pe) / list_dot_product(pe, pe) * pe[i]) AS r FROM emb, p)
SELECT c.id, c.slot, round(sqrt(sum({_PAIRS})), 6) + 0.0 AS value FROM r c JOIN r j USING (slot) WHERE c.id > 1 GROUP BY c.id, c.slot""")
def lowrank_swap_values(spark, d):
    pts = embeddings(spark, d)
    return scores.swap_values(pts, two(pts), "lowrank", 2).select("id", "slot", r6("value").alias("value"))


# Cones and hulls of two prototypes, in closed form.
PAIR = """p AS (SELECT e AS pe, row_number() OVER (ORDER BY id) AS n FROM {t}), z AS (SELECT a.pe AS a, b.pe AS b FROM p a, p b WHERE a.n = 1 AND b.n = 2)"""


def first_two(pts: DataFrame) -> pairs.Prototypes:
    return pairs.prototypes(pts, [r.id for r in pts.orderBy("id").limit(2).select("id").collect()])


@query(f"""WITH {LINE}, {PAIR.format(t='line')},
g AS (SELECT id, list_dot_product(e, e) AS xx, list_dot_product(e, a) AS xa, list_dot_product(e, b) AS xb, list_dot_product(a, a) AS aa, list_dot_product(a, b) AS ab, list_dot_product(b, b) AS bb FROM line, z),
h AS (SELECT *, (xa * bb - xb * ab) / (aa * bb - ab * ab) AS u, (xb * aa - xa * ab) / (aa * bb - ab * ab) AS v FROM g),
k AS (SELECT id, least(xx, CASE WHEN xa > 0 THEN xx - xa * xa / aa ELSE xx END, CASE WHEN xb > 0 THEN xx - xb * xb / bb ELSE xx END,
      CASE WHEN u > 0 AND v > 0 THEN xx - u * xa - v * xb ELSE xx END) AS d FROM h)
SELECT id, round(sqrt(greatest(0, d)), 5) + 0.0 AS dist FROM k""")
def conic_distance(spark, d):
    pts = energies.of("conic").prepare(lineitems(spark, d))
    return energies.assign(pts, first_two(pts), "conic").select("id", (F.round("dist", 5) + F.lit(0.0)).alias("dist"))


@query(f"""WITH {LINE}, m AS (SELECT avg(e[1]) AS a, avg(e[2]) AS b, avg(e[3]) AS c, avg(e[4]) AS d FROM line),
cen AS MATERIALIZED (SELECT id, [e[1] - m.a, e[2] - m.b, e[3] - m.c, e[4] - m.d] AS e FROM line, m), {PAIR.format(t='cen')},
y AS (SELECT id, e, a, list_transform([1, 2, 3, 4], lambda i: b[i] - a[i]) AS ba, list_transform([1, 2, 3, 4], lambda i: e[i] - a[i]) AS ea FROM cen, z),
t AS (SELECT *, least(1, greatest(0, list_dot_product(ea, ba) / list_dot_product(ba, ba))) AS t FROM y)
SELECT id, round(list_distance(ea, list_transform(ba, lambda x: t * x)), 5) + 0.0 AS dist FROM t""")
def convex_distance(spark, d):
    pts = energies.of("convex").prepare(lineitems(spark, d))
    return energies.assign(pts, first_two(pts), "convex").select("id", (F.round("dist", 5) + F.lit(0.0)).alias("dist"))


@query(f"""WITH {NEAR} SELECT id, round(list_distance(e, pe) / len(e), 6) + 0.0 AS error FROM emb JOIN s USING (id) JOIN p ON slot = near_slot""")
def reconstruction_error(spark, d):
    pts = embeddings(spark, d)
    return energies.reconstruction_error(pts, five(pts), "cluster").select("id", r6("error").alias("error"))


@query(f"""WITH {NEAR}, m AS (SELECT avg(dist) AS m FROM s), o AS (SELECT id FROM s, m ORDER BY abs(dist - m), id LIMIT 1) SELECT id FROM o""")
def exemplar(spark, d):
    pts = embeddings(spark, d)
    rows = energies.cluster_assign(pts, five(pts)).withColumnRenamed("dist", "error")
    return pts.filter(F.col("id") == energies.exemplar_nearest_mean_error(rows)).select("id")


# Scores

CROSS = "x AS MATERIALIZED (SELECT c.id, j.id AS j, list_distance(c.e, j.e) AS d FROM emb c, emb j)"


@query(f"""WITH {NEAR}, {CROSS}, v AS (SELECT x.id, sum(least(x.d, s.dist)) AS value FROM x JOIN s ON s.id = x.j WHERE x.id > 4 GROUP BY x.id)
SELECT id, round(value, 4) + 0.0 AS value FROM v UNION ALL SELECT id, (SELECT round(sum(dist), 4) + 0.0 FROM s) FROM emb WHERE id < 5""")
def cluster_search_values(spark, d):
    pts = embeddings(spark, d)
    return scores.search_values(pts, five(pts), "cluster", 1).withColumn("value", F.round("value", 4) + F.lit(0.0))


def _swaps(value: str) -> str:
    return f"""WITH {NEAR}, {CROSS} SELECT x.id, p.slot, round({value}, 6) + 0.0 AS value
FROM x JOIN s ON s.id = x.j CROSS JOIN p WHERE x.id > 4 GROUP BY x.id, p.slot"""


_LEFT = "least(x.d, CASE WHEN s.near_slot = p.slot THEN s.next_dist ELSE s.dist END)"


@query(_swaps(f"sqrt(sum(pow({_LEFT}, 2)))"))
def cluster_swap_values(spark, d):
    pts = embeddings(spark, d)
    return scores.swap_values(pts, five(pts), "cluster", 2).select("id", "slot", r6("value").alias("value"))


@query(_swaps(f"max({_LEFT})"))
def cluster_swap_values_worst(spark, d):
    pts = embeddings(spark, d)
    return scores.swap_values(pts, five(pts), "cluster", None).select("id", "slot", r6("value").alias("value"))


@query(f"WITH {NEAR} SELECT id, round(pow(CASE WHEN near_slot = 1 THEN next_dist ELSE dist END, 2), 6) + 0.0 AS weight FROM s")
def swap_sampling_weights(spark, d):
    pts = embeddings(spark, d)
    return scores.swap_sampling_weights(pts, five(pts), 1, "cluster", 2).withColumn("weight", r6("weight"))


_SHIFTED = """sh AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda v: v - m) AS e FROM embeddings, (SELECT least(0, min(list_min(embedding::DOUBLE[]))) AS m FROM embeddings))"""
_CENTRED = """cm AS MATERIALIZED (SELECT list(a ORDER BY pos) AS m FROM (SELECT pos, avg(v) AS a FROM (SELECT unnest(embedding::DOUBLE[]) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY pos)),
sh AS MATERIALIZED (SELECT vec_id AS id, list_transform(range(1, len(m) + 1), lambda i: embedding[i]::DOUBLE - m[i]) AS e FROM embeddings, cm)"""
_DOTS = "x AS MATERIALIZED (SELECT i.id AS i, j.id AS j, list_dot_product(i.e, j.e) AS d FROM sh i, sh j)"
#: Squared distances of all rows j from the cone, or the hull, of rows a and b of pairs (a, b).
_TO_CONE = """g AS (SELECT w.*, j.j, jj.d AS xx, j.d AS xa, k.d AS xb, aa.d AS aa, ab.d AS ab, bb.d AS bb FROM w
    JOIN x j ON j.i = w.a JOIN x k ON k.i = w.b AND k.j = j.j JOIN x jj ON jj.i = j.j AND jj.j = j.j
    JOIN x aa ON aa.i = w.a AND aa.j = w.a JOIN x ab ON ab.i = w.a AND ab.j = w.b JOIN x bb ON bb.i = w.b AND bb.j = w.b),
h AS (SELECT *, (xa * bb - xb * ab) / (aa * bb - ab * ab) AS u, (xb * aa - xa * ab) / (aa * bb - ab * ab) AS v, greatest(0, least(1, (xb - xa - ab + aa) / (aa - 2 * ab + bb))) AS t FROM g),"""
_CONE = "least(xx, CASE WHEN xa > 0 THEN xx - xa * xa / aa ELSE xx END, CASE WHEN xb > 0 THEN xx - xb * xb / bb ELSE xx END, CASE WHEN u > 0 AND v > 0 THEN xx - u * xa - v * xb ELSE xx END)"
_HULL = "xx - 2 * ((1 - t) * xa + t * xb) + (1 - t) * (1 - t) * aa + 2 * t * (1 - t) * ab + t * t * bb"


def _moves_sql(rows: str, dist: str, pairs_: str, by: str) -> str:
    return f"""WITH {rows}, {_DOTS}, w AS ({pairs_}), {_TO_CONE}
SELECT {by}, round(sqrt(sum(greatest(0, {dist}))), 5) + 0.0 AS value FROM h GROUP BY {by}"""


_ADDED = "SELECT 0 AS a, id AS b, id FROM sh WHERE id > 0"
_REFILLED = "SELECT (1 - slot) AS a, id AS b, id, slot FROM sh, (SELECT unnest([0, 1]) AS slot) WHERE id > 1"


def _search(spark, d, energy, ready):
    pts = energies.of(energy).prepare(ready(embeddings(spark, d)))
    values = scores.search_values(pts, pairs.prototypes(pts, [0]), energy, 2).filter("id > 0")
    return values.select("id", (F.round("value", 5) + F.lit(0.0)).alias("value"))


def _swap(spark, d, energy, ready):
    pts = energies.of(energy).prepare(ready(embeddings(spark, d)))
    values = scores.swap_values(pts, two(pts), energy, 2)
    return values.select("id", F.col("slot").cast("int").alias("slot"), (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query(_moves_sql(_SHIFTED, _CONE, _ADDED, "id"))
def conic_search_values(spark, d):
    return _search(spark, d, "conic", prep.shift_nonneg)


@query(_moves_sql(_CENTRED, _HULL, _ADDED, "id"))
def convex_search_values(spark, d):
    return _search(spark, d, "convex", lambda pts: pts)


@query(_moves_sql(_SHIFTED, _CONE, _REFILLED, "id, slot"))
def conic_swap_values(spark, d):
    return _swap(spark, d, "conic", prep.shift_nonneg)


@query(_moves_sql(_CENTRED, _HULL, _REFILLED, "id, slot"))
def convex_swap_values(spark, d):
    return _swap(spark, d, "convex", lambda pts: pts)


# Complex rows: the first half of an embedding as real parts, the second as imaginary ones.
_COMPLEX = """z AS MATERIALIZED (SELECT vec_id AS id, embedding[1 : len(embedding) // 2]::DOUBLE[] AS a, embedding[len(embedding) // 2 + 1 : len(embedding)]::DOUBLE[] AS b FROM embeddings),
x AS MATERIALIZED (SELECT i.id AS i, j.id AS j, list_dot_product(i.a, j.a) + list_dot_product(i.b, j.b) AS re, list_dot_product(i.b, j.a) - list_dot_product(i.a, j.b) AS im FROM z i, z j),
-- Products of what rows have beside prototype s.
r AS MATERIALIZED (SELECT s.id AS s, x.i, x.j, x.re - (p.re * q.re + p.im * q.im) / n.re AS re, x.im - (p.im * q.re - p.re * q.im) / n.re AS im
    FROM z s JOIN x n ON n.i = s.id AND n.j = s.id JOIN x ON true JOIN x p ON p.i = x.i AND p.j = s.id JOIN x q ON q.i = x.j AND q.j = s.id WHERE s.id < 2),
v AS (SELECT r.s, r.i AS id, sqrt(sum(greatest(0, m.re - (r.re * r.re + r.im * r.im) / o.re))) AS value
    FROM r JOIN r m ON m.s = r.s AND m.i = r.j AND m.j = r.j JOIN r o ON o.s = r.s AND o.i = r.i AND o.j = r.i WHERE r.i > 1 GROUP BY r.s, r.i)"""


def complex_rows(spark, d):
    pts = embeddings(spark, d)
    half = F.expr("size(features) div 2")
    return pts.select("id", F.slice("features", 1, half).alias("re"), F.slice("features", half + 1, half).alias("im"))


@query(f"WITH {_COMPLEX} SELECT id, round(value, 6) + 0.0 AS value FROM v WHERE s = 0")
def complex_search_values(spark, d):
    pts = complex_rows(spark, d)
    return scores.search_values(pts, pairs.prototypes(pts, [0]), "lowrank", 2).filter("id > 1").withColumn("value", r6("value"))


@query(f"WITH {_COMPLEX} SELECT id, (1 - s)::INTEGER AS slot, round(value, 6) + 0.0 AS value FROM v")
def complex_swap_values(spark, d):
    pts = complex_rows(spark, d)
    values = scores.swap_values(pts, two(pts), "lowrank", 2)
    return values.select("id", F.col("slot").cast("int").alias("slot"), r6("value").alias("value"))


# Builds

def _steps(spark: SparkSession, got: build.Build) -> DataFrame:
    return got.table(spark).select("step", "id", r6("energy").alias("energy"))


def _race(n: int, p: int) -> str:
    out = [f"{EMB}", "s0 AS MATERIALIZED (SELECT id, e, 1.0::DOUBLE AS d FROM emb)"]
    for s in range(n):
        u = _U.format(seed=42, step=s)
        out.append(f"w{s} AS MATERIALIZED (SELECT {s} AS step, id, e FROM s{s} WHERE d > 0 ORDER BY ln(-ln({u})) - {p} * ln(d), id LIMIT 1)")
        new = "list_distance(a.e, b.e)" if s == 0 else "least(a.d, list_distance(a.e, b.e))"
        out.append(f"s{s + 1} AS MATERIALIZED (SELECT a.id, a.e, {new} AS d FROM s{s} a, w{s} b)")
    rows = " UNION ALL ".join(f"SELECT step, id, (SELECT round(pow(sum(pow(d, {p})), 1.0 / {p}), 6) + 0.0 FROM s{s + 1}) AS energy FROM w{s}" for s in range(n))
    return "WITH " + ", ".join(out) + " " + rows


@query(_race(5, 2))
def build_sampling(spark, d):
    return _steps(spark, build.build_sampling(embeddings(spark, d), 5, "cluster", 2, 42))


@query(_race(3, 1).replace("emb AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)", LINE + ", emb AS (SELECT id, e FROM line)").replace(", 6) + 0.0 FROM", ", 4) + 0.0 FROM"))
def build_sampling_lineitem(spark, d):
    pts = lineitems(spark, d).persist()  # read by every step
    got = build.build_sampling(pts, 3, "cluster", 1, 42)
    pts.unpersist()
    return got.table(spark).select("step", "id", (F.round("energy", 4) + F.lit(0.0)).alias("energy"))


@query(f"""WITH {EMB}, c AS MATERIALIZED (SELECT id, e, (row_number() OVER (ORDER BY {_U.format(seed=42, step='sample')}, id) - 1)::INTEGER AS step FROM emb QUALIFY step < 5),
x AS (SELECT c.step, j.id, list_distance(c.e, j.e) AS d FROM c, emb j),
y AS (SELECT a.step, b.id, min(b.d) AS d FROM c a JOIN x b ON b.step <= a.step GROUP BY a.step, b.id)
SELECT step, c.id, round(sqrt(sum(d * d)), 6) + 0.0 AS energy FROM y JOIN c USING (step) GROUP BY step, c.id""")
def build_uniform(spark, d):
    return _steps(spark, build.build_uniform(embeddings(spark, d), 5, "cluster", 2, 42))


def _greedy(n: int) -> str:
    out = [EMB, CROSS, "s0 AS (SELECT id AS j, 1e300::DOUBLE AS d FROM emb)"]
    for s in range(n):
        out.append(f"w{s} AS MATERIALIZED (SELECT {s} AS step, x.id, sqrt(sum(pow(least(x.d, s.d), 2))) AS energy FROM x JOIN s{s} s USING (j) GROUP BY x.id ORDER BY energy, x.id LIMIT 1)")
        out.append(f"s{s + 1} AS MATERIALIZED (SELECT j, least(x.d, s.d) AS d FROM s{s} s JOIN x USING (j) JOIN w{s} w ON w.id = x.id)")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT step, id, round(energy, 6) + 0.0 AS energy FROM w{s}" for s in range(n))


@query(_greedy(3))
def build_search(spark, d):
    return _steps(spark, build.build_search(embeddings(spark, d), 3, "cluster", 2, 42))


def _greedy_span(n: int) -> str:
    """Greedy column subset selection: residuals of all rows after each pick."""
    out = [EMB, "r0 AS MATERIALIZED (SELECT id, e AS r FROM emb)"]
    for s in range(n):
        out += [
            f"t{s} AS (SELECT sum(list_dot_product(r, r)) AS t FROM r{s})",
            f"""w{s} AS MATERIALIZED (SELECT {s} AS step, c.id, any_value(c.r) AS r, sqrt(greatest(0, any_value(t) - sum(pow(list_dot_product(c.r, j.r), 2)) / any_value(list_dot_product(c.r, c.r)))) AS energy
                FROM r{s} c, r{s} j, t{s} WHERE list_dot_product(c.r, c.r) > 1e-8 GROUP BY c.id ORDER BY energy, c.id LIMIT 1)""",
            f"r{s + 1} AS MATERIALIZED (SELECT j.id, list_transform(range(1, len(j.r) + 1), lambda i: j.r[i] - list_dot_product(j.r, w.r) / list_dot_product(w.r, w.r) * w.r[i]) AS r FROM r{s} j, w{s} w)",
        ]
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT step, id, round(energy, 6) + 0.0 AS energy FROM w{s}" for s in range(n))


@query(_greedy_span(5))
def build_search_lowrank(spark, d):
    return _steps(spark, build.build_search(embeddings(spark, d), 5, "lowrank", 2, 42))


@query()
def build_sampling_convex(spark, d):
    pts = energies.of("convex").prepare(embeddings(spark, d))
    return _steps(spark, build.build_sampling(pts, 4, "convex", 2, 42))


@query()
def build_sampling_conic(spark, d):
    pts = energies.of("conic").prepare(prep.shift_nonneg(embeddings(spark, d)))
    return _steps(spark, build.build_sampling(pts, 4, "conic", 2, 42))


# Swaps: loops whose length depends on the data; tests compare them with plain loops.

def _swapped(spark: SparkSession, got: swap.Swap) -> DataFrame:
    return got.table(spark).select("swap_no", r6("energy").alias("energy"), "stagnation")


@query(f"""WITH {EMB}, {CROSS}, s(slot, pid) AS (VALUES (0, 0), (1, 1), (2, 2)),
now AS (SELECT sqrt(sum(d * d)) AS e FROM (SELECT j, min(d) AS d FROM x JOIN s ON x.id = pid GROUP BY j)),
rest AS (SELECT a.slot, j, min(d) AS d FROM s a JOIN s b ON b.slot <> a.slot JOIN x ON x.id = b.pid GROUP BY a.slot, j),
v AS (SELECT x.id, slot, sqrt(sum(pow(least(x.d, rest.d), 2))) AS e FROM x JOIN rest USING (j) WHERE x.id > 2 GROUP BY x.id, slot),
w AS (SELECT v.id, v.e FROM v, now WHERE v.e < now.e AND abs(v.e - now.e) > 1e-8 + 1e-5 * now.e ORDER BY v.id, v.e LIMIT 1)
SELECT 1 AS swap_no, round(e, 6) + 0.0 AS energy, id::BIGINT AS stagnation FROM w UNION ALL SELECT 2, round(e, 6) + 0.0, 0 FROM w""")
def swap_search_first(spark, d):
    """One swap: ids start at 0, so that an id is the number of rows tried in vain before it."""
    pts = embeddings(spark, d)
    return _swapped(spark, swap.swap_search(pts, pairs.prototypes(pts, [0, 1, 2]), "cluster", 2, max_swaps=1))


@query()
def swap_search(spark, d):
    pts = embeddings(spark, d)
    return _swapped(spark, swap.swap_search(pts, pairs.prototypes(pts, [0, 1, 2]), "cluster", 2))


@query(f"""WITH {EMB}, s(slot, a, b) AS (VALUES (0, 1, 2), (1, 0, 2), (2, 0, 1)),
q0 AS (SELECT slot, b, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS q0 FROM s JOIN emb ON emb.id = a),
w1 AS (SELECT slot, q0, list_transform(range(1, len(e) + 1), lambda i: e[i] - list_dot_product(e, q0) * q0[i]) AS w FROM q0 JOIN emb ON emb.id = b),
q AS (SELECT slot, q0, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS q1 FROM w1),
r AS MATERIALIZED (SELECT slot, id, list_transform(range(1, len(e) + 1), lambda i: e[i] - list_dot_product(e, q0) * q0[i] - list_dot_product(e, q1) * q1[i]) AS r FROM emb, q),
v AS MATERIALIZED (SELECT c.id, c.slot, sqrt(sum({_PAIRS})) AS e FROM r c JOIN r j USING (slot) WHERE list_dot_product(c.r, c.r) > 1e-12 GROUP BY c.id, c.slot),
now AS (SELECT e FROM v WHERE id = 0 AND slot = 0),
w AS (SELECT v.id, v.e FROM v, now WHERE v.id > 2 AND v.e < now.e AND abs(v.e - now.e) > 1e-8 + 1e-5 * now.e ORDER BY v.id, v.e LIMIT 1)
SELECT 1 AS swap_no, round(e, 6) + 0.0 AS energy, id::BIGINT AS stagnation FROM w UNION ALL SELECT 2, round(e, 6) + 0.0, 0 FROM w""")
def swap_search_lowrank_first(spark, d):
    """One swap, as ``swap_search_first``."""
    pts = embeddings(spark, d)
    return _swapped(spark, swap.swap_search(pts, pairs.prototypes(pts, [0, 1, 2]), "lowrank", 2, max_swaps=1))


@query()
def swap_search_lowrank(spark, d):
    pts = embeddings(spark, d)
    return _swapped(spark, swap.swap_search(pts, pairs.prototypes(pts, [0, 1, 2]), "lowrank", 2))


@query()
def swap_sampling(spark, d):
    pts = embeddings(spark, d)
    return _swapped(spark, swap.swap_sampling(pts, pairs.prototypes(pts, [0, 1, 2]), "cluster", 2))


@query()
def swap_sampling_lowrank(spark, d):
    pts = embeddings(spark, d)
    return _swapped(spark, swap.swap_sampling(pts, pairs.prototypes(pts, [0, 1, 2]), "lowrank", 2))


#: Prototypes of a run of the grid: every swap starts from each prefix.
GRID_K = 4


@query()
def run_grid(spark, d):
    """The whole grid, methods and powers, kept in a folder of the session; steps of builds and swaps together."""
    pts = embeddings(spark, d)
    plan = experiment.grid(spark, "embeddings", "cluster", k=GRID_K)
    built, swapped, _ = experiment.run_grid(pts, plan, new_folder(spark, "grid"))
    keys = ["energy", "p", "method", "seed", "k"]
    built = built.select(*keys, F.lit("build").alias("phase"), F.col("step").alias("at"), "energy_value", F.lit(0).cast("long").alias("stagnation"))
    swapped = swapped.select(*keys, F.lit("swap").alias("phase"), F.col("swap_no").alias("at"), "energy_value", "stagnation")
    return built.union(swapped).withColumn("energy_value", r6("energy_value"))


@query()
def spectral_embedding(spark, d):
    return cells(spectral.spectral_embedding(embeddings(spark, d), 10, 4))


# Comparison of methods, on step tables made from events

@query(f"""WITH {STEPS}, a AS (SELECT method, seed, step + 1 AS k, energy_value FROM built WHERE NOT contains(method, '_')
UNION ALL SELECT method, seed, k, arg_max(energy_value, swap_no) FROM swapped GROUP BY method, seed, k)
SELECT method, k::INTEGER AS k, round(avg(energy_value / sqrt(500)), 6) + 0.0 AS energy FROM a GROUP BY method, k""")
def energy_by_k(spark, d):
    return analysis.energy_by_k(build_steps(spark, d), swap_steps(spark, d), 500, 2).withColumn("energy", r6("energy"))


_PHASES = """b AS (SELECT method, seed, 0 AS phase, step AS "at", energy_value, {built} AS amount FROM built WHERE step < 5 AND split_part(method, '_', 1) <> 'uniform'),
w AS (SELECT method, seed, 1 AS phase, swap_no AS "at", CASE WHEN method LIKE '%\\_sampling' ESCAPE '\\' THEN min(energy_value) OVER (PARTITION BY method, seed ORDER BY swap_no) ELSE energy_value END AS energy_value, {swapped} AS amount
      FROM swapped WHERE k = 5),
c AS (SELECT *, sum(amount) OVER (PARTITION BY method, seed ORDER BY phase, "at") AS total FROM (SELECT * FROM b UNION ALL SELECT * FROM w))
SELECT method, seed, phase, "at", {total}, round(energy_value / sqrt(500), 6) + 0.0 AS energy FROM c"""


@query(f"WITH {STEPS}, " + _PHASES.format(built="seconds", swapped="seconds", total="round(total, 6) + 0.0 AS total_seconds"))
def energy_by_time(spark, d):
    rows = analysis.energy_by_time(build_steps(spark, d), swap_steps(spark, d), 500, 5, 2)
    return rows.withColumns({"energy": r6("energy"), "total_seconds": r6("total_seconds")})


@query(f"WITH {STEPS}, " + _PHASES.format(
    built="CASE WHEN split_part(method, '_', 1) = 'search' THEN 500 - step ELSE 1 END",
    swapped="CASE WHEN method LIKE '%\\_search' ESCAPE '\\' THEN 5 * (stagnation + 1) ELSE 2 * (stagnation + 1) END", total="total::BIGINT AS total_calls"))
def energy_by_calls(spark, d):
    return analysis.energy_by_calls(build_steps(spark, d), swap_steps(spark, d), 500, 5, 2).withColumn("energy", r6("energy"))


@query(f"WITH {STEPS} SELECT k, seed, count(*) FILTER (WHERE stagnation >= k) AS forced, sum(stagnation)::BIGINT AS trivial, count(*) AS total FROM swapped WHERE method = 'sampling_sampling' GROUP BY k, seed")
def forced_trivial_swaps(spark, d):
    return analysis.forced_trivial_swaps(swap_steps(spark, d).filter("method = 'sampling_sampling'"))


@query(f"""WITH {STEPS}, a AS (SELECT *, sum(seconds) OVER w AS total_seconds, min(energy_value) OVER w AS best, coalesce(energy_value > lag(energy_value) OVER (PARTITION BY method, seed ORDER BY step), false) AS rises
FROM built WINDOW w AS (PARTITION BY method, seed ORDER BY step ROWS UNBOUNDED PRECEDING)) SELECT method, seed, step, round(total_seconds, 6) + 0.0 AS total_seconds, round(best, 6) + 0.0 AS best, rises FROM a""")
def step_windows(spark, d):
    by = ["method", "seed"]
    rows = analysis.monotone(analysis.running_minimum(analysis.cumulative_time(build_steps(spark, d), by, "step"), by, "step"), by, "step")
    return rows.select(*by, "step", r6("total_seconds").alias("total_seconds"), r6("best").alias("best"), "rises")


@query(f"""WITH {STEPS}, m AS (SELECT method, min(seed) AS seed FROM built GROUP BY method), k AS (SELECT method, seed, max(step) AS step FROM built SEMI JOIN m USING (method, seed) GROUP BY method, seed)
SELECT method, seed, step, id FROM built SEMI JOIN k USING (method, seed, step)""")
def final_prototypes(spark, d):
    rows = build_steps(spark, d).select("method", "seed", F.col("step").alias("k"), "id")
    return analysis.final_prototypes(rows).select("method", "seed", F.col("k").alias("step"), "id")


@query(f"""WITH {STEPS}, a AS (SELECT method, arg_max(energy_value, step) AS e FROM (SELECT method, step, avg(energy_value) AS energy_value FROM built GROUP BY method, step) GROUP BY method)
SELECT round(min(e), 6) + 0.0 AS low, round(max(e), 6) + 0.0 AS high FROM a""")
def energy_range(spark, d):
    by_k = build_steps(spark, d).groupBy("method", F.col("step").alias("k")).agg(F.avg("energy_value").alias("energy"))
    return analysis.energy_range(by_k).select(r6("low").alias("low"), r6("high").alias("high"))


@query(f"""WITH {STEPS}, done AS (SELECT DISTINCT method, seed FROM swapped), plan AS (SELECT DISTINCT method, seed FROM built)
SELECT method, seed FROM plan ANTI JOIN done USING (method, seed) WHERE seed = 42 OR NOT method LIKE '%search'""")
def pending_runs(spark, d):
    def named(df):
        return df.select(F.lit("d").alias("dataset"), F.lit("cluster").alias("energy"), F.lit("2").alias("p"), "method", "seed").distinct()

    plan = experiment.deterministic_once(named(build_steps(spark, d)))
    return experiment.pending_runs(plan, named(swap_steps(spark, d))).select("method", "seed")


@query(f"""WITH {STEPS}, a AS (SELECT *, lag(energy_value) OVER (PARTITION BY method, seed ORDER BY step) AS b FROM built)
SELECT method, seed, step, abs(energy_value - b) <= 1e-8 + 1e-5 * abs(b) AS same FROM a WHERE b IS NOT NULL""")
def isclose_steps(spark, d):
    before = F.lag("energy_value").over(Window.partitionBy("method", "seed").orderBy("step"))
    rows = build_steps(spark, d).withColumn("b", before).filter("b is not null")
    return rows.select("method", "seed", "step", isclose("energy_value", "b").alias("same"))
