"""Distance and cluster-quality queries over the embedding vectors
(J7, J8, O3, R8, M12-M16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelens.functions.exprs import py_round
from storelens.operators import evaluate as EV
from storelens.operators import neighbors as NB
from storelens.operators import price as P
from storelens.plans.catalog import register
from storelens.sources.fixtures import VIEWS, table

POINTS_SQL = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _points(spark, sf):
    return VIEWS["points"](spark, sf).persist()


@register("knn_embeddings", f"""
WITH {POINTS_SQL},
d AS (SELECT a.id AS query_id, b.id AS neighbor_id, list_distance(a.v, b.v) AS distance FROM p a, p b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, rank, neighbor_id, round(distance, 9) AS distance FROM r WHERE rank <= 5
""")
def q_knn(spark, sf):
    """Exact 5 nearest other vectors per vector (leave-one-out)."""
    p = _points(spark, sf)
    nb = NB.knn_join(p, p, 5, exclude_self=True)
    return nb.withColumn("distance", py_round("distance", 9))


@register("kdist_embeddings", f"""
WITH {POINTS_SQL},
d AS (SELECT a.id AS query_id, b.id AS neighbor_id, list_distance(a.v, b.v) AS distance FROM p a, p b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, rank, neighbor_id, round(distance, 9) AS distance,
       row_number() OVER (PARTITION BY rank ORDER BY distance, query_id) AS "order"
FROM r WHERE rank <= 10
""")
def q_kdist(spark, sf):
    """J8 + O3: 10-NN distances with self as neighbour 1, each rank sorted."""
    return NB.kdist(_points(spark, sf), 10).withColumn("distance", py_round("distance", 9))


ITEMS_SQL = ("items AS (SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v, p.p_name AS text, "
             "p.p_retailprice AS price FROM embeddings e JOIN part p ON e.vec_id = p.p_partkey)")


def _items(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"),
                                              F.col("embedding").cast("array<double>").alias("features"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"),
                                        F.col("p_retailprice").alias("price"))
    return e.join(p, "id").persist()


@register("knn_neighbor_price", f"""
WITH {ITEMS_SQL},
d AS (SELECT a.id AS query_id, b.id AS neighbor_id, list_distance(a.v, b.v) AS distance, b.text AS item, b.price
      FROM items a, items b WHERE a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d),
nb AS (SELECT query_id, list({{'item': item, 'price': price}} ORDER BY rank) AS neighbors FROM r WHERE rank <= 5 GROUP BY 1),
c AS (SELECT nb.query_id AS id, i.text, neighbors, neighbors[1:5] AS top,
             ([1.0, 0.8, 0.6, 0.4, 0.2])[1:len(neighbors[1:5])] AS ws FROM nb JOIN items i ON nb.query_id = i.id),
s AS (SELECT id, text, neighbors,
        list_reduce(list_transform(list_zip(top, ws), lambda z: z[1].price * z[2]), lambda a, x: a + x, CAST(0.0 AS DOUBLE)) AS num,
        list_reduce(ws, lambda a, x: a + x, CAST(0.0 AS DOUBLE)) AS den FROM c)
SELECT id, len(neighbors) AS n_neighbors, neighbors[1].item AS first_neighbor,
  CASE WHEN len(neighbors) > 0 THEN greatest(0.99, num / den * (1.0 + ({" + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in P.NEIGHBOR_PREMIUM)}
       - ({" + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in P.NEIGHBOR_BUDGET)})) * 0.15)) ELSE 9.99 END AS frontier_price
FROM s
""")
def q_knn_price(spark, sf):
    """J7 + R8: neighbour-weighted price from the 5 nearest other items."""
    items = _items(spark, sf)
    nb = NB.knn_join(items, items, 5, vec="features", exclude_self=True)
    nb = nb.join(items.select(F.col("id").alias("neighbor_id"), F.col("text").alias("item"), "price"), "neighbor_id")
    lists = nb.groupBy("query_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "item", "price"))),
        lambda s: F.struct(s["item"].alias("item"), s["price"].alias("price"))).alias("neighbors"))
    q = items.select("id", "text").join(lists, items["id"] == lists["query_id"]).drop("query_id")
    out = P.neighbor_price(q, "text", "neighbors")
    return out.select("id", F.size("neighbors").alias("n_neighbors"),
                      F.col("neighbors")[0]["item"].alias("first_neighbor"), "frontier_price")


CENTROID_SQL = f"""
{POINTS_SQL},
ex AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p),
cen AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM ex GROUP BY 1, 2) GROUP BY 1),
gex AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p),
g AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM gex GROUP BY 1))
"""


@register("cluster_metrics_embeddings", f"""
WITH {CENTROID_SQL.strip()},
d AS (SELECT a.id, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS dist FROM p a, p b),
s AS (SELECT id, la, lb, sum(dist) AS sd, count(*) AS c FROM d GROUP BY 1, 2, 3),
ab AS (SELECT id, max(CASE WHEN la = lb THEN c END) AS own_n,
              max(CASE WHEN la = lb AND c > 1 THEN sd / (c - 1) END) AS a,
              min(CASE WHEN la <> lb THEN sd / c END) AS b FROM s GROUP BY 1),
sil AS (SELECT avg(CASE WHEN own_n <= 1 OR b IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END) AS silhouette FROM ab),
sc AS (SELECT p.label, avg(list_distance(p.v, cen.c)) AS s FROM p JOIN cen USING (label) GROUP BY 1),
cs AS (SELECT cen.label, cen.c, sc.s FROM cen JOIN sc USING (label)),
db AS (SELECT avg(dmax) AS davies_bouldin FROM (SELECT i.label, max((i.s + j.s) / nullif(list_distance(i.c, j.c), 0)) AS dmax
       FROM cs i JOIN cs j ON i.label <> j.label GROUP BY 1)),
bw AS (SELECT sum(n_k * pow(list_distance(cen.c, g.c), 2)) AS between_ss FROM cen
       JOIN (SELECT label, count(*) AS n_k FROM p GROUP BY 1) USING (label) CROSS JOIN g),
ww AS (SELECT sum(pow(list_distance(p.v, cen.c), 2)) AS within_ss, count(*) AS n, count(DISTINCT p.label) AS k
       FROM p JOIN cen USING (label))
SELECT round(silhouette, 6) AS silhouette, round(davies_bouldin, 6) AS davies_bouldin,
       round(CASE WHEN within_ss = 0 THEN 1.0 ELSE (between_ss / (k - 1)) / (within_ss / (n - k)) END, 6) AS calinski_harabasz,
       n, k
FROM sil, db, bw, ww
""")
def q_metrics(spark, sf):
    """Silhouette (Euclidean), Davies-Bouldin, Calinski-Harabasz of the labels."""
    m = EV.evaluate_clusters(_points(spark, sf), "id", "features", "label")
    return m.select(*[py_round(c, 6).alias(c) for c in ("silhouette", "davies_bouldin", "calinski_harabasz")],
                    "n", "k")


@register("label_agreement_1nn", f"""
WITH {POINTS_SQL},
d AS (SELECT a.id AS query_id, a.label AS la, b.label AS lb,
             row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
      FROM p a, p b WHERE a.id <> b.id)
SELECT avg(CAST(la = lb AS DOUBLE)) AS agreement FROM d WHERE rank = 1
""")
def q_agreement(spark, sf):
    """Share of vectors whose label equals their nearest neighbour's label."""
    p = _points(spark, sf)
    nn = NB.knn_join(p, p, 1, exclude_self=True)
    lab = p.select("id", "label")
    j = nn.join(lab.withColumnRenamed("id", "query_id").withColumnRenamed("label", "la"), "query_id") \
          .join(lab.withColumnRenamed("id", "neighbor_id").withColumnRenamed("label", "lb"), "neighbor_id")
    return EV.label_agreement(j, "la", "lb")


#: Lattice of the invoice lines: quantity, line number and discount in tenths, as two of them are never quite 0.3 apart.
LATTICE_EPS = 0.3


@register("eps_counts_lattice", f"""
WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS id, CAST(l_quantity AS DOUBLE) * 0.1 AS x,
                  CAST(l_linenumber AS DOUBLE) * 0.1 AS y FROM lineitem),
u AS (SELECT x, y, count(*) AS w FROM p GROUP BY 1, 2),
c AS (SELECT a.x, a.y, CAST(sum(b.w) AS BIGINT) AS n_within FROM u a, u b
      WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {LATTICE_EPS} GROUP BY 1, 2)
SELECT id, n_within FROM p JOIN c ON p.x = c.x AND p.y = c.y
""")
def q_eps_counts(spark, sf):
    """Invoice lines within eps of each line on a lattice of (quantity, line
    number) tenths, where many distances are exactly eps."""
    tenth = lambda c: F.col(c).cast("double") * F.lit(0.1)
    points = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
                                                 F.array(tenth("l_quantity"), tenth("l_linenumber")).alias("features"))
    return NB.eps_counts(points, LATTICE_EPS)


SWEEP_K = tuple(range(2, 9))


@register("silhouette_sweep_embeddings", f"""
WITH {POINTS_SQL},
ks AS (SELECT unnest({list(SWEEP_K)}) AS k),
d AS MATERIALIZED (SELECT a.id, a.label AS la, b.label AS lb, list_distance(a.v, b.v) AS dist FROM p a, p b),
s AS (SELECT k, id, la % k AS own, lb % k AS other, sum(dist) AS sd, count(*) AS c FROM d, ks GROUP BY ALL),
ab AS (SELECT k, id, max(CASE WHEN own = other AND c > 1 THEN sd / (c - 1) END) AS a,
              min(CASE WHEN own <> other THEN sd / c END) AS b FROM s GROUP BY 1, 2)
SELECT k, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END), 6) AS silhouette
FROM ab GROUP BY k
""")
def q_silhouette_sweep(spark, sf):
    """M3 + M14: silhouettes of seven labellings (label modulo k) by one pair pass."""
    points = _points(spark, sf).select("features", *[(F.col("label") % k).alias(f"k{k}") for k in SWEEP_K])
    found = EV.silhouettes(points, [f"k{k}" for k in SWEEP_K])
    return spark.createDataFrame([(k, found[f"k{k}"]) for k in SWEEP_K], "k int, silhouette double").withColumn(
        "silhouette", py_round("silhouette", 6))
