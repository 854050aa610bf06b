"""Vector queries: neighbours, density clusters, text vectors, PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from revwise.operators import embed as EM
from revwise.operators import knn as KN
from revwise.plans.registry import CLUSTER_VECTORS_CTE, REVIEWS_CTE, query, with_ctes
from revwise.session import materialize_table
from revwise.sources.testdata import cluster_vectors, reviews

KNN_K = 15

@query("q_knn", with_ctes(CLUSTER_VECTORS_CTE) + f"""
, p AS (
  SELECT run_id, review_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(
           list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v
  FROM cluster_vectors),
pairs AS (
  SELECT a.run_id, a.review_id, b.review_id AS neighbor_id, round(1.0 - list_inner_product(a.v, b.v), 12) AS distance
  FROM p a JOIN p b ON a.run_id = b.run_id AND a.review_id <> b.review_id)
SELECT run_id, review_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, review_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
WHERE rank <= {KNN_K}""")
def q_knn(spark, sf):
    """The 15 nearest neighbours of every vector of its run, exactly."""
    nn = KN.knn(cluster_vectors(spark, sf), k=KNN_K)
    return nn.select("run_id", "review_id", "neighbor_id", F.col("rank").cast("int").alias("rank"),
                     F.round("distance", 6).alias("distance"))


@query("q_density_clusters", with_ctes(CLUSTER_VECTORS_CTE) + """
SELECT run_id, review_id, CAST(dense_rank() OVER (PARTITION BY run_id ORDER BY size DESC, first) - 1 AS INTEGER) AS cluster
FROM (SELECT run_id, review_id, count(*) OVER w AS size, min(review_id) OVER w AS first
      FROM cluster_vectors WINDOW w AS (PARTITION BY run_id, cluster))""")
def q_density_clusters(spark, sf):
    """M3 on vectors planted by the table's labels: a label's axis plus a fortieth of the
    embedding, so that each label must come out as one cluster."""
    from revwise.operators.density import density_clusters
    axis = F.transform(F.sequence(F.lit(-1), F.lit(14)), lambda i: (i == F.col("cluster")).cast("double"))
    planted = F.concat(axis, F.transform(F.col("embedding").cast("array<double>"), lambda x: x / 40))
    rows = cluster_vectors(spark, sf).select("run_id", "review_id", planted.alias("embedding"))
    return density_clusters(rows)


@query("q_text_vectors", with_ctes(REVIEWS_CTE) + f"""
, tok AS (SELECT id, unnest(regexp_extract_all(lower(body), '{EM.TOKEN_PATTERN}')) AS t FROM reviews),
tf AS (
  SELECT id, CAST(CAST('0x' || substring(sha1(t), 1, 8) AS BIGINT) % {EM.DIM} AS INTEGER) AS bucket, count(*) AS tf
  FROM tok GROUP BY ALL),
df AS (SELECT bucket, count(*) AS df FROM tf GROUP BY bucket),
x AS (
  SELECT id, bucket, tf * ln(((SELECT count(*) FROM reviews) + 1) / (df + 1)) AS x FROM tf JOIN df USING (bucket))
SELECT id, bucket, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS value FROM x WHERE x <> 0""")
def q_text_vectors(spark, sf):
    """M1 (hashed TF-IDF provider) over all reviews: the vectors' non-zero cells."""
    cells = EM.tfidf_cells(reviews(spark, sf).select("id", "body"))
    return cells.select("id", "bucket", F.round("value", 6).alias("value"))


@query("q_reduce", with_ctes(CLUSTER_VECTORS_CTE) + """
SELECT run_id, count(*) AS n, CAST(greatest(2, least(15, count(*) - 2)) AS INTEGER) AS dim, true AS centred, true AS ordered,
       true AS within_total
FROM cluster_vectors GROUP BY run_id""")
def q_reduce(spark, sf):
    """M2: PCA of the run's vectors, and what must hold of it: the dimension, component
    means of 0, falling variances, and no more variance than the vectors have."""
    vec = materialize_table(cluster_vectors(spark, sf).select("run_id", "review_id", "embedding"))
    r = EM.reduce_dims(vec).select("run_id", "review_id", F.posexplode("reduced").alias("c", "x"))
    per = r.groupBy("run_id", "c").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    total = (vec.select("run_id", F.posexplode("embedding").alias("d", "x")).groupBy("run_id", "d")
             .agg(F.var_pop(F.col("x").cast("double")).alias("v")).groupBy("run_id").agg(F.sum("v").alias("total")))
    g = per.groupBy("run_id").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).cast("int").alias("dim"), F.max(F.abs("mean")).alias("mean"),
        F.transform(F.array_sort(F.collect_list(F.struct("c", "var"))), lambda s: s["var"]).alias("vars"), F.sum("var").alias("all"))
    falling = F.forall(F.sequence(F.lit(1), F.size("vars") - 1), lambda i: F.col("vars")[i] <= F.col("vars")[i - 1] + 1e-9)
    return g.join(total, "run_id").select("run_id", "n", "dim", (F.col("mean") < 1e-6).alias("centred"), falling.alias("ordered"),
                                          (F.col("all") <= F.col("total") + 1e-9).alias("within_total"))
