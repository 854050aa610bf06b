"""Queries over clustered vectors: centroids, medoids, sizes, members."""

from __future__ import annotations

from pyspark.sql import functions as F

from revwise.operators import clusters as CL
from revwise.plans.registry import CLUSTER_VECTORS_CTE, query, with_ctes
from revwise.sources.testdata import cluster_vectors

MEMBERS_CTE = """
m AS (
  SELECT run_id, cluster, sha1(run_id || '-cluster-' || CAST(cluster AS VARCHAR)) AS cluster_id,
         review_id, embedding
  FROM cluster_vectors WHERE cluster >= 0
)"""

CENTROID_CTE = """
ex AS (
  SELECT run_id, cluster, cluster_id, unnest(generate_series(1, len(embedding))) AS dim,
         unnest(embedding) AS x
  FROM m),
cent AS (
  SELECT run_id, cluster, cluster_id, dim, avg(CAST(x AS DOUBLE)) AS value
  FROM ex GROUP BY ALL),
centroids AS (
  SELECT run_id, cluster, cluster_id, list(value ORDER BY dim) AS centroid
  FROM cent GROUP BY ALL)"""

SIZES_CTE = """
sizes AS (SELECT run_id, cluster_id, count(*) AS size FROM m GROUP BY ALL)"""


@query("q_centroids", with_ctes(CLUSTER_VECTORS_CTE, MEMBERS_CTE, CENTROID_CTE, SIZES_CTE) + """
SELECT c.run_id, c.cluster_id, s.size, CAST(c.dim AS INTEGER) AS dim, round(c.value, 6) AS value
FROM cent c JOIN sizes s USING (run_id, cluster_id)""")
def q_centroids(spark, sf):
    c = CL.centroids(cluster_vectors(spark, sf))
    return c.select("run_id", "cluster_id", "size",
                    F.posexplode("centroid").alias("pos", "value")).select(
        "run_id", "cluster_id", "size", (F.col("pos") + 1).alias("dim"),
        F.round("value", 6).alias("value"))


@query("q_medoid", with_ctes(CLUSTER_VECTORS_CTE, MEMBERS_CTE, CENTROID_CTE) + """
, sims AS (
  SELECT m.run_id, m.cluster_id, m.review_id,
         list_inner_product(CAST(m.embedding AS DOUBLE[]), c.centroid) AS sim
  FROM m JOIN centroids c USING (run_id, cluster, cluster_id))
SELECT run_id, cluster_id, review_id AS medoid_review_id, round(sim, 6) AS medoid_sim FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY sim DESC, review_id) AS rn
  FROM sims) WHERE rn = 1""")
def q_medoid(spark, sf):
    md = CL.medoids(cluster_vectors(spark, sf))
    return md.select("run_id", "cluster_id", "medoid_review_id",
                     F.round("medoid_sim", 6).alias("medoid_sim"))


@query("q_cluster_metrics", with_ctes(CLUSTER_VECTORS_CTE) + """
SELECT run_id, count(*) AS review_count, count(*) FILTER (WHERE cluster = -1) AS noise_count,
       count(DISTINCT cluster) FILTER (WHERE cluster >= 0) AS cluster_count,
       round(count(*) FILTER (WHERE cluster = -1) / count(*), 3) AS noise_ratio,
       count(*) FILTER (WHERE cluster = -1) / count(*) > 0.35 AS high_noise
FROM cluster_vectors GROUP BY run_id""")
def q_cluster_metrics(spark, sf):
    return CL.cluster_metrics(cluster_vectors(spark, sf))


@query("q_cluster_members", with_ctes(CLUSTER_VECTORS_CTE, MEMBERS_CTE, SIZES_CTE) + """
SELECT m.run_id, m.cluster_id, m.review_id, s.size FROM m JOIN sizes s USING (run_id, cluster_id)""")
def q_cluster_members(spark, sf):
    return CL.cluster_members(cluster_vectors(spark, sf)).select("run_id", "cluster_id",
                                                                 "review_id", "size")


@query("q_top_clusters", with_ctes(CLUSTER_VECTORS_CTE, MEMBERS_CTE, SIZES_CTE) + """
SELECT run_id, cluster_id, size, size_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY size DESC, cluster_id) AS size_rank
  FROM sizes) WHERE size_rank <= 6""")
def q_top_clusters(spark, sf):
    t = CL.top_clusters(CL.cluster_sizes(cluster_vectors(spark, sf)))
    return t.select("run_id", "cluster_id", "size", "size_rank")


@query("q_representatives", with_ctes(CLUSTER_VECTORS_CTE, MEMBERS_CTE) + """
SELECT run_id, cluster_id, review_id, member_rank FROM (
  SELECT run_id, cluster_id, review_id,
         row_number() OVER (PARTITION BY run_id, cluster_id ORDER BY review_id) AS member_rank
  FROM m) WHERE member_rank <= 10""")
def q_representatives(spark, sf):
    r = CL.first_members(cluster_vectors(spark, sf), 10)
    return r.select("run_id", "cluster_id", "review_id", "member_rank")
