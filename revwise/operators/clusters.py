"""Cluster-level operators over labelled vectors.

Input: one row per member ``(run_id, review_id, embedding array<float>,
cluster int)``, cluster -1 being noise.  Membership is kept in long form;
nothing collects a whole cluster into one row or one task.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HIGH_NOISE_SHARE = 0.35
TOP_CLUSTERS = 6
REPRESENTATIVES = 10


def as_double(arr: Column) -> Column:
    return arr.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two equal-length numeric arrays (in double)."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def cluster_id(run_id: Column, label: Column) -> Column:
    """sha1('<run>-cluster-<label>')."""
    return F.sha1(F.concat(run_id, F.lit("-cluster-"), label.cast("string")))


def members(rows: DataFrame) -> DataFrame:
    """Clustered rows only (noise dropped), with the stable cluster id."""
    return (rows.filter(F.col("cluster") >= 0)
            .withColumn("cluster_id", cluster_id(F.col("run_id"), F.col("cluster"))))


def centroids(rows: DataFrame) -> DataFrame:
    """A4: element-wise mean vector per (run, cluster).

    ``Summarizer.mean`` is a typed aggregate with a partial step, so each map
    task ships one running sum per cluster; vectors are never exploded.
    """
    m = members(rows).withColumn("_v", array_to_vector(as_double(F.col("embedding"))))
    return (m.groupBy("run_id", "cluster", "cluster_id")
            .agg(Summarizer.mean(F.col("_v")).alias("_c"), F.count(F.lit(1)).alias("size"))
            .select("run_id", "cluster", "cluster_id", "size",
                    vector_to_array(F.col("_c")).alias("centroid")))


def medoids(rows: DataFrame, cents: DataFrame | None = None) -> DataFrame:
    """Member with the largest dot product with its centroid; ties → smallest id.

    The join is on (run, cluster); the centroid side has one row per cluster and
    is broadcast by Catalyst only while its estimated size is under the
    threshold.  The pick is a grouped ``min_by`` (partial aggregation), not a
    window sort of the whole cluster.
    """
    cents = cents if cents is not None else centroids(rows)
    j = members(rows).join(cents.select("run_id", "cluster", "centroid"), ["run_id", "cluster"])
    j = j.withColumn("sim", dot(F.col("embedding"), F.col("centroid")))
    return (j.groupBy("run_id", "cluster", "cluster_id")
            .agg(F.min_by("review_id", F.struct((-F.col("sim")).alias("k"),
                                                F.col("review_id"))).alias("medoid_review_id"),
                 F.max("sim").alias("medoid_sim")))


def cluster_metrics(rows: DataFrame) -> DataFrame:
    """A5: clusters, noise count and share, high-noise flag, by run."""
    g = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.count_if(F.col("cluster") == -1).alias("noise_count"),
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("cluster_count"))
    share = F.col("noise_count") / F.col("review_count")
    return g.select("*", F.round(share, 3).alias("noise_ratio"),
                    (share > HIGH_NOISE_SHARE).alias("high_noise"))


def cluster_sizes(rows: DataFrame) -> DataFrame:
    return (members(rows).groupBy("run_id", "cluster", "cluster_id")
            .agg(F.count(F.lit(1)).alias("size")))


def cluster_members(rows: DataFrame) -> DataFrame:
    """Long form (run, cluster id, review id) with the cluster's size."""
    m = members(rows).select("run_id", "cluster", "cluster_id", "review_id")
    return m.join(cluster_sizes(rows), ["run_id", "cluster", "cluster_id"])


def top_clusters(sizes: DataFrame, n: int = TOP_CLUSTERS) -> DataFrame:
    """The n largest clusters of each run (size desc, then cluster id)."""
    w = Window.partitionBy("run_id").orderBy(F.col("size").desc(), F.col("cluster_id"))
    return sizes.withColumn("size_rank", F.row_number().over(w)).filter(F.col("size_rank") <= n)


def first_members(rows: DataFrame, n: int = REPRESENTATIVES, order: str = "review_id") -> DataFrame:
    """First n members of each cluster by ``order``.

    The ``row_number() <= n`` filter plans as WindowGroupLimit, a per-partition
    top-n before the shuffle, so a huge cluster never reaches one sort whole.
    """
    w = Window.partitionBy("run_id", "cluster_id").orderBy(F.col(order))
    return (members(rows).withColumn("member_rank", F.row_number().over(w))
            .filter(F.col("member_rank") <= n))
