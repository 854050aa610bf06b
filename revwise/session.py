"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  On a cluster the shuffle partition count comes
# from the cluster's own configuration; AQE then coalesces small partitions
# toward the advisory size and splits skewed join partitions.  Tests and the
# bench pass a small ``shuffle_partitions`` for local mode.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "revwise", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taken from ``spark.checkpoint.dir``.

    On a cluster the folder is the shared one the cluster names.  Only when the
    setting is absent (``local`` masters only) a private folder under the temp dir is
    made, which goes when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf_dir = None
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="revwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)  # made here, for this process
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Stage boundary: reliable checkpoint of ``df`` into the shared folder
    (``spark.checkpoint.dir``), cutting its lineage.

    Used where a stage's output feeds several later branches (the way the batch
    writes its stage tables) and at the end of every round of an iterative
    operator.  The folder is the cluster's shared one, so the data survives
    executor loss; it is never node-local.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _stage_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def drop_stage_tables(spark: SparkSession) -> None:
    """Remove the stage tables this application has written, once their readers are done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stage_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize_table(df):
    """Stage boundary as a written parquet table in the shared checkpoint folder,
    continued from a fresh scan (fresh attributes, no carried constraints).

    Spark 4.1 fails to plan some self-joins of checkpointed plans that carry a
    constant column ("key not found" during planning); the label-propagation
    loop of the density operator hits that, so it uses tables instead.
    """
    path = f"{_stage_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
