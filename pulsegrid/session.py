"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are tuned for; all are plain Spark options.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "pulsegrid", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    One is made up only in local mode, where the machine is the cluster.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="pulsegrid-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the folder named by ``spark.checkpoint.dir``.

    Iterative drivers call this between rounds.  The data lands in shared
    storage, so it outlives the executors that wrote it.
    """
    shared_folder(df.sparkSession)
    return _without_vast_size(df.checkpoint(eager=True))


def _without_vast_size(stored: DataFrame) -> DataFrame:
    """The same rows without Spark's estimate of their size, if that is beyond all memory.

    A stored table keeps the estimate of the plan that made it, and a join's is the product of both sides'.  Over rounds of
    joins the digits double each time, until one number takes megabytes of the driver.
    """
    session, plan = stored.sparkSession._jsparkSession, stored._jdf.queryExecution().analyzed()
    try:
        if plan.stats().sizeInBytes() < 1 << 62:
            return stored
    except ValueError:  # more digits than Python reads
        pass
    return type(stored)(session.internalCreateDataFrame(plan.rdd(), stored._jdf.schema(), False), stored.sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files no table needs any more; it does so when the driver's garbage is collected."""
    gc.collect()  # handles on this side keep plans alive on the other
    spark.range(1).count()  # and so does the last query run
    spark.sparkContext._jvm.System.gc()
