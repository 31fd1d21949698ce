"""Tables that a later step reads again, kept in the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import cut_lineage


def written(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back: lineage ends, columns can be pruned.

    All executors share that folder, so the table outlives each of them.  The shuffle files behind it are no longer
    needed then; Spark deletes them when the driver's garbage is collected, which ``release`` asks for after large ones.
    """
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        cut_lineage(spark.range(1))  # picks the folder as cut_lineage does
    path = f"{context.getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if release:
        gc.collect()  # handles on this side keep plans alive on the other
        spark.range(1).count()  # and so does the last query run
        context.listenerBus().waitUntilEmpty()
        spark.sparkContext._jvm.System.gc()
    return table


def row_key(text: str = "text"):
    """Tells rows that share an id apart: repeated rows with equal text get equal results."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def blocks(docs: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` the texts fill."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-total // block_bytes))
