"""Writing results (SINK-1..SINK-3)."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class StageConfig:
    """Parameters that name a stage's output folder."""

    root: str
    experiment: str
    method: str = "original"
    offset: int = 60
    overlap: int = 0
    columns: str = ""


def dataset_path(config: StageConfig, stage: str) -> str:
    """Folder name with the experiment and parameters (SINK-2)."""
    named = [f"{f.name}_{getattr(config, f.name)}" for f in fields(config) if f.name not in ("root", "experiment", "columns")]
    tail = "_".join(named) + (f"_{config.columns}" if config.columns else "")
    return f"{config.root}/{config.experiment}/{stage}/{tail}"


def write(df: DataFrame, path: str, pid: str = "participant_id", mode: str = "overwrite", files_per_key: int = 8, by_partition: bool = True) -> None:
    """Write one folder per participant (SINK-1); ``mode='ignore'`` skips existing output (SINK-3).

    Rows are spread by participant and a hash, so a large participant is
    written by several tasks while a small one makes few files.
    """
    plain = [c for c in df.columns if c != pid]
    spread = F.pmod(F.xxhash64(*plain), F.lit(files_per_key))
    out = df.repartition(F.col(pid), spread)
    writer = out.write.mode(mode)
    (writer.partitionBy(pid) if by_partition else writer).parquet(path)


def write_parts(df: DataFrame, path: str, pid: str = "participant_id", ts: str = "ts", mode: str = "errorifexists") -> None:
    """Gzip CSV parts by participant and day, ``path/<pid>=../day=..`` (SINK-1); ``mode='ignore'`` skips existing output (SINK-3).

    A day of a participant is one part; rows without a time go to the null day's folder.
    """
    out = df.withColumn("day", F.to_date(ts)).repartition(pid, "day")
    # all six digits: the default writes milliseconds
    out.write.mode(mode).options(header=True, compression="gzip", timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").partitionBy(pid, "day").csv(path)
