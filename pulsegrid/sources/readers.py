"""Readers for per-participant files (SRC-1..SRC-5, SRC-11, SRC-14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import schemas


def read_named_csv(spark: SparkSession, path, schema: T.StructType | None, missing: str = "error", bad: str | None = None) -> DataFrame:
    """CSV files with a header, columns picked by name.

    A column is looked up under its own name and its names in ``schemas.ALIASES``; other columns of the file are left out.  A column
    that the header lacks raises ValueError, or is null with ``missing="null"``.  Files whose headers differ from the first one's
    make the read fail instead of shifting columns.  Text that does not read as the column's type gives null;
    ``bad`` names a column that counts such cells per row.  Nothing is scanned to infer types.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    if schema is None:
        return raw.select("*", F.col("_metadata.file_path").alias("_path"))
    found, lost, wrong = [], [], F.lit(0)
    for f in schema.fields:
        name = next((n for n in (f.name, *schemas.ALIASES.get(f.name, ())) if n in raw.columns), None)
        if name is None:
            lost.append(f.name)
            found.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text = F.col(f"`{name}`")
        value = text.try_cast(f.dataType)
        found.append(value.alias(f.name))
        wrong = wrong + ((F.trim(text) != "") & text.isNotNull() & value.isNull()).cast("int")
    if lost and missing == "error":
        raise ValueError(f"no column for {', '.join(lost)} in {raw.columns}")
    return raw.select(*found, *([wrong.alias(bad)] if bad else []), F.col("_metadata.file_path").alias("_path"))


def read_stream_csv(
    spark: SparkSession, path, schema: T.StructType | None, id_pattern: str = r"([^/_]+)_[^/]*$", pid="participant_id", missing: str = "error", bad: str | None = None,
) -> DataFrame:
    """CSV files (gzip allowed) of one stream, see ``read_named_csv``; the file name gives the participant (SRC-1)."""
    df = read_named_csv(spark, path, schema, missing, bad)
    name = F.regexp_extract(F.col("_path"), id_pattern, 1)
    return df.select(F.url_decode(name).alias(pid), *[c for c in df.columns if c != "_path"])


def read_wrist_bundle(spark: SparkSession, folder: str, suffix: str = ".csv.gz") -> dict[str, DataFrame]:
    """Heart rate, steps and daily summary of one export folder (SRC-2)."""
    parts = {"heart_rate": ("heartRate", schemas.WRIST_HR), "steps": ("stepCount", schemas.WRIST_STEPS),
             "summary": ("dailySummary", schemas.WRIST_SUMMARY)}
    # summaries differ in the sleeps and zones they list
    return {k: read_stream_csv(spark, f"{folder}/*_{stem}{suffix}", schema, missing="null" if k == "summary" else "error") for k, (stem, schema) in parts.items()}


def read_parts(spark: SparkSession, folder: str, schema: T.StructType | None = None, pid="participant_id") -> DataFrame:
    """A folder of per-participant sub-folders of daily CSV parts (SRC-3).

    ``folder/<participant>/<day>.csv.gz``; Parquet written by ``write`` is read
    with ``spark.read.parquet`` and prunes participants by itself.
    """
    return read_stream_csv(spark, f"{folder}/*/*", schema, r"([^/]+)/[^/]+$", pid)


def read_dated_parts(spark: SparkSession, path: str, schema: T.StructType, pid: T.StructField = T.StructField("participant_id", T.StringType())) -> DataFrame:
    """Parts written by ``sinks.write_parts`` (SRC-3): the participant and ``day`` come from the folders.

    Filters on those two choose folders before any file is opened.
    """
    whole = T.StructType([*schema.fields, pid, T.StructField("day", T.DateType())])
    return spark.read.schema(whole).options(header=True, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def read_proximity(spark: SparkSession, path, min_rssi: int = 140) -> DataFrame:
    """Proximity stream above a signal cut-off (SRC-4)."""
    df = read_stream_csv(spark, path, schemas.PROXIMITY)
    return proximity_cut(df, min_rssi)


def proximity_cut(df: DataFrame, min_rssi: float = 140, rssi="rssi", drop: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(rssi) >= min_rssi).drop(*drop)


def read_survey(spark: SparkSession, path) -> DataFrame:
    """Momentary survey with its parsed timestamp (SRC-5)."""
    df = read_named_csv(spark, path, schemas.SURVEY).drop("_path")
    return df.withColumn("ts", F.to_timestamp_ntz("timestamp")).drop("timestamp")


def parse_json_lines(df: DataFrame, text: str, schema: str) -> DataFrame:
    """JSON text column to columns (SRC-11)."""
    return df.withColumn("_j", F.from_json(text, schema)).select(*df.columns, "_j.*")


def parse_csv_lines(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Headerless CSV text column to columns (SRC-11)."""
    return df.withColumn("_c", F.from_csv(text, schema)).select(*df.columns, "_c.*")


def participants(df: DataFrame, pid="participant_id") -> DataFrame:
    return df.select(pid).distinct()


def participants_union(a: DataFrame, b: DataFrame, pid="participant_id") -> DataFrame:
    """Participants found in either stream (SRC-14); each side is reduced first."""
    return a.select(pid).distinct().union(b.select(pid).distinct()).distinct()
