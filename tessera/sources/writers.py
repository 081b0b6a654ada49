"""Writing results: JSON lines, CSV, appended chunks, cached tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .paths import exists, files_under, publish

_JSON_SUFFIXES = (".json", ".jsonl")
DEFAULT_FILE = "generate.jsonl"


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists",
                rows_per_file: int | None = None, compression: str | None = None) -> None:
    """JSON lines, UTF-8 as it is, null fields written out.

    Readers take compressed files as they are. One task reads a gzip file, so `rows_per_file` goes with it.
    """
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if compression:
        writer = writer.option("compression", compression)
    writer.json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists",
              rows_per_file: int | None = None, compression: str | None = None) -> None:
    """CSV with a header, quotes doubled, no row index."""
    writer = (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def result_target(path: str) -> tuple[str, str]:
    """The folder that results for `path` are in, and their format.

    The suffix picks the format; a path without a known one stands for a
    JSON-lines folder of a fixed name in it.
    """
    suffix = PurePath(path).suffix
    if suffix in (".xls", ".xlsx"):
        raise ValueError("spreadsheets are not written; use .jsonl or .csv")
    if suffix == ".csv":
        return path, "csv"
    return (path if suffix in _JSON_SUFFIXES else f"{path.rstrip('/')}/{DEFAULT_FILE}"), "json"


def append_results(df: DataFrame, path: str, rows_per_file: int | None = None,
                   resume: bool = True, compression: str | None = None) -> str:
    """Add results under `path`; without `resume` what is there is replaced.

    Returns the folder written to, as `result_target` names it.
    """
    target, fmt = result_target(path)
    write = write_csv if fmt == "csv" else write_jsonl
    write(df, target, "append" if resume else "overwrite", rows_per_file, compression)
    return target


def read_results(spark: SparkSession, path: str, key: T.StructField) -> DataFrame | None:
    """(key, finish_reason) of the results under `path`; nothing if none are written yet."""
    target, fmt = result_target(path)
    if not exists(spark, target):
        return None
    wanted = T.StructType([key, T.StructField("finish_reason", T.StringType())])
    if fmt == "json":
        return spark.read.schema(wanted).json(target)
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(target)
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def shard_path(directory: str, rank: int | None = None, world: int | None = None,
               stem: str = "generate") -> str:
    """Where the run for one shard of the rows puts its results."""
    if rank is None or world is None:
        rank, world = 0, 1
    return f"{directory.rstrip('/')}/{stem}.{rank}.{world}.jsonl"


def write_shards(df: DataFrame, path: str, shard: str = "shard", mode: str = "append") -> None:
    """JSON lines in one folder per value of the shard column."""
    df.write.mode(mode).option("ignoreNullFields", "false").partitionBy(shard).json(path)


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at `path`, or nothing when it was never finished."""
    return spark.read.parquet(path) if exists(spark, f"{path.rstrip('/')}/_SUCCESS") else None


def cache_key(spark: SparkSession, inputs: Sequence[str] = (), **made_with: object) -> str:
    """A name for what is prepared from these files, as they are now, under these settings."""
    manifest = [files_under(spark, path) for path in inputs]
    return hashlib.sha256(json.dumps([manifest, made_with], sort_keys=True, default=str).encode()).hexdigest()[:32]


def cached(spark: SparkSession, path: str, prepare: Callable[[], DataFrame], inputs: Sequence[str] = (),
           **made_with: object) -> DataFrame:
    """The table prepared from `inputs` under the given settings, prepared and written first if it is not there.

    It lies in a folder of `path` that is named after the path, length and
    time of each input file and the settings, so that a changed input is prepared anew. It is
    written aside and renamed when whole: of two writers one whole table stays.
    """
    table = f"{path.rstrip('/')}/{cache_key(spark, inputs, **made_with)}"
    found = read_if_present(spark, table)
    if found is not None:
        return found
    aside = f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    prepare().write.parquet(aside)
    publish(spark, aside, table)
    return spark.read.parquet(table)
