"""Reading record files: CSV, JSON, JSON lines, text, and zipped ones."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.position import with_id
from ..schemas import CODE_REFERENCE
from .csv_ranges import read_csv_ranges
from .paths import matching

FORMATS = ("csv", "json", "jsonl", "csv.zip", "json.zip", "jsonl.zip")
_LINES_PER_BATCH = 10_000
_CHARACTERS_PER_BATCH = 8 << 20
_JSON_ARRAY = r"^\s*\["
_STRICT = {"mode": "FAILFAST"}


def split_paths(paths: str | PurePath | Sequence[str | PurePath]) -> list[str]:
    """One path, a comma-separated list, or a sequence of paths."""
    if isinstance(paths, str):
        return [p for p in paths.split(",") if p]
    if isinstance(paths, PurePath):
        return [str(paths)]
    if isinstance(paths, (list, tuple)):
        return [str(p) for p in paths]
    raise ValueError(f"cannot read paths from {type(paths).__name__}")


def format_of(path: str) -> str:
    """The format that the file name's suffix stands for."""
    name = PurePath(path).name
    for fmt in sorted(FORMATS, key=len, reverse=True):
        if name.endswith("." + fmt):
            return fmt
    raise ValueError(f"unsupported file format: {name}")


def read_records(spark: SparkSession, paths: str | PurePath | Sequence[str | PurePath],
                 fmt: str | None = None, schema: T.StructType | None = None,
                 provenance: str | None = None, order_columns: bool = False) -> DataFrame:
    """All records of the given files, columns united by name.

    Files of one format go to one reader call. `provenance` names a column
    that gets the file name. `order_columns` adds `_path`, `_split` and
    `_line`, whose order is that of the given list and of the records in the
    files. Without a schema the types are inferred, which reads the data once
    more. A record that cannot be read is an error.
    """
    listed = split_paths(paths)
    if not listed:
        raise ValueError("no paths given")
    if order_columns and len(listed) > 1:
        return _united([
            _in_place(read_records(spark, [path], fmt, schema, provenance, True), n) for n, path in enumerate(listed)])
    by_format: dict[str, list[str]] = {}
    for path in listed:
        by_format.setdefault(fmt or format_of(path), []).append(path)
    return _united([_read_format(spark, f, group, schema, provenance, order_columns)
                    for f, group in by_format.items()])


def _united(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def _in_place(df: DataFrame, place: int) -> DataFrame:
    """`_path` with the place of its path in the list before it."""
    return df.withColumn("_path", F.concat(F.lit(f"{place:06d}:"), "_path"))


def read_directory(spark: SparkSession, directory: str | PurePath, pattern: str = "*.jsonl",
                   schema: T.StructType | None = None, provenance: str | None = None) -> DataFrame:
    """The JSON lines of everything in a directory whose name matches `pattern`.

    A match is a file, or a folder of files as the writers here leave it. No
    match is an error.
    """
    found = matching(spark, str(directory), pattern)
    if not found:
        raise FileNotFoundError(f"nothing in {directory} matches {pattern}")
    reader = spark.read.option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema else reader
    return _tag(reader.json(found), provenance, False)


def read_code_references(spark: SparkSession, paths: str | PurePath | Sequence[str | PurePath]) -> DataFrame:
    """(ref_id, diag, diag_code) of reference files; ids count the records in order from 0."""
    rows = read_records(spark, paths, schema=CODE_REFERENCE, order_columns=True)
    return with_id(rows, "ref_id").select("ref_id", "diag", "diag_code")


def read_text_lines(spark: SparkSession, paths: str | PurePath | Sequence[str | PurePath],
                    provenance: str | None = None, order_columns: bool = False) -> DataFrame:
    """One row `text` per line; empty lines stay."""
    listed = split_paths(paths)
    if order_columns and len(listed) > 1:
        return _united([
            _in_place(read_text_lines(spark, [path], provenance, True), n) for n, path in enumerate(listed)])
    return _tag(spark.read.text(listed), provenance, order_columns).withColumnRenamed("value", "text")


def _tag(df: DataFrame, provenance: str | None, order_columns: bool) -> DataFrame:
    """File name and reading order from the hidden file metadata.

    A split of a file is read by one task from front to back, so the file,
    the start of the split and a number that grows within the task order
    the records however the scan is partitioned.
    """
    added = []
    if provenance:
        added.append(F.col("_metadata.file_name").alias(provenance))
    if order_columns:
        added += [F.col("_metadata.file_path").alias("_path"),
                  F.col("_metadata.file_block_start").alias("_split"),
                  F.monotonically_increasing_id().alias("_line")]
    return df.select("*", *added) if added else df


def _read_format(spark: SparkSession, fmt: str, paths: list[str], schema: T.StructType | None,
                 provenance: str | None, order_columns: bool) -> DataFrame:
    if fmt == "jsonl":
        reader = spark.read.option("mode", "FAILFAST")
        reader = reader.schema(schema) if schema else reader
        return _tag(reader.json(paths), provenance, order_columns)
    if fmt == "csv":
        return read_csv_ranges(spark, paths, schema, provenance, order_columns)
    if fmt == "json":
        text = spark.read.text(paths, wholetext=True)
        return _json_documents(_tag(text, provenance, order_columns), schema)
    if fmt in ("csv.zip", "json.zip", "jsonl.zip"):
        archives = spark.read.format("binaryFile").load(paths)
        return unzip_records(archives, fmt, schema, provenance, order_columns)
    raise ValueError(f"unsupported file format: {fmt}")


def _inferred(texts: DataFrame) -> DataFrame:
    """JSON texts read with inferred types, without leaving the JVM."""
    spark = texts.sparkSession
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark._jsparkSession.read().json(strings), spark)


def _json_documents(documents: DataFrame, schema: T.StructType | None) -> DataFrame:
    """Records of whole JSON documents held in `value`.

    A list holds one record per element. An object is column-oriented:
    {"column": {"row key": value}}.
    """
    extra = [c for c in documents.columns if c != "value"]
    is_list = F.col("value").rlike(_JSON_ARRAY)
    listed = documents.where(is_list)
    columnar = documents.where(~is_list)
    cells = "map<string,map<string,string>>"
    if schema is None:
        names = [r[0] for r in columnar.select(
            F.explode(F.map_keys(F.from_json("value", cells, _STRICT)))).distinct().collect()]
        inferred = _inferred(listed.select("value"))
        known = {f.name: f for f in inferred.schema}
        schema = T.StructType([
            known.get(n, T.StructField(n, T.StringType())) for n in sorted(set(names) | set(known))])
    elements = listed.select(
        *extra, F.posexplode(F.from_json("value", T.ArrayType(schema), _STRICT)).alias("_at", "_record"))
    if "_line" in extra:
        elements = elements.withColumn("_line", F.col("_at").cast("bigint"))
    records = elements.select(*extra, "_record.*")

    # Column-oriented: one row per cell, put back together per row key.
    per_column = columnar.withColumn("_doc", F.monotonically_increasing_id()).select(
        *extra, "_doc", F.explode(F.from_json("value", cells, _STRICT)).alias("_column", "_cells"))
    per_cell = per_column.select(*extra, "_doc", "_column", F.explode("_cells").alias("_key", "_cell"))
    rows = per_cell.groupBy(*extra, "_doc", "_key").agg(*[
        F.max(F.when(F.col("_column") == f.name, F.col("_cell"))).cast(f.dataType).alias(f.name)
        for f in schema])
    if "_line" in extra:
        rows = rows.withColumn("_line", F.col("_key").try_cast("bigint"))
    return records.select(*schema.names, *extra).unionByName(rows.select(*schema.names, *extra))


def _zip_records(stream: io.BufferedIOBase, fmt: str) -> Iterator[str]:
    """JSON text of each record of one archive member."""
    text = io.TextIOWrapper(stream, encoding="utf-8", newline="")
    if fmt == "csv.zip":
        for row in csv.DictReader(text):
            yield json.dumps(row, ensure_ascii=False)
    elif fmt == "jsonl.zip":
        for line in text:
            if line.strip():
                yield line.rstrip("\r\n")
    else:
        document = json.load(text)
        if isinstance(document, list):
            for record in document:
                yield json.dumps(record, ensure_ascii=False)
        else:
            keys = dict.fromkeys(k for cells in document.values() for k in cells)
            for key in keys:
                yield json.dumps({c: cells.get(key) for c, cells in document.items()},
                                 ensure_ascii=False)


def _chunks(records: Iterator[str]) -> Iterator[list[str]]:
    """Lists of records, bounded in number and characters but for one record."""
    chunk, size = [], 0
    for record in records:
        chunk.append(record)
        size += len(record)
        if len(chunk) >= _LINES_PER_BATCH or size >= _CHARACTERS_PER_BATCH:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def unzip_records(archives: DataFrame, fmt: str, schema: T.StructType | None = None,
                  provenance: str | None = None, order_columns: bool = False) -> DataFrame:
    """Records of archives given as (path, content).

    Zip has no splits: one task unpacks one archive, in batches of lines of bounded size.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                start = 0
                records = _archive_records(content, fmt)
                for chunk in _chunks(records):
                    end = start + len(chunk)
                    yield pd.DataFrame({"path": path, "line": range(start, end), "value": chunk})
                    start = end

    lines = archives.select("path", "content").mapInPandas(
        unpack, "path string, line long, value string")
    if schema is None:
        schema = _inferred(lines.select("value")).schema
    text_cells = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    parsed = F.from_json("value", text_cells if fmt == "csv.zip" else schema, _STRICT)
    columns = [F.col(f"_record.`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]
    if provenance:
        columns.append(F.substring_index("path", "/", -1).alias(provenance))
    if order_columns:
        columns += [F.col("path").alias("_path"), F.lit(0).cast("bigint").alias("_split"),
                    F.col("line").alias("_line")]
    return lines.withColumn("_record", parsed).select(*columns)


def _archive_records(content: bytes, fmt: str) -> Iterator[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for member in sorted(archive.namelist()):
            if not member.endswith("/"):
                with archive.open(member) as stream:
                    yield from _zip_records(stream, fmt)
