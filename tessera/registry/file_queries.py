"""File formats: each job writes a table out and reads it back."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators.position import shard_of, with_file_position, with_id, with_row_id
from ..schemas import struct
from ..session import fresh_path, settings, stage
from ..sources import readers, writers
from . import views

DOCUMENT = struct("doc_id bigint, text string")
LABEL = struct("doc_id bigint, quality int, toxic int")


def _labels(spark, sf_dir):
    return views.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")


def sink_jsonl(spark, sf_dir):
    """Null labels are written as nulls, not left out."""
    path = fresh_path(spark, "jsonl") + "/rows.jsonl"
    writers.write_jsonl(views.clf_input(spark, sf_dir), path)
    lines = spark.read.text(path)
    written = lines.where(F.col("value").contains('"label":')).count()
    return readers.read_records(spark, path).withColumn("lines", F.lit(written))


def sink_csv(spark, sf_dir):
    path = fresh_path(spark, "csv") + "/rows.csv"
    writers.append_results(views.documents(spark, sf_dir), path, resume=False)
    return readers.read_records(spark, path, schema=DOCUMENT)


def sink_append(spark, sf_dir):
    """Two appends, the second after a run that started over."""
    path = fresh_path(spark, "append")
    rows = _labels(spark, sf_dir)
    writers.append_results(rows, path, resume=False)
    target = writers.append_results(rows.where(F.col("toxic") == 1), path, 64, resume=False)
    writers.append_results(rows.where(F.col("toxic") == 0), path, 64)
    return readers.read_records(spark, target, schema=LABEL)


def sink_shards(spark, sf_dir):
    path = fresh_path(spark, "shards")
    rows = with_row_id(_labels(spark, sf_dir), ["doc_id"], replayable=True)
    writers.write_shards(rows.withColumn("shard", shard_of(F.col("row_id"), 4)), path)
    return spark.read.json(path).select("doc_id", "row_id", "shard")


def sink_cache(spark, sf_dir):
    """Prepared once; the second call finds the table, other settings prepare one of their own."""
    path, inputs = fresh_path(spark, "cache"), [f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet"]

    def again():
        raise RuntimeError("the cached table was not used")

    writers.cached(spark, path, lambda: views.clf_input(spark, sf_dir), inputs, block_size=64)
    writers.cached(spark, path, lambda: views.documents(spark, sf_dir), inputs, block_size=65)
    return writers.cached(spark, path, again, inputs, block_size=64)


def src_jsonl(spark, sf_dir):
    path = fresh_path(spark, "src") + "/rows.jsonl"
    writers.write_jsonl(views.documents(spark, sf_dir), path)
    return readers.read_records(spark, path, schema=DOCUMENT)


def src_csv(spark, sf_dir):
    """Quoted line breaks and quotes; types inferred; columns in another order in one of two inputs."""
    base = fresh_path(spark, "src")
    rows = views.documents(spark, sf_dir)
    odd = F.col("doc_id") % 2 == 1
    writers.write_csv(rows.where(odd).select("doc_id", "text"), f"{base}/odd.csv")
    writers.write_csv(rows.where(~odd).select("text", "doc_id"), f"{base}/even.csv")
    read = readers.read_records(spark, f"{base}/odd.csv,{base}/even.csv")
    return read.select(F.col("doc_id").cast("bigint"), "text")


def src_csv_ranges(spark, sf_dir):
    """Files of at least 16 ranges each, their quoted line breaks and quotes across borders; one file while that is small."""
    path = fresh_path(spark, "src") + "/one.csv"
    rows = views.documents(spark, sf_dir)
    size = views.text_bytes(rows)
    files = views.file_count(size)
    writers.write_csv(rows.coalesce(files), path)
    with settings(spark, spark__sql__files__maxPartitionBytes=str(size // (20 * files))):
        return stage(readers.read_records(spark, path, schema=DOCUMENT), "csv-rows")


def src_positions(spark, sf_dir):
    """Rows numbered in the order of the path list, which is not that of the names."""
    base = fresh_path(spark, "src")
    rows = _labels(spark, sf_dir).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    writers.write_jsonl(rows.where(F.col("toxic") == 1), f"{base}/z.jsonl")
    writers.write_jsonl(rows.where(F.col("toxic") == 0), f"{base}/a.jsonl")
    read = readers.read_records(spark, [f"{base}/z.jsonl", f"{base}/a.jsonl"], schema=LABEL, order_columns=True)
    return with_id(read, "place").select("place", "doc_id", "toxic")


def _write_json_documents(rows, path, columnar=False):
    """Documents of 64 records: a list, or column by column."""
    key = F.col("doc_id").cast("string")

    def column(name):
        return F.map_from_entries(F.collect_list(F.struct(key, F.col(name)))).alias(name)

    content = F.struct(column("doc_id"), column("text")) if columnar else F.collect_list(
        F.struct("doc_id", "text"))
    documents = rows.groupBy(F.floor(F.col("doc_id") / 64).alias("part")).agg(
        F.to_json(content).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)


def src_json(spark, sf_dir):
    """List documents next to column-oriented ones."""
    base = fresh_path(spark, "src")
    rows = views.documents(spark, sf_dir)
    middle = rows.agg(F.max("doc_id")).first()[0] // 2
    _write_json_documents(rows.where(F.col("doc_id") <= middle), f"{base}/listed.json")
    _write_json_documents(rows.where(F.col("doc_id") > middle), f"{base}/columnar.json", columnar=True)
    return readers.read_records(
        spark, [f"{base}/listed.json", f"{base}/columnar.json"], schema=DOCUMENT)


def src_text(spark, sf_dir):
    """Lines in file order, empty ones included."""
    path = fresh_path(spark, "src")
    lines = views.pretrain_lines(spark, sf_dir)
    files = 3 + views.file_count(views.text_bytes(views.documents(spark, sf_dir)))
    lines.repartitionByRange(files, "doc_id", "line").sortWithinPartitions("doc_id", "line").select(
        "text").write.text(path)
    read = readers.read_text_lines(spark, path, order_columns=True)
    return with_file_position(read).select("row_id", "text")


def src_dir(spark, sf_dir):
    """Only the JSON-lines files of a directory that holds others as well."""
    path = fresh_path(spark, "src")
    _labels(spark, sf_dir).write.json(path)
    _labels(spark, sf_dir).write.mode("append").option("header", True).csv(path)
    return readers.read_directory(spark, path, "*.json", schema=LABEL)


def src_multi(spark, sf_dir):
    """Two inputs in one list, one of them without the label columns."""
    base = fresh_path(spark, "src")
    writers.write_jsonl(_labels(spark, sf_dir), f"{base}/labelled.jsonl")
    writers.write_jsonl(views.documents(spark, sf_dir).select("doc_id"), f"{base}/all.jsonl")
    return readers.read_records(spark, f"{base}/labelled.jsonl,{base}/all.jsonl", schema=LABEL)


def src_dispatch(spark, sf_dir):
    """The suffix of each path picks its reader."""
    base = fresh_path(spark, "src")
    rows = _labels(spark, sf_dir)
    writers.write_csv(rows.where(F.col("quality") == 1), f"{base}/good.csv")
    writers.write_jsonl(rows.where(F.col("quality") == 0), f"{base}/poor.jsonl")
    return readers.read_records(spark, [f"{base}/good.csv", f"{base}/poor.jsonl"], schema=LABEL)


def src_provenance(spark, sf_dir):
    """File names are Spark's own; what they begin and end with is shown."""
    path = fresh_path(spark, "src") + "/rows.jsonl"
    writers.write_jsonl(_labels(spark, sf_dir), path)
    rows = readers.read_records(spark, path, schema=LABEL, provenance="data_source")
    return rows.select("doc_id", F.substring("data_source", 1, 5).alias("head"),
                       F.substring_index("data_source", ".", -1).alias("suffix"))


def _archives(rows, fmt):
    """One archive for each thousand rows at most of an Arrow batch, its text written as `fmt`."""

    def pack(batches):
        pieces = (batch[at:at + 1000] for batch in batches for at in range(0, len(batch), 1000))
        for n, batch in enumerate(pieces):
            text = (batch.to_csv(index=False, lineterminator="\n") if fmt == "csv.zip" else
                    batch.to_json(orient="records", lines=fmt == "jsonl.zip", force_ascii=False))
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"rows.{fmt.removesuffix('.zip')}", text)
            yield pd.DataFrame({"path": [f"/data/{n}.{fmt}"], "content": [buffer.getvalue()]})

    return rows.mapInPandas(pack, "path string, content binary")


def src_zip(spark, sf_dir):
    """Documents zipped as JSON lines and unpacked again."""
    archives = _archives(views.documents(spark, sf_dir), "jsonl.zip")
    return readers.unzip_records(archives, "jsonl.zip", DOCUMENT)


def src_zip_csv(spark, sf_dir):
    archives = _archives(views.documents(spark, sf_dir), "csv.zip")
    return readers.unzip_records(archives, "csv.zip", DOCUMENT)


QUERIES = {f.__name__: f for f in (
    sink_jsonl, sink_csv, sink_append, sink_shards, sink_cache, src_jsonl, src_csv, src_csv_ranges, src_json,
    src_text, src_dir, src_multi, src_positions, src_dispatch, src_provenance, src_zip, src_zip_csv)}

_DOCUMENTS = "SELECT doc_id, text FROM documents"
_LABELS = "SELECT doc_id, quality, toxic FROM labels"

SQL = {
    "sink_jsonl": views.with_views("clf_input", """
        SELECT qid, text, CAST(label AS BIGINT) AS label,
          CAST((SELECT count(*) FROM clf_input) AS INTEGER) AS lines FROM clf_input"""),
    "sink_csv": _DOCUMENTS,
    "sink_append": _LABELS,
    "sink_shards": """
        SELECT doc_id, row_id, CAST(row_id % 4 AS INTEGER) AS shard FROM (
          SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM labels)""",
    "sink_cache": views.with_views("clf_input", "SELECT qid, text, label FROM clf_input"),
    "src_jsonl": _DOCUMENTS,
    "src_csv": _DOCUMENTS,
    "src_csv_ranges": _DOCUMENTS,
    "src_json": _DOCUMENTS,
    "src_text": views.with_views("numbered_lines", "SELECT row_id, text FROM numbered_lines"),
    "src_dir": _LABELS,
    "src_multi": f"""
        {_LABELS} UNION ALL SELECT doc_id, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER) FROM documents""",
    "src_positions": """
        SELECT row_number() OVER (ORDER BY toxic DESC, doc_id) - 1 AS place, doc_id, toxic FROM labels""",
    "src_dispatch": _LABELS,
    "src_provenance": "SELECT doc_id, 'part-' AS head, 'json' AS suffix FROM labels",
    "src_zip": _DOCUMENTS,
    "src_zip_csv": _DOCUMENTS,
}
