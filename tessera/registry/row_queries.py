"""Positions, shards, limits, resuming and alignment."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import position, resume
from . import views
from .views import with_views


def row_position(spark, sf_dir):
    """Documents numbered by text, where copies are told apart by their id."""
    rows = position.with_row_id(
        views.documents(spark, sf_dir), ["text", "doc_id"], replayable=True)
    return rows.select("doc_id", "row_id")


def _numbered(spark, sf_dir):
    rows = views.documents(spark, sf_dir).select("doc_id")
    return position.with_row_id(rows, ["doc_id"], replayable=True)


def stride_shard(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    shards = [position.take_shard(rows, rank, 3).withColumn("shard", F.lit(rank)) for rank in range(3)]
    return shards[0].unionByName(shards[1]).unionByName(shards[2])


def chunk_rows(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    chunk = position.chunk_of(F.col("row_id"), rows.count(), 64)
    return rows.groupBy(chunk.alias("chunk")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_doc"),
        F.max("doc_id").alias("last_doc"))


def head_limit(spark, sf_dir):
    return position.take_head(_numbered(spark, sf_dir), 100)


def seeded_shuffle(spark, sf_dir):
    key = tx.seeded_key(42, F.col("qid"), F.col("i"))
    rows = views.generations(spark, sf_dir).select(
        "qid", "i", "response_token_len", key.alias("shuffle_key"))
    return position.with_row_id(
        rows, ["shuffle_key", F.asc_nulls_last("response_token_len")], name="place")


def resume_anti(spark, sf_dir):
    """Labelled documents count as done."""
    done = views.table(spark, sf_dir, "labels").select("doc_id")
    return resume.skip_done(views.documents(spark, sf_dir), done, "doc_id")


def align_outputs(spark, sf_dir):
    """Orders are the requests; their lines, several per order, the outputs."""
    requests = views.originals(spark, sf_dir).select("qid", F.col("text").alias("prompt"))
    outputs = views.generations(spark, sf_dir).select("qid", "i", "response", "response_token_len")
    order = [F.asc("i"), F.asc_nulls_last("response_token_len")]
    return resume.align_outputs(requests, outputs, "qid", order)


QUERIES = {f.__name__: f for f in (
    row_position, stride_shard, chunk_rows, head_limit, seeded_shuffle, resume_anti, align_outputs)}

SQL = {
    "row_position": "SELECT doc_id, row_number() OVER (ORDER BY text, doc_id) - 1 AS row_id FROM documents",
    "stride_shard": """
        SELECT doc_id, row_id, CAST(row_id % 3 AS INTEGER) AS shard FROM (
          SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents)""",
    "chunk_rows": """
        SELECT chunk, count(*) AS n_rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (
          SELECT doc_id, ntile(CAST(ceil(n / 64.0) AS INTEGER)) OVER (ORDER BY doc_id) - 1 AS chunk
          FROM documents, (SELECT count(*) AS n FROM documents)) GROUP BY chunk""",
    "head_limit": """
        SELECT doc_id, row_id FROM (
          SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents)
        ORDER BY row_id LIMIT 100""",
    "seeded_shuffle": with_views("generations", """
        SELECT qid, i, response_token_len, shuffle_key, row_number() OVER (
          ORDER BY shuffle_key, response_token_len NULLS LAST) - 1 AS place
        FROM (SELECT *, md5('42|' || qid || '|' || i) AS shuffle_key FROM generations)"""),
    "resume_anti": "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "align_outputs": with_views("originals generations", """
        SELECT o.qid, o.text AS prompt, g.i, coalesce(g.response, '') AS response, g.response_token_len
        FROM originals o LEFT JOIN (
          SELECT * FROM generations QUALIFY row_number() OVER (
            PARTITION BY qid ORDER BY i, response_token_len NULLS LAST) = 1) g ON o.qid = g.qid"""),
}
