"""Inputs of the registered queries, derived from the given tables.

Each view exists twice: as a DataFrame for the jobs and as SQL for the
check, written independently of the operators under test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import metrics
from ..session import stage

FILE_BYTES = 128 << 20
TASK_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(k: Column) -> Column:
    """A 7-character code whose prefixes of 1, 3, 5, 7 form a hierarchy."""
    def bit(div: int) -> Column:
        return (F.floor(k / F.lit(div)) % 2).cast("string")

    first = F.when(k % 2 == 0, F.lit("A")).otherwise(F.lit("B"))
    return F.concat(first, bit(2), bit(4), F.lit("."), bit(8), bit(16), bit(32))


def code_sql(k: str) -> str:
    bits = [f"CAST(({k}) // {d} % 2 AS VARCHAR)" for d in (2, 4, 8, 16, 32)]
    return (f"CASE WHEN ({k}) % 2 = 0 THEN 'A' ELSE 'B' END || {bits[0]} || {bits[1]} || '.' || "
            f"{bits[2]} || {bits[3]} || {bits[4]}")


def _index() -> Column:
    return (F.col("l_linenumber") + 8 * F.col("l_partkey")).cast("bigint")


def task_count(rows: DataFrame) -> int:
    """How many tasks deal with so many rows, `TASK_ROWS` each at most: in number with the input."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated answer per order line; the order is the question.

    Lines are dealt by their order before texts make them wide, into tasks in number with the
    input: what is then sorted or kept per question stays where it is, and no task's share grows.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    gold = parts.select(F.col("p_partkey").alias("o_custkey"), F.col("p_name").alias("label"))
    asked = orders.join(gold, "o_custkey", "left")
    joined = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .repartition(task_count(lines), "l_orderkey")
        .join(asked, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    i = _index()
    priority = F.col("o_orderpriority")
    return joined.select(
        F.col("l_orderkey").alias("qid"),
        i.alias("i"),
        F.concat(F.lit("The most likely diagnosis is: "), "p_name", F.lit(" "),
                 F.col("l_partkey").cast("string"), F.lit(", option "), i.cast("string")
                 ).alias("response"),
        F.when(F.col("l_quantity") == 1, 0).when(F.col("l_quantity") == 2, None)
        .otherwise(F.col("l_quantity").cast("int")).alias("response_token_len"),
        "label",
        code(F.col("o_custkey")).alias("label_code"),
        F.when(priority == "1-URGENT", code(F.col("o_custkey")))
        .when(priority == "2-HIGH", code(F.col("o_custkey") + 1))
        .otherwise(code(F.col("l_partkey"))).alias("pred_code"),
        F.col("l_linestatus").alias("status"),
        F.concat(F.lit("Case "), F.col("l_orderkey").cast("string"), F.lit("[[SEP]]pending")
                 ).alias("text"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the answers on lines with a return flag other than N.

    The rest are meant to be answers without a score: all answers are read,
    and the left join of scores leaves theirs null. The view's SQL says the same.
    """
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") != "N")
    return lines.select(F.col("l_orderkey").alias("qid"), _index().alias("i"),
                        F.col("l_discount").alias("score"))


def _hot_key(number: Column, key: Column) -> Column:
    return F.when(number % 3 == 0, F.lit(0)).when(number % 7 != 1, key).cast("bigint")


def hot_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, a third of them of one question and about a tenth of none."""
    key = _hot_key(F.col("l_orderkey"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(
        key.alias("qid"), (key * 0).alias("i"), (8 * F.col("l_orderkey") + F.col("l_linenumber")).cast("bigint").alias("line"))


def hot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per supplier, under the same keys."""
    key = _hot_key(F.col("s_suppkey"), F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(
        key.alias("qid"), (key * 0).alias("i"), F.col("s_acctbal").alias("score"))


def originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    response = F.concat(F.lit("Diagnosis is "), code(F.col("o_custkey")), F.lit(", confirmed"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("qid"),
        F.concat(F.lit("Case "), F.col("o_orderkey").cast("string"), F.lit("[[SEP]]"), response
                 ).alias("text"),
        response.alias("response"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in ten wordings, one per part."""
    name, key = F.col("p_name"), F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 10
    wordings = [
        F.concat(F.lit("The most likely diagnosis is acute "), name, F.lit(", specifically "),
                 name, F.lit(" "), key, F.lit(". Follow up.")),
        F.concat(F.lit("The most likely diagnosis is: "), name, F.lit(", given the history.")),
        F.concat(F.lit("Seen today. The probable diagnosis is "), name, F.lit(" "), key, F.lit(".")),
        F.concat(name, F.lit(" is the most likely diagnosis, doctor.")),
        F.concat(F.lit("Diagnosis is: "), name, F.lit(", confirmed")),
        F.concat(F.lit("Diagnosis shows "), name, F.lit(". Rest.")),
        F.concat(F.lit("Diagnosis may be: "), name, F.lit(", pending\nresults")),
        F.concat(F.lit("Likely suffering from: "), name, F.lit(". Rest.")),
        name,
        F.concat(F.lit(" "), name),
    ]
    text = F.when(kind == 0, wordings[0])
    for k in range(1, 10):
        text = text.when(kind == k, wordings[k])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rid"), text.alias("response"))


def diagnosis_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per order that names a part; the order's own part is the label."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    asked = parts.select(F.col("p_partkey").alias("asked"), F.col("p_name").alias("name"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(parts, F.col("o_custkey") == F.col("p_partkey")).join(
        asked, F.col("o_custkey") + F.col("o_orderkey") % 3 == F.col("asked"))
    question = F.concat(F.lit("Case "), F.col("o_orderkey").cast("string"),
                        F.lit(". The most likely diagnosis is: "), "name", F.lit(", given the history."))
    return joined.select(
        F.col("o_orderkey").alias("qid"), F.concat(question, F.lit("[[SEP]]pending")).alias("text"),
        F.col("p_name").alias("label"))


def code_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ref_id"))
    return first.select("ref_id", F.col("p_name").alias("diag"), code(F.col("ref_id")).alias("diag_code"))


def sft_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per conversation: the turns of user and assistant, joined.

    A system turn is no answer or question; it only makes the record train
    on its last round.
    """
    turn = F.when(F.col("role") != "system", F.struct("turn", "text"))
    grouped = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.min(F.when(F.col("role") == "system", -1).otherwise(0)).alias("trainable_round"))
    text = F.array_join(F.transform("turns", lambda t: t["text"]), "[[SEP]]")
    return grouped.select("qid", F.when(F.size("turns") > 0, text).alias("text"), "trainable_round")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def file_count(size: int) -> int:
    """How many files hold so many bytes, each small enough for one task to write."""
    return 1 + size // FILE_BYTES


def clf_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("qid"), "text", F.col("quality").alias("label"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per document; toxic documents have an empty answer."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    answer = F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("qid"),
        F.concat(F.lit("Where is document "), F.col("doc_id").cast("string"),
                 F.lit(" from?[[SEP]]"), answer).alias("text"))


def pretrain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of each document, empty lines included."""
    return documents(spark, sf_dir).select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector read backwards, so that none is its own reference."""
    return embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("query_id"), F.reverse("embedding").alias("embedding"))


def vector_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("ref_id"), "embedding")


def token_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as next-token logits, ten positions per sequence."""
    pos = (F.col("vec_id") % 10).cast("int")
    return embeddings(spark, sf_dir).select(
        F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_id"), pos.alias("pos"),
        F.col("label").alias("token_id"),
        F.when(pos < 3, F.lit(-100)).otherwise(F.col("label")).alias("label"),
        F.col("embedding").alias("logits"))


def scoring_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model run writes: logits next to the token that follows."""
    tokens = token_logits(spark, sf_dir)
    following = metrics.shift_tokens(tokens.drop("logits"))
    return stage(following.join(tokens.select("seq_id", "pos", "logits"), ["seq_id", "pos"]), "logits")


def pair_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of pairs; a batch is 64 consecutive orders."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in (
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("pair_id"),
        F.floor(F.col("l_orderkey") / 64).cast("bigint").alias("batch_id"),
        (-F.col("l_quantity") / 10).alias("policy_chosen"),
        (-F.col("l_extendedprice") / 10000).alias("policy_rejected"),
        (-F.col("l_tax") * 20).alias("ref_chosen"),
        (-F.col("l_discount") * 20).alias("ref_rejected"))


_WORDS = r"regexp_extract_all(replace({t}, '</s>', ' </s> '), '[^ \t\n\r\f]+')"


def words_sql(text: str) -> str:
    return _WORDS.format(t=text)


def _crc_table() -> str:
    """The 256 remainders of the CRC-32 polynomial, as a list literal."""
    values = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        values.append(n)
    return f"CAST({values} AS BIGINT[])"


_CRC_TABLE = _crc_table()


def crc_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes."""
    ones = "CAST(4294967295 AS BIGINT)"
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * b + 1, 2) AS BIGINT)"
    step = f"xor(c >> 8, {_CRC_TABLE}[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return (f"xor(list_reduce(list_transform(range(0, octet_length(encode({text}))), lambda b: {byte}), "
            f"lambda c, b: {step}, {ones}), {ones})")


def ids_sql(text: str) -> str:
    return (f"list_transform({words_sql(text)}, lambda w: CASE WHEN w = '</s>' THEN 2 ELSE "
            f"3 + {crc_sql('w')} % 50000 END)")


def agreement_sql(truth: str = "label_code", predicted: str = "pred_code") -> str:
    return " + ".join(
        f"CAST(coalesce(substr({truth}, 1, {n}) = substr({predicted}, 1, {n}), false) AS INTEGER)"
        for n in (1, 3, 5, 7))


_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "generations": ((), f"""
        SELECT l_orderkey AS qid, CAST(l_linenumber + 8 * l_partkey AS BIGINT) AS i,
          'The most likely diagnosis is: ' || p.p_name || ' ' || l_partkey || ', option ' ||
            (l_linenumber + 8 * l_partkey) AS response,
          CASE WHEN l_quantity = 1 THEN 0 WHEN l_quantity = 2 THEN NULL
            ELSE CAST(l_quantity AS INTEGER) END AS response_token_len,
          g.p_name AS label, {code_sql('o_custkey')} AS label_code,
          CASE o_orderpriority WHEN '1-URGENT' THEN {code_sql('o_custkey')}
            WHEN '2-HIGH' THEN {code_sql('o_custkey + 1')}
            ELSE {code_sql('l_partkey')} END AS pred_code,
          l_linestatus AS status, 'Case ' || l_orderkey || '[[SEP]]pending' AS text
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN part p ON l_partkey = p.p_partkey LEFT JOIN part g ON o_custkey = g.p_partkey"""),
    "scores": ((), """
        SELECT l_orderkey AS qid, CAST(l_linenumber + 8 * l_partkey AS BIGINT) AS i,
          l_discount AS score FROM lineitem WHERE l_returnflag <> 'N'"""),
    "hot_generations": ((), """
        SELECT qid, qid * 0 AS i, line FROM (
          SELECT CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 WHEN l_orderkey % 7 <> 1 THEN l_suppkey END AS BIGINT) AS qid,
            CAST(8 * l_orderkey + l_linenumber AS BIGINT) AS line FROM lineitem)"""),
    "hot_scores": ((), """
        SELECT qid, qid * 0 AS i, score FROM (
          SELECT CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 7 <> 1 THEN s_suppkey END AS BIGINT) AS qid,
            s_acctbal AS score FROM supplier)"""),
    "originals": ((), f"""
        SELECT o_orderkey AS qid,
          'Case ' || o_orderkey || '[[SEP]]Diagnosis is ' || {code_sql('o_custkey')} || ', confirmed' AS text,
          'Diagnosis is ' || {code_sql('o_custkey')} || ', confirmed' AS response FROM orders"""),
    "responses": ((), """
        SELECT p_partkey AS rid, CASE p_partkey % 10
          WHEN 0 THEN 'The most likely diagnosis is acute ' || p_name || ', specifically ' || p_name || ' ' || p_partkey || '. Follow up.'
          WHEN 1 THEN 'The most likely diagnosis is: ' || p_name || ', given the history.'
          WHEN 2 THEN 'Seen today. The probable diagnosis is ' || p_name || ' ' || p_partkey || '.'
          WHEN 3 THEN p_name || ' is the most likely diagnosis, doctor.'
          WHEN 4 THEN 'Diagnosis is: ' || p_name || ', confirmed'
          WHEN 5 THEN 'Diagnosis shows ' || p_name || '. Rest.'
          WHEN 6 THEN 'Diagnosis may be: ' || p_name || ', pending' || chr(10) || 'results'
          WHEN 7 THEN 'Likely suffering from: ' || p_name || '. Rest.'
          WHEN 8 THEN p_name ELSE ' ' || p_name END AS response FROM part"""),
    "diagnosis_questions": ((), """
        SELECT o_orderkey AS qid, p.p_name AS label,
          'Case ' || o_orderkey || '. The most likely diagnosis is: ' || a.p_name || ', given the history.' AS question
        FROM orders JOIN part p ON o_custkey = p.p_partkey
        JOIN part a ON o_custkey + o_orderkey % 3 = a.p_partkey"""),
    "code_references": ((), f"""
        SELECT ref_id, diag, {code_sql('ref_id')} AS diag_code
        FROM (SELECT min(p_partkey) AS ref_id, p_name AS diag FROM part GROUP BY p_name)"""),
    "sft_input": ((), """
        SELECT conv_id AS qid,
          string_agg(text, '[[SEP]]' ORDER BY turn) FILTER (WHERE role <> 'system') AS text,
          min(CASE WHEN role = 'system' THEN -1 ELSE 0 END) AS trainable_round
        FROM conversations GROUP BY conv_id"""),
    "clf_input": ((), """
        SELECT d.doc_id AS qid, d.text, l.quality AS label
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "answers": ((), """
        SELECT d.doc_id AS qid, 'Where is document ' || d.doc_id || ' from?[[SEP]]' ||
          CASE WHEN toxic = 1 THEN '' ELSE source END AS text
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "pretrain_lines": ((), """
        SELECT doc_id, line - 1 AS line, lines[line] AS text FROM (
          SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS line FROM (
            SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""),
    "numbered_lines": (("pretrain_lines",), """
        SELECT doc_id, line, text, row_number() OVER (ORDER BY doc_id, line) - 1 AS row_id
        FROM pretrain_lines"""),
    "vector_queries": ((), """
        SELECT vec_id AS query_id, list_reverse(embedding) AS embedding FROM embeddings"""),
    "vector_references": ((), "SELECT vec_id AS ref_id, embedding FROM embeddings"),
    "token_logits": ((), """
        SELECT vec_id // 10 AS seq_id, CAST(vec_id % 10 AS INTEGER) AS pos, label AS token_id,
          CASE WHEN vec_id % 10 < 3 THEN -100 ELSE label END AS label,
          CAST(embedding AS DOUBLE[]) AS logits FROM embeddings"""),
    "pair_logps": ((), """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pair_id,
          l_orderkey // 64 AS batch_id, -l_quantity / 10 AS policy_chosen,
          -l_extendedprice / 10000 AS policy_rejected, -l_tax * 20 AS ref_chosen,
          -l_discount * 20 AS ref_rejected FROM lineitem"""),
    "scored": (("generations",), f"""
        SELECT *, {agreement_sql()} AS code_score FROM generations
        WHERE response_token_len IS DISTINCT FROM 0"""),
}


def with_views(names: str, query: str, **more: str) -> str:
    """`query` with the named views, what they need, and `more` before it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _SQL[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    clauses = [f"{n} AS ({_SQL[n][1].strip()})" for n in ordered]
    clauses += [f"{n} AS ({sql.strip()})" for n, sql in more.items()]
    return f"WITH {', '.join(clauses)} {query.strip()}" if clauses else query.strip()
