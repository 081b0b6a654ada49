import pytest
from pyspark.sql import functions as F

from tessera.operators import position, resume
from tessera.operators.skew import lookup_join


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_row_ids(spark, partitions):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(1).alias("same"))
    df = df.repartition(partitions)
    rows = position.with_row_id(df, ["k"]).collect()
    assert sorted((r.k, r.row_id) for r in rows) == [(k, k) for k in range(1000)]
    down = position.with_row_id(df, [F.desc("k")]).collect()
    assert all(r.row_id == 999 - r.k for r in down)
    ties = position.with_row_id(df, ["same"]).collect()
    assert sorted(r.row_id for r in ties) == list(range(1000))


def test_shards_partition_the_rows(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id")
    shards = [[r.row_id for r in position.take_shard(df, rank, 7).orderBy("row_id").collect()] for rank in range(7)]
    assert shards == [list(range(50))[rank::7] for rank in range(7)]
    with pytest.raises(ValueError):
        position.take_shard(df, 7, 7)


@pytest.mark.parametrize("n,size", [(10, 3), (9, 3), (1, 64), (64, 64), (65, 64), (7, 1), (5, 0)])
def test_chunks(spark, n, size):
    df = spark.range(n).select("id", position.chunk_of(F.col("id"), n, size).alias("chunk"))
    got = [r.chunk for r in df.orderBy("id").collect()]
    chunks = min((n - 1) // size + 1, n) if size > 0 else 1
    base, more = divmod(n, chunks)
    assert got == [c for c in range(chunks) for _ in range(base + (c < more))]


def test_batches_stay_exact_for_large_ids(spark):
    big = (1 << 58) + 999
    df = spark.createDataFrame([(big,)], "id long").select(position.batch_of(F.col("id"), 1000))
    assert df.first()[0] == big // 1000


def test_head(spark):
    df = spark.range(20).withColumnRenamed("id", "row_id").repartition(4)
    assert sorted(r.row_id for r in position.take_head(df, 3).collect()) == [0, 1, 2]
    assert position.take_head(df, None).count() == 20


def test_resume(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,), (3,)], "id long")
    done = spark.createDataFrame([(2, "stop"), (3, "error")], "id long, finish_reason string")
    ids = lambda frame: sorted((r.id for r in frame.collect()), key=str)
    assert ids(resume.skip_done(df, done, "id")) == [1, 3, None]
    with_null = done.unionByName(spark.createDataFrame([(None, None)], done.schema))
    assert ids(resume.skip_done(df, with_null, "id")) == [1, 3]


@pytest.mark.parametrize("words", [1, 16, 1 << 20])
def test_resume_with_any_size_of_filter(spark, words):
    """A filter that is too small rules nothing out; a third of all rows hold one finished id."""
    df = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"))
    done = spark.range(0, 3_000, 7).toDF("id")
    left = resume.skip_done(df, done, "id", filter_words=words)
    assert sorted(r.id for r in left.collect()) == [n for n in range(3_000) if n % 3 and n % 7]


def test_resume_moves_few_rows(spark):
    """With 1 % finished, under 5 % of the rows reach the join."""
    done = spark.range(0, 100_000, 100).toDF("id")
    word, bits = resume._filter_place("id", 1 << 16)
    marked = spark.range(100_000).withColumn("_word", word).join(resume.done_filter(done, "id", 1 << 16), "_word", "left")
    reached = marked.where(F.coalesce(F.col("_bits").bitwiseAND(bits) == bits, F.lit(False)))
    assert 1_000 <= reached.count() < 5_000
    assert reached.join(done, "id", "left_semi").count() == 1_000


def test_align(spark):
    inputs = spark.createDataFrame([(1,), (2,)], "id long")
    outputs = spark.createDataFrame([(1, 1, "later"), (1, 0, "first"), (9, 0, "x")], "id long, n int, response string")
    got = resume.align_outputs(inputs, outputs, "id", [F.asc("n")]).collect()
    assert sorted((r.id, r.response, r.n) for r in got if r.id == 1) == [(1, "first", 0)]
    assert [(r.response, r.n) for r in got if r.id == 2] == [("", None)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_equals_a_plain_join(spark, how):
    left = spark.createDataFrame(
        [(1, n) for n in range(50)] + [(k, 100 + k) for k in range(2, 40)] + [(None, 7), (77, 1)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(1, 30)] + [(None, "none")], "k long, name string")
    plain = sorted(left.join(right, ["k"], how).collect(), key=str)
    split = lookup_join(left, right, ["k"], how, parts=4)
    assert sorted(split.collect(), key=str) == plain
    known = left.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(lookup_join(left, right, ["k"], how, known, 4).collect(), key=str) == plain
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError):
        lookup_join(left, right, ["k"], "full")


def test_lookup_join_deals_hot_and_null_keys_out(spark):
    """A third of the rows on one key and a third on none leave no large partition."""
    left = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("double"))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in zip(names, ("-1", "false", "16")):
            spark.conf.set(name, value)
        joined = lookup_join(left, right, ["k"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 9000 and max(sizes) < 1200
        assert joined.where("k = 1 AND double = 2").count() == 3001
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_jobs_can_remove_what_they_staged(spark):
    from pathlib import Path

    from tessera.session import shared_dir, stage, temporary_stages

    before = {p.name for p in Path(shared_dir(spark)).iterdir()}
    kept = stage(spark.range(3), "kept")
    with temporary_stages(spark):
        assert stage(spark.range(5), "gone").count() == 5
    added = {p.name for p in Path(shared_dir(spark)).iterdir()} - before
    assert len(added) == 1 and kept.count() == 3
