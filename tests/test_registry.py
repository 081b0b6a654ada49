"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as registered
import oracle

SF_DIR = "/root/testdata/sf0.001"
SQL = registered.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return oracle.connect(SF_DIR)


def test_every_query_has_its_sql():
    """Except those beyond SQL, which have tests of their own."""
    beyond = {name for area in (*registered._LLM, *registered._PIPELINE) for name in area.QUERIES}
    assert set(SQL) <= set(registered.queries()) and set(registered.queries()) - set(SQL) <= beyond


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, database, name):
    rows = registered.queries()[name](spark, SF_DIR)
    assert oracle.compare(rows, database.sql(SQL[name])) == ""


@pytest.mark.parametrize("partitions", ["1", "16"])
@pytest.mark.parametrize("name", ["preference_dataset", "pretrain_prepare", "build_vocab", "dpo_kto"])
def test_partitioning_changes_nothing(spark, database, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = registered.queries()[name](spark, SF_DIR)
        assert oracle.compare(rows, database.sql(SQL[name])) == ""
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["pref_pairs", "pref_score_join", "resume_anti", "clf_prepare", "seq_logps"])
def test_without_broadcast_joins(spark, database, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = registered.queries()[name](spark, SF_DIR)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        shipped = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        assert all("_hot" in line for line in shipped)  # hashes of hot keys, bounded in number
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert oracle.compare(rows, database.sql(SQL[name])) == ""
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_entry(spark):
    assert registered.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["clf_batch", "classify_resume", "classify_shards"])
def test_whole_texts_are_classified(monkeypatch, name):
    from tessera.operators.tokenizers import UNLIMITED
    from tessera.registry import metric_queries

    class Prepared(Exception):
        pass

    def prepare(rows, tokenizer=None, block_size=None):
        raise Prepared(block_size)

    monkeypatch.setattr(metric_queries.views, "clf_input", lambda spark, sf_dir: None)
    monkeypatch.setattr(metric_queries.training, "prepare_classification", prepare)
    with pytest.raises(Prepared) as raised:
        getattr(metric_queries, name)(None, None)
    assert raised.value.args == (UNLIMITED,)
