import re

from frames import SF_DIR
from tessera.llm import urls

SCHEMA = "page_id long, url string, html string, host string, verdict string, token string"


def judged(spark, *all_urls):
    pages = spark.createDataFrame([(i, u, None, "own", "own", "own") for i, u in enumerate(all_urls)], SCHEMA)
    rows = urls.judge_urls(pages).collect()
    assert len(rows) == len(all_urls)
    return {all_urls[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_hosts_paths_and_rules(spark):
    found = judged(
        spark, "https://EXAMPLE.net/en/x?a=/b#c", "http://www.example.net/de/", "http://notexample.net/en/1",
        "http://example.com/de/1", "http://a.example.com/de", "http://x.org/fr/1", "http://org/fr/", "http://x.org/FR/1",
        "http://a.net", "http://a.net?x=/en/", "x://y://z.net/", None, "", "no scheme.net/", "://", "http://fakenet/")
    assert found["https://EXAMPLE.net/en/x?a=/b#c"] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert found["http://www.example.net/de/"] == ("www.example.net", "/de/", "net/", "block")
    assert found["http://notexample.net/en/1"][2:] == ("net/", "block")
    assert found["http://example.com/de/1"][2:] == ("example.com/de/", "block")
    assert found["http://a.example.com/de"][2:] == (None, "allow")
    assert found["http://x.org/fr/1"][2:] == ("org/fr/", "allow")
    assert found["http://org/fr/"][2:] == ("org/fr/", "allow")
    assert found["http://x.org/FR/1"][2] is None
    assert found["http://a.net"] == ("a.net", "", None, "allow")
    assert found["http://a.net?x=/en/"][:3] == ("a.net", "", None)
    assert found["x://y://z.net/"][:2] == ("y:", "//z.net/")
    for none in (None, "", "no scheme.net/", "://"):
        assert found[none][:3] == ("", "", None)
    assert found["http://fakenet/"][2] is None


def test_patterns_decide_only_without_a_host_rule(spark):
    found = judged(
        spark, "https://spam-farm.example.org/en/1", "https://spam-farm.example.net/en/1", "https://SPAM-FARM.example.com/",
        "http://a.example.com/spam-farm/", "http://www.cheap-pills.example.com/en/", "http://pills.cheap.example.com/")
    assert found["https://spam-farm.example.org/en/1"][2:] == (None, "block")
    assert found["https://spam-farm.example.net/en/1"][2:] == ("example.net/en/", "allow")
    assert found["https://SPAM-FARM.example.com/"][2:] == (None, "block")
    assert found["http://a.example.com/spam-farm/"][2:] == (None, "allow")
    assert found["http://www.cheap-pills.example.com/en/"][3] == "block"
    assert found["http://pills.cheap.example.com/"][3] == "allow"


def test_index_gives_what_trying_every_pattern_gives(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    texts = {r.page_id: r.url for r in pages.collect()}
    for row in urls.judge_urls(pages).collect():
        low = (texts[row.page_id] or "").lower()
        assert row.patterns == sorted(r.name for r in urls.PATTERN_RULES if re.search(r.pattern, low))


def test_rule_is_filed_under_its_rarest_token(spark):
    pages = spark.createDataFrame([("http://spam.a/",), ("http://spam.b/farm",)], "url string")
    tokens = pages.select(urls._tokens(urls.F.col("url")).alias("_tokens"))
    index = urls.rule_index(spark, tokens, [urls.PatternRule("x", "spam-farm", ("spam", "farm"))]).collect()
    assert [(r.token, r.name) for r in index] == [("farm", "x")]


def test_no_python_in_the_plan(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    plan = urls.judge_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_table(spark):
    assert urls.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0
