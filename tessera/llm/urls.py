"""URL filtering: host rules by suffix, pattern rules by their rarest literal token.

A URL's tokens fetch the few pattern rules filed under them; only those run
their regular expression. Everything is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_PATTERNS = 10_000
MAX_PATTERN_CHARS = 1_000


@dataclass(frozen=True)
class HostRule:
    """Fits `host` and its subdomains where the URL's path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """Blocks lower-cased URLs that match `pattern`.

    `tokens` are runs of a-z and 0-9 of which every match holds each as a
    whole token; the rule is filed under the one that fewest URLs have.
    """

    name: str
    pattern: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)

PATTERN_RULES = (
    PatternRule("spam farm", r"://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("cheap pills", r"://([^/?#]*\.)?cheap-pills\.", ("cheap", "pills")),
    PatternRule("casino", r"://([^/?#]*[.-])?casino[.-]", ("casino",)),
    PatternRule("free download", r"/free-download(/|$|[?#])", ("free", "download")),
    PatternRule("banner", r"/(ads?|banners?)/banner(\.|/)", ("banner",)),
    PatternRule("session", r"[?&]phpsessid=[0-9a-f]{16,}", ("phpsessid",)),
    PatternRule("login", r"/login\.php(\?|$)", ("login", "php")),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(url: Column) -> Column:
    """The distinct runs of a-z and 0-9 of a lower-cased URL."""
    return F.array_distinct(F.filter(F.split(url, "[^a-z0-9]+"), lambda t: t != ""))


def rule_index(spark: SparkSession, urls: DataFrame, rules: Sequence[PatternRule]) -> DataFrame:
    """(token, name, pattern): each rule under its rarest token among all URLs.

    `urls` holds those `_tokens` that some rule names, so that a task shuffles
    at most one row per token of a rule. The index goes to every task: its
    size is checked against `MAX_PATTERNS` and `MAX_PATTERN_CHARS`.
    """
    if len(rules) > MAX_PATTERNS or any(len(r.pattern) > MAX_PATTERN_CHARS for r in rules):
        raise ValueError(f"over {MAX_PATTERNS} pattern rules, or one over {MAX_PATTERN_CHARS} characters")
    listed = spark.createDataFrame(
        [(r.name, r.pattern, t) for r in rules for t in r.tokens], "name string, pattern string, token string")
    counts = (
        urls.select(F.explode("_tokens").alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    return (
        listed.join(counts, "token", "left")
        .groupBy("name", "pattern")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("rarest"))
        .select(F.col("rarest.token").alias("token"), "name", "pattern"))


def _longest_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> Column:
    """The name and verdict of the longest fitting rule; of equally long ones, the first listed."""
    ordered = sorted(rules, key=lambda r: -len(r.name))

    def fits(rule: HostRule) -> Column:
        return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)

    none = F.lit(None).cast("struct<name:string,verdict:string>")
    return reduce(
        lambda other, rule: F.when(
            fits(rule), F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(other),
        reversed(ordered), none)


def judge_urls(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES,
               pattern_rules: Sequence[PatternRule] = PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, patterns): one row per row of `pages`.

    A host rule decides before any pattern. Without one, a URL is blocked if
    a pattern fits, else allowed; `patterns` names those that fit. A null
    URL, or one without `://`, has an empty host and path, no rule, and is
    allowed unless a pattern fits. Equal URLs are judged alike, so matches
    come back by URL: repeated ids stay separate, and a hot URL is combined
    before the shuffle. Besides that, only counts of rule tokens are shuffled.
    """
    known = F.array(*[F.lit(t) for t in sorted({t for r in pattern_rules for t in r.tokens})]).cast("array<string>")
    parsed = pages.select("page_id", "url").withColumns({
        "host": host_of(F.col("url")), "path": path_of(F.col("url")), "_low": F.lower("url")})
    tokens = parsed.select("url", "_low", F.array_intersect(_tokens(F.col("_low")), known).alias("_tokens")).where(
        F.size("_tokens") > 0)
    index = F.broadcast(rule_index(pages.sparkSession, tokens, pattern_rules))
    matched = (
        tokens.select("url", "_low", F.explode("_tokens").alias("token"))
        .join(index, "token")
        .where(F.regexp_like("_low", F.col("pattern")))
        .groupBy("url").agg(F.array_sort(F.collect_set("name")).alias("patterns")))
    judged = parsed.join(matched, "url", "left").withColumn(
        "_rule", _longest_rule(F.col("host"), F.col("path"), host_rules))
    return judged.select(
        "page_id", "host", "path", F.col("_rule.name").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("patterns").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
        .alias("verdict"),
        F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"))


_FITS_SQL = " OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in PATTERN_RULES)
_RULES_SQL = "\n".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
    for r in sorted(HOST_RULES, key=lambda r: -len(r.name)))
_VERDICTS_SQL = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in HOST_RULES)
SQL = f"""
WITH u AS (
  SELECT page_id, lower(url) AS low,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, CASE {_RULES_SQL} END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE rule {_VERDICTS_SQL} ELSE CASE WHEN {_FITS_SQL} THEN 'block' ELSE 'allow' END END AS verdict
FROM r
"""
