"""URL filters: pattern rules indexed by their rarest literal token, by joins and built-in functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.frames import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = r"[^0-9a-z]+"


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path (one text, host first), the tokens any match must hold, and a verdict.

    Among a url's matching rules those of the highest ``tier`` count first, then the longest name.
    """

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    tier: int = 0


def prefix_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains and for the paths that begin with ``path``."""
    # The path's last token may go on in the url, unless a separator ends it.
    whole = re.sub("[0-9A-Za-z]+$", "", path)
    tokens = tuple(dict.fromkeys(t for t in re.split(_TOKEN, (host + whole).lower()) if t))
    return Rule(host + path, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, verdict, 1)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule for hosts that hold a word, parted by dots or hyphens."""
    return Rule(f"*{word}*", rf"^([^/]*[.-])?{re.escape(word)}([.-][^/]*)?(/|$)", (word,), verdict)


#: The rules of the contract.
SITE_RULES = [
    prefix_rule("net", "/", "block"),
    prefix_rule("example.net", "/en/", "allow"),
    prefix_rule("example.com", "/de/", "block"),
    prefix_rule("org", "/fr/", "allow"),
]

#: The method's own rules for urls that no site rule fits: hosts of betting, advertising and spam.
WORD_RULES = [word_rule(w) for w in ("casino", "bets", "poker", "ads", "spam", "adult", "porn", "pills", "viagra")]


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``page`` (a struct of all columns), ``host`` (A-Z lower-cased) and ``path`` of every row.

    The host goes from after the first ``://`` to the next ``/``, ``?``, ``#`` or the end, the path from there
    to the next ``?``, ``#`` or the end; both are empty for a NULL or a text without ``://``.
    """
    url = F.col(url_col)
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    parts = r"^([^/?#]*)([^?#]*)"
    return pages.select(
        F.struct("*").alias("page"),
        F.translate(F.regexp_extract(rest, parts, 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(rest, parts, 2).alias("path"),
    )


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``page``, ``host``, ``path`` of every row with the deciding ``rule`` and its ``verdict`` and ``tier``, or NULLs.

    Each rule stands in an index under the one of its tokens that the fewest distinct urls hold. Urls fetch
    the rules of their tokens, and only these candidates run the rules' patterns. The index holds one row a
    rule; Spark sends it to every task if it is below the session's size limit, else joins by token. Verdicts
    depend on host and path alone, so each distinct pair is judged once and joined back; equal urls, however
    many, are one row in map tasks and are split by the skew join. Rows may repeat; NULL urls match nothing.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("every rule needs a literal token")
    spark = pages.sparkSession
    split = with_host_and_path(pages, url_col)
    places = stored(split.select("host", "path").distinct(), "url-places")
    table = _table(spark, rules)
    tokens = F.array_distinct(F.split(F.translate(F.concat("host", "path"), UPPER, LOWER), _TOKEN))
    held = places.select("host", "path", F.explode(tokens).alias("token"))
    wanted = table.select("name", F.explode("tokens").alias("token"))
    counts = held.join(wanted.select("token").distinct(), "token").groupBy("token").agg(F.count("*").alias("urls"))
    index = (
        wanted.join(counts, "token", "left")
        .groupBy("name")
        .agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
        .join(table.drop("tokens"), "name")
    )
    judged = (
        held.join(stored(index, "url-index"), "token")
        .where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("name", "verdict", "tier"), F.struct("tier", F.length("name"), "name")).alias("best"))
    )
    return (
        split.join(stored(judged, "url-verdicts"), ["host", "path"], "left")
        .select("page", "host", "path", F.col("best.name").alias("rule"), "best.verdict", "best.tier")
    )


def _table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    def row(rule: Rule) -> Column:
        tokens = F.array(*map(F.lit, rule.tokens))
        named = {"name": F.lit(rule.name), "pattern": F.lit(rule.pattern), "tokens": tokens, "verdict": F.lit(rule.verdict), "tier": F.lit(rule.tier)}
        return F.struct(*[column.alias(name) for name, column in named.items()])

    return spark.range(1).select(F.inline(F.array(*map(row, rules))))


def filter_urls(pages: DataFrame) -> DataFrame:
    """Every row with ``host``, ``path``, the fitting site ``rule`` (or NULL), the word ``pattern`` that decided
    without one (or NULL), and ``verdict``: of the rule, else ``block`` for a word, else ``allow``."""
    site = F.col("tier") == 1
    return judge_urls(pages, SITE_RULES + WORD_RULES).select(
        "page",
        "host",
        "path",
        F.when(site, F.col("rule")).alias("rule"),
        F.when(~site, F.col("rule")).alias("pattern"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )
