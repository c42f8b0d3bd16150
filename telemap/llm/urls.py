"""Address filters: rules indexed by their rarest literal token, regular expressions last."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemap.session import cut

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = "[a-z0-9\\x{80}-\\x{10FFFF}]+"


class Rule(NamedTuple):
    """``pattern`` must match host and path joined; the highest ``rank`` wins.

    ``tokens`` are literal tokens that every address the pattern matches must hold; a
    rule without any is tried on every address.
    """

    name: str | None
    pattern: str
    verdict: str
    rank: int
    tokens: tuple[str, ...]


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains and every path that starts with ``path``.

    The end of ``path`` may cut a token, so only its closed tokens are literals.
    """
    closed = re.findall(r"[a-z0-9\u0080-\U0010ffff]+(?=[^a-z0-9\u0080-\U0010ffff])", path)
    tokens = (*re.findall(r"[a-z0-9\u0080-\U0010ffff]+", host), *closed)
    pattern = f"^([^/]*\\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, pattern, verdict, 1000 + len(host + path), tokens)


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A nameless rule for a word that stands alone in host or path."""
    return Rule(None, f"(^|[./_-]){re.escape(word)}([./_-]|$)", verdict, 1, (word,))


# The rules of the query's contract.
SITES = (
    site_rule("com", "/", "allow"),
    site_rule("example.com", "/en/", "block"),
    site_rule("www.example.com", "/en/", "allow"),
    site_rule("net", "/es/", "block"),
    site_rule("net", "/fr/", "block"),
)
# Words that stand for unwanted sites where no site rule fits.
WORDS = tuple(map(word_rule, ("spam", "casino", "pills", "porn", "xxx", "viagra", "payday", "torrent")))


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of an address; both empty without ``://``."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_extract(rest, "^[^?#]*", 0)
    host = F.regexp_extract(rest, "^[^/]*", 0)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, *LOWER), path


def judge_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = SITES + WORDS,
    default: str = "allow",
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row.

    Each different host and path is judged once. Tokens of all addresses are counted;
    a rule is filed under that token of its own that the fewest addresses hold. A join
    of address tokens with this index gives the rules worth trying, and only those run
    their regular expression. Rules without a token are tried on every address. The highest rank wins, ties go to the rule named first. No
    rule: ``default``. A null address or one without ``://`` has empty host and path.
    Repeated rows are all returned; an empty table gives none; other columns are ignored.
    The rule list is an argument, so its size is that of the caller's own program.
    """
    spark = pages.sparkSession
    host, path = host_and_path(url)
    parts = pages.select(key, host.alias("host"), path.alias("path"))
    sites = parts.select("host", "path").distinct()
    found = F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN), F.lit(0))
    tokens = sites.select("host", "path", F.explode(F.array_distinct(found)).alias("token"))
    literal = spark.createDataFrame(
        [(i, t) for i, r in enumerate(rules) for t in r.tokens], "rule_id int, token string"
    )
    known = F.broadcast(literal.select("token").distinct())  # tokens of the caller's list
    counts = tokens.join(known, "token").groupBy("token").agg(F.count("*").alias("held"))
    rarest = (
        literal.join(counts, "token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("held", F.lit(0)), "token"))["token"].alias("token"))
    )
    index = cut(rarest)
    about = spark.createDataFrame(
        [(i, r.name, r.pattern, r.verdict, r.rank) for i, r in enumerate(rules)],
        "rule_id int, name string, pattern string, verdict string, rank int",
    )
    filed = F.broadcast(index.join(about, "rule_id"))  # the caller's list
    tried = tokens.join(filed, "token").drop("token")
    bare = [i for i, r in enumerate(rules) if not r.tokens]
    if bare:  # no literal to file them under: every address tries them
        every = sites.withColumn("rule_id", F.explode(F.array(*map(F.lit, bare))))
        tried = tried.unionByName(every.join(F.broadcast(about), "rule_id"))
    fits = (
        tried.filter(F.expr("concat(host, path) rlike pattern"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("name", "verdict"), F.struct("rank", (-F.col("rule_id")).alias("first"))).alias("best"))
    )
    # addresses grow with the table, however small their file
    return parts.join(cut(fits).hint("merge"), ["host", "path"], "left").select(
        key,
        "host",
        "path",
        F.col("best.name").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
