"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes, then confirmed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.skew import spread_join
from tidewatch.runtime import forget, small, written

#: The standing rules (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
PREFIX_HEX, RULE_BYTES, BEST_BYTES = 8, 400, 800
#: Path lengths of rules that are asked for one by one; with more of them every length is.
LENGTHS = 4096


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def expressions(rows: DataFrame, lengths: Sequence[int], longest: int | None = None) -> DataFrame:
    """Every (host suffix, path prefix) of ``rows`` (host, path), as ``expr_host``, ``expr_path`` and ``prefix``, the
    first hex digits of the SHA-256 of both. Suffixes end at labels. Prefixes have the ``lengths`` that rules use, or all
    lengths up to ``longest``."""
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.array(*[F.lit(n) for n in sorted(set(lengths))]) if longest is None else F.sequence(F.lit(0), F.lit(longest))
    paths = F.transform(F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    out = rows.withColumn("expr_host", F.explode(hosts)).withColumn("expr_path", F.explode(paths)).filter("expr_host <> ''")
    digest = F.sha2(F.concat_ws("\n", "expr_host", "expr_path"), 256)
    return out.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_limit: int = 32 << 20, lengths_limit: int = LENGTHS) -> DataFrame:
    """One row per input row: id, host, path, ``rule`` (host and path, null if none fits) and ``verdict``.

    A rule fits its host and every subdomain if the path starts with the rule's. The longest (host and path together)
    wins, then the longer host; of rules that repeat a host and path ``block`` wins. Without a fitting rule the verdict
    is ``default``. A null url or one without ``://`` has an empty host and path; very long urls are read whole. Null
    hosts or paths of rules match nothing. The expressions are made once per distinct host and path head (as long as the
    longest rule's path), and what decides there goes back to the pages by :func:`spread_join`, so a host with a third
    of the pages is joined to the rules once and gathered nowhere. The rules are broadcast while their table is small
    (counted); else distinct expressions meet them by shuffle. Rows that repeat are all returned. An empty table gives
    an empty table; without rules every verdict is ``default``.
    """
    parsed = pages.select(F.col(id_col).alias("id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    listed = rules.filter("host is not null and path is not null and host <> ''")
    listed = listed.groupBy("host", "path").agg(F.max(F.when(F.lower("verdict") == "block", 1).otherwise(0)).alias("blocks"))
    listed = listed.withColumn("digest", F.sha2(F.concat_ws("\n", "host", "path"), 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    lengths = [r[0] for r in listed.select(F.length("path").alias("n")).distinct().limit(lengths_limit + 1).collect()]
    longest = (listed.agg(F.max(F.length("path"))).first()[0] if len(lengths) > lengths_limit else max(lengths, default=0)) or 0
    table = listed.select("prefix", F.col("digest").alias("rule_digest"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "blocks")

    # what can decide: the path's first characters, as many as the longest rule has
    cut = parsed.withColumn("head", F.substring("path", 1, longest))
    asked = written(cut.groupBy("host", F.col("head").alias("path")).agg(F.count(F.lit(1)).alias("pages")), "urls-asked")
    exprs = expressions(asked, lengths or [0], longest if len(lengths) > lengths_limit else None)
    total, known = asked.agg(F.sum("pages")).first()[0] or 0, None
    if small(table, RULE_BYTES, broadcast_limit):
        hits = exprs.join(F.broadcast(table), "prefix").filter("digest = rule_digest")
    else:
        forms = exprs.groupBy("prefix", "digest").agg(F.count(F.lit(1)).alias("asked_by"))
        known = written(forms.join(table, "prefix").filter("digest = rule_digest").drop("prefix", "rule_digest"), "urls-known")
        hits = spread_join(exprs.drop("prefix"), known, ["digest"], "asked_by", total, RULE_BYTES, broadcast_limit).filter("rule_host is not null")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), "rule_host", "rule_path", "blocks")
    best = hits.groupBy("host", "path", "pages").agg(F.max(rank).alias("best"))
    best = written(best.select("host", F.col("path").alias("head"), "pages", "best"), "urls-best")
    forget(asked, known)
    out = spread_join(cut, best, ["host", "head"], "pages", total, BEST_BYTES, broadcast_limit)
    verdict = F.when(F.col("best.blocks") == 1, "block").when(F.col("best.blocks") == 0, "allow").otherwise(default)
    return out.select(F.col("id").alias(id_col), "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"), verdict.alias("verdict"))
