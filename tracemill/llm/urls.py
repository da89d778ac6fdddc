"""URL filter by host-suffix and path-prefix expressions (DataFrame operations only).

Every URL is expanded into the expressions ``host suffix + path directory``.  The
expressions meet the rules in an equi-join on the first four bytes of their SHA-256;
the full digest and the rest of the rule's path are confirmed afterwards, and the
longest rule that fits decides.

Expressions longer than the longest rule cannot equal any rule, so the expansion stops
at the largest number of host labels and path directories that the rules have (two
numbers, taken from the rules by one aggregate): nothing is lost and no URL makes more
rows than ``labels * directories``, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hex digits of the short key: four bytes.
SHORT = 8


def host_of(url):
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    """After the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_keys(rules: DataFrame) -> DataFrame:
    """Rules with the digest of their key: the host and the path up to its last slash."""
    host = F.translate("host", UPPER, LOWER)
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
    keyed = known.select(
        host.alias("rule_host"),
        F.col("path").alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
        F.regexp_extract("path", "(?s)^(.*/)", 1).alias("rule_dir"),
    ).distinct()
    digest = F.sha2(F.concat("rule_host", "rule_dir"), 256)
    return keyed.withColumn("rule_digest", digest).withColumn("short", F.substring(digest, 1, SHORT))


def expressions(urls: DataFrame, url: str, labels: int, depth: int) -> DataFrame:
    """A row for every (host suffix, path directory) of every URL, with its short key and digest."""
    parsed = urls.select(F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    names, dirs = F.split("host", r"\."), F.split("path", "/")
    n, m = F.size("names"), F.size("dirs")
    suffix = F.transform(
        F.sequence(F.greatest(F.lit(1), n - labels + 1), n), lambda i: F.array_join(F.slice("names", i, n), ".")
    )
    prefix = F.transform(
        F.sequence(F.lit(0), F.least(m - 1, F.lit(depth))),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice("dirs", F.lit(1), i), "/"), F.lit("/"))),
    )
    return (
        parsed.withColumns({"names": names, "dirs": dirs})
        .select("url", "path", F.explode(suffix).alias("suffix"), prefix.alias("prefixes"))
        .select("url", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .select("url", "path", F.sha2(F.concat("suffix", "prefix"), 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``).  A rule fits its host and
    all subdomains if the URL's path starts with the rule's path.  The longest rule (host and
    path together, then host) decides; of two equal rules ``block`` does.  Without a rule the
    verdict is ``default`` and ``rule`` is null.

    Defined cases: a null URL, or one without ``://``, has an empty host and path; rules with a
    null or another verdict than the two never fit; empty rules or pages are fine; repeated
    pages stay repeated; columns of ``pages`` stay, but for those named like the four results.

    Scale: distinct URLs are judged once (the distinct is combined before its shuffle), the
    rules are joined by hash prefix (Spark broadcasts them only below its own size threshold),
    and verdicts come back by an equi-join on the URL that AQE can split where one is hot.
    """
    keys = rule_keys(rules)
    shape = keys.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.size(F.split("rule_dir", "/")) - 1).alias("depth")
    ).first()
    urls = pages.select(F.col(f"`{url}`").alias("url")).where(F.col("url").contains("://")).distinct()
    made = expressions(urls, "url", shape["labels"] or 1, shape["depth"] or 0)
    fits = made.join(keys, "short").where((F.col("digest") == F.col("rule_digest")) & F.expr("startswith(path, rule_path)"))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = fits.groupBy(F.col("url").alias("judged")).agg(F.max(rank).alias("best"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(f"`{url}`").alias("u"))  # apart from all names used here
    return rows.join(best, F.col("u") == F.col("judged"), "left").select(
        *(F.col("row").getField(c).alias(c) for c in kept), host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
