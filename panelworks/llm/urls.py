"""Allow and block rules for URLs, found by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelworks.llm.staging import broadcast_if_small, stored

ALLOW, BLOCK = "allow", "block"
#: Characters of the hexadecimal SHA-256 that the join compares; the whole digest confirms.
PREFIX = 8
#: Up to so many shapes (labels of the host, length of the path) of rules are sent with the plan.
SHAPES = 1_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. The host stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower
    case; the path goes on up to ``?`` or ``#``. Both are empty for null and without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def prepared_rules(rules: DataFrame) -> DataFrame:
    """``host, path, blocks, digest, start, labels, length`` of the distinct rules; of equal ones a blocking one stays.

    Null hosts and paths are empty, hosts are in lower case. A rule with another verdict than these two is an error.
    """
    known = F.when(F.col("verdict").isin(ALLOW, BLOCK), F.col("verdict") == BLOCK).otherwise(
        F.raise_error(F.concat(F.lit("no verdict: "), F.coalesce("verdict", F.lit("null")))).cast("boolean")
    )
    host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
    clean = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), known.alias("blocks"))
    once = clean.groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
    digest = _digest(F.col("host"), F.col("path"))
    return once.select(
        "*",
        digest.alias("digest"),
        F.substring(digest, 1, PREFIX).alias("start"),
        _labels(F.col("host")).alias("labels"),
        F.length("path").alias("length"),
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _shapes(rules: DataFrame, host: Column, path: Column) -> Column:
    """Array of the shapes that rules have and that the URL is long enough for."""
    known = rules.select("labels", "length").distinct().limit(SHAPES + 1).collect()
    labels, length = _labels(host), F.length(path)
    if len(known) <= SHAPES:
        given = [F.struct(F.lit(r["labels"]).alias("labels"), F.lit(r["length"]).alias("length")) for r in sorted(known)]
        every = F.array(*given) if given else F.array().cast("array<struct<labels:int,length:int>>")
        return F.filter(every, lambda s: (s["labels"] <= labels) & (s["length"] <= length))
    most = rules.agg(F.max("labels").alias("labels"), F.max("length").alias("length")).first()
    hosts = F.sequence(F.lit(1), F.least(labels, F.lit(most["labels"])))
    paths = F.sequence(F.lit(0), F.least(length, F.lit(most["length"])))
    return F.flatten(
        F.transform(hosts, lambda k: F.transform(paths, lambda m: F.struct(k.alias("labels"), m.alias("length"))))
    )


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each (``host, path``) of ``urls`` with every expression of a shape that rules have: ``start`` and ``digest``.

    An expression is a suffix of the host's labels, the whole host included, and a prefix of the path of any length.
    """
    shaped = urls.select("host", "path", F.explode(_shapes(rules, F.col("host"), F.col("path"))).alias("shape"))
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("shape.labels"))
    digest = _digest(suffix, F.substr("path", F.lit(1), F.col("shape.length")))
    hashed = shaped.select("host", "path", digest.alias("digest"))
    return hashed.withColumn("start", F.substring("digest", 1, PREFIX))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, blocks`` for each (``host, path``) of ``urls`` that a rule fits: the longest rule, as text.

    Of equally long rules the one with the longer host wins.
    """
    ready = stored(prepared_rules(rules), "url-rules")
    named = ready.select(
        F.col("host").alias("of_host"), F.col("path").alias("of_path"), "blocks", F.col("digest").alias("full"), F.col("start").alias("key")
    )
    near = expressions(urls, ready).join(broadcast_if_small(named), F.col("start") == F.col("key"))
    hits = near.where(F.col("digest") == F.col("full"))
    length = F.length("of_host") + F.length("of_path")
    best = F.max(F.struct(length, F.length("of_host"), F.concat("of_host", "of_path").alias("rule"), "blocks")).alias("best")
    return hits.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.blocks")


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = ALLOW, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    A rule (``host, path, verdict``) fits its host and all subdomains if the path starts with the rule's; the longest
    one decides, and ``default`` where none fits (``rule`` is null). Each different host and path is looked up once:
    its expressions meet the rules on the first PREFIX digits of their digests, and a hit counts if whole digests are
    equal. Null and broken URLs have an empty host and path. Repeated rows and null ids get rows of their own; other
    columns are not read; empty tables give none, and without rules all is ``default``.
    """
    host, path = split_url(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    found = stored(fitting_rules(rows.select("host", "path").distinct(), rules), "url-hits")
    named = found.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "rule", "blocks")
    same = (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path"))
    verdict = F.when(F.col("blocks"), BLOCK).when(~F.col("blocks"), ALLOW).otherwise(default)
    return rows.join(named, same, "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def rule_rows(rows: DataFrame, *given: tuple[str, str, str]) -> DataFrame:
    """A table of rules from (verdict, host, path) triples, in the session of ``rows``."""
    quoted = ", ".join("(" + ", ".join(f"'{part}'" for part in rule) + ")" for rule in given)
    return rows.sparkSession.sql(f"SELECT * FROM VALUES {quoted} AS rules(verdict, host, path)")
