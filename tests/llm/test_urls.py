"""URL rules against a plain search through all of them."""

import duckdb
from pyspark.sql import functions as F

from panelworks.llm import urls
from panelworks.llm.queries import QUERIES, SQL
from tests.llm.conftest import CLASHING

URLS = [
    "http://a.example.org/es/1", "https://example.org/en/12", "https://example.org/en/2", "http://EXAMPLE.org/es/?x=/de/",
    "http://notexample.org/es/", "ftp://x.com/de/#y", "http://x.com/fr/de/", "http://com/de/", "http://x.com", "http://x.com?/de/",
    "no scheme", "", None, "://", "http:///de/", "http://x.com:80/de/", "http://a.b.c.d.e.f.com/de/" + "x" * 50_000, "http://a://b.org/es/",
    "HTTP://WWW.Ä.ORG/Ä", "http://.com/de/", "http://com./de/", "http://x.org/\n/es/", "http://q.net/de/", "http://" + "a." * 2_000 + "org/z",
]
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"), ("allow", "com", "/de/"), ("block", "X.com", ""), ("block", "ä.org", "/Ä"), ("allow", "a.b.org", "/e"), ("block", "b.org", "/es/"),
]


def plain(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), h + p, v == "block") for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[2], "block" if best[3] else "allow"


def pages(spark):
    rows = [(i, u, *(c for c in CLASHING)) for i, u in enumerate(URLS)] + [(1, URLS[0], *CLASHING), (None, URLS[1], *CLASHING), (None, None, *CLASHING)]
    extra = [*CLASHING, "host", "path", "rule", "blocks", "digest", "start", "shape", "of_host"]
    return spark.createDataFrame([(*r, *extra[len(CLASHING) :]) for r in rows], "page_id long, url string, " + ", ".join(f"`{c}` string" for c in extra)).repartition(3)


def test_every_url_against_plain_rules(spark, monkeypatch):
    given = pages(spark)
    rules = spark.createDataFrame([(*r, "x") for r in RULES], "verdict string, host string, path string, digest string")
    lowered = [(v, h.lower(), p) for v, h, p in RULES]
    want = sorted(str((r.page_id, *plain(r.url, lowered, "block"))) for r in given.collect())
    for shapes in (urls.SHAPES, 0):
        monkeypatch.setattr(urls, "SHAPES", shapes)
        few = given.where(F.coalesce(F.length("url"), F.lit(0)) < 1_000) if not shapes else given
        got = sorted(str(tuple(r)) for r in urls.judge_urls(few, rules, "block").collect())
        assert got == [w for w in want if shapes or "x" * 100 not in w and "a.a.a" not in w]


def test_without_rules_or_pages(spark):
    given = pages(spark)
    rules = spark.createDataFrame([], "verdict string, host string, path string")
    assert {(r.rule, r.verdict) for r in urls.judge_urls(given, rules).collect()} == {(None, "allow")}
    assert urls.judge_urls(given.limit(0), urls.rule_rows(given, ("allow", "org", "/"))).count() == 0


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = QUERIES["op13_url_filter"](spark, sf_dir).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["op13_url_filter"]).fetchall())
    assert {r.verdict for r in got} == {"allow", "block"}
