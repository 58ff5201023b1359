"""URL filters against a plain reading of the rules and a set of listed forms."""

import itertools

import pytest
from pyspark.sql import functions as F

from pitchlake.llm import urls

ODD = [None, "", "no scheme", "://", "http://", "http://?a", "http://#x/y", "HTTP://WWW.A.ORG", "http://org/", "http://org", "x://notorg/", "http://a.org:80/p?q=1#f", "http://u:p@b.com/fr/", "http://a.com/fr\n/x", "http://é.ORG/ü?z=1&b=2", "y" * 50_000 + "://org/" + "z" * 50_000, "http://a.com/de/1", "http://a.com/de/1"]


def parts(url):
    if url is None or "://" not in url:
        return "", "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    path, rest = rest[:end], rest[end:].split("#", 1)[0]
    query = sorted(p for p in rest[1:].split("&") if p and not p.startswith("utm_") and p.split("=")[0] not in ("ref", "fbclid", "gclid"))
    form = (host[4:] if host.startswith("www.") else host) + path.rstrip("/") + ("?" + "&".join(query) if query else "") if host else ""
    return host, path, form


def plain(url, listed):
    host, path, form = parts(url)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
    return host, path, rule and rule.name, form in listed, rule.verdict if rule else "block" if form in listed else "allow"


def all_urls():
    made = [f"{s}{h}{p}{q}" for s, h, p, q in itertools.product(("http://", "https://"), ("example.org", "www.Example.org", "m.example.org", "a.com", "b.net", "org.net"), ("", "/", "/es/1", "/en/12/", "/fr/3", "/de/4"), ("", "?utm_source=x", "?b=1&a=2&ref=q", "#top", "?a=2&b=1#x?y"))]
    return ODD + made + ["http://b.net/fr/3"] * 400  # one form with about half of all rows


@pytest.mark.parametrize("most_blocks, most", [(1000, 1000), (0, 1000), (1000, 3), (0, 0)])
def test_verdicts_are_those_of_a_plain_reading(spark, most_blocks, most):
    """Also where the filter stays in shards, and where more forms are hit than are broadcast."""
    given = all_urls()
    listed = ["https://www.b.net/fr/3/?utm_x=1", "http://b.net/?b=1&a=2", "http://ORG.net/de/4", "http://a.com", None, "", "none"]
    listed += [f"http://b.net/es/1?a=2&b=1&n={i}" for i in range(500)] + ["http://m.example.org/es/1", "http://m.example.org/fr/3"]
    forms = {parts(u)[2] for u in listed} - {""}
    rows = [(i if i % 7 else None, u, "x") for i, u in enumerate(given)]
    df = spark.createDataFrame(rows, "page_id long, url string, Verdict string").withColumn("other", F.col("page_id") + 1)
    out = urls.judge(df, spark.createDataFrame([(u,) for u in listed], "url string"), most_blocks=most_blocks, most=max(most, 1))
    assert out.columns == ["page_id", "url", "other", "host", "path", "rule", "listed", "verdict"]
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["listed"], r["verdict"]) for r in out.collect()), key=key)
    assert got == sorted(((i, u, *plain(u, forms)) for i, u, _ in rows), key=key)
    assert any(g[5] and g[4] is None for g in got) and any(g[5] and g[6] == "allow" for g in got)


def test_the_filter_loses_nothing_and_passes_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("in"), "id").alias("form"))
    blocks = 20_000 * urls.BITS_A_URL // 512
    table = urls.bloom_filter(keys, "form", blocks).cache()
    assert urls.maybe_listed(keys, "form", table, blocks).count() == 20_000
    others = spark.range(20_000).select(F.concat(F.lit("out"), "id").alias("form"))
    assert urls.maybe_listed(others, "form", table, blocks).count() < 200


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    some = spark.createDataFrame([(1, "http://b.net/x")], "page_id long, url string")
    assert urls.judge(none, some.select("url")).count() == 0
    assert [r["verdict"] for r in urls.judge(some, none.select("url")).collect()] == ["allow"]
    assert [r["verdict"] for r in urls.judge(some, some.select("url")).collect()] == ["block"]
