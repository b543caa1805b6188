import os
import random

import pytest
from pyspark.sql import functions as F

from keyloom.llm import queries, urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[n:]
    m = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:n]), path[:m]


URLS = ["https://A.Example.ORG/es/x?q#f", "http://example.org", "http://example.org?x=/es/", "x://ÄB.com/fr/1", "no scheme", None, "", "a://b://c/d", "http://notexample.org/es/", "http://org/x", "http://m.example.org/en/12", "http://x.com/de/1#", "http://h:80/p"]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    host, path = urls.parts(F.col("url"))
    got = df.select("page_id", host.alias("h"), path.alias("p")).withColumn("r", urls.rule_for(F.col("h"), F.col("p"), queries.RULES)).collect()
    for r in got:
        assert (r.h, r.p) == parts(URLS[r.page_id])
        fits = [(len(h + p), h + p, v) for h, p, v in queries.RULES if (r.h == h or r.h.endswith("." + h)) and r.p.startswith(p)]
        want = max(fits)[1:] if fits else None
        assert (tuple(r.r) if r.r else None) == want


def test_reputation_shrinks_towards_its_domain(spark):
    rows = [("good.site.net", 1)] * 60 + [("bad.site.org", 0)] * 60 + [("one.site.net", 0), ("one.site.org", 1)] + [("lone.example", 1)] * 2
    for k in range(6):
        rows += [(f"h{k}.site.net", int(i > 1)) for i in range(20)] + [(f"h{k}.site.org", int(i < 2)) for i in range(20)]
    outcomes = spark.createDataFrame(rows, "host string, good int")
    asked = spark.createDataFrame([(h,) for h in ("good.site.net", "bad.site.org", "one.site.net", "one.site.org", "new.site.org", "", "x.co.uk", "10.0.0.1:80")], "host string")
    got = {r.host: r for r in urls.reputation(outcomes, asked, least=0.5).collect()}
    assert got["good.site.net"].verdict == "allow" and got["bad.site.org"].verdict == "block"
    assert got["one.site.net"].mean > got["one.site.org"].mean  # one page says less than the domain
    assert got["new.site.org"].verdict == "block" and got["new.site.org"].n == 0
    assert all(r.bound <= r.mean for r in got.values())


def test_every_page_is_judged(spark):
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], "old", 1)], "page_id long, url string, verdict string, good int")
    none = spark.createDataFrame([], "host string, good int")
    got = urls.judge(pages, none, queries.RULES).collect()
    assert len(got) == len(URLS) + 1 and {r.verdict for r in got} <= {"allow", "block"}
    assert urls.judge(pages.limit(0), none, []).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_query_against_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()["op8_urls"])
    got = sorted((tuple(r[c] for c in rel.columns) for r in queries.op8_urls(spark, sf).collect()), key=str)
    assert got == sorted(rel.fetchall(), key=str)


def test_joined_rules_are_those_of_the_expression(spark):
    rng = random.Random(4)
    names = ["a", "b.a", "c.b.a", "x.b.a", "d", "ad"]
    rules = [(rng.choice(names), "/" + "".join(rng.choices("xy/", k=rng.randrange(4))), rng.choice(["allow", "block"])) for _ in range(40)]
    pages = [(i, f"http://{rng.choice(names)}/{''.join(rng.choices('xy/', k=rng.randrange(6)))}", 1) for i in range(300)]
    pages += [(900, None, 1), (901, "none", 1), (0, pages[0][1], 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, rule int")
    none = spark.createDataFrame([], "host string, good int")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(map(tuple, urls.judge(df, none, rules).collect()), key=repr)
    assert sorted(map(tuple, urls.judge(df, none, table).collect()), key=repr) == want
    for r in urls.judge(df, none, table).collect():
        fits = [(len(h + p), h, p, v) for h, p, v in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert r.rule == ("".join(max(fits)[1:3]) if fits else None)


def test_a_hundred_thousand_rules(spark):
    rules = [(f"h{i % 1000}.org", f"/{i}/", "block" if i % 2 else "allow") for i in range(100_000)]
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://www.h', id % 1500, '.org/', id, '/x') as url")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame([], "host string, good int"), rules).collect()}
    assert len(got) == 3000
    for i, (rule, verdict) in got.items():
        if i % 1500 < 1000 and i % 1000 == i % 1500:
            assert (rule, verdict) == (f"h{i % 1000}.org/{i}/", "block" if i % 2 else "allow")
        else:
            assert rule is None


def test_suffixes_by_rule_and_from_a_table(spark):
    hosts = spark.createDataFrame([(h,) for h in ("x.com.ar", "y.com.ar", "www.x.co.uk", "a.b.blogs.example", "c.d.example", "net", "")], "host string")
    outcomes = spark.createDataFrame([("x.com.ar", 1)] * 50 + [("y.com.ar", 0)] * 50, "host string, good int")
    domain = hosts.select("host", urls._levels(F.col("host"))[1].alias("d"), urls._levels(F.col("host"))[2].alias("s"))
    assert {r.host: (r.d, r.s) for r in domain.collect()} == {"x.com.ar": ("x.com.ar", "com.ar"), "y.com.ar": ("y.com.ar", "com.ar"), "www.x.co.uk": ("x.co.uk", "co.uk"), "a.b.blogs.example": ("blogs.example", "example"), "c.d.example": ("d.example", "example"), "net": ("net", "net"), "": ("", "")}
    listed = urls._listed(hosts, spark.createDataFrame([("blogs.example",), ("example",)], "suffix string"))
    got = {r.host: (r.d, r.s) for r in listed.select("host", urls._levels(F.col("host"), F.col("_listed"))[1].alias("d"), urls._levels(F.col("host"), F.col("_listed"))[2].alias("s")).collect()}
    assert got["a.b.blogs.example"] == ("b.blogs.example", "blogs.example") and got["c.d.example"] == ("d.example", "example") and got["x.com.ar"] == ("x.com.ar", "com.ar")
    known = {r.host: r.mean for r in urls.reputation(outcomes, hosts, suffixes=spark.createDataFrame([("blogs.example",)], "suffix string")).collect()}
    assert known["x.com.ar"] > 0.8 > 0.2 > known["y.com.ar"]
