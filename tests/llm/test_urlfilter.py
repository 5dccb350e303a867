import re

from pyspark.sql import functions as F

from voxelyard.llm import urlfilter as u


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda x: len(x[0]), default=(None, None))
    listed = bool(set(host.split(".")) & set(u.LISTED_LABELS))
    return host, path, rule[0], rule[1] or ("block" if listed else "allow"), listed


URLS = [
    None, "", "no scheme/en/", "http://com/en/1", "http://x.COM/en/?q", "https://a.example.com/en/77#x", "https://notcom/en/", "https://b.net/de/9", "https://b.example.net/de/81",
    "https://spam-farm.example.org/x", "https://spam-farm.org/es/1", "http://a.b://c.com/en/", "http://ÄB.com/en/", "http://h?x://y", "http://x\ny.com/en/\nz", "https://www.cheap-pills.net/de/",
]


def test_against_brute_force(spark):
    rows = [(i, x, "h", 1) for i, x in enumerate(URLS + URLS)] + [(1000 + i, f"http://h{i}.{'spam-farm' if i % 7 == 0 else 'fine'}.io/{i}", "h", 1) for i in range(3000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    for bits in (u.MAX_BITS, 2048):  # one cascade and several
        got = {r.page_id: tuple(r)[1:] for r in u.judge_urls(frame, u.listed_host(), max_bits=bits).collect()}
        assert got == {i: brute(x) for i, x, *_ in rows}
    assert u.judge_urls(frame.limit(0), u.listed_host()).count() == 0
    hosts = frame.select(u.host_of(F.col("url")).alias("key")).where(u.listed_host()).union(spark.createDataFrame([(None,), ("not.there",)], "key string"))
    got = {r.page_id: tuple(r)[1:] for r in u.judge_urls(frame, hosts).collect()}
    assert got == {i: brute(x) for i, x, *_ in rows}


def test_cascade_has_levels_and_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 4 == 0).alias("listed"))
    cascade = u.build_cascade(universe, first_rate=0.3)
    assert len(cascade.levels) > 2
    assert universe.where(cascade.member(F.col("key")) != F.col("listed")).count() == 0
    nothing = u.build_cascade(universe.withColumn("listed", F.lit(False)))
    assert universe.where(nothing.member(F.col("key"))).count() == 0


def test_main_path_is_native(spark):
    frame = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    plan = u.judge_urls(frame, u.listed_host())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
