import duckdb
import numpy as np
import pytest

from astroloom.llm import urls

SCHEMA = "page_id long, url string, html string, host string, rule string, key string"


def judged(spark, values, **more):
    frame = spark.createDataFrame([(i, u, "<p>", "h", "r", "k") for i, u in values], SCHEMA)
    return sorted(urls.judge(frame, **more).collect(), key=lambda r: (r.page_id is None, r.page_id))


CASES = [
    (1, None), (2, ""), (3, "no scheme/com/"), (4, "http://x.com"), (5, "http://X.COM/"), (6, "http://example.com/en/a?b#c"), (7, "https://a.Example.com/en/"),
    (8, "http://www.example.com/en/x"), (9, "http://m.www.example.com/en/"), (10, "http://net/es/"), (11, "http://xnet/es/"), (12, "http://a.net/fr/b#d"),
    (13, "a://b://c/d"), (14, "http://?q"), (15, "http://É.org/ü"), (15, "http://É.org/ü"), (None, "http://org/"), (16, "https://safe.org/"), (17, "http://safe.org/" + "x" * 100_000),
]


def test_cases(spark):
    out = {r.page_id: tuple(r)[1:] for r in judged(spark, CASES)}
    assert out[1] == out[2] == out[3] == ("", "", None, "allow")
    assert out[4] == ("x.com", "", None, "block")  # listed: only http
    assert out[5][2:] == ("com/", "allow") and out[6] == ("example.com", "/en/a", "example.com/en/", "block")
    assert out[7][2:] == ("example.com/en/", "block") and out[8][2:] == out[9][2:] == ("www.example.com/en/", "allow")
    assert out[10][2:] == ("net/es/", "block") and out[11][2] is None and out[12][1:3] == ("/fr/b", "net/fr/")
    assert out[13][:2] == ("b:", "//c/d") and out[14][:2] == ("", "") and out[15][:2] == ("É.org", "/ü")
    assert out[16][3] == out[17][3] == "allow" and len(judged(spark, CASES)) == len(CASES)


def test_empty(spark):
    assert judged(spark, []) == []


@pytest.mark.parametrize("bound", [urls.BROADCAST_BYTES, -1])
def test_cascade_is_exact(spark, monkeypatch, bound):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(urls, "SHARD_KEYS", 700)
    keys = spark.range(3000).selectExpr("concat('k', id) key", "id % 7 = 0 listed")
    cascade = urls.BloomCascade(keys)
    assert cascade.shards == 5
    assert cascade.mark(keys, "key", "found").filter("listed <> found").count() == 0


def test_hot_shards_are_met_in_parts(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(urls, "SHARD_KEYS", 50)
    monkeypatch.setattr(urls, "PART_ROWS", 300)
    keys = spark.range(400).selectExpr("concat('k', id) key", "id % 3 = 0 listed")
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'k3', concat('k', id % 400)) key", "id shard", "id part", "id h", "map('a', id) m")
    rows = rows.unionByName(spark.createDataFrame([(9, None, 1, 1, 1, {"a": 1})] * 2, rows.schema))
    out = urls.BloomCascade(keys).mark(rows, "key", "found")
    assert out.columns == [*rows.columns, "found"] and out.count() == 3002
    assert out.filter("found <> coalesce(cast(substr(key, 2) AS int) % 3 = 0, false)").count() == 0
    assert out.filter("shard <> id OR part <> id OR h <> id OR m['a'] <> id").count() == 2  # the two rows that were given so
    assert urls.BloomCascade(keys).mark(rows.limit(0), "key", "found").count() == 0


def test_sql_beyond_the_broadcast(spark, small, monkeypatch):
    whole = sorted(map(repr, urls.op4_url_filter(spark, small).collect()))
    monkeypatch.setattr(urls, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(urls, "PART_ROWS", 40)
    assert sorted(map(repr, urls.op4_url_filter(spark, small).collect())) == whole


def test_levels():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63, 20_000)
    for cut in (0, 1, 300, 20_000):
        levels = urls.build_levels(h[:cut], h[cut:])
        assert urls.member(levels, h).tolist() == [True] * cut + [False] * (20_000 - cut)
        assert sum(map(len, levels)) < 6 * cut + 512  # the listed keys count, hardly the universe


def test_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    got = urls.op4_url_filter(spark, small).toPandas().sort_values("page_id").fillna("-").values.tolist()
    assert got == con.sql(urls.OP4_SQL).df().sort_values("page_id").fillna("-").values.tolist()
