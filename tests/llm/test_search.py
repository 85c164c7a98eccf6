"""Top-k search and revisit resolution against brute force and SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, revisits, topk
from tests.conftest import SMALL


def brute(rows, wanted, k):
    out = {}
    for q, v in wanted.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("a_pass", [topk.QUERIES_A_PASS, 3])
def test_top_k_is_exact_with_ties(spark, monkeypatch, a_pass):
    monkeypatch.setattr(topk, "QUERIES_A_PASS", a_pass)
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(700)]
    base = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(5)
    wanted = {i: v for i, v in rows if i % 100 == 0}
    got: dict = {}
    for r in topk.search(base, base.where("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(rows, wanted, 10)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]), (6, [-0.5, 0.25]), (7, [3.0]), (6, [-0.5, 0.25])]
    base = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [(r.vec_id, r["rank"], r.score) for r in topk.search(base, base.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(7, 1, 1024 * 3072), (6, 2, 1024 * -512 + 2048 * 256), (6, 3, 1024 * -512 + 2048 * 256)]
    assert topk.search(base.limit(0), base).count() == 0 and topk.search(base, base.limit(0)).count() == 0


def test_scores_that_doubles_do_not_hold_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(rng.integers(-(1 << 40), 1 << 40)) if i % 3 == 0 else float(rng.integers(-9, 9)) for _ in range(4)]) for i in range(60)]
    rows += [(60, [1e18, 1.0, 0.0, 0.0]), (61, [-1e18, 0.0, 0.0, 1.0]), (62, [1e308, 1.0, 1.0, 1.0])]
    base = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), scale=1024)
    got: dict = {}
    for r in topk.search(base, base.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    long = (1 << 63) - 1
    whole = [(i, [int(x * 1024) for x in v]) for i, v in rows if i != 62]  # 1e308 * 1024 isn't finite
    want = {}
    for q, v in whole:
        if q % 20 == 0:
            scored = [(-max(-long - 1, min(long, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in whole if i != q]
            want[q] = [(i, -s) for s, i in sorted(scored)[:5]]
    assert got == want


@pytest.mark.parametrize("name", ["op7_revisits", "op9_topk"])
def test_queries_give_the_rows_of_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    relation = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SMALL)
    assert df.columns == relation.columns
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, relation.fetchall()))


def test_urls_fold_alike(spark):
    same = ["http://WWW.Example.org:80/a/?b=2&a=1&utm_source=x#frag", "https://example.org/a?a=1&b=2", " example.org/a/?a=1&b=2&ref=q "]
    keys = {r[0] for r in spark.createDataFrame([(u,) for u in same], "url string").select(revisits.canonical_url(F.col("url"))).collect()}
    assert keys == {"example.org/a?a=1&b=2"}


RECORDS = [
    (1, "http://a.org/", 10, 200, {"ETag": '"x"', "Content-Length": "5", "Server": "one"}, "body"),
    (2, "http://a.org", 20, 304, {"etag": 'W/"x"', "Content-Length": "0", "SERVER": "two"}, None),
    (3, "http://a.org", 30, 304, {"etag": '"y"'}, None),
    (4, "http://a.org", 5, 304, {}, None),
    (5, "http://a.org", 25, 200, None, "other"),
    (6, "http://a.org", 26, 304, None, None),
    (7, None, 26, 304, None, None),
    (8, "http://b.org", None, 304, None, None),
    (9, "http://b.org", 1, 404, None, None),
    (10, "http://b.org", 2, 304, {"Last-Modified": "d"}, None),
    (11, "http://a.org", 10, 304, {"etag": '"x"'}, None),
]


@pytest.mark.parametrize("slices", [1, 3, 11])
def test_revisits_resolve_as_of(spark, slices):
    rows = spark.createDataFrame(RECORDS, "record_id long, url string, ts long, status int, headers map<string,string>, found string")
    got = {r.record_id: r for r in revisits.resolve(rows, slices).collect()}
    assert {k: (r.status, r.original_id) for k, r in got.items()} == {2: ("resolved", 1), 3: ("resolved", 5), 4: ("missing", None), 6: ("resolved", 5), 10: ("missing", None), 11: ("resolved", 1)}
    assert got[2].headers == {"etag": 'W/"x"', "content-length": "5", "server": "two"}
    assert revisits.resolve(rows.limit(0), slices).count() == 0


def test_a_hot_url_is_cut_over_slices(spark):
    rows = spark.range(500).select(F.col("id").alias("record_id"), F.lit("http://hot.org/").alias("url"), F.col("id").alias("ts"), F.when(F.col("id") % 90 == 0, 200).otherwise(304).alias("status"), F.lit(None).cast("map<string,string>").alias("headers"))
    got = revisits.resolve(rows, 7)
    assert got.where("original_id != record_id - record_id % 90 or status != 'resolved'").isEmpty() and got.count() == 494
