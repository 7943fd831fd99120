"""URL filters and mixing against plain Python and SQL."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import same_rows
from tracelight.llm import mixing, registry, urls

SF = "/root/testdata/sf0.001"


def judged(url, rules, default="allow"):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url is not None and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h) + len(p), len(h), verdict == "allow")
            if best is None or key > best[0]:
                best = (key, h + p, verdict)
    return host, path, best and best[1], best[2] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://?q", "http://COM/", "https://Example.com/en/1?x=/es/", "http://www.example.com/en/", "http://www.example.com/EN/",
    "http://a.www.example.com/en/x#y", "http://xample.com/en/", "http://myexample.com/en/", "http://n.net/es/", "http://net/fr/", "http://n.net/es", "http://n.net",
    "http://a.com?x", "x://y://z.com/", "http://u@h.com:80/en/", "http://.com/", "http://a..net/fr/x", "http://É.COM/", "http://a.com./", "http://" + "a." * 3000 + "com/" + "p" * 3000,
    "http://exa\nmple.com/en/\nz",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*URLS, *URLS[:3]])], "page_id long, url string, host string, rule string")
    found = {(r.page_id): tuple(r)[1:] for r in urls.filter_urls(pages).collect()}
    assert found == {i: judged(u, urls.RULES) for i, u in enumerate([*URLS, *URLS[:3]])}
    assert urls.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_many_rules(spark, seed):
    r = np.random.default_rng(seed)
    hosts = [f"h{i}.example" for i in range(150)] + ["example", "deep.h1.example"]
    paths = ["/", "", "/a", "/a/b/", "/c"]
    rules = [(str(r.choice(["allow", "block"])), str(r.choice(hosts)), str(r.choice(paths))) for _ in range(200)]
    found = [f"http://{r.choice(['', 'x.', 'y.z.'])}{r.choice([*hosts, 'other.test', 'h1.sample'])}{r.choice(['', '/', '/a', '/a/b/c', '/cd', '/e'])}" for _ in range(700)]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    for default in ("allow", "block"):
        got = {x.page_id: tuple(x)[1:] for x in urls.filter_urls(pages, rules, default).collect()}
        assert got == {i: judged(u, rules, default) for i, u in enumerate(found)}


def test_a_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 20000, 40)] + ["not there"]
    levels = urls.build_cascade(universe, listed, 1, 1000)
    inside = {r.key for r in universe.where(urls.contains(levels, F.col("key"))).collect()}
    assert inside == set(listed) - {"not there"} and len(levels) > 2
    # the first level alone makes mistakes
    assert universe.where(levels[0].has(F.col("key"))).count() > len(inside)
    with pytest.raises(ValueError):
        urls.build_cascade(universe, listed, 1, 10)


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in urls.filter_urls(pages, [], "block").collect()] == [(1, "a.com", "/", None, "block")]


def filled(sizes, weights, cap):
    """Targets by resharing until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        left = [s for s in names if s not in fixed]
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        above = [s for s in left if share[s] > cap * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in above}


DOCS = [(i, None if i % 17 == 0 else f"s{i % 7}" if i % 3 else "hot", "w " * (i % 23) if i % 11 else None) for i in range(900)]
DOCS += [(5000, "tiny", "one"), (5001, "no words", " \t"), (5002, "é", "x\u00a0y\x1fz"), (5003, "Z", "a\x0bb"), (None, "tiny", "two words"), (3, "hot", "w w w"), (3, "hot", "w w w")]


def test_targets_and_copies(spark):
    docs = spark.createDataFrame([(*d, 1.0, "t") for d in DOCS], "doc_id long, source string, text string, target double, rate string")
    found = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, s, t in DOCS:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = filled(sizes, mixing.WEIGHTS, 3)
    assert len(found) == len(DOCS)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, s, t in DOCS:
        r = next(x for x in by_doc[i] if x["size"] == size(t))
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        rate = targets[s] / sizes[s] if sizes[s] else 0
        assert r.taken == r["size"] * r.copies and rate - 1 < r.copies < rate + 1 and r.taken <= 3 * r["size"]
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(str, mixing.mix(docs.repartition(5)).collect())) == sorted(map(str, found))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_taken_words_come_near_the_target(spark):
    docs = spark.createDataFrame([(i, f"s{i % 4}", "w " * (5 + i % 9)) for i in range(8000)], "doc_id long, source string, text string")
    totals = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"))
    for r in totals.collect():
        assert abs(r.t - r.g) < 0.05 * r.g


@pytest.mark.parametrize("limit", [100_000, 0])
def test_the_mix_itself(spark, limit):
    docs = spark.createDataFrame([(*d, 7, "r", "c") for d in DOCS], "doc_id long, source string, text string, mix_size int, mix_rate string, mix_copy string")
    out = mixing.emit(docs, max_sources=limit)
    assert out.columns == ["doc_id", "source", "text", "mix_rate", "mix_copy", "mix_size", "mix_target"]
    copies = {(r.doc_id, r["size"]): r.copies for r in mixing.mix(docs).collect()}
    rows = out.collect()
    got = {}
    for r in rows:
        got[r.doc_id, r.mix_size] = max(got.get((r.doc_id, r.mix_size), 0), r.mix_copy)
    assert got == {k: v for k, v in copies.items() if v}
    assert len(rows) == sum(r.copies for r in mixing.mix(docs).collect())


def test_all_empty(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mixing.mix(docs).collect()] == [(0.0, 0)] * 2 and mixing.emit(docs).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_queries_with_sql(spark, name):
    same_rows(registry.QUERIES[name](spark, SF), SF, registry.ORACLES[name])


@pytest.mark.parametrize("name", ["op5_url_filters", "op6_mix_sources"])
@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
def test_native_plans(spark, name, capsys):
    registry.QUERIES[name](spark, SF).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow", plan)
