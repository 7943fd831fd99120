"""URL filters by a cascade of Bloom filters, with DataFrame functions only.

A rule is a host with a path prefix. Every url has a few candidate keys: each
suffix of its host joined with each prefix of its path that is as long as some
rule's path. Those keys, over the whole corpus, are the universe for which
the cascade is exact: level 1 encodes the listed keys, level 2 the keys of the
universe that level 1 lets through by mistake, level 3 the listed keys that
level 2 lets through, and so on until a level lets nothing through. A key's
membership is then read off the bits alone; the pages are joined with nothing.

Level 1 takes bits in proportion to the list and to the logarithm of
universe / list, so what later levels encode is about as large as the list:
the bits that are sent to executors grow with the list, whose size is checked
against ``max_keys``, not with the pages.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm.common import cut, table, with_ids

#: verdict, host, path prefix
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Share of keys outside the list that a level after the first lets through.
LATER_RATE = 0.5


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """What stands after the first ``://`` up to ``/ ? #``, lower-cased, and then up to ``? #``; both empty if there is no ``://``."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def candidates(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The keys that rules can have for a url, longest first (of two as long, the longer host first).

    Rules bound the work on odd urls: a host has no more suffixes than the
    longest rule host has labels, a path as many prefixes as rule paths have
    lengths.
    """
    labels = max((r[1].count(".") + 1 for r in rules), default=1)
    lengths = sorted({len(r[2]) for r in rules})
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.greatest(n - labels + 1, F.lit(1)), n), lambda i: F.concat_ws(".", F.slice(parts, i, n))
    )
    reach = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda k: F.length(path) >= k)
    keys = F.flatten(
        F.transform(suffixes, lambda s: F.transform(reach, lambda k: F.struct((-(F.length(s) + k)).alias("order"), (-F.length(s)).alias("host_order"), F.concat(s, F.substring(path, F.lit(1), k)).alias("key"))))
    )
    # the empty host fits no rule
    return F.when(F.length(host) > 0, F.transform(F.array_sort(keys), lambda x: x["key"])).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def ends(self, key: Column) -> tuple[Column, Column]:
        a, b = (F.pmod(F.xxhash64(key, F.lit(s)), F.lit(self.bits)) for s in (self.seed, -self.seed))
        return a, b

    def position(self, a: Column, b: Column, i: Column | int) -> Column:
        return F.pmod(a + b * i, F.lit(self.bits))

    def positions(self, key: Column) -> list[Column]:
        a, b = self.ends(key)
        return [self.position(a, b, i) for i in range(self.hashes)]

    def has(self, key: Column) -> Column:
        if not self.words:
            return F.lit(False)
        # a constant either way, and one in the whole test; the text form keeps the plan of a long filter small
        words = F.array(*[F.lit(w) for w in self.words]) if len(self.words) < 64 else F.from_json(F.lit(str(list(self.words))), "array<bigint>")

        def is_set(p: Column) -> Column:
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            return F.call_function("shiftright", word, (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

        a, b = self.ends(key)
        steps = F.array(*[F.lit(i) for i in range(self.hashes)])
        # the key is hashed twice, whatever the number of positions
        return F.exists(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda e: F.forall(steps, lambda i: is_set(self.position(e["a"], e["b"], i))))


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the ``n`` rows of ``keys(key)``; only its words come to the driver."""
    per_key = max(1.0, -math.log(rate) / math.log(2) ** 2)
    bits = max(64, math.ceil(per_key * max(1, n) / 64) * 64)
    level = Level(bits, max(1, round(per_key * math.log(2))), seed, ())
    if not n:
        return level
    hit = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    rows = (
        hit.select(F.shiftright("p", 6).cast("int").alias("at"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("bit"))
        .groupBy("at")
        .agg(F.bit_or("bit").alias("word"))
        .collect()
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r["at"]] = r["word"]
    return Level(bits, level.hashes, seed, tuple(words))


def contains(levels: Sequence[Level], key: Column) -> Column:
    """Whether the cascade holds a key of its universe: the first level without it decides, by turns no and yes."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].has(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def distinct_keys(universe: DataFrame) -> int:
    return universe.agg(F.approx_count_distinct("key")).first()[0]


def build_cascade(universe: DataFrame, listed: Sequence[str], seed: int, max_keys: int, n_all: int | None = None) -> list[Level]:
    """Levels that tell the ``listed`` keys from all other rows of ``universe(key)`` without an error.

    ``n_all``, about the number of its distinct keys, sets the first level's size only; it is counted if not given.
    """
    if len(listed) > max_keys:
        raise ValueError(f"{len(listed)} keys listed; max_keys is {max_keys}")
    spark = universe.sparkSession
    inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
    n_in = len(set(listed))
    if n_all is None:
        n_all = distinct_keys(universe)
    rate = min(0.5, max(1e-9, n_in / max(1, n_all)))
    levels = [build_level(inside, n_in, rate, seed)]
    # few keys pass level 1: the list and about as many others
    passed = universe.where(levels[0].has(F.col("key"))).select("key", F.lit(0).alias("listed"))
    both = passed.union(inside.select("key", F.lit(1).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed"))
    both = cut(both)
    inside, outside = both.where("listed = 1").select("key"), both.where("listed = 0").select("key")
    while n := outside.count():
        levels.append(build_level(outside, n, LATER_RATE, seed + len(levels)))
        inside, outside = outside, inside.where(levels[-1].has(F.col("key")))
    return levels


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", seed: int = 71, max_keys: int = 1_000_000) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule`` (host and path prefix, or null), ``verdict``.

    The longest rule that fits decides (of two as long, the one with the
    longer host); of rules with the same host and path, allow goes before
    block. Urls that fit no rule get ``default``. A null url and one without
    ``://`` have an empty host and path and fit no rule. Rows that repeat are
    each judged; no rows give no rows; extra columns are ignored. Very long
    urls cost in proportion to their length.
    """
    rules = [(v, lower, p) for v, h, p in rules if (lower := "".join(c.lower() if c.isascii() else c for c in h))]
    host, path = host_and_path()
    read = with_ids(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return read.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = read.select("*", candidates(F.col("host"), F.col("path"), rules).alias("keys"))
    allow = {h + p for v, h, p in rules if v == "allow"}
    block = {h + p for v, h, p in rules if v == "block"} - allow
    universe = keyed.select(F.explode("keys").alias("key"))
    n_all = distinct_keys(universe)
    allowed, blocked = (build_cascade(universe, sorted(s), seed + 1000 * i, max_keys, n_all) if s else [] for i, s in enumerate((allow, block)))
    hit_a, hit_b = (lambda k, c=c: contains(c, k) if c else F.lit(False) for c in (allowed, blocked))
    verdict = lambda k: F.when(hit_a(k), F.lit("allow")).when(hit_b(k), F.lit("block"))
    judged = F.transform(F.col("keys"), lambda k: F.struct(k.alias("rule"), verdict(k).alias("verdict")))
    found = F.filter(judged, lambda x: x["verdict"].isNotNull())
    return keyed.withColumn("best", F.get(found, F.lit(0))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, ('.' || host) AS dotted FROM p),
g AS (SELECT page_id, host, path, CASE
        WHEN dotted LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
        WHEN dotted LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
        WHEN dotted LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
        WHEN dotted LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
        WHEN dotted LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM g
"""
