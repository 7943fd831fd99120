"""SimHash near-duplicate detection over deletion-variant signatures.

A fingerprint has 64 bits, and two documents are linked when at most three
bits differ. Cut into two halves, at least one half of a linked pair differs
by at most one bit. Each half is therefore indexed under its 32 one-wildcard
variants (the half with one bit masked out, and the position of that bit);
an equality join on the variant finds every such pair, and the whole
fingerprints verify it.

Documents with the same fingerprint are one node from the start: copies are
never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.llm.common import components, cut, discard, slices, small, stored, table, unused, with_ids

LANES = np.uint64(0x0101010101010101)
#: Counters that all shingles of the corpus are counted in, by their upper bits; the counts order shingles.
SLOT_BITS = 17
#: Shingles in common among the first ones that make two documents a candidate pair.
SHARED = 4
#: Rows of one shingle that are looked at together, about; more are dealt to several tasks.
HOT = 10_000
#: Words whose hashes a worker remembers, at most.
REMEMBERED = 1 << 18


def fingerprint(text: str | None, words_per_shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text (unsigned). Null, empty and blank texts give 0.

    A-Z are lower-cased; words are runs of bytes other than space and
    0x09-0x0D; fewer words than a shingle takes make one shingle of them all.
    A bit is set if more than half of the shingle hashes, repeats counted,
    have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), dtype=np.uint64, count=n
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have. Eight byte-wide lanes are summed at a time, 255 rows to a sum."""
    cuts = np.arange(0, len(hashes), 255)
    out = 0
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.nonzero(counts * 2 > len(hashes))[0].tolist():
            out |= 1 << (8 * byte + k)
    return out


def fingerprints(docs: DataFrame, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, of every row."""

    def batches(it):
        for batch in slices(it):
            fps = np.fromiter(
                (fingerprint(t, words_per_shingle, seed) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return with_ids(docs, "doc_id", "text").mapInArrow(batches, "doc_id long, fp long")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_key(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


class WordCodes(dict):
    """64-bit hashes of words, remembered as they come and forgotten when they are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


CODES = WordCodes()


def shingle_hashes(words: list[bytes], words_per_shingle: int = 5) -> np.ndarray:
    """64-bit hashes of the words' shingles, rising, each once; fewer words make one shingle of them all."""
    if not words:
        return np.zeros(0, np.int64)
    codes = np.fromiter(map(CODES.__getitem__, words), np.uint64, count=len(words))
    k = min(words_per_shingle, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """``shingle_hashes`` of a text."""
    return shingle_hashes(normal_words(text), words_per_shingle)


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many texts have the shingles of each slot, counted over all documents; the number of slots is fixed.

    The counts only decide the order of shingles: any order finds the same
    links, and one with frequent shingles last finds them with few candidates.
    A shingle stands out if it is in more texts than the square root of its slot's others.
    """

    def batches(it):
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in slices(it):
            for t in batch.column(0).to_pylist():
                np.add.at(counts, slots(shingle_set(t)), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], names=["slot", "n"])

    out = np.zeros(1 << SLOT_BITS, np.int64)
    rows = with_ids(docs, "text").mapInArrow(batches, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def head(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles, frequent ones last, of which two sets of at least that Jaccard similarity have ``SHARED`` in common, or all.

    Both have at least that share of their own shingles in common, so of each
    no more than the rest can stand before or between the first common ones.
    """
    hashes = hashes[np.argsort(counts[slots(hashes)], kind="stable")]
    return hashes[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + SHARED]


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def profiles(docs: DataFrame, counts: np.ndarray, similarity: float, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fp``, ``key`` (a hash of the words), ``n`` (five-word shingles) and ``head`` (the first of them) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(counts)

    def batches(it):
        for batch in slices(it):
            texts = batch.column(1).to_pylist()
            fps = np.fromiter((fingerprint(t, words_per_shingle, seed) for t in texts), np.uint64, count=len(texts)).view(np.int64)
            words = [normal_words(t) for t in texts]
            keys = np.fromiter((text_key(w) for w in words), np.uint64, count=len(words)).view(np.int64)
            hashes = [shingle_hashes(w) for w in words]
            heads = lists([head(h, shipped.value, similarity) for h in hashes])
            columns = [batch.column(0), pa.array(fps), pa.array(keys), pa.array([len(h) for h in hashes], pa.int32()), heads]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "key", "n", "head"])

    return with_ids(docs, "doc_id", "text").mapInArrow(batches, "doc_id long, fp long, key long, n int, head array<long>")


def variants(fps: DataFrame) -> DataFrame:
    """``fp`` and ``variant``: each fingerprint's halves under their one-wildcard variants, 64 rows."""
    low = F.lit(0xFFFFFFFF)
    half = F.when(F.col("w") < 32, F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", 32))
    bit = F.expr("shiftleft(1L, w % 32)")
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("w")).select(
        "fp", (half.bitwiseAND(F.bitwise_not(bit)) + F.shiftleft(F.col("w").cast("long"), 32)).alias("variant")
    )


def linked_pairs(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``src``, ``dst``: the distinct fingerprints of ``fps(fp)`` that differ in 1 to ``max_bits`` (at most 3) bits, each pair once.

    A pair whose halves agree under several wildcards is kept under one: the
    differing bit of the lower half if that half differs by at most one bit
    (wildcard 0 if it is equal), else of the upper half.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("two halves with one wildcard find at most three differing bits")
    index = variants(fps)
    a, b = index.alias("a"), index.alias("b")
    pairs = a.join(
        b,
        F.expr(
            "a.variant = b.variant AND a.fp < b.fp"
            f" AND bit_count(a.fp ^ b.fp) <= {max_bits}"
            # the one wildcard that this half's difference belongs to
            " AND (CASE WHEN shiftrightunsigned(a.variant, 32) < 32 THEN (a.fp ^ b.fp) & 4294967295L ELSE shiftrightunsigned(a.fp ^ b.fp, 32) END)"
            " IN (CASE WHEN shiftrightunsigned(a.variant, 32) % 32 = 0 THEN 0L ELSE shiftleft(1L, CAST(shiftrightunsigned(a.variant, 32) % 32 AS INT)) END,"
            " shiftleft(1L, CAST(shiftrightunsigned(a.variant, 32) % 32 AS INT)))"
            # the upper half counts only where the lower differs by more than a bit
            " AND (shiftrightunsigned(a.variant, 32) < 32 OR bit_count((a.fp ^ b.fp) & 4294967295L) > 1)"
        ),
    )
    return pairs.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def several_roots(held: DataFrame, column: str) -> DataFrame:
    """The rows of ``held`` whose value in ``column`` stands under more than one ``root``."""
    ends = held.groupBy(column).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    wanted = small(ends.where("lo <> hi").select(column))
    return held.join(wanted, column)


def fingerprint_roots(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``node``, ``root``: components of the distinct ``fps(fp)`` that differ in at most ``max_bits`` (at most 3) bits; single ones are left out.

    Variants of one fingerprint only are left out by a count. Then each variant's fingerprints are compared
    with three of them, which joins most of a large group of copies by one link each; last,
    those of one variant that are in different components by then are compared
    with each other, so that no link is lost and pairs within a component are never made.
    """
    if not 1 <= max_bits <= 3:
        raise ValueError("two halves with one wildcard find at most three differing bits")
    index = variants(fps)
    shared = small(index.groupBy("variant").count().where("count > 1").select("variant"))
    held = cut(index.join(shared, "variant"))
    near = F.expr(f"filter(centres, x -> bit_count(fp ^ x) BETWEEN 1 AND {max_bits})")
    centres = held.groupBy("variant").agg(
        F.array(F.min("fp"), F.max("fp"), F.min_by("fp", F.xxhash64("fp"))).alias("centres")
    )
    stars = cut(held.join(centres, "variant").select(F.col("fp").alias("src"), F.explode(near).alias("dst")).distinct())
    roots = components(stars)
    marked = held.join(roots, held.fp == roots.node, "left").select("variant", "fp", F.coalesce("root", "fp").alias("root"))
    rest = cut(several_roots(marked, "variant"))
    a, b = rest.alias("a"), rest.alias("b")
    pairs = a.join(b, F.expr(f"a.variant = b.variant AND a.fp < b.fp AND a.root <> b.root AND bit_count(a.fp ^ b.fp) <= {max_bits}"))
    links = cut(stars.union(pairs.select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))).distinct())
    discard(held, stars, rest, shared)
    found = components(links)
    discard(links)
    return found


def verified(docs: DataFrame, texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``src``, ``dst`` of those of the ``pairs(k, l, src, dst)`` of keys in ``texts`` whose texts' whole shingle sets are that similar."""
    pairs = cut(pairs)
    involved = cut(pairs.select(F.col("k").alias("key")).union(pairs.select("l")).distinct())
    ids = small(texts.join(involved, "key").select(F.col("first_id").alias("wanted_id")).distinct())
    rows = with_ids(docs, "doc_id", "text")
    rows = rows.join(ids, rows.doc_id.eqNullSafe(ids.wanted_id), "left_semi").select("text")

    def batches(it):
        for batch in slices(it):
            found = [normal_words(t) for t in batch.column(0).to_pylist()]
            keys = np.fromiter((text_key(w) for w in found), np.uint64, count=len(found)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), lists([shingle_hashes(w) for w in found])], names=["key", "shingles"])

    sets = rows.mapInArrow(batches, "key long, shingles array<long>")
    # sets join the narrow pairs first, so that they are shuffled once, by the other side's key; an id that
    # several rows share may bring a text twice, so links are made distinct
    one = sets.select(F.col("key").alias("k"), F.col("shingles").alias("x")).join(small(pairs), "k")
    other = small(pairs.select("l").distinct())
    two = sets.select(F.col("key").alias("l"), F.col("shingles").alias("y")).join(other, "l")
    overlap = F.size(F.array_intersect("x", "y"))
    alike = overlap >= similarity * (F.size("x") + F.size("y") - overlap) - 1e-9
    links = cut(one.join(two, "l").where(alike).select("src", "dst").distinct())
    discard(pairs, involved, ids, other)
    return links


def similar_roots(docs: DataFrame, fps: DataFrame, roots: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """``node``, ``root`` of the fingerprints in ``fps`` (``profiles`` of ``docs``) where ``roots`` and all pairs of texts of that similarity are links.

    Two distinct texts as similar as that have ``SHARED`` shingles of their heads in common (all of them, if they are
    fewer), so an equality join on shingles, and a count, misses none. What two texts can have in common
    is bounded by where in their heads the common shingles stand. In a first turn texts are compared with two
    of those that have a shingle of theirs (the one with the fewest rare shingles before it, from which others were likely made, and the smallest), so
    that large groups of near copies are joined by a link each; in the second, all that have shingles in common and aren't joined
    yet are compared. Each pair is verified on the two texts' whole shingle sets.
    """
    texts = cut(fps.groupBy("key").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.count("*").alias("copies")))
    copied = small(texts.where("copies > 1").select("key"))
    heads = fps.select("key", "head")
    once = heads.join(copied, "key", "left_anti").union(heads.join(copied, "key", "left_semi").groupBy("key").agg(F.first("head").alias("head")))
    parts = np.maximum(0, counts - int(counts.mean())) // HOT + 1
    hot = np.flatnonzero(parts > 1)
    hot = docs.sparkSession.createDataFrame([(int(s), int(parts[s])) for s in hot], "slot long, parts long")
    tokens = once.select("key", F.posexplode("head").alias("pos", "token")).withColumn("slot", F.shiftrightunsigned("token", 64 - SLOT_BITS))
    tokens = tokens.join(F.broadcast(hot), "slot", "left").withColumn("part", F.expr("coalesce(pmod(key, parts), -1)"))
    tokens = tokens.withColumn("rows", F.count("*").over(Window.partitionBy("token", "part"))).where("rows > 1 OR part >= 0")
    rooted = texts.join(roots, texts.fp == roots.node, "left").select("key", "n", F.coalesce("root", "fp").alias("root"))
    held = stored(tokens.select("key", "pos", "token", "part").join(rooted, "key"))
    # a hot shingle's parts are looked at each by itself, and stay for the second turn whatever they hold
    same = Window.partitionBy("token", "part")

    # the least overlap of two sets of such sizes; their common shingles from the k-th on stand so late that no more than the rest can be common
    least = f"ceil({similarity / (1 + similarity)} * (n + m) - 1e-6)"
    fits = f"least(n, m) >= {similarity} * greatest(n, m) - 1e-9 AND least(n - pos, m - place) + {SHARED - 1} >= {least}"
    enough = f"c >= least({SHARED}, {least}) AND c + least(n - pos, m - place) - 1 >= {least}"

    def candidates(rows: DataFrame, *more: str) -> DataFrame:
        """Of a row per pair ``k``, ``l`` and shingle in common, the pairs that may be similar."""
        ends = [F.first(x).alias(x) for x in ("n", "m", "src", "dst")]
        pairs = rows.where(fits).groupBy("k", "l", *more).agg(F.count("*").alias("c"), F.max("pos").alias("pos"), F.max("place").alias("place"), *ends)
        return pairs.where(enough)

    centre = F.struct("pos", "key", "n", "root")
    first = held.withColumns({"c0": F.min(centre).over(same), "c1": F.min_by(centre, "key").over(same)})
    first = first.select("*", F.posexplode(F.expr("filter(array(c0, c1), x -> x.root <> root)")).alias("kind", "o"))
    first = first.selectExpr("key AS k", "o.key AS l", "n", "o.n AS m", "pos", "o.pos AS place", "root AS src", "o.root AS dst", "kind")
    best = candidates(first, "kind").groupBy("k", "kind").agg(F.max(F.struct("c", "l", "src", "dst")).alias("x"))
    star = verified(docs, texts, best.select("k", "x.l", "x.src", "x.dst").distinct(), similarity)
    joined = cut(components(star))
    marked = held.join(joined, held.root == joined.node, "left").select("token", "part", "key", "pos", "n", F.coalesce(joined.root, held.root).alias("root"))
    marked = marked.withColumns({"lo": F.min("root").over(same), "hi": F.max("root").over(same)}).where("lo <> hi OR part >= 0")
    rest = stored(marked.select("token", "key", "pos", "n", "root"))
    pairs = rest.alias("a").join(rest.alias("b"), F.expr("a.token = b.token AND a.key < b.key AND a.root <> b.root"))
    pairs = pairs.selectExpr("a.key AS k", "b.key AS l", "a.n AS n", "b.n AS m", "a.pos AS pos", "b.pos AS place", "a.root AS src", "b.root AS dst")
    more = verified(docs, texts, candidates(pairs).select("k", "l", "src", "dst"), similarity)
    found = components(roots.select(F.col("node").alias("src"), F.col("root").alias("dst")).union(star).union(more))
    discard(texts, copied, held, star, joined, rest, more)
    return found


def rooted_fingerprints(fps: DataFrame, roots_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fp``, ``first_id`` (the smallest id that has it) and ``root`` (by ``roots_of`` the distinct ones) of the distinct fingerprints in ``fps``."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = roots_of(nodes.select("fp"))
    return nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = 3, words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the row's
    own included. Texts without words have fingerprint zero and are linked
    like any other. Rows with a null ``doc_id`` are kept and take part; a
    component of such rows only has a null id. Repeated rows stay repeated;
    no rows give no rows; extra columns are ignored.
    """
    fps = cut(fingerprints(docs, words_per_shingle, seed))
    rooted = rooted_fingerprints(fps, lambda nodes: fingerprint_roots(nodes, max_bits))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = rooted.join(smallest, "root").select(F.col("fp").alias("member_fp"), "component_id")
    return fps.join(member, fps.fp == member.member_fp).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, max_bits: int = 3, similarity: float | None = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one stays per component: that of the smallest id (null last).

    Documents are linked by their fingerprints as in ``near_duplicates``, and
    with ``similarity`` also where their five-word shingles have that Jaccard
    similarity (``similar_roots``).
    Ids of rows that go are found on narrow rows and anti-joined: by a broadcast
    if they are few enough, else texts are shuffled once. Ids that several rows share, and null ids, can't tell
    rows apart; such rows only are fingerprinted again and told apart by
    id and fingerprint, and of rows with both in common one stays.
    """
    if similarity is None:
        fps = cut(fingerprints(docs))
        rooted = rooted_fingerprints(fps, lambda nodes: fingerprint_roots(nodes, max_bits))
    else:
        counts = shingle_counts(docs)
        fps = stored(profiles(docs, counts, similarity))
        rooted = rooted_fingerprints(fps, lambda nodes: similar_roots(docs, fps, fingerprint_roots(nodes, max_bits), counts, similarity))
    # null ids stand after all others
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("n"), F.col("first_id").alias("id"), "fp")).alias("x"))
    stays = first.select(F.col("x.id").alias("kept_id"), F.col("x.fp").alias("kept_fp"))
    both = fps.doc_id.eqNullSafe(stays.kept_id) & (fps.fp == stays.kept_fp)
    marked = fps.join(stays, both, "left").select("doc_id", "fp", F.col("kept_fp").isNotNull().alias("kept"))
    by_id = cut(marked.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    unclear = small(by_id.where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("other_id")))
    gone = small(by_id.where("n > 1 OR NOT kept").select(F.col("doc_id").alias("other_id")))
    clear = docs.where(F.col("doc_id").isNotNull()).join(gone, docs.doc_id == gone.other_id, "left_anti")
    again = docs.join(unclear, docs.doc_id.eqNullSafe(unclear.other_id), "left_semi")
    [own] = unused(docs, "fp_of_row")
    at = docs.columns.index("text")

    def batches(it):
        for batch in slices(it):
            fp = np.fromiter((fingerprint(t) for t in batch.column(at).to_pylist()), np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, own])

    again = again.mapInArrow(batches, T.StructType([*docs.schema, T.StructField(own, T.LongType())]))
    again = again.join(stays, again.doc_id.eqNullSafe(stays.kept_id) & (again[own] == stays.kept_fp), "left_semi")
    return clear.unionByName(again.dropDuplicates(["doc_id", own]).drop(own))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
