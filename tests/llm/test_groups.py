"""Components, SimHash and embeddings against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelight.llm import embeddings, simhash
from tracelight.llm.common import components, unused


def closure(nodes, linked):
    """The smallest node of each one's component."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("n, m, seed", [(1, 0, 0), (30, 12, 1), (300, 200, 2), (300, 600, 3)])
def test_components(spark, n, m, seed):
    r = np.random.default_rng(seed)
    links = [tuple(map(int, p)) for p in r.integers(0, n, (m, 2))]
    made = components(spark.createDataFrame([*links, *links[:5], (None, 1)], "src long, dst long"))
    expected = closure(range(n), links)
    touched = {a for a, b in links if a != b} | {b for a, b in links if a != b}
    found = {x.node: x.root for x in made.collect()}
    assert {k: found.get(k, k) for k in range(n)} == expected and set(found) <= touched


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    found = {x.node: x.root for x in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(found[i] == 0 for i in range(1, 201)) and all(found[1000 + i] == 1000 for i in range(1, 300))
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def plain_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


TEXTS = [
    None, "", " \t\n", "one", "One TWO", "a b c", "A  b\nc\x0bd é É", "x\u00a0y z\u2003w q", "\x1c a \x85 b c", "a b " * 700,
    " ".join(f"w{i}" for i in range(3000)), "ß İ ſ K Ω" * 3, "𝔘 😀 漢 字",
]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_a_hash_is_spark_s(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] == np.uint64(xxhash.xxh64_intdigest("a b c", 42)).astype(np.int64)


def test_links_between_fingerprints(spark):
    r = np.random.default_rng(5)
    fps = set()
    for _ in range(60):
        base = int(r.integers(0, 1 << 63)) * 2 + int(r.integers(0, 2))
        for _ in range(6):
            flips = r.choice(64, int(r.integers(0, 6)), replace=False)
            fps.add(base ^ sum(1 << int(b) for b in flips))
    fps |= {0, 1, 7, 15, (1 << 64) - 1, 1 << 63, (1 << 63) | (1 << 31)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in sorted(fps)]
    for bits in (1, 2, 3):
        found = [tuple(x) for x in simhash.linked_pairs(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()]
        expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        assert len(found) == len(set(found)) and set(found) == expected
    with pytest.raises(ValueError):
        simhash.linked_pairs(spark.createDataFrame([(1,)], "fp long"), 4)


def near_texts():
    base = [" ".join(f"t{g}x{i}" for i in range(400)) for g in range(4)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + 10 * g + j, t.replace(f"t{g}x{50 * j} ", "new ")) for g, t in enumerate(base) for j in range(1, 4)]
    return rows + [(300, base[0]), (7, base[0].upper()), (None, base[1]), (None, "only here"), (7, base[0].upper()), (7, "another")]


def test_near_duplicates(spark):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, fp string, component_id int, node int")
    found = simhash.near_duplicates(docs).collect()
    fps = [plain_fingerprint(t) for _, t in rows]
    pairs = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 3]
    root = closure(set(fps), pairs)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    expected = sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps)), key=str)
    assert sorted((tuple(x) for x in found), key=str) == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = near_texts()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, fp_of_row string")
    found = simhash.one_of_each(docs, similarity=None)
    assert found.columns == simhash.one_of_each(docs).columns == docs.columns
    kept = [(r.doc_id, r.text) for r in found.collect()]
    # ids may repeat between groups, so groups are told apart by their fingerprints
    fps = {plain_fingerprint(t) for _, t in rows}
    root = closure(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    groups = [root[plain_fingerprint(t)] for _, t in kept]
    assert len(groups) == len(set(groups)) and set(groups) == set(root.values())
    least = {}
    for i, t in rows:
        least.setdefault(root[plain_fingerprint(t)], []).append((i is None, i))
    assert all((i is None, i) == min(least[g], key=lambda x: (x[0], x[1] or 0)) for (i, _), g in zip(kept, groups))
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def brute(x, threshold):
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("seed", range(8))
def test_cover_trees(seed):
    r = np.random.default_rng(seed)
    d, n = int(r.integers(2, 65)), int(r.integers(1, 500))
    base = r.normal(size=(int(r.integers(1, 20)), d))
    x = base[r.integers(0, len(base), n)] + r.normal(size=(n, d)) * r.choice([0, 0.01, 0.1, 0.3, 1.0], size=(n, 1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = brute(x, 0.93)
    count, root = embeddings.link(x, None)
    expected = closure(range(n), np.argwhere(near).tolist())
    assert (count == near.sum(1)).all() and root.tolist() == [expected[i] for i in range(n)]
    if n > 1:
        near[: n // 2, : n // 2] = near[n // 2 :, n // 2 :] = False
        assert (embeddings.link(x[: n // 2], x[n // 2 :])[0] == near.sum(1)).all()


def test_a_tree_covers_its_members():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = embeddings.CoverTree(x)
    work = [tree.root]
    while work:
        node = work.pop()
        assert np.linalg.norm(x[tree.members(node)] - x[node.centre], axis=1).max() <= node.radius + 1e-7
        if node.children:
            assert node.children[0].centre == node.centre
            assert sorted(m for c in node.children for m in tree.members(c)) == sorted(tree.members(node))
            assert all(c.radius <= node.radius + 1e-7 for c in node.children)
        work += node.children


@pytest.mark.parametrize("block, pivots", [(2048, 4096), (16, 4096), (16, 3)])
def test_near_duplicate_embeddings(spark, block, pivots):
    r = np.random.default_rng(3)
    rows = []
    for i in range(240):
        base = np.random.default_rng(int(r.integers(0, 12))).normal(size=16)
        rows.append((i, [float(v) for v in base + r.normal(size=16) * float(r.choice([0.0, 0.05, 0.3, 1.0]))], int(r.integers(0, 2)) if i % 9 else None))
    hot = [1.0] * 16
    rows += [(500 + i, [*hot[:15], 1.0 + i / 1e4], 1) for i in range(60)] + [(500, hot, 1), (None, hot, 1)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0, None], 1), (905, [1.0, 1.0], 1), (906, [float("inf")] * 16, 1), (907, [1e-200] * 16, 1)]
    vectors = spark.createDataFrame([(*x, "e", 1) for x in rows], "vec_id long, embedding array<double>, label int, row string, u int").repartition(3)
    found = embeddings.near_duplicates(vectors, block=block, max_pivots=pivots)
    units = [embeddings.unit(v) for _, v, _ in rows]

    def linked(i, j):
        a, b = units[i], units[j]
        same = rows[i][2] is not None and rows[i][2] == rows[j][2]
        return i != j and same and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.93

    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if linked(i, j)]
    root = closure(range(len(rows)), pairs)
    count = np.bincount([i for i, _ in pairs], minlength=len(rows))
    least = {}
    for i, x in enumerate(rows):
        if x[0] is not None:
            least[root[i]] = min(least.get(root[i], x[0]), x[0])
    expected = [(x[0], int(count[i]), least[root[i]], x[0] == least[root[i]]) for i, x in enumerate(rows)]
    assert sorted(map(str, (tuple(x) for x in found.collect()))) == sorted(map(str, expected))
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


def test_equal_vectors_are_looked_at_once(spark):
    v = F.array(*[F.lit(float(i)) for i in range(1, 9)])
    scaled = spark.range(20_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, v).otherwise(F.transform(v, lambda x: x * 4)).alias("embedding"), F.lit(1).alias("label"))
    other = spark.createDataFrame([(30_000, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0], 1), (30_001, [-1.0] * 8, 1)], "vec_id long, embedding array<double>, label int")
    found = embeddings.near_duplicates(scaled.union(other), block=64)
    states = found.groupBy("n_links", "component_id").count().collect()
    assert sorted(tuple(x) for x in states) == [(0, 30_001, 1), (20_000, 0, 20_001)]
    rows = embeddings.units(scaled.union(other).withColumnRenamed("vec_id", "row"))
    distinct = rows.groupBy("label", "length", "u").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    # what is shuffled by pairs of blocks is in proportion to the distinct vectors
    assert distinct.count() <= 4


def test_floats_are_compared_in_double_precision(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(5)], "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: r.n_links for r in embeddings.near_duplicates(vectors).collect()} == {0: 0, 1: 1, 2: 3, 3: 2, 4: 2}


def test_unused_names(spark):
    assert unused(spark.createDataFrame([(1, 2)], "a int, B int"), "a", "b", "c") == ["a_", "b_", "c"]


def jaccard(a, b):
    def runs(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    x, y = runs(a), runs(b)
    return len(x & y) / max(1, len(x | y))


def test_similar_documents_are_one_group(spark):
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(25):
        base = [str(w) for w in r.choice(words, int(r.integers(60, 400)))]
        texts.append(" ".join(base))
        for share in (0.003, 0.01, 0.02, 0.06):
            texts.append(" ".join("new" + str(int(r.integers(0, 9999))) if r.random() < share else w for w in base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in simhash.one_of_each(docs).collect()}
    similar = [(a, b) for a in range(len(texts)) for b in range(a) if a // 5 == b // 5 and jaccard(texts[a], texts[b]) >= 0.8]
    root = closure(range(len(texts)), similar)
    # nothing goes that isn't similar to something that stays, and nine in ten of those that are go
    groups = set(root.values())
    assert {root[i] for i in kept} == groups and len(groups) < 0.5 * len(texts)
    assert len(texts) - len(kept) >= 0.9 * (len(texts) - len(groups))
    assert len(simhash.one_of_each(docs, similarity=None).collect()) > len(kept)


def test_shingle_sets():
    assert simhash.shingle_set(None).tolist() == simhash.shingle_set(" ").tolist() == []
    assert len(simhash.shingle_set("a b")) == 1 and len(simhash.shingle_set("a b c d e f a b c d e")) == 6
    assert simhash.shingle_set("A b c d e").tolist() == simhash.shingle_set("a  B\nc d e").tolist()


def test_similar_documents_are_compared_beyond_one_partner(spark):
    # the same words in another order: one word-set fingerprint, of whose texts only the smallest was compared
    r = np.random.default_rng(5)
    texts = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(120)]
        for _ in range(3):
            base = [str(w) for w in r.permutation(words)]
            swapped = list(base)
            # swapped words break up to ten of 116 shingles
            swapped[40], swapped[41] = swapped[41], swapped[40]
            swapped[80], swapped[81] = swapped[81], swapped[80]
            texts += [" ".join(base), " ".join(swapped)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in simhash.one_of_each(docs).collect()}
    similar = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(similar) == 36 and kept == set(range(0, 72, 2))
