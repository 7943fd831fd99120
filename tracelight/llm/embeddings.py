"""Exact near-duplicate pairs of embeddings by dual traversal of cover trees.

Unit vectors with a cosine of at least c are at a Euclidean distance of at
most sqrt(2 - 2c). Vectors of one label (and one length) are the points of a
cover tree: its levels are nested (a node's first child has the node's own
centre) and their radii halve. Two nodes whose centres are further apart than
that distance plus both covering radii hold no pair; if the distance of the
centres plus both radii is below it, all their members are pairs, and these are
counted without being listed.

A label's points can be too many for one task. The tree's upper part is
then a bounded set of pivots: each point belongs to the cell of its nearest pivot,
cells have covering radii like any node, and pairs of cells that the radii
rule out are never formed. Cells of more than a block are split by a hash.
Each remaining pair of blocks is one task, which builds the two lower trees and
traverses them together. Tasks return, for each vector, how many links it has and
one vector of its component: rows in proportion to the vectors, whatever
the number of pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm.common import components, cut, table

THRESHOLD = 0.93
#: Vectors that a block holds at most, about.
BLOCK = 2048
#: Pivots of all labels together, at most.
MAX_PIVOTS = 4096
#: Members that a node of the tree isn't divided below.
LEAF = 24
#: Slack of the bounds, far above rounding; pairs within it are compared exactly.
SLACK = 1e-7


def unit(vector) -> np.ndarray | None:
    """The vector at length 1 in double precision; none if it is null, empty, zero or holds null or non-finite components."""
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    v = np.asarray(vector, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    largest = np.abs(v).max()
    if largest == 0:
        return None
    if not 1e-140 < largest < 1e140:
        v = v / largest
    return v / math.sqrt(float(v @ v))


def gap(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


@dataclass
class Node:
    centre: int
    #: largest distance of a member from the centre
    radius: float
    #: where the members stand in the tree's order
    begin: int
    end: int
    children: list[Node] = field(default_factory=list)
    joined: bool = False


class CoverTree:
    """A cover tree of the rows of ``x``, unit vectors, all of which the root covers."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        d = gap(x @ x[0])
        self.root = Node(0, float(d.max()), 0, len(x))
        # radii halve from the least power of two that covers all
        work = [(self.root, d, 2.0 ** math.ceil(math.log2(max(self.root.radius, 1e-12))))]
        while work:
            node, far, level = work.pop()
            n = node.end - node.begin
            if n <= LEAF or node.radius <= SLACK:
                continue
            while node.radius <= level / 2:
                level /= 2
            level /= 2
            members = self.order[node.begin : node.end].copy()
            at = node.begin
            centre, distance = node.centre, far
            while len(members):
                near = distance <= level
                own, own_far = members[near], distance[near]
                child = Node(int(centre), float(own_far.max()), at, at + len(own))
                self.order[at : child.end] = own
                at = child.end
                node.children.append(child)
                work.append((child, own_far, level))
                members = members[~near]
                if len(members):
                    centre = members[0]
                    distance = gap(x[members] @ x[centre])
                    # a point is its own centre whatever rounding says
                    distance[0] = 0.0

    def members(self, node: Node) -> np.ndarray:
        return self.order[node.begin : node.end]


class Links:
    """Link counts and components of points that are found to be linked, without a list of the links.

    A point stands for ``weight`` vectors; those of the other point count.
    """

    def __init__(self, n: int, weight: np.ndarray | None = None):
        self.count = np.zeros(n, np.int64)
        self.weight = np.ones(n, np.int64) if weight is None else weight
        self.root = np.arange(n)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.held += len(a)
        if self.held > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        a, b = (np.concatenate(s) for s in zip(*self.waiting))
        self.waiting, self.held = [], 0
        while len(a):
            ra, rb = self.root[a], self.root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(self.root, above := self.root[self.root]):
                self.root = above


def traverse(a: CoverTree, b: CoverTree, threshold: float, links: Links, offset: int) -> None:
    """Finds all linked pairs between two trees, or within one if they are the same.

    Points of ``b`` are numbered from ``offset`` on in ``links``.
    """
    same = a is b
    reach = float(gap(np.array(threshold)))

    def connect(tree: CoverTree, node: Node, shift: int) -> None:
        if not node.joined and node.end - node.begin > 1:
            own = tree.members(node) + shift
            links.join(np.full(len(own), own[0]), own)
        node.joined = True

    def all_pairs(p: Node, q: Node) -> None:
        own, other = a.members(p), b.members(q) + offset
        if p is q:
            links.count[own] += links.weight[own].sum() - links.weight[own]
        else:
            links.count[own] += links.weight[other].sum()
            links.count[other] += links.weight[own].sum()
            connect(b, q, offset)
            links.join(own[:1], other[:1])
        connect(a, p, 0)

    def compare(p: Node, q: Node) -> None:
        own, other = a.members(p), b.members(q)
        linked = a.x[own] @ b.x[other].T >= threshold
        if p is q:
            linked = np.triu(linked, 1)
        i, j = np.nonzero(linked)
        if len(i):
            i, j = own[i], other[j] + offset
            np.add.at(links.count, i, links.weight[j])
            np.add.at(links.count, j, links.weight[i])
            links.join(i, j)

    work = [(a.root, b.root)]
    while work:
        p, q = work.pop()
        if p is q and 2 * p.radius <= reach - SLACK:
            # every two members are within two radii
            all_pairs(p, q)
            continue
        if not p.children and not q.children:
            compare(p, q)
            continue
        # the larger node is divided, or both if they are about as large
        split_p = bool(p.children) and (p is q or not q.children or p.radius >= q.radius / 2)
        split_q = bool(q.children) and (p is q or not p.children or q.radius >= p.radius / 2)
        ps, qs = p.children if split_p else [p], q.children if split_q else [q]
        rp, rq = np.array([c.radius for c in ps]), np.array([c.radius for c in qs])
        cp, cq = np.array([c.centre for c in ps]), np.array([c.centre for c in qs])
        for at in range(0, len(ps), 256):
            rows = slice(at, at + 256)
            cosines = a.x[cp[rows]] @ b.x[cq].T
            distance = gap(cosines)
            slack = rp[rows, None] + rq[None, :]
            maybe = distance - slack <= reach + SLACK
            if p is q:
                maybe &= np.arange(len(qs))[None, :] >= (np.arange(len(ps))[rows])[:, None]
            sizes = np.array([c.end - c.begin for c in ps[rows]])[:, None] * np.array([c.end - c.begin for c in qs])[None, :]
            single = maybe & (sizes == 1)
            i, j = np.nonzero(single & (cosines >= threshold))
            if len(i):
                i, j = cp[rows][i], cq[j] + offset
                keep = i != j if same else slice(None)
                i, j = i[keep], j[keep]
                np.add.at(links.count, i, links.weight[j])
                np.add.at(links.count, j, links.weight[i])
                links.join(i, j)
            for i, j in np.argwhere(maybe & ~single).tolist():
                u, v = ps[at + i], qs[j]
                if u is not v and distance[i, j] + slack[i, j] <= reach - SLACK:
                    all_pairs(u, v)
                else:
                    work.append((u, v))


def link(x: np.ndarray, y: np.ndarray | None, threshold: float = THRESHOLD, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of ``x`` and then of ``y``, the links between the two (or within ``x``): how many, and the first row of the component."""
    links = Links(len(x) + (0 if y is None else len(y)), weight)
    a = CoverTree(x)
    if y is None:
        traverse(a, a, threshold, links, 0)
    else:
        traverse(a, CoverTree(y), threshold, links, len(x))
    links.settle()
    return links.count, links.root


@dataclass
class Cells:
    """The upper part of a label's tree."""

    pivots: np.ndarray
    radii: np.ndarray
    #: blocks of each cell, and the number of its first one
    blocks: np.ndarray
    first: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        return gap(x @ self.pivots.T)


#: Columns of the vectors while they are worked on; ``row`` tells rows with the same id apart.
UNITS = "row long, label long, length int, u binary"


def units(rows: DataFrame) -> DataFrame:
    """``row``, ``label``, ``length`` and the unit vector's doubles, of the rows that can be linked."""

    def batches(it):
        for batch in it:
            row, label, vector = (batch.column(i).to_pylist() for i in range(3))
            found = [(r, g, v) for r, g, v in zip(row, label, map(unit, vector)) if g is not None and v is not None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([len(f[2]) for f in found], pa.int32()),
                    pa.array([f[2].tobytes() for f in found], pa.binary()),
                ],
                names=["row", "label", "length", "u"],
            )

    return rows.select("row", F.col("label").cast("long"), "embedding").mapInArrow(batches, UNITS)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, length)


def by_group(batch: pa.RecordBatch):
    """The rows of each label and length in a batch: the two, and the rows' places."""
    label, length = batch.column("label").to_numpy(), batch.column("length").to_numpy()
    both = np.stack([label, length], axis=1)
    groups, of = np.unique(both, axis=0, return_inverse=True)
    for k, g in enumerate(groups.tolist()):
        yield tuple(g), np.flatnonzero(of.reshape(-1) == k)


def plan_cells(points: DataFrame, block: int, max_pivots: int, seed: int) -> dict[tuple[int, int], Cells]:
    """The cells of every label that is larger than a block: a list as long as vectors / block at most, and ``max_pivots`` pivots at most."""
    large = points.groupBy("label", "length").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()
    if not large:
        return {}
    total = sum(r["n"] for r in large)
    per_cell = max(block, math.ceil(total / max_pivots * 2))
    wanted = {(r["label"], r["length"]): max(1, r["n"] // per_cell) for r in large}
    # a hash draws somewhat more than the pivots that are wanted
    draw = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    marks = points.sparkSession.createDataFrame(
        [(r["label"], r["length"], min(1.0, (3 * wanted[r["label"], r["length"]] + 20) / r["n"])) for r in large], "label long, length int, share double"
    )
    drawn = points.join(marks, ["label", "length"]).where(draw < F.col("share")).select("row", "label", "length", "u").collect()
    drawn.sort(key=lambda r: r["row"])
    pivots: dict[tuple[int, int], list] = {}
    for r in drawn:
        own = pivots.setdefault((r["label"], r["length"]), [])
        if len(own) < wanted[r["label"], r["length"]]:
            own.append(np.frombuffer(r["u"], np.float64))
    found = {}
    for g in wanted:
        p = np.array(pivots[g]) if g in pivots else np.eye(1, g[1])
        zero = np.zeros(len(p), np.int64)
        found[g] = Cells(p, np.zeros(len(p)), zero, zero)
    shipped = points.sparkSession.sparkContext.broadcast(found)

    def batches(it):
        for batch in it:
            out = []
            for g, at in by_group(batch):
                cells = shipped.value.get(g)
                if cells is None:
                    continue
                d = cells.distances(matrix(batch.column("u").take(pa.array(at)), g[1]))
                near = d.argmin(axis=1)
                for c in np.unique(near).tolist():
                    own = near == c
                    out.append((*g, c, int(own.sum()), float(d[own, c].max())))
            columns = zip(*out) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["label", "length", "cell", "n", "radius"])

    sizes = points.mapInArrow(batches, "label long, length int, cell int, n long, radius double").groupBy("label", "length", "cell")
    for r in sizes.agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
        cells = found[r["label"], r["length"]]
        cells.radii = cells.radii.copy()
        cells.blocks = cells.blocks.copy()
        cells.radii[r["cell"]] = r["radius"]
        cells.blocks[r["cell"]] = math.ceil(r["n"] / block)
    for cells in found.values():
        cells.first = np.cumsum(cells.blocks) - cells.blocks
    return found


def near_links(points: DataFrame, threshold: float, block: int, max_pivots: int, seed: int = 29) -> DataFrame:
    """``row``, ``n``, ``other``: of each pair of blocks, the links that a vector has there and a vector of its component.

    ``points`` are distinct vectors; each counts as often as its ``copies`` say.
    """
    plan = points.sparkSession.sparkContext.broadcast(plan_cells(points, block, max_pivots, seed))
    reach = float(gap(np.array(threshold)))
    kinds = "label long, length int, low int, high int, row long, block int, u binary, copies long"

    def deal(it):
        for batch in it:
            place, low, high, own_block = [], [], [], []
            rows = batch.column("row").to_numpy()
            for g, at in by_group(batch):
                cells = plan.value.get(g)
                if cells is None:
                    place.append(at)
                    for s in (low, high, own_block):
                        s.append(np.zeros(len(at), np.int64))
                    continue
                d = cells.distances(matrix(batch.column("u").take(pa.array(at)), g[1]))
                near = d.argmin(axis=1)
                mixed = (rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = cells.first[near] + (mixed % cells.blocks[near].astype(np.uint64)).astype(np.int64)
                # a vector meets the blocks of each cell that can hold one of its links
                i, c = np.nonzero((d - cells.radii[None, :] <= reach + SLACK) & (cells.blocks > 0)[None, :])
                times = cells.blocks[c]
                i, c = np.repeat(i, times), np.repeat(c, times)
                step = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                other = cells.first[c] + step
                place.append(at[i])
                own_block.append(own[i])
                low.append(np.minimum(own[i], other))
                high.append(np.maximum(own[i], other))
            if not place:
                continue
            places = pa.array(np.concatenate(place))
            new = {k: pa.array(np.concatenate(v).astype(np.int32)) for k, v in (("low", low), ("high", high), ("block", own_block))}
            old = {k: batch.column(k).take(places) for k in ("label", "length", "row", "u", "copies")}
            names = [k.split()[0] for k in kinds.split(", ")]
            made = pa.RecordBatch.from_arrays([(new | old)[k] for k in names], names=names)
            for at in range(0, made.num_rows, 4096):
                yield made.slice(at, 4096)

    def match(t: pa.Table) -> pa.Table:
        length, low, high = (t.column(k)[0].as_py() for k in ("length", "low", "high"))
        row, block_of, copies = (t.column(k).to_numpy() for k in ("row", "block", "copies"))
        x = matrix(t.column("u").combine_chunks(), length)
        left = block_of == low
        if low == high:
            rows, (n, root) = row, link(x, None, threshold, copies)
        elif left.all() or not left.any():
            rows, n, root = row[:0], np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            both = np.concatenate([np.flatnonzero(left), np.flatnonzero(~left)])
            rows, (n, root) = row[both], link(x[left], x[~left], threshold, copies[both])
        some = n > 0
        return pa.table({"row": rows[some], "n": n[some], "other": rows[root[some]]})

    return points.mapInArrow(deal, kinds).groupBy("label", "length", "low", "high").applyInArrow(match, "row long, n long, other long")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, max_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors are compared where labels are equal and not null and lengths are
    equal, by cosine in double precision; vectors that are null, empty, zero or hold
    null or non-finite components link with nothing. Rows that repeat,
    their ids as well, are vectors of their own and link with each other;
    equal vectors are looked at once, however many they are.
    ``component_id`` is the smallest ``vec_id`` that links reach; null ids
    count only where there is no other. No rows give no rows; extra columns
    are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    rows = cut(vectors.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`") for c in ("vec_id", "embedding", "label")]))
    every = cut(units(rows).withColumns({"h1": F.xxhash64("u"), "h2": F.xxhash64(F.lit(1), "u")}))
    # vectors that are equal after scaling are one point: their links with each other are counted, not looked for
    same = ["label", "length", "h1", "h2"]
    points = cut(every.groupBy(*same).agg(F.min("row").alias("row"), F.first("u").alias("u"), F.count("*").alias("copies")))
    found = cut(near_links(points.drop("h1", "h2"), threshold, block, max_pivots))
    roots = components(found.select(F.col("row").alias("src"), F.col("other").alias("dst")))
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    joined = points.select(*same, "row", "copies").join(roots.withColumnRenamed("node", "row"), "row", "left").join(counts, "row", "left")
    joined = joined.select(
        *same, F.coalesce("root", "row").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    members = every.select("row", *same).join(joined, same).select("row", "root", "n_links")
    linked = rows.select("row", "vec_id").join(members, "row", "left")
    linked = linked.select("vec_id", F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return linked.join(least, "root").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS s, b.vec_id AS d FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT s, d FROM l UNION SELECT r.s, l.d FROM r JOIN l ON r.d = l.s),
c AS (SELECT s, min(d) AS lowest FROM r GROUP BY s),
n AS (SELECT s, count(*) AS n_links FROM l GROUP BY s)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(lowest, vec_id))::BIGINT AS component_id,
  least(vec_id, coalesce(lowest, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.s = vec_id LEFT JOIN n ON n.s = vec_id
"""
