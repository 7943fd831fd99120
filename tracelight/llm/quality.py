"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are bins of what it is made of
(letters, capitals, symbols, repeated words and so on); its emission score adds
the weights of its own features and, with weights of their own, those of the
line before and the line after. Transition weights link neighbouring labels.
The forward-backward algorithm gives each line's probability of being good;
the mean of those, weighted by line length, is the document's quality, which a
logistic curve with two parameters turns into a probability.

Labels are known for documents only. Lines start with their document's label;
a first fit sees each line alone, lines of bad documents that look good by
themselves are relabelled, and the field is then fitted to those labels, so that
its links learn where labels change within a document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelight.llm.common import crc_bucket, cut, slices, table, with_ids

#: Labelled documents that a model learns from, whatever the size of the corpus, of at most so many characters each.
SAMPLE = 3000
SAMPLE_CHARS = 200_000
#: Code points that are worked on at a time.
PIECE = 1 << 20
#: Lines whose features are held at a time.
LINES = 1 << 16
#: Characters and lines of the fitting sample, at most; labelled texts beyond them, in the order of a hash of their ids, are left out.
SAMPLE_TOTAL, SAMPLE_LINES = 60_000_000, 400_000

OTHER, LOWER, UPPER, LETTER, DIGIT, SPACE, POINT, BANG, PIPE, SYMBOL = range(10)
CLASSES = 10
POINTS = ".,;:'\"()-?¿¡«»’‘“”–—…"
#: Upper edges of the bins of each feature.
EDGES = {
    "length": (0, 10, 30, 80, 200, 600, 2000),
    "words": (0, 1, 3, 8, 20, 60),
    "letters": (0.3, 0.5, 0.65, 0.75, 0.85),
    "capitals": (0.005, 0.05, 0.15, 0.4, 0.7),
    "digits": (0.0, 0.02, 0.1, 0.3),
    "points": (0.0, 0.01, 0.03, 0.08, 0.2),
    "bangs": (0.0, 0.01, 0.05),
    "pipes": (0.0, 0.01, 0.05),
    "symbols": (0.0, 0.01, 0.04, 0.1, 0.25),
    "word_length": (2.5, 4.0, 5.5, 7.5, 11.0),
    "repeats": (0.0, 0.05, 0.2, 0.35),
    "marked": (0.0, 0.05, 0.2, 0.5),
    "others": (0.0, 0.02, 0.2),
}
WIDTH = sum(len(e) + 1 for e in EDGES.values()) + 3

_classes: np.ndarray | None = None
_powers = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, dtype=np.uint64))


def classes() -> np.ndarray:
    """For each code point, the class it counts as."""
    global _classes
    if _classes is None:
        out = np.zeros(sys.maxunicode + 1, np.uint8)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                out[i] = UPPER if c.isupper() else LOWER if c.islower() else LETTER
            elif c.isdigit():
                out[i] = DIGIT
            elif c.isspace():
                out[i] = SPACE
            elif 32 < i < 127:
                out[i] = SYMBOL
        for c in POINTS:
            out[ord(c)] = POINT
        out[ord("!")], out[ord("|")] = BANG, PIPE
        _classes = out
    return _classes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def line_counts(codes: np.ndarray) -> np.ndarray:
    """Of each line in a piece (the last may go on in the next): counts by class, words, repeats of the word before, words that end in two symbols."""
    kind = classes()[codes]
    breaks = codes == 10
    line = np.cumsum(breaks) - breaks
    n = int(line[-1]) + 1
    by_class = np.bincount(line * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    by_class[:, SPACE] -= np.bincount(line[breaks], minlength=n)
    solid = kind != SPACE
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.concatenate([by_class, np.zeros((n, 3), np.int64)], axis=1)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = np.flatnonzero(last)
    word = np.cumsum(first) - 1
    place = np.arange(len(codes)) - starts[np.maximum(word, 0)]
    hashes = np.add.reduceat(np.where(solid, codes.astype(np.uint64) * _powers[place & 255], np.uint64(0)), starts)
    of_line = line[starts]
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_line[1:] == of_line[:-1])
    odd = (kind == SYMBOL) | (kind == BANG)
    marked = odd[ends] & odd[np.maximum(ends - 1, 0)] & (ends > starts)
    count = lambda which: np.bincount(of_line[which], minlength=n)[:, None]
    return np.concatenate([by_class, count(slice(None)), count(again), count(marked)], axis=1)


def long_counts(text: str) -> np.ndarray:
    """``line_counts`` of a text of any length, a bounded part at a time; a word that a cut divides counts as two."""
    found, unfinished = [], False
    for at in range(0, len(text), PIECE):
        part = text[at : at + PIECE]
        counts = line_counts(code_points(part))
        if unfinished:
            found[-1][-1] += counts[0]
            counts = counts[1:]
        if len(counts):
            found.append(counts)
        unfinished = part[-1] != "\n"
    if not unfinished:
        found.append(np.zeros((1, CLASSES + 3), np.int64))
    return np.concatenate(found)


def document_lines(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole texts in order, a group at a time: the counts of their lines, and how many lines each has (one at least)."""
    held, size = [], 0

    def group() -> tuple[np.ndarray, np.ndarray]:
        lines = np.array([t.count("\n") + 1 for t in held])
        return line_counts(code_points("\n".join(held) + "\n")), lines

    for t in texts:
        t = t or ""
        if held and size + len(t) > PIECE:
            yield group()
            held, size = [], 0
        if len(t) > PIECE:
            counts = long_counts(t)
            yield counts, np.array([len(counts)])
        else:
            held.append(t)
            size += len(t) + 1
    if held:
        yield group()


def features(counts: np.ndarray) -> np.ndarray:
    """One row of zeros and ones per line."""
    by_class = counts[:, :CLASSES].astype(np.float64)
    words, again, marked = (counts[:, CLASSES + i].astype(np.float64) for i in range(3))
    n = by_class.sum(axis=1)
    solid = np.maximum(n - by_class[:, SPACE], 1)
    letters = by_class[:, LOWER] + by_class[:, UPPER] + by_class[:, LETTER]
    some = np.maximum(words, 1)
    values = {
        "length": n,
        "words": words,
        "letters": letters / solid,
        "capitals": by_class[:, UPPER] / np.maximum(letters, 1),
        "digits": by_class[:, DIGIT] / solid,
        "points": by_class[:, POINT] / solid,
        "bangs": by_class[:, BANG] / solid,
        "pipes": by_class[:, PIPE] / solid,
        "symbols": by_class[:, SYMBOL] / solid,
        "word_length": solid / some,
        "repeats": again / some,
        "marked": marked / some,
        "others": by_class[:, OTHER] / solid,
    }
    out = np.zeros((len(counts), WIDTH), np.float32)
    at = 0
    for name, edges in EDGES.items():
        out[np.arange(len(counts)), at + np.searchsorted(edges, values[name], side="left")] = 1
        at += len(edges) + 1
    out[:, at] = 1
    out[:, at + 1] = n == 0
    out[:, at + 2] = words > 0
    return out


@dataclass
class Model:
    #: weights of a line's own features, of the line before's and of the line after's, for good over bad
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    #: log weights of a label (0 bad, 1 good) after a label
    links: np.ndarray
    #: of the logistic curve over the logit of the weighted mean
    slope: float = 1.0
    offset: float = 0.0

    def emissions(self, x: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Of each line, the score for good over bad. Lines of different documents are no neighbours."""
        return self.joined(np.stack([x @ w for w in (self.own, self.before, self.after)]), lines)

    def emissions_of(self, counts: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """``emissions`` of the lines' counts, whose features are made some lines at a time."""
        looks = np.empty((3, len(counts)))
        for i in range(0, len(counts), LINES):
            x = features(counts[i : i + LINES])
            for j, w in enumerate((self.own, self.before, self.after)):
                looks[j, i : i + LINES] = x @ w
        return self.joined(looks, lines)

    def joined(self, looks: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Of each line, what it, the line before and the line after say."""
        own, back, ahead = looks
        first = np.concatenate(([0], np.cumsum(lines)[:-1]))
        last = np.cumsum(lines) - 1
        from_before = np.concatenate(([0], back[:-1]))
        from_before[first] = 0
        from_after = np.concatenate((ahead[1:], [0]))
        from_after[last] = 0
        return own + from_before + from_after


def marginals(emit: np.ndarray, lines: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: each line's probability of good, and the expected counts of label pairs.

    Documents go by falling length, so those that still have a line at some
    step are the first ones.
    """
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    sizes = lines[order]
    most = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(most), side="left")
    odds = np.exp(np.clip(emit, -30, 30))
    move = np.exp(links)
    total = len(emit)
    forward = np.empty((total, 2))
    a = np.stack([np.ones(len(first)), odds[first]], axis=1)
    a /= a.sum(axis=1, keepdims=True)
    forward[first] = a
    for t in range(1, most):
        at = first[: alive[t]] + t
        a = a[: alive[t]] @ move
        a[:, 1] *= odds[at]
        a /= a.sum(axis=1, keepdims=True)
        forward[at] = a
    good = np.empty(total)
    pairs = np.zeros((2, 2))
    b = np.ones((len(first), 2))
    for t in range(most - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        p = forward[at] * b[:n]
        p /= p.sum(axis=1, keepdims=True)
        good[at] = p[:, 1]
        if t:
            e = b[:n].copy()
            e[:, 1] *= odds[at]
            joint = forward[at - 1][:, :, None] * move[None] * e[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            e = e @ move.T
            b[:n] = e / e.sum(axis=1, keepdims=True)
    return good, pairs


def weighted_means(good: np.ndarray, lengths: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The mean of a document's line probabilities, weighted by length; without any character, by line."""
    first = np.cumsum(lines) - lines
    weight = np.add.reduceat(lengths, first)
    bare = np.repeat(weight == 0, lines)
    weights = np.where(bare, 1.0, lengths)
    return np.add.reduceat(good * weights, first) / np.add.reduceat(weights, first)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_field(
    x: np.ndarray, lines: np.ndarray, y: np.ndarray, steps: int, alone: bool = False, penalty: float = 0.05, rate: float = 0.1
) -> Model:
    """Weights of the greatest penalised likelihood of the line labels ``y``, by Adam on the whole sample.

    With ``alone``, lines have neither neighbours nor links.
    """
    zero = lambda: np.zeros(x.shape[1])
    m = Model(zero(), zero(), zero(), np.zeros((2, 2)))
    first, last = np.cumsum(lines) - lines, np.cumsum(lines) - 1
    inner = np.ones(len(y), bool)
    inner[first] = False
    told = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(told, (y[at - 1].astype(int), y[at].astype(int)), 1)
    x_before = np.concatenate((x[:1] * 0, x[:-1]))
    x_before[first] = 0
    x_after = np.concatenate((x[1:], x[:1] * 0))
    x_after[last] = 0
    params = [m.own, m.before, m.after, m.links]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        good, pairs = marginals(m.emissions(x, lines), lines, m.links)
        gap = y - good
        slopes = [gap @ x, gap @ x_before, gap @ x_after, told - pairs]
        for p, g, u, v in list(zip(params, slopes, mean, square))[: 1 if alone else None]:
            g = (g - penalty * p) / len(y)
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            p += rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return m


def train(texts: list[str | None], good: list[int], steps: int = 200) -> Model:
    """A model of labelled documents. One label only, or no rows, gives a model whose score is that share (or a half)."""
    y = np.array(good, dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(good)) < 2:
        none = np.zeros(WIDTH)
        return Model(none, none, none, np.zeros((2, 2)), 0.0, float(logit(np.array(share))))
    groups = list(document_lines(texts))
    counts, lines = np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])
    x, lengths = features(counts).astype(np.float64), counts[:, :CLASSES].sum(axis=1).astype(np.float64)
    of_document = np.repeat(y, lines)
    m = fit_field(x, lines, of_document, steps, alone=True)
    looks, _ = marginals(m.emissions(x, lines), lines, m.links)
    m = fit_field(x, lines, np.where((of_document == 0) & (looks > 0.8), 1.0, of_document), steps)
    looks, _ = marginals(m.emissions(x, lines), lines, m.links)
    z = logit(weighted_means(looks, lengths, lines))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-9
        design = np.stack([z, np.ones_like(z)], axis=1)
        slope = design.T @ (y - p) - 0.01 * np.array([a - 1, b])
        step = np.linalg.solve((design * w[:, None]).T @ design + 0.01 * np.eye(2), slope)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    m.slope, m.offset = max(float(a), 0.0), float(b)
    return m


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """The probability of label 1 of each whole text; null and empty texts are one line without characters."""
    out = []
    for counts, lines in document_lines(texts):
        good, _ = marginals(model.emissions_of(counts, lines), lines, model.links)
        mean = weighted_means(good, counts[:, :CLASSES].sum(axis=1).astype(np.float64), lines)
        out.append(1 / (1 + np.exp(-(model.slope * logit(mean) + model.offset))))
    return np.concatenate(out) if out else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, seed: int = 11) -> Model:
    """A model of at most ``limit`` labelled documents, chosen by a hash of the id; only their texts come to the driver.

    A document with several labels counts by the lowest; null labels and ids,
    and labels without a document, are passed over; of documents with the same
    id, however many, one counts: that of the least text.
    """
    chosen = (
        with_ids(labels, "doc_id", "quality")
        .where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(limit)
        .collect()
    )
    # at most ``limit`` ids, so they can stand in the plan
    marks = docs.sparkSession.createDataFrame([(r[0], int(r[1] > 0)) for r in chosen], "doc_id long, good int")
    rows = with_ids(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id")
    rows = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    rows = rows.groupBy("doc_id", "good").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    ahead = Window.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # of at most ``limit`` rows, those that come first by the hash and are short enough together
    rows = cut(rows.withColumns({"chars": F.length("text").cast("long"), "lines": F.regexp_count("text", F.lit("\n")) + 1}))
    fits = rows.select("doc_id", F.sum("chars").over(ahead).alias("c"), F.sum("lines").over(ahead).alias("l"))
    fits = fits.where((F.col("c") <= SAMPLE_TOTAL) & (F.col("l") <= SAMPLE_LINES)).select("doc_id")
    rows = rows.join(F.broadcast(fits), "doc_id").select("doc_id", "good", "text").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))
    return train([r["text"] for r in rows], [r["good"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id``, ``score``.

    Whole texts are read once and never shuffled. A null or empty text is
    scored as an empty line; rows that repeat are each scored; no rows give no
    rows; extra columns are ignored. A very long text takes time and memory in proportion to its
    lines: about 200 bytes and 25 microseconds a line besides the text itself.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        for batch in slices(it):
            found = scores(shipped.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return with_ids(docs, "doc_id", "text").mapInArrow(batches, "doc_id long, score double")


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is at least ``threshold``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def batches(it):
        for batch in slices(it):
            yield batch.filter(pa.array(scores(shipped.value, batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(batches, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(crc_bucket("doc_id", 5) != 0))
    return score(docs, model).select(
        "doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
