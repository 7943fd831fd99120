"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, everything but letters becomes a space, and each
character n-gram of one to four characters (spaces mark where words begin and
end) is hashed to a row of an embedding table. The rows' mean goes through a
linear layer and a softmax. Embeddings and layer are trained together by
stochastic gradient descent in numpy on a bounded sample; the confidence is
calibrated by a temperature fitted on a part of the sample that training
doesn't see, and the rejection threshold is the confidence that all but a
small share of that part's rightly labelled texts reach, and a half at most.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm.common import crc_bucket, slices, table, with_ids

BUCKET_BITS = 16
ORDERS = (1, 2, 3, 4)
DIMENSIONS = 16
#: Texts that a model learns from: about so many per language, whatever the size of the corpus, of at most so many characters each.
SAMPLE_PER_LANGUAGE = 600
SAMPLE_CHARS = 200_000
#: Languages that a model tells apart at most; its tables grow with their number.
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: Of rightly labelled held-back texts, the share that calibration lets go.
REJECT_SHARE = 0.0005

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return _letters


def normalised(text: str | None) -> np.ndarray:
    """The lower-cased code points, each run of non-letters one zero, with a zero at either end; empty if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(is_letter, codes, 0).astype(np.uint32)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def buckets(codes: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """The table rows of all n-grams of normalised code points, repeats included, a bounded piece at a time."""
    longest = max(orders)
    for at in range(0, len(codes), chunk):
        wide = codes[at : at + chunk + longest - 1].astype(np.uint64)
        rolling = np.zeros(len(wide), np.uint64)
        for n in range(1, min(longest, len(wide)) + 1):
            rolling = rolling[: len(wide) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :] + np.uint64(n)
            if n in orders:
                mixed = rolling[:chunk]
                mixed = mixed ^ (mixed >> np.uint64(29))
                yield ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    #: embeddings times the linear layer: what a table row adds to each language's score
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    orders: tuple[int, ...] = ORDERS

    def logits(self, text: str | None) -> np.ndarray | None:
        bits, total, n = int(np.log2(len(self.scores))), np.zeros(len(self.languages)), 0
        for rows in buckets(normalised(text), self.orders, bits):
            total += self.scores[rows].sum(axis=0, dtype=np.float64)
            n += len(rows)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the calibrated confidence in it; ``und`` and 0 where the text has no letter."""
        z = self.logits(text) if self.languages else None
        if z is None:
            return UNKNOWN, 0.0
        z = (z - z.max()) / self.temperature
        p = np.exp(z)
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())

    def rejects(self, said: tuple[str, float]) -> bool:
        return said[0] == UNKNOWN or said[1] < self.threshold


def train(texts: list[str], langs: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 5, orders=ORDERS, bits: int = BUCKET_BITS) -> Model:
    """Stochastic gradient descent, one text a step, over whole texts and a few words of each. Every sixth is held back for calibration.

    Texts without letters are passed over. One language or none gives a model
    that always answers it (or ``und``).
    """
    languages = sorted(set(langs))
    label = {x: i for i, x in enumerate(languages)}
    random = np.random.default_rng(seed)
    rows, short = [], []
    for t, g in zip(texts, langs):
        words = t.split()
        if len(words) > 1:
            # a few words in a row, so that short texts are learnt as well
            at, n = int(random.integers(len(words))), int(random.integers(1, 8))
            short.append((" ".join(words[at : at + n]), g))
    for t, g in [*zip(texts, langs), *short]:
        grams = list(buckets(normalised(t), orders, bits))
        if grams:
            ids, n = np.unique(np.concatenate(grams), return_counts=True)
            rows.append((t, label[g], ids, (n / n.sum()).astype(np.float32)))
    k = len(languages)
    # small, so that n-grams which training never sees say next to nothing, and texts of them are rejected
    embed = random.normal(0, 0.02, (1 << bits, DIMENSIONS)).astype(np.float32)
    layer = random.normal(0, 0.3, (DIMENSIONS, k)).astype(np.float32)
    bias = np.zeros(k, np.float32)
    order = random.permutation(len(rows))
    held, learnt = order[::6], np.setdiff1d(order, order[::6])
    if not len(learnt):
        learnt = order
    total, step = max(1, epochs * len(learnt)), 0
    for _ in range(epochs):
        for i in random.permutation(learnt):
            _, y, ids, share = rows[i]
            lr = rate * (1 - step / total)
            step += 1
            mean = share @ embed[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            down = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= lr * p
            # a text spreads its step over its n-grams, so the table learns at a higher rate than the layer
            embed[ids] -= (lr * 20 * share)[:, None] * down
    model = Model(languages, (embed @ layer).astype(np.float32), bias.astype(np.float64), orders=tuple(orders))
    calibrate(model, [(rows[i][0], rows[i][1]) for i in (held if len(held) else order)])
    return model


def calibrate(model: Model, held: list[tuple[str, int]], reject_share: float = REJECT_SHARE) -> None:
    """The temperature with the best held-back likelihood, and the confidence that all but ``reject_share`` of the right answers reach."""
    found = [(model.logits(t), y) for t, y in held]
    found = [(z, y) for z, y in found if z is not None]
    if not found:
        return
    z, y = np.array([a for a, _ in found]), np.array([b for _, b in found])

    def likelihood(t: float) -> float:
        s = z / t
        s -= s.max(axis=1, keepdims=True)
        return float((s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).sum())

    model.temperature = float(max(np.geomspace(0.3, 6, 41), key=likelihood))
    s = z / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    if len(right):
        # held-back texts are few and clean ones are not to go: a language that holds half of the confidence is never rejected
        model.threshold = min(0.5, float(right[int(reject_share * len(right))]))


def sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, seed: int = 3, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """About ``per_language`` rows ``doc_id``, ``text``, ``lang`` of each language, chosen by a hash of the id: a bounded sample for the driver.

    Of more than ``max_languages`` languages, those with the most rows are learnt (of two with as many, the lesser name).
    Of rows with the same id, however many, one is taken: that of the least text.
    """
    rows = with_ids(docs, "doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(F.length("text") <= SAMPLE_CHARS)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    limits = {r["lang"]: min(1.0, per_language / r["n"]) for r in counts.collect()}
    if not limits:
        return rows.limit(0)
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    drawn = rows.where(draw < F.element_at(limit, F.col("lang")))
    return drawn.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.text", "row.lang")


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of a bounded sample of the labelled rows, in an order that doesn't depend on partitions."""
    rows = sorted(sample(docs, per_language).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id``, ``lang_pred``, ``score``, ``rejected``.

    Whole texts are read. A null, empty or letterless text is ``und`` with
    score 0 and rejected; others are rejected below the model's threshold.
    Rows that repeat are each scored; no rows give no rows; extra columns are
    ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        m = shipped.value
        for batch in slices(it):
            said = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([s[0] for s in said], pa.string()),
                    pa.array([s[1] for s in said], pa.float64()),
                    pa.array([m.rejects(s) for s in said], pa.bool_()),
                ],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return with_ids(docs, "doc_id", "text").mapInArrow(batches, "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the model doesn't reject."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def batches(it):
        m = shipped.value
        for batch in slices(it):
            yield batch.filter(pa.array([not m.rejects(m.predict(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(batches, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_bucket("doc_id", 4) != 2))
    said = identify(docs, model)
    return said.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
