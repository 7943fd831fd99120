"""Benchmark decontamination: block-max WAND over a BM25 index of the test items.

The inverted index holds the test items; every training document is a query:
its words that lie in a shingle of any item, wherever they stand, so that an
item counts however much is inserted between its parts.

An item's BM25 weights are divided by the least score that a document can
have which verification accepts (the total of the item or of its question, less its heaviest words as often as
verification lets shingles be missing: a word in no shingle that was found breaks one at least), so that a score of 1 is the threshold for
every item and nothing that would be verified is lost. Items stand in blocks by
length. A block's bound for a document is the sum of its largest weights of the
document's words; where no bound reaches 1 the document is done, and where one
does, WAND moves through the posting lists and scores only items that can still
reach 1. Items of which all words may be missing have no such bound and are verified wherever one of their shingles stands.

A retrieved item is verified on its question (all before the answer: the last ``Answer:`` or the last sentence) and
its answer. It counts as ``question and answer`` if at least 0.8 of the item's five-word shingles stand
in the document, and half of the question's and half of the answer's; else as ``question`` if
the question has eight words or more and 0.8 of its shingles stand there, whatever answer
does. An answer by itself is no leak. Questions and answers shorter than a shingle are looked for as they are, between
the item's first and last shingle there and as many words around as the item has. Items of fewer than five words
count where they stand as a whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.llm.common import slices, table, with_ids

K1, B = 1.2, 0.75
SHINGLE = 5
OVERLAP = 0.8
#: Of the question, and of the answer, where the item as a whole reaches ``OVERLAP``.
PART_OVERLAP = 0.5
#: Words that a question has at least which counts by itself.
QUESTION = 8
#: Items indexed, and sent to executors, at a time; more items are searched for in turns.
ITEMS_AT_A_TIME = 20_000
CHARS_AT_A_TIME = 20_000_000
BLOCKS = 24
#: Words of a document that are looked up at a time.
PIECE = 1 << 18

#: Scripts that put no spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han; a character is a word.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")
ANSWER_MARK = re.compile(r"\b(?:answer|a)\s*:\s*", re.I)
SENTENCE_END = re.compile(r"[.!?]\s+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[str, str]:
    """What stands before and after the last ``Answer:``, else all but the last sentence and the last; one sentence is a question."""
    marks = list(ANSWER_MARK.finditer(text))
    cuts = [m.end() for m in marks] or [m.end() for m in SENTENCE_END.finditer(text) if text[m.end() :].strip()]
    return (text[: cuts[-1]], text[cuts[-1] :]) if cuts else (text, "")


def shingles(ids: Sequence[int], n: int = SHINGLE) -> list[tuple[int, ...]]:
    """All runs of ``n`` words, repeats included; fewer words are one run."""
    if not ids:
        return []
    n = min(n, len(ids))
    return [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)]


def codes(ids: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``n`` word numbers."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out + ids[i : i + len(out)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


@dataclass(frozen=True)
class Item:
    item_id: int | None
    ids: tuple[int, ...]
    whole: tuple[tuple[int, ...], ...]
    question: tuple[tuple[int, ...], ...]
    answer: tuple[tuple[int, ...], ...]
    question_words: int


class Index:
    """The inverted index of some items; those of fewer than five words stand beside it, by their whole run of words."""

    def __init__(self, items: Sequence[tuple[int | None, str | None]], overlap: float = OVERLAP):
        self.overlap = overlap
        self.vocabulary: dict[str, int] = {}
        texts = [(i, t, len(words(t))) for i, t in items if t and words(t)]
        texts.sort(key=lambda x: (x[2], x[0] is None, x[0] or 0))
        number = lambda t: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)]
        self.items: list[Item] = []
        #: by their number of words, the items that are shorter than a shingle
        self.short: dict[int, dict[tuple[int, ...], list[int | None]]] = {}
        for i, t, n in texts:
            ids = number(t)
            if n < SHINGLE:
                self.short.setdefault(n, {}).setdefault(tuple(ids), []).append(i)
                continue
            q, a = (number(x) for x in question_and_answer(t))
            self.items.append(Item(i, tuple(ids), *(tuple(shingles(x)) for x in (ids, q, a)), question_words=len(q)))
        self.short_codes = {n: np.unique(np.concatenate([codes(np.array(x), n) for x in found])) for n, found in self.short.items()}
        n = len(self.items)
        per_block = max(1, math.ceil(n / BLOCKS))
        self.block_of = [k // per_block for k in range(n)]
        blocks = self.block_of[-1] + 1 if n else 0
        frequency = Counter(w for x in self.items for w in set(x.ids))
        mean = sum(len(x.ids) for x in self.items) / max(1, n)
        #: postings of each word: numbers of items, rising, and weights
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.vocabulary]
        #: largest weight of each word in each block; the last row stands for all other words
        self.bounds = np.zeros((len(self.vocabulary) + 1, blocks), np.float32)
        #: by their shingles, the items that have no bound
        self.unbounded: dict[tuple[int, ...], list[int]] = {}
        for k, x in enumerate(self.items):
            weight = {
                w: math.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x.ids) / mean))
                for w, c in Counter(x.ids).items()
            }

            def least(ids, runs, weight=weight) -> float:
                """The least score with ``overlap`` of the runs there: without the heaviest words, one for each run that may be missing."""
                missing = math.floor((1 - overlap) * len(runs) + 1e-9)
                return math.fsum(sorted((weight[w] for w in set(ids)), reverse=True)[missing:])

            need = least(x.ids, x.whole)
            if x.question_words >= QUESTION:
                need = min(need, least({w for run in x.question for w in run}, x.question))
            if need <= 0:
                for run in x.whole:
                    self.unbounded.setdefault(run, []).append(k)
                continue
            need *= 1 - 1e-6
            b = self.block_of[k]
            for w, v in weight.items():
                self.postings[w][0].append(k)
                self.postings[w][1].append(v / need)
                self.bounds[w, b] = max(self.bounds[w, b], np.float32(v / need * (1 + 1e-6)))
        self.codes = np.unique(np.concatenate([codes(np.array(x.ids)) for x in self.items] or [np.zeros(0, np.uint64)]))
        self.top = [max(p[1], default=0.0) for p in self.postings]

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where in the document's words a shingle of any item begins."""
        out = []
        for at in range(0, len(ids), PIECE):
            part = codes(ids[at : at + PIECE + SHINGLE - 1])
            near = np.minimum(np.searchsorted(self.codes, part), len(self.codes) - 1)
            out.append(at + np.flatnonzero(self.codes[near] == part))
        return np.concatenate(out)

    def wand(self, terms: Sequence[int], blocks: set[int]) -> list[tuple[int, float]]:
        """Items of the blocks whose score for the words reaches 1: weak AND over posting lists, one cursor a word.

        Cursors are in order of the item they stand at. The pivot is the first
        item that the words up to it, at their best, can lift to 1; items
        before it are skipped, and so is the pivot if its block's bounds rule it out.
        """
        lists = [(self.postings[t], self.top[t], t) for t in terms]
        place = [0] * len(lists)
        end = len(self.items)
        at = lambda c: lists[c][0][0][place[c]] if place[c] < len(lists[c][0][0]) else end
        live = [c for c in range(len(lists)) if at(c) < end]
        found = []
        while live:
            live.sort(key=at)
            bound, pivot = 0.0, -1
            for n, c in enumerate(live):
                bound += lists[c][1]
                if bound >= 1:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = at(live[pivot])
            block = self.block_of[item]
            if block not in blocks or sum(float(self.bounds[lists[c][2], block]) for c in live if at(c) <= item) < 1:
                # the block's words up to the pivot can't reach 1: on to the item after it
                goal = item + 1
                chosen = [c for c in live if at(c) <= item]
            elif at(live[0]) == item:
                score = 0.0
                chosen = [c for c in live if at(c) == item]
                for c in chosen:
                    score += lists[c][0][1][place[c]]
                if score >= 1:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
                chosen = [c for c in live if at(c) < item]
            for c in chosen:
                p, stops = place[c], lists[c][0][0]
                while p < len(stops) and stops[p] < goal:
                    p += 1
                place[c] = p
            live = [c for c in live if at(c) < end]
        return found

    def verified(self, k: int, stands: dict[tuple, list[int]], ids: np.ndarray) -> tuple[float, float, float, str] | None:
        """The overlaps of the whole item, its question and its answer, and what leaks of it, by where item shingles stand."""
        x = self.items[k]
        there = [stands[s] for s in x.whole if s in stands]
        if not there:
            return None
        first, last = min(p[0] for p in there), max(p[-1] for p in there)
        here = ids[max(0, first - len(x.ids)) : last + SHINGLE + len(x.ids)].tolist()

        def share(wanted) -> float:
            if not wanted:
                return 1.0
            seen = stands if len(wanted[0]) == SHINGLE else set(zip(*(here[i:] for i in range(len(wanted[0])))))
            return sum(s in seen for s in wanted) / len(wanted)

        whole, question, answer = len(there) / len(x.whole), share(x.question), share(x.answer)
        enough = self.overlap - 1e-9
        if whole >= enough and question >= PART_OVERLAP and answer >= PART_OVERLAP:
            return whole, question, answer, "question and answer"
        if x.question_words >= QUESTION and question >= enough:
            return whole, question, answer, "question"
        return None

    def leaks(self, text: str | None) -> list[tuple[int | None, float, float, float, float, str]]:
        """Item, score, the overlaps of the whole item, its question and its answer, and what leaks, of every leaked item."""
        if not text or not (self.items or self.short):
            return []
        own = words(text)
        if not own:
            return []
        ids = np.fromiter(map(self.vocabulary.get, own, repeat(len(self.vocabulary))), np.int64, count=len(own))
        found: list[tuple[int | None, float, float, float, float, str]] = []
        for n, known in sorted(self.short.items()):
            at = np.flatnonzero(np.isin(codes(ids, n), self.short_codes[n])).tolist()
            runs = {tuple(ids[p : p + n].tolist()) for p in at}
            found += [(i, 1.0, 1.0, 1.0, 1.0, "question and answer") for run in sorted(runs) for i in known.get(run, ())]
        places = self.places(ids) if self.items else ids[:0]
        if not len(places):
            return found
        stands: dict[tuple, list[int]] = {}
        for p in places.tolist():
            stands.setdefault(tuple(ids[p : p + SHINGLE].tolist()), []).append(p)
        terms = np.unique(ids[places[:, None] + np.arange(SHINGLE)])
        terms = terms[terms < len(self.vocabulary)]
        blocks = set(np.flatnonzero(self.bounds[terms].sum(axis=0, dtype=np.float64) >= 1).tolist())
        retrieved = self.wand(terms.tolist(), blocks) if blocks else []
        if self.unbounded:
            retrieved += [(k, 1.0) for k in sorted({k for run in stands for k in self.unbounded.get(run, ())})]
        for k, score in sorted(retrieved):
            if (kind := self.verified(k, stands, ids)) is not None:
                found.append((self.items[k].item_id, score, *kind))
        return found


def indexes(benchmark: DataFrame, overlap: float = OVERLAP, at_a_time: int = ITEMS_AT_A_TIME) -> Iterator[Index]:
    """An index for each bounded part of the items, one after the other; ``at_a_time`` bounds what is held and broadcast."""
    items = with_ids(benchmark, "item_id", "text").where("text IS NOT NULL")
    n, chars = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(1, math.ceil(n / (0.8 * at_a_time)), math.ceil((chars or 0) / (0.8 * CHARS_AT_A_TIME)))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        yield Index([(r[0], r[1]) for r in rows], overlap)


KINDS = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, leaked string"
SCHEMA = pa.schema([(x.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]]) for x in KINDS.split(", ")])


def find_leaks(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and item it leaks: ``doc_id``, ``item_id``, ``score`` (1 is the threshold), ``overlap``, ``question_overlap``, ``answer_overlap``, ``leaked`` (what does).

    Whole texts are read and never shuffled; a task holds one text's words and their places, in time and memory in proportion to the text. Null and empty texts leak
    nothing; null items and items without a word are never found, items of fewer than five words as a whole run;
    items with the same text are each found; rows that repeat give their leaks
    again; empty tables give no rows; extra columns are ignored.
    """
    out = None
    source = with_ids(docs, "doc_id", "text")
    for index in indexes(benchmark, overlap):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def batches(it, shipped=shipped):
            for batch in slices(it):
                rows = [(i, *leak) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for leak in shipped.value.leaks(t)]
                columns = zip(*rows) if rows else [[]] * len(SCHEMA)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

        part = source.mapInArrow(batches, KINDS)
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that leak no item."""
    at = docs.columns.index("text")
    for index in indexes(benchmark, overlap):
        shipped = docs.sparkSession.sparkContext.broadcast(index)

        def batches(it, shipped=shipped):
            for batch in slices(it):
                yield batch.filter(pa.array([not shipped.value.leaks(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(batches, docs.schema)
    return docs


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
