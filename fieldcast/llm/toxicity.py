"""Toxicity by votes of the nearest labelled examples.

Examples are a bounded sample of the labelled texts, about ``per_class`` of
each class picked by a hash of the id. Terms are all whole words of the
examples, weighted by (1 + log count) and by the documents of the corpus that
have them; a text's other words have no example to meet and are left out of its
length. The examples' inverted index is cut into blocks of 64 examples, those
that use the same words most often side by side, and each term has the largest
weight that it takes in each block; of common terms every weight is at hand. A text's
cosine with any example of a block is at most the block's bound: the largest dot
product of the common terms, and that of the others with those weights. Each text
visits its most promising blocks, then every other one whose bound reaches its
k-th cosine so far, so the k nearest are exact. Ties in cosine go to the example
that comes first.

A neighbour's vote is its cosine, with each shared term's part of it counted by
how far the term tells the labels apart (squared phi coefficient among the
examples): long texts are near others for what they are about, which says little
about the label. The share of the votes for toxic, weighted by class against the
sampling, is mapped to a probability by isotonic regression on the examples
themselves, each scored without its own vote.

Defined results: a null or empty text, or one without terms, has no neighbours
and gets the probability of examples without any. With examples of no class or
of one class alone, every score is that class's share (0 without labels). Rows
of ``labels`` with a null label teach nothing; of labels that contradict each
other for an id, toxic counts; of different texts of an id, the smallest teaches.
Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import col, shared

PER_CLASS = 2000
NEIGHBOURS = 200
BLOCK = 64
COMMON = 16
_TEXTS_AT_ONCE = 256
_WORD = re.compile(r"\w+")
_NOTHING = np.empty(0, np.int64), np.empty(0), np.empty(0)


def terms_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """TF-IDF of labelled examples as a block-max inverted index, and the calibration of its votes.

    ``n_docs`` documents are the corpus, and ``df`` of them have a term; without them the examples are the corpus.
    """

    def __init__(self, examples: list[tuple[object, str, int]], totals: dict[int, int], df: dict[str, int] | None = None,
                 n_docs: int = 0):
        texts = [terms_of(t) for _, t, _ in examples]
        label = np.array([y for *_, y in examples], np.int64)
        n = len(examples)
        rows = {c: int((label == c).sum()) for c in (0, 1)}
        self.terms = {t: k for k, t in enumerate(sorted(set().union(*texts)))}
        counted = [self._counts(words) for words in texts]
        size = np.array([len(term) for term, _ in counted], np.int64)
        term = np.concatenate([t for t, _ in counted]) if n else np.empty(0, np.int64)
        have = {c: np.bincount(term[np.repeat(label == c, size)], minlength=len(self.terms)) for c in (0, 1)}
        seen = have[0] + have[1]
        known = np.array([(df or {}).get(t, 0) for t in self.terms], np.int64)
        self.idf = np.log(1 + max(n_docs, n) / np.maximum(known, seen)) if n else np.empty(0)
        apart = (have[1] * (rows[0] - have[0]) - have[0] * (rows[1] - have[1])).astype(float) ** 2
        spread = float(rows[0]) * rows[1] * seen * (n - seen)
        self.tells = np.divide(apart, spread, out=np.zeros(len(seen)), where=spread > 0)
        vectors = [self._weighted(*c) for c in counted]
        # Blocks hold like examples: those with the same most frequent words, which tell the language, side by side.
        often = [tuple(t[np.lexsort((t, -seen[t], -c))[:3]].tolist()) for t, c in counted]
        order = [i for i in sorted(range(n), key=lambda i: (often[i], i)) if size[i]]
        self.label, self.ids = label[order], [examples[i][0] for i in order]
        self.vote = np.array([totals[c] / max(1, rows[c]) for c in (0, 1)])[self.label] if order else np.empty(0)
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.empty(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.empty(0)
        example = np.repeat(np.arange(len(order)), size[order]) if order else np.empty(0, np.int64)
        # Terms that one in COMMON examples has are kept as rows, whose products with many texts at once are cheap.
        self.common = np.flatnonzero(seen * COMMON >= n) if order else np.empty(0, np.int64)
        self.row = np.full(len(self.terms), -1)
        self.row[self.common] = np.arange(len(self.common))
        self.dense = np.zeros((len(self.common), len(order)))
        mine = self.row[term] >= 0
        self.dense[self.row[term[mine]], example[mine]] = weight[mine]
        term, weight, example = term[~mine], weight[~mine], example[~mine]
        by = np.lexsort((example, term))
        self.example, self.weight = example[by], weight[by]  # postings by term, then block
        slot = term[by] * max(1, self.blocks) + self.example // BLOCK
        first = np.flatnonzero(np.diff(slot, prepend=-1))  # a cell: the postings of a term in a block
        self.cell_begin, self.cell_size = first, np.diff(np.append(first, len(slot)))
        self.cell_block = slot[first] % max(1, self.blocks)
        self.cell_most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.begin = np.searchsorted(slot[first], np.arange(len(self.terms) + 1) * max(1, self.blocks))
        whole = totals[0] + totals[1]
        self.base = totals[1] / whole if whole else 0.0
        self.steps = (np.array([0.0, 1.0]), np.array([self.base, self.base]))
        if rows[0] and rows[1]:
            at = {i: k for k, i in enumerate(order)}
            share = np.array([s for s, *_ in self.shares(vectors, [at.get(i, -1) for i in range(n)])])
            self.steps = _isotonic(share, label, np.array([totals[c] / rows[c] for c in (0, 1)])[label])

    def _counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's terms, and how often each is there."""
        bag = Counter(words)
        number = np.fromiter(map(self.terms.get, bag, repeat(-1)), np.int64, len(bag))
        at = np.argsort(number)[np.count_nonzero(number < 0):]
        return number[at], np.fromiter(bag.values(), np.int64, len(bag))[at]

    def _weighted(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their weights, scaled to length one."""
        weight = (1 + np.log(count)) * self.idf[term]
        return term, weight / (np.sqrt((weight * weight).sum()) or 1)

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self._weighted(*self._counts(terms_of(text)))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: list[int] | None = None,
                ) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The k nearest examples of each text, nearest first, with their cosines and votes; never its ``own``."""
        if not self.blocks:
            return [_NOTHING] * len(vectors)
        x = np.zeros((len(vectors), len(self.common)))
        rare = []
        for i, (term, weight) in enumerate(vectors):
            row = self.row[term]
            x[i, row[row >= 0]] = weight[row >= 0]
            rare.append((term[row < 0], weight[row < 0]))
        cosine, vote = x @ self.dense, (x * self.tells[self.common]) @ self.dense
        return [self._nearest(*v, *cv) for v, cv in zip(rare, zip(cosine, vote, own or repeat(-1)))]

    def _nearest(self, term: np.ndarray, weight: np.ndarray, cosine: np.ndarray, vote: np.ndarray, own: int):
        """Adds the rare terms, by blocks, to what the common ones give."""
        n = self.begin[term + 1] - self.begin[term]
        cell = _runs(self.begin[term], n)
        of = np.repeat(np.arange(len(term)), n)
        block = self.cell_block[cell]
        bound = np.maximum.reduceat(cosine, np.arange(self.blocks) * BLOCK)
        bound = bound + np.bincount(block, weight[of] * self.cell_most[cell], self.blocks)
        # The first visit finds k examples unless fewer have a term of the text.
        visit = np.zeros(self.blocks, bool)
        visit[np.argsort(-bound, kind="stable")[:NEIGHBOURS // BLOCK + 2]] = True
        left = bound > 0
        for _ in range(2):
            mine = (visit & left)[block]
            size = self.cell_size[cell[mine]]
            posting = _runs(self.cell_begin[cell[mine]], size)
            example, part = self.example[posting], np.repeat(weight[of[mine]], size) * self.weight[posting]
            cosine += np.bincount(example, part, len(cosine))
            vote += np.bincount(example, part * np.repeat(self.tells[term[of[mine]]], size), len(cosine))
            left &= ~visit
            if own >= 0:
                cosine[own] = 0
            # A cosine without its rare terms is no more than the whole one, so the k-th is never too high.
            kth = np.partition(cosine, -NEIGHBOURS)[-NEIGHBOURS] if len(cosine) > NEIGHBOURS else 0.0
            visit = bound >= kth - 1e-9  # rounding may put a bound a hair below a cosine that it bounds
        some = np.flatnonzero((cosine > 0) & (cosine >= kth))  # ties with the k-th stay in
        best = some[np.lexsort((some, -cosine[some]))[:NEIGHBOURS]]
        return best, cosine[best], vote[best]

    def shares(self, vectors: list[tuple[np.ndarray, np.ndarray]], own: list[int] | None = None,
               ) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """The toxic share of the neighbours' votes, -1 without any; the neighbours and their cosines."""
        out = []
        for at in range(0, len(vectors), _TEXTS_AT_ONCE):
            for best, cosine, vote in self.nearest(vectors[at:at + _TEXTS_AT_ONCE], own and own[at:at + _TEXTS_AT_ONCE]):
                vote = vote * self.vote[best]
                total = vote.sum()
                out.append((float((vote * self.label[best]).sum() / total) if total > 0 else -1.0, best, cosine))
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Probabilities, nearest examples and their cosines; copies among the texts are looked up once."""
        once = list(dict.fromkeys(texts))
        told = dict(zip(once, self.shares([self.vector(t) for t in once])))
        found = [told[t] for t in texts]
        return np.interp([s for s, *_ in found], *self.steps), [b for _, b, _ in found], [c for *_, c in found]


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression: the means of pooled runs at their mean x, to be interpolated."""
    pools: list[list[float]] = []  # weight, sum of w * y, sum of w * x
    for v in np.unique(x):
        mine = x == v
        pools.append([weight[mine].sum(), (weight * y)[mine].sum(), (weight * x)[mine].sum()])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def document_frequencies(docs: DataFrame, terms: dict[str, int], text_col: str = "text") -> tuple[dict[str, int], int]:
    """How many texts have each of the terms, and how many texts there are: one pass, counts merged by term.

    The terms are those of the bounded sample, so are the counts that reach the driver.
    """
    sent = shared(docs.sparkSession, frozenset(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, n = sent(), Counter(), 0
        for b in batches:
            n += b.num_rows
            for t, copies in Counter(b.column(0).to_pylist()).items():
                words = known & set(terms_of(t))
                found.update(words if copies == 1 else dict.fromkeys(words, copies))
        # The number of texts goes with the empty word, which no text has.
        yield pa.RecordBatch.from_arrays([pa.array(["", *found], pa.string()), pa.array([n, *found.values()], pa.int64())],
                                         ["term", "n"])

    texts = docs.select(col(text_col).cast("string").alias("text")).where("text is not null")
    sums = texts.mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in sums.collect()}
    return df, df.pop("", 0)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, per_class: int = PER_CLASS,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Index:
    """An index of about ``per_class`` labelled texts of each class, of the ids that are ``learnable``."""
    marks = labels.select(col(id_col).alias("doc_id"), col(label_col).cast("int").alias("y"))
    marks = marks.where("doc_id is not null and y in (0, 1)")
    if learnable is not None:
        marks = marks.where(learnable)
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    totals = {0: 0, 1: 0} | {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    steps = 1 << 30
    part = F.pmod(F.xxhash64(F.lit("examples"), "doc_id"), F.lit(steps))
    share = {c: min(steps, steps * per_class // max(1, n)) for c, n in totals.items()}
    picked = marks.where(part < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    # About 2 * per_class rows, whatever the tables: small enough to broadcast, and to collect with a text each.
    found = texts.where("text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    examples = sorted((r["doc_id"], r["text"], r["y"]) for r in found.collect())
    df, n_docs = document_frequencies(docs, dict.fromkeys(w for _, t, _ in examples for w in terms_of(t)), text_col)
    return Index(examples, totals, df, n_docs)


def scored(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """(doc_id, score, evidence): the probability of toxic, and the nearest examples with cosine and label."""
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    sent = shared(docs.sparkSession, index)
    near = T.StructType([T.StructField("example", src.schema["doc_id"].dataType),
                         T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())])
    schema = T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType()),
                           T.StructField("evidence", T.ArrayType(near))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent()
        for b in batches:
            p, best, cosine = index.score(b.column(1).to_pylist())
            rows = [[{"example": index.ids[e], "cosine": c, "label": int(index.label[e])}
                     for e, c in zip(es[:evidence].tolist(), cs[:evidence].tolist())] for es, cs in zip(best, cosine)]
            kind = pa.list_(pa.struct([("example", b.schema.types[0]), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array(rows, kind)], schema.names)

    return src.mapInArrow(run, schema)
