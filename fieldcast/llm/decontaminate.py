"""Benchmark decontamination with an FM-index per training shard.

A task turns its documents, in shards of about ``shard_words`` words, into one
sequence of word numbers and indexes it: suffix order, Burrows-Wheeler
transform, a wavelet matrix for rank queries and every 32nd suffix position.
Words that no phrase has stay in their places, but share ``OTHERS`` numbers,
dealt by place: no search can meet them, and copies of long passages then
differ soon, which keeps the suffix sort short.
The test phrases (windows of ``window`` words; an item with fewer words is one
window) are found by backward search, all at once; occurrences are located by
stepping back to a sampled position, and overlapping ones are merged into
removal spans. Whole documents lie in one shard, so nothing is shuffled.

The benchmark is sent to the tasks in parts of at most ``part_bytes`` of text,
whatever its size: each part is one more pass over the rows in the same stage,
which adds to the spans and items already found.

Defined results: null, empty and wordless texts have no words, spans or items.
Items without words are no phrase. Repeated benchmark rows count once by
item_id; a null item_id is an item too, left out of the digest. Repeated
documents are judged one by one. An empty table of either kind is fine.
Columns of the input, whatever their names, are passed through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import as_named, by_place, col

WINDOW = 13
SHARD_WORDS = 1_000_000
PART_BYTES = 16 << 20
ROW_BYTES = 16
SAMPLED = 32
OTHERS = 256
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered: runs of ASCII letters, digits and non-ASCII characters."""
    return (text or "").encode().translate(_WORD_BYTES).split()


class _Bits:
    """A bit vector with rank: ones before a position."""

    def __init__(self, bits: np.ndarray):
        words = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([words, np.zeros(16 - len(words) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence whose last symbol is its unique smallest, by prefix doubling of ties."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length())
    packed = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(packed):
        key <<= bits
        if k < n:
            key[:n - k] |= symbols[k:]
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    del key
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int64)  # of a suffix: the first slot of its group
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    slots = np.flatnonzero(~(first & np.append(first[1:], True)))  # of suffixes that are not alone yet
    h = packed
    while len(slots):
        at = order[slots]
        beyond = at + h
        after = np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0)
        whole = rank[at] * (n + 1) + after
        by = np.argsort(whole, kind="stable")
        at, whole = at[by], whole[by]
        order[slots] = at
        fresh = np.concatenate([[True], whole[1:] != whole[:-1]])
        begin = np.flatnonzero(fresh)
        rank[at] = np.repeat(slots[begin], np.diff(np.append(begin, len(slots))))
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order


class FMIndex:
    """Backward search and locating over a sequence of small numbers."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        order = suffix_order(symbols)
        counts = np.bincount(symbols, minlength=size)
        self.n, self.size = n, size
        self.smaller = np.cumsum(counts) - counts
        last = symbols[order - 1]  # order 0 wraps to the end mark
        sampled = order % SAMPLED == 0
        self.marked, self.position = _Bits(sampled), order[sampled]
        self.levels: list[tuple[int, _Bits, int]] = []
        for level in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            one = (last >> level & 1).astype(bool)
            zeros = last[~one]
            self.levels.append((level, _Bits(one), len(zeros)))
            last = np.concatenate([zeros, last[one]])

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def back(self, symbol: np.ndarray, *ats: np.ndarray) -> list[np.ndarray]:
        """The row of ``symbol`` put before each row of ``ats``."""
        base = self.smaller[symbol] - self._down(symbol, np.zeros_like(symbol))
        return [base + self._down(symbol, at) for at in ats]

    def find(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges of phrases that occur: (phrase, first, end)."""
        live = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            more = np.flatnonzero(length[live] > step)
            if not len(more):
                break
            which = live[more]
            lo[more], hi[more] = self.back(phrases[which, length[which] - 1 - step], lo[more], hi[more])
            found = lo < hi
            live, lo, hi = live[found], lo[found], hi[found]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows, by stepping back to sampled ones."""
        out, live, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(live):
            here = self.marked.get(at).astype(bool)
            out[live[here]] = self.position[self.marked.rank(at[here])] + steps
            live, at = live[~here], at[~here]
            symbol, down = np.zeros_like(at), at
            for level, bits, zeros in self.levels:
                one = bits.get(down).astype(bool)
                ones = bits.rank(down)
                symbol |= one.astype(np.int64) << level
                down = np.where(one, zeros + ones, down - ones)
            at = self.smaller[symbol] - self._down(symbol, np.zeros_like(symbol)) + down
            steps += 1
        return out


def phrases_of(items: list[tuple[object, str]], window: int) -> dict[tuple[bytes, ...], list[int]]:
    """Each distinct window of the items, with the places of its items."""
    out: dict[tuple[bytes, ...], list[int]] = {}
    for i, (_, text) in enumerate(items):
        words = words_of(text)
        if words:
            for w in {tuple(words[k:k + window]) for k in range(max(1, len(words) - window + 1))}:
                out.setdefault(w, []).append(i)
    return out


class Phrases:
    """The distinct phrases, coded by numbers of their words; ``items`` has the places of each one's items."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        found = phrases_of(items, window)
        self.items = list(found.values())
        # 0 ends the shard, 1 a document
        self.numbers = {w: k for k, w in enumerate(sorted({w for phrase in found for w in phrase}), 2)}
        self.length = np.array([len(p) for p in found], np.int64)
        self.coded = np.zeros((len(found), window), np.int64)
        for k, phrase in enumerate(found):
            self.coded[k, :len(phrase)] = [self.numbers[w] for w in phrase]


def search_shard(texts: list[str | None], phrases: Phrases,
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text in the shard, hit flag of each word, text and item of each found pair)."""
    number, symbols, lengths = phrases.numbers.get, [], []
    for text in texts:
        words = words_of(text)
        lengths.append(len(words))
        symbols.append(np.fromiter(map(number, words, repeat(-1)), np.int64, len(words)))
        symbols.append(np.ones(1, np.int64))
    symbols.append(np.zeros(1, np.int64))
    sequence = np.concatenate(symbols)
    others = np.flatnonzero(sequence < 0)
    first_other = len(phrases.numbers) + 2
    sequence[others] = first_other + (others * 0x9E3779B1 >> 13) % OTHERS
    starts = np.cumsum(np.array(lengths, np.int64) + 1) - np.array(lengths, np.int64) - 1
    change = np.zeros(len(sequence) + 1, np.int64)
    texts_of = items_of = np.empty(0, np.int64)
    if len(phrases.items):
        index = FMIndex(sequence, first_other + OTHERS)
        which, lo, hi = index.find(phrases.coded, phrases.length)
        n = hi - lo
        which = np.repeat(which, n)
        at = index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n))
        np.add.at(change, at, 1)
        np.add.at(change, at + phrases.length[which], -1)
        text = np.searchsorted(starts, at, "right") - 1
        pairs = np.unique(np.stack([text, which]), axis=1) if len(at) else np.empty((2, 0), np.int64)
        per = [phrases.items[w] for w in pairs[1]]
        texts_of = np.repeat(pairs[0], [len(p) for p in per])
        items_of = np.fromiter((i for p in per for i in p), np.int64, len(texts_of))
    return starts, np.cumsum(change[:-1]) > 0, texts_of, items_of


def scan(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", item_col: str = "item_id",
         phrase_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
         part_bytes: int = PART_BYTES) -> DataFrame:
    """The ``carry`` columns of ``docs``, and of each text:

    ``__n_words``; ``__spans``, the merged removal spans as (start, end) word
    numbers; ``__items``, the ids of the items with a window in the text.
    Carried columns have other names than these.
    """
    if clash := {"__n_words", "__spans", "__items", "__text"} & set(carry):
        raise ValueError(f"columns {sorted(clash)} cannot be carried under these names")
    spark = docs.sparkSession
    items = benchmark.select(col(item_col).alias("item"), col(phrase_col).cast("string").alias("phrase")).where("phrase is not null").distinct()
    total = items.agg(F.sum(F.octet_length("phrase") + ROW_BYTES)).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    item_type = items.schema["item"].dataType
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    state = T.StructType([T.StructField("__n_words", T.LongType()), T.StructField("__spans", span),
                          T.StructField("__items", T.ArrayType(item_type))])
    out = docs.select(*[col(c) for c in carry], col(text_col).cast("string").alias("__text"),
                      F.lit(0).cast("long").alias("__n_words"), F.array().cast(span).alias("__spans"),
                      F.array().cast(state["__items"].dataType).alias("__items"))
    kept = T.StructType([docs.schema[c] for c in carry])
    for part in range(parts):
        # Dealt by item and text: copies of a text under many ids spread over the parts.
        mine = items.where(F.pmod(F.xxhash64("item", "phrase"), F.lit(parts)) == part) if parts > 1 else items
        sent = spark.sparkContext.broadcast([(r["item"], r["phrase"]) for r in mine.collect()])
        text_too = [T.StructField("__text", T.StringType())] if part < parts - 1 else []
        schema = T.StructType([*kept, *text_too, *state])
        out = out.mapInArrow(_pass(sent, len(carry), bool(text_too), window, shard_words), schema)
    return out


def _pass(sent, n_carry: int, text_too: bool, window: int, shard_words: int):
    def shard(rows: list[pa.RecordBatch], ids: list, phrases: Phrases) -> Iterator[pa.RecordBatch]:
        texts = [t for b in rows for t in b.column(n_carry).to_pylist()]
        starts, hit, text_of, item_of = search_shard(texts, phrases)
        done = 0
        for b in rows:
            n_words, spans, items = [], [], []
            before = zip(b.column(n_carry + 2).to_pylist(), b.column(n_carry + 3).to_pylist())
            for i, (old_spans, old_items) in enumerate(before, done):
                end = (starts[i + 1] if i + 1 < len(starts) else len(hit) - 1) - 1
                n_words.append(end - starts[i])
                lo, hi = np.searchsorted(text_of, [i, i + 1])
                if hi == lo:
                    spans.append(old_spans)
                    items.append(old_items)
                    continue
                mine = np.concatenate([[False], hit[starts[i]:end], [False]])
                for s in old_spans:
                    mine[s["start"] + 1:s["end"] + 1] = True
                edges = np.flatnonzero(mine[1:] != mine[:-1])
                spans.append([{"start": a, "end": z} for a, z in edges.reshape(-1, 2).tolist()])
                found = dict.fromkeys(old_items)
                found.update(dict.fromkeys(ids[k] for k in item_of[lo:hi].tolist()))
                items.append(list(found))
            done += b.num_rows
            state = [pa.array(n_words, pa.int64()), pa.array(spans, b.column(n_carry + 2).type),
                     pa.array(items, b.column(n_carry + 3).type)]
            columns = [b.column(k) for k in range(n_carry + text_too)] + state
            names = b.schema.names[:n_carry + text_too] + b.schema.names[n_carry + 1:]
            yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        phrases, ids = Phrases(items, window), [i for i, _ in items]
        rows, size = [], 0
        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(n_carry)):
                size += len(text.as_py() or "") // 6 + 1  # about the words
                if size >= shard_words:
                    rows.append(batch.slice(at, i + 1 - at))
                    yield from shard(rows, ids, phrases)
                    rows, size, at = [], 0, i + 1
            if at < batch.num_rows:
                rows.append(batch.slice(at))
        if rows:
            yield from shard(rows, ids, phrases)

    return run


def verdict(scanned: DataFrame) -> dict[str, Column]:
    """The judgement on a scanned text: contaminated if a twentieth of its words, at least one, is hit."""
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    ids = F.array_sort(F.transform("__items", lambda x: x.cast("string")))
    return {"n_words": F.col("__n_words"), "n_hit": n_hit, "n_items": F.size("__items").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", ids), 256),
            "contaminated": (n_hit > 0) & (20 * n_hit >= F.col("__n_words"))}


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the contaminated rows."""
    rows = by_place(docs)
    with_found = scan(rows, benchmark, rows.columns, f"c{docs.columns.index(text_col)}", **options)
    return as_named(with_found.where(~verdict(with_found)["contaminated"]), docs)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the words of the removal spans, and what stands between them, cut out."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    out, at = [], 0
    for start, end in spans:
        out.append(data[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]]).decode()
