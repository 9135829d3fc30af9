"""Spelling variants by a trie-node pair dictionary.

The distinct words of a table are sorted twice, as they are and reversed, and the
nodes of the two tries are numbered: every prefix of a word is one number, every
suffix another. Sorting is by range, so a trie spans tasks. A task numbers the
nodes of its range with a stack along its sorted words; a path that its first word
shares with the last word of the range before keeps the numbers it has there.

A word then stands in the dictionary under integer pairs (prefix node, suffix
node): with each of its places skipped, and with each gap between places as a place
where one may be inserted. Two words with an equal pair, both with a skipped place,
differ by a replaced code point; a skipped place that meets a gap is a deletion or
an insertion. Only the first place of a run of equal code points is a deletion, so
each pair of near words meets exactly once and nothing has to be checked again.
A pair's skipped words differ in one code point only, so a key has no more members
than the alphabet has letters: no key can be hot.

Defined results: null and empty texts have no words. Repeated rows count each time.
A null id hashes as an empty one. Words of any length cost time and memory in
proportion to it. An empty table gives an empty result. Only the named columns of
the input are read, so its other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import col, shared, stored

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Code points of words that are spread into pairs at a time.
SPREAD = 500_000
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "replace").translate(_LOWER).decode("utf-8")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, one_in: int = 0) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lowered, of a length and count at least.

    ``one_in`` plants typing errors: one of so many (document, run) loses a code point.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[a-zÀ-ÿ]{{{max(1, min_length)},}}").findall
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())],
                                               ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = runs(lower_ascii(text.as_py() or ""))
                if one_in:
                    start = f"{'' if doc_id is None else doc_id}:".encode()
                    first = zlib.crc32(start)
                    for run, n in Counter(found).items():
                        h = zlib.crc32(run.encode(), first)
                        if not h % one_in:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < min_length:
                                continue
                        total[run] += n
                else:
                    total.update(found)
                if len(total) >= COUNTED:
                    yield out()
        if total:
            yield out()

    read = docs.select(col(id_col), col(text_col).cast("string"))
    parts = read.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --------------------------------------------------------------------------- trie nodes

def _path(words: Iterator[str]) -> Iterator[list[int]]:
    """For each of sorted words the numbers of its trie nodes, the root's first; a new node gets the next number."""
    path, before, fresh = [0], "", 1
    for word in words:
        same, most = 0, min(len(word), len(before))
        while same < most and word[same] == before[same]:
            same += 1
        path = path[:same + 1]
        path.extend(range(fresh, fresh + len(word) - same))
        fresh += len(word) - same
        before = word
        yield path


def numbered(words: DataFrame, key: str, carry: list[str], parts: int) -> tuple[DataFrame, Callable]:
    """Trie nodes of the distinct strings in ``key``.

    Returns the ``carry`` columns with ``part``, ``at`` (the place among the part's
    sorted strings) and ``nodes`` (local numbers by prefix length), stored; and a
    broadcast :class:`Nodes` that makes the local numbers global.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        waiting: list[str] = []
        paths = _path(iter(lambda: waiting.pop() if waiting else None, None))
        for batch in batches:
            lists, size, from_row = [], 0, 0
            for i, word in enumerate(batch.column(0).to_pylist()):
                waiting.append(word)
                lists.append(np.array(next(paths), np.int64))
                size += len(word)
                if size >= SPREAD or i + 1 == batch.num_rows:
                    rows = batch.slice(from_row, i + 1 - from_row)
                    ends = np.cumsum([0] + [len(x) for x in lists])
                    nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns[1:], pa.array(np.full(len(lists), part), pa.int32()),
                         pa.array(np.arange(at, at + len(lists)), pa.int64()), nodes],
                        [*carry, "part", "at", "nodes"])
                    at += len(lists)
                    lists, size, from_row = [], 0, i + 1

    types = dict(words.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in carry) + ", part int, at long, nodes array<long>"
    laid = words.select(F.col(key).alias("__key"), *carry).repartitionByRange(parts, "__key").sortWithinPartitions("__key")
    done = stored(laid.mapInArrow(walk, schema), f"trie-{key}")
    # one row a part: its first and last string, and the path of the last; the others are found by their numbers
    whole = F.col("word") if key == "word" else F.reverse("word")
    ends = (done.select("part", "at", "nodes", whole.alias("s"))
            .groupBy("part").agg(F.min_by("s", "at").alias("first"), F.max_by("s", "at").alias("last"),
                                 F.max_by("nodes", "at").alias("path"), F.max(F.element_at("nodes", -1)).alias("high"))
            .orderBy("part").collect())
    return done, shared(words.sparkSession, Nodes([(r["part"], r["first"], r["last"], r["path"], r["high"]) for r in ends]))


class Nodes:
    """Global numbers of a trie that lies in parts.

    A part's numbers follow those of the parts before it. What its first string
    shares with the last string of the part before is that string's path.
    """

    def __init__(self, ends: list[tuple[int, str, str, list[int], int]]):
        n = max((e[0] for e in ends), default=-1) + 1
        self.offset, self.begin, self.shared = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        flat: list[np.ndarray] = []
        at = next_free = 0
        before, before_path = "", np.zeros(1, np.int64)
        for part, first, last, path, high in ends:
            same = 0
            while same < min(len(first), len(before)) and first[same] == before[same]:
                same += 1
            base = before_path[:same + 1]
            self.offset[part], self.begin[part], self.shared[part] = next_free, at, same + 1
            flat.append(base)
            at += same + 1
            next_free += high + 1
            before, local = last, np.array(path, np.int64)
            before_path = local + self.offset[part]
            alike = 0
            while alike < min(same, len(last)) and last[alike] == first[alike]:
                alike += 1
            before_path[:alike + 1] = base[:alike + 1]
        self.base = np.concatenate(flat) if flat else np.zeros(0, np.int64)

    def of(self, part: np.ndarray, depth: np.ndarray, local: np.ndarray, on_first: np.ndarray) -> np.ndarray:
        """Global numbers; ``on_first`` marks nodes that lie on the path of the part's first string."""
        out = local + self.offset[part]
        known = on_first & (depth < self.shared[part])
        out[known] = self.base[self.begin[part[known]] + depth[known]]
        return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists, whatever its slice."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2 ... within each of consecutive stretches."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _spread(forward: Callable, backward: Callable):
    """Rows (p, s, v, n) of the dictionary: v is 4 * id, 2 more for a gap, 1 more for the first place of a run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = forward(), backward()
        for batch in batches:
            size = np.cumsum(batch.column("length").to_numpy())
            cuts = np.searchsorted(size, np.arange(SPREAD, size[-1] + SPREAD, SPREAD) if len(size) else [])
            cuts = np.unique(np.concatenate([[0], np.minimum(cuts + 1, batch.num_rows), [batch.num_rows]]))
            for a, z in zip(cuts[:-1], cuts[1:]):
                yield from pairs(batch.slice(a, z - a), tries)

    def pairs(b: pa.RecordBatch, tries) -> Iterator[pa.RecordBatch]:
        length = b.column("length").to_numpy().astype(np.int64)
        ids, n = b.column("id").to_numpy(), b.column("n").to_numpy()
        nodes = []
        for trie, part, column in zip(tries, ("part", "r_part"), ("nodes", "r_nodes")):
            local, size = _flat(b.column(column))
            depth = _within(size)
            # the first string of a part got the numbers 0, 1, 2 ... along its path
            nodes.append(trie.of(np.repeat(b.column(part).to_numpy(), size), depth, local, local == depth))
        points = np.frombuffer("".join(b.column("word").to_pylist()).encode("utf-32-le"), "<u4")
        start = np.cumsum(length + 1) - length - 1  # of a word among the nodes
        for gap in (0, 1):
            count = length + gap
            i, begin, whole = _within(count), np.repeat(start, count), np.repeat(length, count)
            p = nodes[0][begin + i]
            s = nodes[1][begin + whole - i - (1 - gap)]
            v = np.repeat(ids * 4, count) + 2 * gap
            if not gap:
                first = np.ones(len(i), bool)
                first[1:] = points[1:] != points[:-1]
                v += first | (i == 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, s, v, np.repeat(n, count))], ["p", "s", "v", "n"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, near, best_n, best) of the members of keys with more than one, from rows sorted by (p, s)."""
    rest = np.zeros((4, 0), np.int64)
    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns[:4]])], axis=1)
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1])) if rows.shape[1] else []
        cut = last[-1] + 1 if len(last) else 0
        rest = rows[:, cut:]
        if cut:
            yield from _keys(rows[:, :cut])
    if rest.shape[1]:
        yield from _keys(rest)


def _keys(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    size = np.diff(np.append(np.flatnonzero(new), len(new)))
    rows = rows[:, np.repeat(size > 1, size)]
    key = np.repeat(np.arange((size > 1).sum()), size[size > 1])
    ids, gap, first, n = rows[2] >> 2, rows[2] >> 1 & 1, rows[2] & 1, rows[3]
    if not len(key):
        return
    out = []

    def best(of: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows ``of``, by key: how many, and the places of the best and second best (-1: none)."""
        order = of[np.lexsort((ids[of], -n[of], key[of]))]
        count = np.bincount(key[of], minlength=n_keys)
        begin = np.cumsum(count) - count
        top = np.full((2, n_keys), -1)
        for k in (0, 1):
            has = count > k
            top[k, has] = order[begin[has] + k]
        return count, top[0], top[1]

    n_keys = key[-1] + 1
    skipped, gaps = np.flatnonzero(gap == 0), np.flatnonzero(gap == 1)
    count, top, second = best(skipped, n_keys)
    mine = key[skipped]
    other = np.where(top[mine] == skipped, second[mine], top[mine])  # replaced
    some = other >= 0
    out.append((ids[skipped[some]], count[mine[some]] - 1, n[other[some]], ids[other[some]]))
    short = np.full(n_keys, -1)
    short[key[gaps]] = gaps  # the one word with a gap here
    long = skipped[(first[skipped] == 1) & (short[mine] >= 0)]
    deleted = short[key[long]]
    out.append((ids[long], np.ones(len(long), np.int64), n[deleted], ids[deleted]))
    count, top, _ = best(long, n_keys)
    with_long = np.flatnonzero(count)
    out.append((ids[short[with_long]], count[with_long], n[top[with_long]], ids[top[with_long]]))
    columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)]
    yield pa.RecordBatch.from_arrays(columns, ["id", "near", "best_n", "best"])


# --------------------------------------------------------------------------- forms

def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``words`` (word, n; distinct) with form, root, n_near and form_n.

    A word's form is its near word of largest n (ties: smallest in code-point
    order) if that occurs ``ratio`` times as often; ``root`` follows forms to the last.
    """
    spark = words.sparkSession
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ahead, forward = numbered(words, "word", ["word", "n"], parts)
    # ids follow the code-point order of the words
    ahead = ahead.withColumn("id", F.shiftleft(F.col("part").cast("long"), 38) + F.col("at"))
    back = ahead.select("id", "word", F.reverse("word").alias("reversed"))
    behind, backward = numbered(back, "reversed", ["id", "word"], parts)
    both = ahead.join(behind.select("id", F.col("part").alias("r_part"), F.col("nodes").alias("r_nodes")), "id")
    pairs = (both.select("id", "n", "word", F.length("word").alias("length"), "part", "nodes", "r_part", "r_nodes")
             .mapInArrow(_spread(forward, backward), "p long, s long, v long, n long"))
    met = (pairs.repartition("p", "s").sortWithinPartitions("p", "s")
           .mapInArrow(_met, "id long, near long, best_n long, best long"))
    near = (met.groupBy("id").agg(F.sum("near").alias("n_near"),
                                  F.max(F.struct("best_n", (-F.col("best")).alias("best"))).alias("b")))
    often = F.col("b.best_n") >= ratio * F.col("n")
    told = stored(ahead.select("id", "word", "n").join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(often, -F.col("b.best")).alias("form_id"), F.when(often, F.col("b.best_n")).alias("form_n")), "variants")
    return _named(told, _roots(told))


def _roots(told: DataFrame) -> DataFrame:
    """(id, root_id) of the words with a form. Counts grow along forms, so a chain is short; each round halves it."""
    here = told.where("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    while True:
        on = here.select(F.col("id").alias("root_id"), F.col("root_id").alias("beyond"))
        here = stored(here.join(on, "root_id", "left").select(
            "id", F.coalesce("beyond", "root_id").alias("root_id"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if here.where("moved").isEmpty():
            return here.select("id", "root_id")
        here = here.drop("moved")


def _named(told: DataFrame, roots: DataFrame) -> DataFrame:
    name = lambda k: told.select(F.col("id").alias(f"{k}_id"), F.col("word").alias(k))
    linked = (told.where("form_id is not null").join(roots, "id")
              .join(name("form"), "form_id").join(name("root"), "root_id"))
    alone = told.where("form_id is null").withColumns({"form": F.lit(None).cast("string"), "root": F.col("word")})
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return linked.select(columns).unionByName(alone.select(columns))
