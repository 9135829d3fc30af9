"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lowered and every run of other characters becomes one blank. The
1- to 3-grams are hashed into a fixed number of bins; a language's log
probabilities of the bins, with add-half smoothing, and its log prior make one
row of a small matrix, which is broadcast (languages x bins floats). Batches of
texts are scored sparsely: each n-gram looks up its bin's column and the sums
run over each text.

The counts are fitted on a bounded sample: about ``train_rows`` distinct texts
of each language at most, picked by a hash of the text at a rate that follows
from the number of distinct texts. Copies of a text teach once, so a large group
of them neither swells the sample nor thins it out, and a language with no more
than ``train_rows`` distinct texts teaches with all of them. The priors are the
shares of all rows. Every text is scored whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if there is nothing to learn from. Rows with a null language
teach nothing. Ties go to the language that sorts first. Other columns of the
input are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import as_named, by_place, col, shared

ORDERS = (1, 2, 3)
BINS = 1 << 16
TRAIN_ROWS = 4000
MAX_LANGS = 500
COUNT_TASKS = 8
_CHARS_AT_ONCE = 1 << 20


def _letter_table(size: int = 0x110000) -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(size)), bool, size)


def grams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all n-grams of the texts, the text of each, and whether a text has a letter."""
    # A text is framed by blanks; the mark 0 between texts never enters an n-gram.
    chars = np.frombuffer("".join(f" {t.lower()} \0" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter, mark = letters[chars], chars == 0
    lengths = np.fromiter((len(t.lower()) + 3 for t in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths) - 1
    mark[:] = False
    mark[ends] = True
    chars = np.where(is_letter, chars, np.where(mark, 0, 32)).astype(np.uint32)
    keep = np.ones(len(chars), bool)
    keep[1:] = ~((chars[1:] == 32) & (chars[:-1] == 32))
    chars, text = chars[keep], text[keep]
    has = np.bincount(text, (chars > 32), minlength=len(texts)) > 0
    bins, owner = [], []
    for n in ORDERS:
        code, whole = np.full(max(0, len(chars) - n + 1), n, np.uint32), np.ones(max(0, len(chars) - n + 1), bool)
        for k in range(n):
            part = chars[k:len(chars) - n + 1 + k]
            code = (code ^ part) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            whole &= part != 0
        bins.append((code[whole] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - (BINS - 1).bit_length()))
        owner.append(text[:len(whole)][whole])
    return np.concatenate(bins), np.concatenate(owner), has


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about _CHARS_AT_ONCE characters, with the place of the first; nulls as empty."""
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= _CHARS_AT_ONCE:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


class Model:
    """Languages, and their log probabilities of the bins (bins x languages) and log priors."""

    def __init__(self, counts: dict[str, np.ndarray], rows: dict[str, int]):
        self.langs = sorted(counts)
        n = np.array([counts[x] for x in self.langs], np.float64).reshape(len(self.langs), BINS) + 0.5
        self.logp = np.ascontiguousarray(np.log(n / n.sum(1, keepdims=True)).T.astype(np.float32))
        seen = np.array([rows[x] for x in self.langs], np.float64)
        self.prior = np.log(seen / seen.sum()) if len(seen) else seen

    def score(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        best, prob = [], []
        for _, part in _parts(texts):
            bins, owner, has = grams(part, letters)
            total = np.tile(self.prior, (len(part), 1))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(owner, self.logp[bins, k], minlength=len(part))
            if not self.langs:
                best += ["und"] * len(part)
                prob.append(np.zeros(len(part)))
                continue
            top = total.argmax(1)
            p = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            best += [self.langs[k] if h else "und" for k, h in zip(top.tolist(), has.tolist())]
            prob.append(np.where(has, p, 0.0))
        return best, np.concatenate(prob) if prob else np.zeros(0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """A model of the rows with a text and a language: of each language a sample of about ``train_rows``.

    The model grows with the languages; more than ``MAX_LANGS`` values of the column are an error, not a cut.
    """
    rows = labelled.select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct(F.xxhash64("text")).alias("texts"))
    sizes = sizes.limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"column {lang_col!r} has more than {MAX_LANGS} values; map them to languages first")
    n = {r["lang"]: r["n"] for r in sizes}
    if not n:
        return Model({}, {})
    steps = 1 << 30
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(steps, steps * train_rows // r["texts"]))])
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(steps)) < share[F.col("lang")]).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = _letter_table(), {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for at, part in _parts(b.column(0).to_pylist()):
                bins, owner, _ = grams(part, letters)
                for x in set(langs[at:at + len(part)]):
                    mine = bins[langs[at:at + len(part)][owner] == x]
                    sums[x] = sums.get(x, 0) + np.bincount(mine, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                          pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())],
                                         ["lang", "sums"])

    counts: dict[str, np.ndarray] = {}
    for r in picked.repartition(COUNT_TASKS).mapInArrow(count, "lang string, sums binary").collect():
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(r["sums"], "<i8")
    return Model(counts, n)


def predict(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The ``carry`` columns of ``docs`` (of other names) with ``__lang`` and ``__score`` of each text."""
    if clash := {"__lang", "__score", "__text"} & set(carry):
        raise ValueError(f"columns {sorted(clash)} cannot be carried under these names")
    sent = shared(docs.sparkSession, model)
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField("__lang", T.StringType()),
                           T.StructField("__score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = _letter_table(), sent()
        for b in batches:
            lang, score = model.score(b.column(len(carry)).to_pylist(), letters)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score)],
                                             schema.names)

    return docs.select(*[col(c) for c in carry], col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language can't be told: ``und``, or a score below ``min_score``."""
    rows = by_place(docs)
    told = predict(rows, model, rows.columns, f"c{docs.columns.index(text_col)}")
    return as_named(told.where((F.col("__lang") != "und") & (F.col("__score") >= min_score)), docs)
