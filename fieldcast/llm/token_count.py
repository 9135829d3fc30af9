"""Token counts of a unigram vocabulary by a count-only Viterbi pass.

An Aho-Corasick automaton lists the vocabulary pieces that end at each
character, longest first; dynamic programming carries the best score and the
number of pieces of the best cut, never the cut itself. Tie rule: of cuts that
end in the same place with equal scores, the one whose last piece is longest
wins. A character that is no piece of its own may be cut off at a score of 10
below the lowest; it counts as its UTF-8 bytes if the vocabulary has them as
byte pieces, else a run of such characters counts as one unknown.

Texts are prepared as the vocabulary's library does: blanks become U+2581, and
one is put in front. If no piece holds U+2581 behind another character, cuts
never cross the front of a run of them, so words are counted by themselves and
remembered. Scores are summed in double precision, word by word.

Defined results: null and empty texts have no tokens and score 0. Equal texts
have equal counts. Other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldcast.llm.common import col, shared

BLANK = "▁"
# Distinct words a task remembers.
WORDS_KEPT = 1_000_000
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class Pieces(NamedTuple):
    """Scores of the pieces that match text, and whether all 256 bytes are pieces too."""

    scores: dict[str, float]
    bytes: bool


def read_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model file; control and unknown pieces never match text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Pieces({model.id_to_piece(i): model.get_score(i) for i in plain}, sum(map(model.is_byte, ids)) == 256)


class Counter:
    """Counts tokens; remembers words."""

    def __init__(self, pieces: Pieces, words_kept: int = WORDS_KEPT):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if pieces.scores:
            self.automaton.make_automaton()
        self.empty = not pieces.scores
        self.single = {p for p in pieces.scores if len(p) == 1}
        self.unknown = min(pieces.scores.values(), default=0.0) - 10
        self.bytes, self.words_kept = pieces.bytes, words_kept
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in pieces.scores)
        self.known: dict[str, tuple[int, float]] = {}

    def viterbi(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best cut of a prepared text."""
        n = len(text)
        best, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = iter(()) if self.empty else self.automaton.iter(text)
        nxt = next(matches, None)
        for i, c in enumerate(text):
            top, from_, pieces = None, 0, 0
            while nxt is not None and nxt[0] == i:
                size, score = nxt[1]
                total = best[i + 1 - size] + score
                if top is None or total > top:
                    top, from_ = total, i + 1 - size
                nxt = next(matches, None)
            if c not in self.single and (top is None or best[i] + self.unknown > top):
                best[i + 1] = best[i] + self.unknown
                loose[i + 1] = True
                count[i + 1] = count[i] + (len(c.encode()) if self.bytes else not loose[i])
            else:
                best[i + 1], count[i + 1] = top, count[from_] + 1
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a text."""
        if not text:
            return 0, 0.0
        ready = BLANK + text.replace(" ", BLANK)
        words = _WORDS.findall(ready) if self.by_word else [ready]
        known = self.known
        if len(known) > self.words_kept:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.viterbi(w)
        found = [known[w] for w in words]
        return sum(n for n, _ in found), sum(s for _, s in found)


def token_counts(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of every text. The vocabulary, of a fixed size, is broadcast."""
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    sent = shared(docs.sparkSession, pieces)
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or Counter(sent())
            found = [counter.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()),
                                              pa.array([s for _, s in found], pa.float64())], schema.names)

    return src.mapInArrow(run, schema)
