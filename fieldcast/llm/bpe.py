"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes about ``CHUNK_CHARS`` characters of text at a time as one corpus.
Character classes cut it into the pieces of the pattern, equal pieces become
one word, and the distinct words are laid out as one row of byte tokens with
links to the live neighbours. An inverted index holds, for each rank, the
positions of the pairs that merge into it. The ranks are replayed in order over
all words at once; a merge touches its two neighbours alone, whose new pairs
enter the index under their ranks.

That equals taking the lowest rank of one word at a time, as long as a merge at
rank r opens no pair of a rank below r. Words where one does (ranks are of byte
strings, so a pair may spell a token that training reached by another split)
are encoded by themselves, lowest rank first and leftmost.

Only the GPT-2 style pattern (``PATTERN``) is cut by classes; another pattern
is refused.

Defined results: a null text is encoded as the empty one, which has no tokens.
Special tokens are ordinary text. A vocabulary without one of the 256 bytes is
refused. Repeated texts get equal ids. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import col

# Fixed value: the pattern that cuts texts before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int32).max
CHUNK_CHARS = 4_000_000
# The replay goes rank by rank in numpy while a rank has FEW positions on average, then by position.
MANY, FEW = 4096, 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines))}


class Vocabulary:
    """Token bytes, and for each pair of tokens that spells a token, that token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        if pattern.strip() != PATTERN:
            raise ValueError("only PATTERN is cut into pieces here")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {ranks[t[:k]] * size + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t))
                 if t[:k] in ranks and t[k:] in ranks}
        self.size, self.by_pair = size, pairs
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pair.tolist()], np.int64)
        self.byte_pair = self.merges(np.repeat(self.bytes, 256), np.tile(self.bytes, 256))

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE if it is no token."""
        if not len(self.pair):
            return np.full(len(left), _NONE)
        code = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, code), len(self.pair) - 1)
        return np.where(self.pair[at] == code, self.merged[at], _NONE)

    def alone(self, piece: bytes) -> list[int]:
        """The tokens of one piece: lowest rank first, leftmost first."""
        ranks, parts = self.ranks, [bytes([b]) for b in piece]
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        rank = lambda i: ranks.get(parts[i] + parts[right[i]], _NONE) if right[i] >= 0 else _NONE
        queue = [(r, i) for i in range(len(parts)) if (r := rank(i)) < _NONE]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            if not parts[i] or rank(i) != r:
                continue
            gone = right[i]
            parts[i] += parts[gone]
            parts[gone] = b""
            right[i] = right[gone]
            if right[i] >= 0:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (new := rank(k)) < _NONE:
                    heapq.heappush(queue, (new, k))
        return [ranks[p] for p in parts if p]

    def replay(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges the words of these (positive) lengths in ``data`` together, in rank order.

        Returns the tokens of all words, how many each word has, and the words
        that must be encoded by themselves.
        """
        token = self.bytes[data].astype(np.int32)
        n = len(token)
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        odd = np.zeros(len(lengths), bool)

        rank = self.byte_pair[data[:-1].astype(np.int64) * 256 + data[1:]]
        at = np.flatnonzero((rank < _NONE) & (after[:-1] >= 0)).astype(np.int32)
        rank = rank[at]
        by = np.argsort(rank, kind="stable")
        at, rank = at[by], rank[by]
        cuts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else []
        index = {int(rank[a]): [at[a:z]] for a, z in zip(cuts, [*cuts[1:], len(rank)])}
        queue = list(index)
        heapq.heapify(queue)
        recent = MANY  # positions per rank of late
        while queue and recent >= FEW:
            r = heapq.heappop(queue)
            lists = index.pop(r)
            recent += (sum(map(len, lists)) - recent) / 32
            at = np.sort(np.concatenate(lists))
            at = at[np.concatenate([[True], at[1:] != at[:-1]]) & (token[at] >= 0) & (after[at] >= 0)]
            at = at[self.merges(token[at], token[after[at]]) == r]
            if not len(at):
                continue
            # aaa: of pairs that overlap, every other one from the left.
            overlap = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if overlap.any():
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(overlap, 0, np.arange(len(at))))
                at = at[run % 2 == 0]
            gone = after[at]
            token[at] = r
            token[gone] = -1
            later = after[gone]
            after[at] = later
            before[later[later >= 0]] = at[later >= 0]
            earlier = before[at]
            touched = np.concatenate([earlier[earlier >= 0], at[later >= 0]])
            if not len(touched):
                continue
            new = self.merges(token[touched], token[after[touched]])
            touched, new = touched[new < _NONE], new[new < _NONE]
            if not len(new):
                continue
            odd[owner[touched[new < r]]] = True
            by = np.argsort(new, kind="stable")
            touched, new = touched[by], new[by]
            cuts = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(new)]):
                rank_here = int(new[a])
                if rank_here not in index:
                    index[rank_here] = []
                    heapq.heappush(queue, rank_here)
                index[rank_here].append(touched[a:z])
        token = self._rest(token.tolist(), after.tolist(), before.tolist(), owner, odd, index, queue)
        live = token >= 0
        return token[live], np.bincount(owner[live], minlength=len(lengths)), np.flatnonzero(odd)

    def _rest(self, token: list[int], after: list[int], before: list[int], owner: np.ndarray, odd: np.ndarray,
              index: dict[int, list[np.ndarray]], queue: list[int]) -> np.ndarray:
        """Goes on with the replay one position at a time, for ranks with few positions each."""
        places = {r: np.concatenate(lists).tolist() for r, lists in index.items()}
        merged, size = self.by_pair.get, self.size
        while queue:
            r = heapq.heappop(queue)
            for i in sorted(places.pop(r)):
                left, gone = token[i], after[i]
                if left < 0 or gone < 0 or merged(left * size + token[gone]) != r:
                    continue
                token[i], token[gone] = r, -1
                later = after[i] = after[gone]
                if later >= 0:
                    before[later] = i
                    new = merged(r * size + token[later])
                    if new is not None:
                        if new < r:
                            odd[owner[i]] = True
                        if new in places:
                            places[new].append(i)
                        else:
                            places[new] = [i]
                            heapq.heappush(queue, new)
                earlier = before[i]
                if earlier >= 0:
                    new = merged(token[earlier] * size + r)
                    if new is not None:
                        if new < r:
                            odd[owner[i]] = True
                        if new in places:
                            places[new].append(earlier)
                        else:
                            places[new] = [earlier]
                            heapq.heappush(queue, new)
        return np.array(token, np.int64)


# Classes of characters that the pattern tells apart.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def class_table() -> np.ndarray:
    """The pattern's class of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


def piece_starts(chars: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pattern piece starts at each character; ``first`` flags the first character of a text."""
    n = len(chars)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # White space before another character: all but its last character is a piece, the last one
    # joins the next piece if it is a blank and is one of its own else.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:])
    start[last] = True
    start[last[chars[last] == 32] + 1] = False
    # An apostrophe that starts a piece and has one of the endings behind it.
    mark = np.flatnonzero((chars == 39) & start)
    at = lambda i: np.where(i < n, chars[np.minimum(i, n - 1)], 0)
    same = lambda i: (i < n) & ~first[np.minimum(i, n - 1)]
    one, two = at(mark + 1), at(mark + 2)
    short = same(mark + 1) & np.isin(one, [ord(c) for c in "stmd"])
    long = same(mark + 1) & same(mark + 2) & np.logical_or.reduce(
        [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
    for marks, size in ((mark[short], 2), (mark[long], 3)):
        start[marks + 1] = False
        behind = marks + size
        start[behind[behind < n]] = True
    return start


def _runs(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places begin[0] .. begin[0] + length[0] - 1, begin[1] .., one after another."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]), dtype=np.uint64)


def _digests(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Polynomial digests of consecutive pieces of ``data``, a run of pieces at a time."""
    random = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)
    out = np.empty(len(begin), np.uint64)
    room = max(1 << 18, int(length.max(initial=0)) + 1)
    up, down = _powers(_BASE, room), _powers(_BACK, room)
    at = 0
    while at < len(begin):
        lo = begin[at]
        end = max(at + 1, int(np.searchsorted(begin + length, lo + room, "right")))
        here = begin[at:end] - lo
        part = data[lo:lo + here[-1] + length[end - 1]]
        total = np.concatenate([[np.uint64(0)], np.cumsum(random[part] * up[:len(part)], dtype=np.uint64)])
        out[at:end] = (total[here + length[at:end]] - total[here]) * down[here]
        at = end
    return out + length.astype(np.uint64)


def distinct(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the distinct pieces among consecutive pieces of ``data``, and each piece's number among them."""
    _, first, number = np.unique(_digests(data, begin, length), return_index=True, return_inverse=True)
    alike = (length[first][number] == length).all()
    for at in range(0, len(begin), 1 << 19) if alike else ():  # equal digests must mean equal bytes
        part = slice(at, at + (1 << 19))
        mine = data[begin[part][0]:begin[part][-1] + length[part][-1]]
        alike = alike and (mine == data[_runs(begin[first][number[part]], length[part])]).all()
    return (first, number) if alike else (np.arange(len(begin)), np.arange(len(begin)))


class Encoder:
    """Encodes texts with a vocabulary, a chunk of texts at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.kinds = vocabulary, class_table()
        spelt = vocabulary.tokens
        self.longest = max(map(len, spelt))
        self.size = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.begin = np.cumsum(self.size) - self.size
        self.spelling = np.frombuffer(b"".join(spelt), np.uint8)
        names = [f"{k}," for k in range(len(spelt))]
        self.name_size = np.fromiter(map(len, names), np.int64, len(names))
        self.name_begin = np.cumsum(self.name_size) - self.name_size
        self.name = np.frombuffer("".join(names).encode(), np.uint8)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of the texts: all their token ids, and how many each text has."""
        at, size = 0, 0
        for i, t in enumerate(texts, 1):
            size += len(t or "")
            if size >= CHUNK_CHARS or i == len(texts):
                yield self._chunk([x or "" for x in texts[at:i]])
                at, size = i, 0

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        if not whole:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        data = np.frombuffer(whole.encode(), np.uint8)
        chars = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths) - lengths
        first = np.zeros(len(chars), bool)
        first[starts[lengths > 0]] = True
        piece = np.flatnonzero(piece_starts(chars, self.kinds[chars], first))
        text_of = np.searchsorted(starts[lengths > 0], piece, "right") - 1
        text_of = np.flatnonzero(lengths > 0)[text_of]
        if len(data) > len(chars):
            begin = np.flatnonzero((data & 0xC0) != 0x80)[piece]  # bytes that start a character
        else:
            begin = piece
        del chars, first
        length = np.diff(np.append(begin, len(data)))
        words, number = distinct(data, begin, length)
        offset, count, ids = self._words(data, begin[words], length[words])
        per = count[number]
        tokens = np.bincount(text_of, per, minlength=len(texts)).astype(np.int64)
        return ids[_runs(offset[number], per)], tokens

    def _words(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each distinct word are, how many they are, and the ids."""
        raw, ranks = data.tobytes(), self.vocabulary.ranks
        whole = np.full(len(begin), -1)  # a word that is a token is that token, whatever the merges give
        short = np.flatnonzero(length <= self.longest)
        spelt = [raw[a:a + n] for a, n in zip(begin[short].tolist(), length[short].tolist())]
        whole[short] = np.fromiter((ranks.get(w, -1) for w in spelt), np.int64, len(spelt))
        hard = np.flatnonzero(whole < 0)
        ids, many, odd = self.vocabulary.replay(data[_runs(begin[hard], length[hard])], length[hard])
        offset, count = np.zeros(len(begin), np.int64), np.ones(len(begin), np.int64)
        offset[hard], count[hard] = np.cumsum(many) - many, many
        easy = np.flatnonzero(whole >= 0)
        offset[easy] = len(ids) + np.arange(len(easy))
        parts, size = [ids, whole[easy]], len(ids) + len(easy)
        for w in hard[odd].tolist():
            mine = self.vocabulary.alone(raw[begin[w]:begin[w] + length[w]])
            offset[w], count[w] = size, len(mine)
            parts.append(np.array(mine, np.int64))
            size += len(mine)
        return offset, count, np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of token ids."""
        return self.spelling[_runs(self.begin[ids], self.size[ids])].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimals joined by commas."""
        return self.name[_runs(self.name_begin[ids], self.name_size[ids])].tobytes()[:-1]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the token ids of every text, and the bytes they decode to.

    With ``digest``, the same passes return n_tokens and the SHA-256 of the
    comma-joined ids and of the decoded bytes instead, so that neither the ids
    nor the bytes travel. The vocabulary, of a fixed size, is broadcast.
    """
    src = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = ([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
               T.StructField("decoded_sha256", T.StringType())] if digest else
              [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    schema = T.StructType([src.schema["doc_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(Vocabulary(sent.value, pattern))
            rows = []
            for ids, counts in encoder.encode(b.column(1).to_pylist()):
                for mine in np.split(ids, np.cumsum(counts)[:-1]):
                    back = encoder.decode(mine)
                    rows.append((len(mine), hashlib.sha256(encoder.decimals(mine)).hexdigest(),
                                 hashlib.sha256(back).hexdigest()) if digest else (mine.tolist(), back))
            kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], kind)
                                                             for k, kind in enumerate(kinds)]], schema.names)

    return src.mapInArrow(run, schema)
