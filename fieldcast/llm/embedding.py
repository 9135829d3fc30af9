"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors are scaled to length one, so a cosine of at least c is a squared
distance of at most 2 - 2c. They are turned by one fixed random rotation, which
spreads distances evenly, and split into ``blocks`` subspaces. If two vectors
are within the budget, in some subspace they are within its share of it, in
proportion to its dimensions. Each subspace is joined by range: a grid on its
first ``grid_dims`` coordinates, with cells as wide as the subspace's radius,
brings each vector together with those of its own and the adjacent cells; full
cells are split into blocks of rows. Candidates within the share are checked by
the whole cosine in double precision. A pair that is found in several subspaces
counts in the first alone, so links are counted and never collected; of the
links themselves each task passes on a spanning forest.

Equal vectors are one class with a weight. Vectors of other dimensions are
compared with their like alone.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, link with nothing: n_links 0, their own component.
Repeated rows are vectors of their own and link with each other. A null id is
never a component_id unless no row of the component has an id; such rows are
not kept. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.llm.common import col, forest, in_blocks, smallest_of_component, stored

BLOCKS = 4
GRID_DIMS = 2
BLOCK_ROWS = 8192
# Added to a subspace's share of the budget, so that rounding loses no pair.
SLACK = 1e-6
_ROWS_AT_ONCE, _PAIRS_AT_ONCE = 1024, 1 << 16


#: A class with more than this part of all rows is hot.
HOT = 1000


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def subspaces(dims: int, blocks: int) -> list[tuple[int, int]]:
    """First and end coordinate of each subspace; no more subspaces than coordinates."""
    m = min(blocks, dims)
    return [(dims * i // m, dims * (i + 1) // m) for i in range(m)]


def share(dims: int, part: tuple[int, int], budget: float) -> float:
    return budget * (part[1] - part[0]) / dims + SLACK


def turned(given: np.ndarray, turns: dict[int, np.ndarray]) -> np.ndarray:
    """Rotated unit vectors; ``turns`` keeps the rotations by dimension."""
    dims = given.shape[1]
    if dims not in turns:
        turns[dims] = rotation(dims)
    return given / np.sqrt((given * given).sum(1, keepdims=True)) @ turns[dims]


def at_least(a: np.ndarray, b: np.ndarray, min_cosine: float) -> np.ndarray:
    """Whether the cosine of each pair of rows, as the nearest double, reaches the threshold.

    Taken of the vectors as they came, since a rotation's rounding would move pairs
    on the threshold; pairs next to it are computed again with longer numbers.
    """
    def cosine(a, b):
        return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))

    found = cosine(a, b)
    close = np.flatnonzero(np.abs(found - min_cosine) < 1e-12)
    found[close] = cosine(a[close].astype(np.longdouble), b[close].astype(np.longdouble)).astype(np.float64)
    return found >= min_cosine


def _prepared(vectors: DataFrame, min_cosine: float, blocks: int, grid_dims: int) -> DataFrame:
    """(vec_id, class, keys, probes, given): class is null for vectors that link with nothing.

    ``given`` is the vector as it came, but for a power of two that brings it near 1."""
    budget = 2 - 2 * min_cosine
    bits = 38 // grid_dims
    forward = [o for o in itertools.product((-1, 0, 1), repeat=grid_dims) if o > (0,) * grid_dims]
    shift = np.array([bits * k for k in range(grid_dims)], np.int64)
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("class", T.BinaryType()),
                           T.StructField("keys", T.ArrayType(T.LongType())),
                           T.StructField("probes", T.ArrayType(T.LongType())), T.StructField("given", T.BinaryType())])

    def place(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dims = units.shape[1]
        keys, probes = [], []
        for b, part in enumerate(subspaces(dims, blocks)):
            width = share(dims, part, budget) ** 0.5
            at = units[:, part[0]:part[1]][:, :grid_dims]
            cell = np.zeros((len(units), grid_dims), np.int64)
            cell[:, :at.shape[1]] = np.floor(at / width)
            cell += 1 << (bits - 1)
            base = (dims << 46) + (b << 38)
            keys.append(base + (cell << shift).sum(1))
            for o in forward:
                probes.append(base + ((cell + np.array(o)) << shift).sum(1))
        return np.stack(keys, 1), np.stack(probes, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            raw = [None if v is None or None in v else np.array(v, np.float64) for v in b.column(1).to_pylist()]
            out: list[tuple | None] = [None] * len(raw)
            good = [i for i, v in enumerate(raw) if v is not None and len(v) and np.isfinite(v).all() and v.any()]
            for dims in {len(raw[i]) for i in good}:
                mine = [i for i in good if len(raw[i]) == dims]
                x = np.stack([raw[i] for i in mine])
                names = [hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() for v in x]
                given = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
                keys, probes = place(turned(given, turns))
                for k, i in enumerate(mine):
                    out[i] = names[k], keys[k].tolist(), probes[k].tolist(), given[k].tobytes()
            kinds = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([r and r[k] for r in out], t) for k, t in enumerate(kinds)]], schema.names)

    return vectors.mapInArrow(run, schema)


def _joined(laid: DataFrame, min_cosine: float, blocks: int) -> DataFrame:
    """Spanning-forest links (u, v) of the pairs found, and (u, null, n): n more links of class u."""
    budget = 2 - 2 * min_cosine
    turns: dict[int, np.ndarray] = {}

    class Cell:
        """The indexed rows of a block of a cell, and the links counted for them."""

        def __init__(self, key: int):
            self.dims, self.b = key >> 46, key >> 38 & 0xFF
            self.parts = subspaces(self.dims, blocks)
            self.names: list[bytes] = []
            self.weight, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
            self.units, self.given = np.empty((0, self.dims)), np.empty((0, self.dims))

    def pairs(cell: Cell, units: np.ndarray, given: np.ndarray, upto: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links between rows and the cell's; ``upto``: only with rows before that place."""
        lo, hi = cell.parts[cell.b]
        limit = share(cell.dims, (lo, hi), budget)
        index = cell.units if upto is None else cell.units[:upto.max(initial=0)]
        a, z = units[:, lo:hi].astype(np.float32), index[:, lo:hi].astype(np.float32)
        near = (a * a).sum(1)[:, None] + (z * z).sum(1)[None] - 2 * (a @ z.T) <= limit + 1e-5
        if upto is not None:
            near &= np.arange(len(index))[None] < upto[:, None]
        rows, places = np.nonzero(near)
        for at in range(0, len(rows), _PAIRS_AT_ONCE):
            p, i = rows[at:at + _PAIRS_AT_ONCE], places[at:at + _PAIRS_AT_ONCE]
            apart = (units[p] - index[i]) ** 2
            within = [apart[:, x:y].sum(1) <= share(cell.dims, (x, y), budget) for x, y in cell.parts[:cell.b + 1]]
            first = within[-1] & ~np.logical_or.reduce([np.zeros(len(p), bool), *within[:-1]])
            p, i = p[first], i[first]
            good = at_least(given[p], cell.given[i], min_cosine)
            yield p[good], i[good]

    def batch(names: list[bytes], others: list[bytes | None], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(others, pa.binary()),
                                           pa.array(n, pa.int64())], ["u", "v", "n"])

    def links(cell: Cell, names: list[bytes], weight: np.ndarray, given: np.ndarray, indexed: bool):
        base, units = len(cell.names), turned(given, turns)
        if indexed:
            cell.names += names
            cell.weight = np.concatenate([cell.weight, weight])
            cell.units, cell.given = np.concatenate([cell.units, units]), np.concatenate([cell.given, given])
            cell.n = np.concatenate([cell.n, np.zeros(len(names), np.int64)])
        for at in range(0, len(names), _ROWS_AT_ONCE):
            some = slice(at, at + _ROWS_AT_ONCE)
            mine = names[some]
            upto = base + at + np.arange(len(mine)) if indexed else None
            n = np.zeros(len(mine), np.int64)
            for p, i in pairs(cell, units[some], given[some], upto):
                if len(p):
                    np.add.at(n, p, cell.weight[i])
                    np.add.at(cell.n, i, weight[some][p])
                    u, v = forest(i, p + (base + at if indexed else len(cell.names)))
                    spelt = lambda k: cell.names[k] if k < len(cell.names) else mine[k - len(cell.names)]
                    yield batch([spelt(k) for k in u], [spelt(k) for k in v], [0] * len(u))
            if indexed:
                cell.n[base + at:base + at + len(mine)] += n
            elif n.any():
                has = np.flatnonzero(n)
                yield batch([mine[k] for k in has], [None] * len(has), n[has].tolist())

    def closed(cell: Cell | None):
        if cell is not None and cell.n.any():
            has = np.flatnonzero(cell.n)
            yield batch([cell.names[k] for k in has], [None] * len(has), cell.n[has].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, cell = None, None
        for b in batches:
            key, block, role, weight = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            if not len(key):
                continue
            names, units = b.column(4).to_pylist(), b.column(5).to_pylist()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (role[1:] != role[:-1])) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if here != (key[a], block[a]):
                    yield from closed(cell)
                    here, cell = (key[a], block[a]), Cell(int(key[a]))
                rows = np.frombuffer(b"".join(units[a:z])).reshape(z - a, cell.dims)
                yield from links(cell, names[a:z], weight[a:z], rows, role[a] == 0)
        yield from closed(cell)

    return (laid.select("key", "block", "role", "weight", "class", "given")
            .mapInArrow(run, "u binary, v binary, n long"))


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.9, id_col: str = "vec_id",
                    vector_col: str = "embedding", blocks: int = BLOCKS, grid_dims: int = GRID_DIMS,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    if not 0 < min_cosine <= 1 or not 1 <= blocks <= 256 or not 1 <= grid_dims <= 6:
        raise ValueError("min_cosine must be in (0, 1], blocks in 1..256, grid_dims in 1..6")
    src = vectors.select(col(id_col).alias("vec_id"), col(vector_col).cast("array<double>").alias("embedding"))
    rows = stored(_prepared(src, min_cosine, blocks, grid_dims), "embedding-rows")
    classes = stored(rows.where("class is not null").groupBy("class")
                     .agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("keys").alias("keys"),
                          F.first("probes").alias("probes"), F.first("given").alias("given")), "embedding-classes")
    member = lambda role, keys: classes.select(
        F.explode(keys).alias("key"), F.lit(role).alias("role"), "weight", "class", "given",
        F.xxhash64("class").alias("spread"))
    # Unit vectors: at most (2 / width + 3) ** grid_dims cells of a subspace can hold one.
    found = stored(_joined(in_blocks(member(0, "keys").union(member(1, "probes")), block_rows, few_keys=grid_dims <= 2),
                           min_cosine, blocks), "embedding-links")
    named = smallest_of_component(classes.select("class", "low"), found.where("v is not null").select("u", "v"),
                                  "class", "low")
    counts = found.where("v is null").groupBy(F.col("u").alias("class")).agg(F.sum("n").alias("n"))
    told = stored(classes.select("class", "weight").join(counts, "class", "left").join(named, "class").select(
        "class", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.col("component").alias("component_id")), "embedding-told")
    # Rows of hot classes stay where they are and meet a broadcast of fewer than HOT rows; the others are shuffled.
    hot = F.col("weight") > (classes.agg(F.sum("weight")).first()[0] or 0) // HOT
    few, rest = F.broadcast(told.where(hot).drop("weight")), told.where(~hot).drop("weight")
    linked = rows.where("class is not null").select("vec_id", "class")
    cold = linked.join(few.select("class"), "class", "left_anti")
    alone = rows.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (linked.join(few, "class").unionByName(cold.join(rest, "class")).drop("class").unionByName(alone)
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
