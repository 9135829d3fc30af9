"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from fieldcast.llm import queries, spelling, sql

SF = "/root/testdata/sf0.001"


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _brute(counts):
    forms, rows = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and _near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * n else None
        rows[w] = (n, len(near), counts[best] if forms[w] else None)
    out = set()
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, *rows[w]))
    return out


def _got(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    letters = "abé" if seed < 3 else "a"
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(400)}
    counts = {w: rng.choice([2, 3, 20, 30, 200, 300, 3000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert _got(spelling.variants(df)) == _brute(counts)


def test_path_shared_over_several_parts(spark):
    """A prefix of a thousand words lies in every part; parts of one word each are met too."""
    words = ["prefix" + w for w in ("", "a", "aa", "ab", "b", "ba", "bab")] + ["q" * 300, "q" * 299, "q" * 150 + "x" + "q" * 149]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = spark.createDataFrame([(w, 2 + 50 * (len(w) % 2)) for w in words], "word string, n long")
            assert _got(spelling.variants(df)) == _brute({w: 2 + 50 * (len(w) % 2) for w in words})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_words_and_batches(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SPREAD", 50)
    counts = {"a" * 20_000: 2, "a" * 19_999: 40, "b" + "a" * 19_999: 3, "short": 5, "shirt": 50}
    got = _got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert ("a" * 20_000, "a" * 19_999, "a" * 19_999, 2, 2, 40) in got
    assert ("b" + "a" * 19_999, "a" * 19_999, "a" * 19_999, 3, 2, 40) in got
    assert ("short", "shirt", "shirt", 5, 1, 50) in got and len(got) == 5


def _words(rows, one_in=31):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run[:h % len(run)] + run[h % len(run) + 1:] if h % one_in == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def test_query_against_brute_force_words(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = _words(rows)
    got = {r["word"]: r["n"] for r in queries.op13_spelling(spark, SF).collect()}
    assert got == want and "op13_spelling" in sql.ORACLE


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "1 2, \n"), (4, "Écoutons ÉCOUTONS éCOUTONS"), (4, "Écoutons ÉCOUTONS éCOUTONS"),
            (None, "writing writing"), (5, "writing " * 30_000), (6, "w" * 100_000 + " " + "w" * 100_000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, word int, __key int, id int")
    for one_in in (31, 2):
        got = {r["word"]: r["n"] for r in spelling.word_counts(df, one_in=one_in).collect()}
        assert got == _words(rows, one_in)
    assert _got(spelling.variants(spelling.word_counts(df.limit(0)))) == set()
    assert _got(spelling.variants(spelling.word_counts(df, one_in=0))) == _brute(
        {w: n for w, n in _words(rows, 1 << 40).items()})
