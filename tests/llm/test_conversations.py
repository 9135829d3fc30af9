"""Conversation repair against an exhaustive search over all audits."""

import hashlib
import heapq
import random
import re

from fieldcast.llm import conversations, queries

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def _faults(rows):
    out = []
    for k, (role, text) in enumerate(rows):
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in rows[:k] else None if said[-1] in ".!?" else "truncated")
    return out


def _exhaustive(rows):
    """All audits by rising (cost, audit), whatever they make of the roles; the first legal one is the answer."""
    found = _faults(rows)
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, k, roles, out = heapq.heappop(heap)
        if k == len(rows) and LEGAL.match(roles):
            return cost, audit, list(out)
        if not re.match(r"s?(ua)*u?\Z", roles):
            continue
        for letter, role in (("u", "user"), ("a", "assistant")):
            if not audit.endswith("II"):
                heapq.heappush(heap, (cost + 2, audit + "I", k, roles + letter, (*out, (role, ""))))
        if k == len(rows):
            continue
        role, text = rows[k]
        heapq.heappush(heap, (cost + 3, audit + "D", k + 1, roles, out))
        if found[k] in (None, "truncated"):
            more = found[k] == "truncated"
            heapq.heappush(heap, (cost + more, audit + "K", k + 1, roles + (role[:1] or "?"), (*out, (role, text))))
            for letter, due in (("u", "user"), ("a", "assistant")):
                heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, roles + letter, (*out, (due, text))))


def test_repair_against_exhaustive_search():
    rng = random.Random(7)
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "u2", ""]), rng.choice(["a.", "b.", "c", " ", "d!", "e?  "]))
                for _ in range(rng.randint(0, 6))]
        cost, audit, out = _exhaustive(rows)
        assert conversations.repair(rows) == (cost, audit), rows
        assert conversations.applied(rows, audit) == out, rows


def test_long_conversation_is_linear():
    rng = random.Random(1)
    rows = [(rng.choice(["user", "assistant", "system"]), f"{k}{rng.choice('.!x')}") for k in range(30_000)]
    cost, audit = conversations.repair(rows)
    roles = "".join(r[:1] for r, _ in conversations.applied(rows, audit))
    assert LEGAL.match(roles) and cost < 3 * len(rows) and len(audit) - audit.count("I") == len(rows)


def test_edges(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho!"),
            (2, None, "user", "b."), (2, 5, "assistant", "c."), (2, 5, "assistant", "c."),  # null turn first, a repeated row
            (3, 0, None, None), (None, 0, "user", "x."), (None, 1, "assistant", "y"),
            (4, 0, "system", "s."), (5, 3, "user", "y" * 300_000), (6, 0, "user", "gone.")]
    df = spark.createDataFrame([(*r, 9, 9, r[0] != 6) for r in rows],
                               "conv_id long, turn long, role string, text string, cost int, r int, here boolean")
    got = {r["conv_id"]: r.asDict() for r in conversations.repaired(df, present=df["here"]).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    pick = lambda k, *c: tuple(got[k][x] for x in c)
    assert pick(1, "cost", "audit", "illegal", "gaps", "repaired") == (0, "KK", 0, 0, "user:Hi.\nassistant:Ho!")
    assert pick(2, "cost", "audit", "duplicate", "illegal", "gaps") == (3, "KKD", 1, 1, 0)
    assert pick(3, "cost", "audit", "blank", "repaired") == (3, "D", 1, "")
    assert pick(None, "cost", "audit", "truncated") == (1, "KK", 1)
    assert pick(4, "cost", "audit") == (3, "D")
    assert pick(5, "cost", "audit", "truncated") == (3, "D", 1)  # as dear as KI, and less
    assert pick(6, "cost", "audit", "gaps", "repaired") == (0, "", 0, "")
    assert conversations.repaired(df.limit(0)).count() == 0


def test_damage(spark):
    import zlib
    rows = [(c, t, r, f"Text {t}. No?") for c in range(200) for t, r in enumerate(["user", "assistant"])] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, planted int")
    got = sorted([tuple(r) for r in conversations.damaged(df).collect()], key=str)
    want = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want += [(c, t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text, h != 0)] * (2 if h == 3 else 1)
    assert got == sorted(want, key=str) and {r[4] for r in got} == {True, False}


def test_query_against_exhaustive_search(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in queries.op12_conversations(spark, sf).collect()}
    by = {}
    for r in conversations.damaged(spark.read.parquet(f"{sf}/conversations.parquet")).collect():
        by.setdefault(r["conv_id"], []).append(r)
    assert set(by) == set(got)
    for k, rows in by.items():
        rows = [(r["role"], r["text"]) for r in sorted((r for r in rows if r["present"]), key=lambda r: (r["turn"], r["role"], r["text"]))]
        cost, audit, out = _exhaustive(rows)
        text = "\n".join(f"{a}:{b}" for a, b in out)
        assert (got[k]["cost"], got[k]["audit"]) == (cost, audit)
        assert got[k]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
