"""Conversation structure repair by depth-first branch-and-bound.

A conversation's rows are edited so that the initials of their roles read
``(s?(ua)+)?``. Keeping a row costs nothing, giving it the role that is due 2,
deleting it 3, inserting an empty turn that is due 2; a truncated row that stays
costs 1 more; blank and duplicate rows must go. Of the cheapest audits (the initials
of the edits in order: D, I, K, R) the least in ASCII order is taken.

The search keeps its open nodes on a stack of its own. A node is a row number and
what the roles so far end in. Suffix lower bounds say what the rows from there on
cost at least (and, audits aside, at best); children above their parent's bound are
not opened. The incumbent is the best whole (cost, audit) so far, and a node that
cannot beat it is cut. A dominance table holds for each node the least cost with
which it was reached: a later prefix with the same cost has the greater audit, since
children are opened in ASCII order, and one with a higher cost is worse whatever
follows. Two prefixes with equal cost at a node are never prefixes of each other, as
only insertions could tell them apart and those cost. The search ends with an empty
stack, which proves the optimum. Audits are links to their last edit, not copies, so
time and memory are linear in a conversation's rows.

Conversations are dealt by their id and streamed one after another. An audit and the
repaired text of a conversation are single values, so a conversation is the least
that a task can hold; it holds no more than one besides an Arrow batch.

Defined results: a null conversation id is a conversation of its own. A null role,
text or (where text is written) id or turn counts as one space; null turns come
first and are left out of ``gaps``. Rows of the same turn are ordered by role and
text. Repeated rows are duplicates. An empty table gives an empty result. Columns of
the input other than the named ones are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import col

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What roles end in: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that is due after each, and the state it leads to.
DUE = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
FINAL = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
_SOME = re.compile(r"[^\x20\x09-\x0D]")
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
Row = tuple[str, str]


def faults(rows: list[Row]) -> list[str | None]:
    """The first fault of each row: blank, duplicate of an earlier row, or truncated."""
    out, seen = [], set()
    for row in rows:
        text = row[1]
        if not _SOME.search(text):
            out.append(BLANK)
        elif row in seen:
            out.append(DUPLICATE)
        else:
            end = text.rstrip(" \t\n\v\f\r")[-1]
            out.append(None if end in ".!?" else CUT)
        seen.add(row)
    return out


def _steps(initial: str, fault: str | None, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row after ``state`` as (letter, cost, next state), in ASCII order; insertions are not among them."""
    out = [("D", DELETE, state)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT else 0
    due, after = DUE[state]
    if initial == due[0]:
        out.append(("K", KEEP + more, after))
    elif initial == "s" and state == START:
        out.append(("K", KEEP + more, SYSTEM))
    out.append(("R", REROLE + more, after))
    return out


def suffix_bounds(initials: list[str], found: list[str | None]) -> list[tuple[int, int, int, int]]:
    """For each row and state a lower bound on the cost of all that follows.

    It is the cost of the rows by their roles and faults alone, without the audits.
    """
    never = 1 << 60

    def with_insertions(cost: list[int]) -> tuple[int, int, int, int]:
        """One or two insertions reach any later state; more than two never pay."""
        for _ in range(2):
            cost = [min(cost[s], INSERT + cost[DUE[s][1]]) for s in range(4)]
        return tuple(cost)

    bounds = [with_insertions([0 if s in FINAL else never for s in range(4)])]
    for initial, fault in zip(reversed(initials), reversed(found)):
        after = bounds[-1]
        bounds.append(with_insertions([min(c + after[t] for _, c, t in _steps(initial, fault, s)) for s in range(4)]))
    bounds.reverse()
    return bounds


def repair(rows: list[Row], found: list[str | None] | None = None) -> tuple[int, str]:
    """(cost, audit) of the best repair of one conversation."""
    found = faults(rows) if found is None else found
    initials = [role[:1] for role, _ in rows]
    bounds, n = suffix_bounds(initials, found), len(rows)
    best_cost: int | None = None
    best: tuple | None = None
    least = [[None] * 4 for _ in range(n + 1)]
    stack: list[tuple[int, int, int, tuple | None]] = [(0, START, 0, None)]
    while stack:
        at, state, cost, audit = stack.pop()
        if best_cost is not None and cost + bounds[at][state] >= best_cost:
            continue  # equal cost would come with a greater audit: nodes are opened in ASCII order
        if least[at][state] is not None and least[at][state] <= cost:
            continue
        least[at][state] = cost
        if at == n and state in FINAL:
            best_cost, best = cost, audit  # an insertion would only add to the cost
            continue
        edits = [(letter, c, at + 1, t) for letter, c, t in _steps(initials[at], found[at], state)] if at < n else []
        edits.append(("I", INSERT, at, DUE[state][1]))
        edits.sort(key=lambda e: e[0], reverse=True)  # the least letter is opened first
        # the node's bound is that of its best child: others cannot be part of the cheapest way on
        limit = cost + bounds[at][state]
        stack += [(to, t, cost + c, (letter, audit)) for letter, c, to, t in edits if cost + c + bounds[to][t] <= limit]
    letters = []
    while best:
        letters.append(best[0])
        best = best[1]
    return best_cost or 0, "".join(reversed(letters))


def applied(rows: list[Row], audit: str) -> list[Row]:
    """The conversation after the edits of an audit."""
    out, state, left = [], START, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        due, after = DUE[state]
        if letter == "K" and role[:1] == "s" and state == START:
            due, after = role, SYSTEM
        out.append((role if letter == "K" else due, text))
        state = after
    return out


def report(rows: list[tuple[int | None, str, str]]) -> tuple:
    """Columns of :func:`repaired` after the id, of rows (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    said = [(role, text) for _, role, text in rows]
    found = faults(said)
    illegal = sum(a[:1] + b[:1] not in LEGAL for (a, _), (b, _) in zip(said, said[1:]))
    cost, audit = repair(said, found)
    text = "\n".join(f"{role}:{text}" for role, text in applied(said, audit))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count(BLANK), found.count(DUPLICATE),
            found.count(CUT), illegal, cost, audit, text)


SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def repaired(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", present: Column | None = None) -> DataFrame:
    """One row per conversation: its id, faults, cost, audit and repaired text.

    Rows where ``present`` is false are gone, but their conversation still counts.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    space = F.lit(" ")
    read = rows.select(col(id_col).alias("i"), col(turn_col).cast("long").alias("t"),
                       F.coalesce(col(role_col).cast("string"), space).alias("r"),
                       F.coalesce(col(text_col).cast("string"), space).alias("x"), here.alias("p"))
    laid = read.repartition("i").sortWithinPartitions(F.col("i"), F.col("t").asc_nulls_first(), "r", "x")
    names = ["i", *(part.split()[0] for part in SCHEMA.split(", "))]
    return laid.mapInArrow(lambda batches: _streamed(batches, names), f"i {kind}, {SCHEMA}").withColumnRenamed("i", id_col)


def _streamed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    open_id, rows, started = None, [], False
    ids, out, size = [], [], 0
    id_type = None

    def batch() -> pa.RecordBatch:
        types = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *[pa.array(c, t) for c, t in zip(zip(*out), types)]], names)

    for b in batches:
        id_type = b.schema.field(0).type
        for i, t, r, x, p in zip(*[c.to_pylist() for c in b.columns]):
            if not started or i != open_id:
                if started:
                    ids.append(open_id)
                    out.append(report(rows))
                    size += len(out[-1][-1])
                    if len(ids) >= 5000 or size >= 16 << 20:
                        yield batch()
                        ids, out, size = [], [], 0
                open_id, rows, started = i, [], True
            if p:
                rows.append((t, r, x))
    if started:
        ids.append(open_id)
        out.append(report(rows))
        yield batch()


def digest(found: DataFrame) -> DataFrame:
    """``found`` with the SHA-256 of the repaired text in its place."""
    return found.withColumn("repaired_sha256", F.sha2(F.col("repaired").cast("binary"), 256)).drop("repaired")


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", one_in: int = 20) -> DataFrame:
    """(id, turn, role, text, present): rows with planted faults, chosen by the crc32 of ``id:turn``.

    0 drops a row (``present`` is false), 1 empties its text, 2 removes its ``.!?``,
    3 repeats it, 4 makes it a user's. Nulls count as one space there.
    """
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(text(id_col), F.lit(":"), text(turn_col)).cast("binary")), F.lit(one_in))
    out = rows.select(col(id_col), col(turn_col), text(role_col).alias(role_col), text(text_col).alias(text_col),
                      h.alias("planted"))
    return out.select(
        col(id_col), col(turn_col),
        F.when(F.col("planted") == 4, "user").otherwise(col(role_col)).alias(role_col),
        F.when(F.col("planted") == 1, "").when(F.col("planted") == 2, F.translate(col(text_col), ".!?", ""))
        .otherwise(col(text_col)).alias(text_col),
        (F.col("planted") != 0).alias("present"),
        F.explode(F.when(F.col("planted") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
