"""Repair of conversations by weighted interval parsing.

A repaired conversation is empty, or a system message or none followed by pairs
of a user's and an assistant's. The grammar in Chomsky normal form has one
nonterminal for each pair of states (p, q): what leads from p to q. Its rules are
pq -> pr rq, and pq -> row for a kept, rewritten or deleted row. A cell of the
chart holds, for every nonterminal that derives a span of rows, the least
(cost, audit); inserted rows close every cell on both sides. As every nonterminal
may be split anywhere, one split of a span finds all it derives, so the chart is
filled for spans of doubling lengths, bottom-up, and a conversation of n rows
needs n - 1 combinations.

Two audits of one span with one cost never begin one another: what follows would
be insertions only, and these cost something. So the least audits of two spans
make the least audit of both together.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_batches

#: States: nothing yet, after the system message, after a user's, after an assistant's.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
START, FINAL, STATES = 0, (0, 3), range(4)
ROLES = {"u": "user", "a": "assistant"}
PAIRS = ("su", "ua", "au")
_BLANKS = " \t\n\x0b\x0c\r"

Entry = tuple[int, str]
Cell = dict[tuple[int, int], Entry]


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


@dataclass(frozen=True)
class Repair:
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str
    repaired: list[tuple[str, str]]


def _note(cell: Cell, key: tuple[int, int], entry: Entry) -> None:
    if key not in cell or entry < cell[key]:
        cell[key] = entry


def combine(left: Cell, right: Cell) -> Cell:
    """What two neighbouring spans derive together."""
    cell: Cell = {}
    for (p, r), (a, begin) in left.items():
        for q in STATES:
            if (r, q) in right:
                b, end = right[r, q]
                if (p, q) not in cell or a + b <= cell[p, q][0]:
                    _note(cell, (p, q), (a + b, begin + end))
    return cell


def insertions(costs: Costs) -> Cell:
    """The cell of an empty span: what inserted rows alone derive."""
    cell: Cell = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, r), (cost, audit) in list(cell.items()):
            for (state, role), q in STEPS.items():
                if state == r and role in ROLES:
                    _note(cell, (p, q), (cost + costs.insert, audit + "I"))
    return cell


def row_cell(role: str, must_go: bool, truncated: bool, closure: Cell, costs: Costs) -> Cell:
    """The cell of one row, closed under insertions; ``role`` is the initial."""
    cell: Cell = {}
    for p in STATES:
        _note(cell, (p, p), (costs.delete, "D"))
    extra = costs.truncated if truncated else 0
    for (p, wanted), q in STEPS.items():
        if must_go:
            break
        if wanted == role:
            _note(cell, (p, q), (costs.keep + extra, "K"))
        if wanted in ROLES:
            _note(cell, (p, q), (costs.rerole + extra, "R"))
    return combine(combine(closure, cell), closure)


def cheapest(cells: list[Cell], closure: Cell) -> Entry:
    """Cost and audit of the whole span, from the cells of its rows."""
    while len(cells) > 1:
        pairs = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        cells = pairs + cells[len(cells) & ~1 :]
    whole = cells[0] if cells else closure
    return min(whole[START, q] for q in FINAL if (START, q) in whole)


def apply_audit(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired rows. Which role a rewritten or inserted row has follows from what stands before it."""
    out: list[tuple[str, str]] = []
    state, at = START, 0
    for edit in audit:
        if edit != "I":
            role, text = rows[at]
            at += 1
            if edit == "D":
                continue
        if edit != "K":
            wanted = next(r for (p, r) in STEPS if p == state and r in ROLES)
            role, text = ROLES[wanted], text if edit == "R" else ""
        state = STEPS[state, role[:1]]
        out.append((role, text))
    return out


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """First fault of each row: blank, duplicate, truncated, or none ("")."""
    seen: set[tuple[str, str]] = set()
    found = []
    for row in rows:
        visible = row[1].rstrip(_BLANKS)
        if not visible:
            found.append("blank")
        elif row in seen:
            found.append("duplicate")
        else:
            found.append("" if visible[-1] in ".!?" else "truncated")
        seen.add(row)
    return found


def repair(rows: list[tuple[str, str]], costs: Costs = Costs()) -> Repair:
    """One conversation's faults and its cheapest repair; of equally cheap ones the one with the least audit."""
    found = faults(rows)
    closure = insertions(costs)
    # Rows of one kind share their cell.
    kinds: dict[tuple, Cell] = {}
    cells = []
    for (role, _), fault in zip(rows, found, strict=True):
        kind = role[:1], fault in ("blank", "duplicate"), fault == "truncated"
        if kind not in kinds:
            kinds[kind] = row_cell(*kind, closure, costs)
        cells.append(kinds[kind])
    cost, audit = cheapest(cells, closure)
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in PAIRS for a, b in zip(initials, initials[1:]))
    return Repair(*(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, apply_audit(rows, audit))


COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
ROW = pa.struct([("role", pa.string()), ("text", pa.string())])


def repair_conversations(turns: DataFrame, present: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired): one row per conversation.

    ``turns`` has conv_id, turn, role and text; other columns are left out. Rows
    follow each other by turn (nulls first), then role and text, so ties and
    repeated rows have one order. A null role or text is one blank. A row for
    which ``present`` is not true doesn't count, but its conversation is returned;
    without rows it has zeros, an empty audit and nothing repaired. Null conv_ids
    are one conversation. ``gaps`` counts turn numbers that are missing between
    the smallest and the largest. ``repaired`` lists (role, text).

    A conversation is one value, as a text is: it isn't split over tasks.
    """
    row = F.struct("turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(there, row))).alias("rows"))
    numbers = F.filter("rows.turn", lambda t: t.isNotNull())
    gaps = F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))
    grouped = grouped.select("conv_id", F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"), F.transform("rows", lambda r: F.struct(r["role"], r["text"])).alias("rows"))
    bound_batches(turns.sparkSession)

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [repair([(r["role"], r["text"]) for r in rows.as_py()], costs) for rows in batch.column("rows")]
        columns = [pa.array([getattr(d, c) for d in done], pa.int64()) for c in COUNTS]
        columns.append(pa.array([d.audit for d in done], pa.string()))
        columns.append(pa.array([[{"role": r, "text": t} for r, t in d.repaired] for d in done], pa.list_(ROW)))
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("gaps"), *columns], names=["conv_id", "gaps", *COUNTS, "audit", "repaired"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired array<struct<role:string,text:string>>"
    return map_batches(grouped, parse, schema)


def listed(repaired: str = "repaired") -> Column:
    """Repaired rows as ``role:text``, joined by line feeds."""
    return F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
