import hashlib
import heapq
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import plain
from pyspark.sql import functions as F

from ensemblescope.llm import queries
from ensemblescope.llm.turn_repair import Costs, cheapest, combine, insertions, repair, repair_conversations, row_cell

RIGHT = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def brute_faults(rows):
    found = []
    for i, (role, text) in enumerate(rows):
        if not text.strip(BLANK):
            found.append("blank")
        elif (role, text) in rows[:i]:
            found.append("duplicate")
        else:
            found.append("" if text.rstrip(BLANK)[-1] in ".!?" else "truncated")
    return found


def brute(rows):
    """Cheapest edits by search over (rows read, output so far is s / u / a / nothing), audits in order."""
    found = brute_faults(rows)
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, last = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for x in follows.replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", at, x))
        if at < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last))
            if found[at] not in ("blank", "duplicate"):
                extra = 3 * (found[at] == "truncated")
                if rows[at][0][:1] and rows[at][0][:1] in follows:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, rows[at][0][:1]))
                for x in follows.replace("s", ""):
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", at + 1, x))


ROWS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", " ", "user", "assistant"]), st.sampled_from(["a.", "b!", "c", "", " ", "d?\n", "e.", "f.", "g ."])), max_size=9)


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_equals_search(rows):
    got = repair(rows)
    assert (got.cost, got.audit) == brute(rows)
    initials = "".join(r[:1] for r, _ in got.repaired)
    assert RIGHT.fullmatch(initials)
    assert (got.blank, got.duplicate, got.truncated) == tuple(brute_faults(rows).count(f) for f in ("blank", "duplicate", "truncated"))
    assert sum(c in "KRD" for c in got.audit) == len(rows)


@settings(max_examples=60, deadline=None)
@given(ROWS)
def test_any_split_of_a_span_derives_the_same(rows):
    """The whole chart, all spans and all splits, agrees with doubling spans."""
    costs = Costs()
    closure = insertions(costs)
    cells = [row_cell(r[:1], f in ("blank", "duplicate"), f == "truncated", closure, costs) for (r, _), f in zip(rows, brute_faults(rows))]
    chart = {(i, i + 1): c for i, c in enumerate(cells)}
    for width in range(2, len(rows) + 1):
        for i in range(len(rows) - width + 1):
            splits = [combine(chart[i, k], chart[k, i + width]) for k in range(i + 1, i + width)]
            assert all(s == splits[0] for s in splits)
            chart[i, i + width] = splits[0]
    if rows:
        assert min(chart[0, len(rows)][0, q] for q in (0, 3) if (0, q) in chart[0, len(rows)]) == cheapest(cells, closure)


def test_long_conversation():
    rows = [("user" if i % 3 else "assistant", f"text {i}.") for i in range(5000)]
    got = repair(rows)
    assert (got.cost, got.audit) == brute(rows)


def test_other_costs():
    rows = [("user", "a."), ("user", "b.")]
    assert repair(rows, Costs(rerole=9, delete=1, insert=5)).audit == "DD"
    assert repair(rows, Costs(rerole=1)).audit == "KR" and repair(rows, Costs(rerole=9, delete=7)).audit == "KIKI"


def test_odd_rows(spark):
    said = [(1, None, "user", "b.", "x"), (1, 5, "assistant", "c.", "x"), (1, 2, None, None, "x"), (1, 2, "user", "b.", "x"), (None, None, None, None, None), (3, 1, "user", "long. " * 50_000, "x"), (3, 2, "assistant", "é.", "x"), (4, 1, "user", "gone.", "x")]
    turns = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string, rows string").repartition(3)
    got = {r.conv_id: r for r in repair_conversations(turns, present=F.coalesce(F.col("conv_id"), F.lit(0)) != 4).collect()}
    assert set(got) == {1, None, 3, 4}
    assert (got[1].gaps, got[1].blank, got[1].duplicate, got[1].illegal) == (2, 1, 1, 2) and got[1].audit == "KDDK" and got[1].cost == 8
    assert (got[None].gaps, got[None].blank, got[None].audit, got[None].repaired) == (0, 1, "D", [])
    assert got[3].audit == "KK" and got[3].repaired[0].text == "long. " * 50_000
    assert (got[4].gaps, got[4].cost, got[4].audit, got[4].repaired) == (0, 0, "", [])
    assert repair_conversations(turns.limit(0)).count() == 0


def expected(table):
    conversations = {}
    for r in table:
        conv = conversations.setdefault(r.conv_id, [])
        role, text = (" " if x is None else x for x in (r.role, r.text))
        turn = " " if r.turn is None else r.turn
        kind = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub(r"[.!?]", "", text)
        conv += [(r.turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv_id, conv in conversations.items():
        conv.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        rows = [r[1:] for r in conv]
        numbers = {r[0] for r in conv if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = brute(rows)
        faults = brute_faults(rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        fixed, at = [], 0
        for edit in audit:
            role, text = ("user" if not fixed or fixed[-1][0][0] in "sa" else "assistant"), ""
            if edit != "I":
                text = rows[at][1]
                role = rows[at][0] if edit == "K" else role
                at += 1
            if edit != "D":
                fixed.append((role, text))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv_id, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def test_query(spark, sf_dir, tmp_path):
    given_rows = queries.read(spark, sf_dir, "conversations")
    more = spark.createDataFrame([(-1, None, None, None), (-1, 3, "user", None), (None, 1, "user", "x"), (-2, 7, "tool", "same."), (-2, 7, "tool", "same."), (-2, 9, "assistant", "?")], "conv_id bigint, turn bigint, role string, text string")
    turns = given_rows.select("conv_id", "turn", "role", "text").unionByName(more)
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = plain(queries.op12_turn_repair(spark, str(tmp_path)))
    assert got == expected(turns.collect())
    assert all(sum(r[k] for r in got) > 0 for k in range(1, 7))
