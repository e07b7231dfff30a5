"""Secrets by one deterministic automaton over the bytes of all texts.

The regexes of all rules become one automaton by subset construction and
minimisation. Read as a search it passes over each byte once and tells which
stretches of text hold a match. In those, its states carry the set of rules that
accept there: one pass follows the tries for a match from all bytes side by side,
for all rules at once, and gives the leftmost and longest matches, without
overlaps within a rule.
"""

from __future__ import annotations

from array import array
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, set_aside, utf8_view, whole_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    ``pattern`` understands literals, ``\\xNN``, escaped characters, classes,
    groups, ``|``, ``?``, ``*``, ``+`` and ``{m,}``, all greedy, over ASCII.
    ``any_case`` lets letters match in either case. A match shorter than
    ``least`` characters is found, and stepped over, but dropped; ``last_least``
    asks the same of the part that the final repeat takes.
    """

    kind: str
    pattern: str
    any_case: bool = False
    least: int = 0
    last_least: int = 0


#: The three kinds every user of the scan relies on.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, last_least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Kinds of this library.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh(p|o|u|s|r)_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox(a|b|p|r|s)-[A-Za-z0-9-]+", least=15),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES


class _Net:
    """A nondeterministic automaton: byte steps and empty steps between numbered states."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[int, int]]] = []  # of each state: (set of bytes as bits, next)
        self.empty: list[list[int]] = []
        self.ends: dict[int, int] = {}  # accepting state: its rule
        self.count: dict[int, tuple[int, int]] = {}  # state inside a counted repeat: (repeat, times)

    def state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1


class _Reader:
    """Builds the states of one pattern by recursive descent."""

    def __init__(self, net: _Net, rule: Rule, screen: bool):
        self.net, self.text, self.i = net, rule.pattern, 0
        self.any_case, self.screen, self.rule = rule.any_case, screen, rule

    def look(self) -> str:
        return self.text[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.text[self.i - 1]

    def either(self, at: int) -> int:
        """Alternatives from state ``at``; gives the state behind them."""
        end = self.net.state()
        while True:
            begin = self.net.state()
            self.net.empty[at].append(begin)
            self.net.empty[self.row(begin)].append(end)
            if self.look() != "|":
                return end
            self.take()

    def row(self, at: int) -> int:
        while self.look() and self.look() not in "|)":
            at = self.item(at)
        return at

    def item(self, at: int) -> int:
        if self.look() == "(":
            self.take()
            end = self.either(at)
            self.take()
            return self.repeat_any(at, end)
        alone = self.i == 0
        chosen = self.chars()
        sign = self.look()
        if sign and sign in "?*+":
            self.take()
            final = self.i >= len(self.text.rstrip(")"))
            least = {"?": 0, "*": 0, "+": 1}[sign]
            # When only screening, the last repeat may ask at once for what a kept match must have.
            if self.screen and final and sign == "+":
                least = max(1, self.rule.last_least, self.rule.least if alone else 0)
            return self.repeat(at, chosen, least, sign != "?")
        end = self.net.state()
        self.net.steps[at].append((chosen, end))
        return end

    def repeat_any(self, at: int, end: int) -> int:
        if self.look() == "?":
            self.take()
            self.net.empty[at].append(end)
        elif self.look() and self.look() in "*+{":
            raise ValueError("groups repeat at most once here")
        return end

    def repeat(self, at: int, chosen: int, least: int, more: bool) -> int:
        loop = len(self.net.steps)
        for times in range(1, max(1, least) + 1):
            end = self.net.state()
            self.net.steps[at].append((chosen, end))
            if more and least > 1:
                self.net.count[end] = (loop, times)
            if least == 0:
                self.net.empty[at].append(end)
            at = end
        if more:
            self.net.steps[at].append((chosen, at))
        return at

    def chars(self) -> int:
        c = self.take()
        if c == "[":
            chosen = 0
            while self.look() != "]":
                low = self.one()
                if self.look() == "-" and self.text[self.i + 1 : self.i + 2] != "]":
                    self.take()
                    high = self.one()
                else:
                    high = low
                for b in range(low, high + 1):
                    chosen |= self.bit(b)
            self.take()
            return chosen
        self.i -= 1
        return self.bit(self.one())

    def one(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        if self.look() == "x":
            self.i += 3
            return int(self.text[self.i - 2 : self.i], 16)
        return ord(self.take())

    def bit(self, b: int) -> int:
        c = chr(b)
        both = {c.lower(), c.upper()} if self.any_case and c.isascii() else {c}
        return sum(1 << ord(x) for x in both)


class Automaton:
    """A minimal deterministic automaton: ``table[state, byte]`` is the next state, 0 the first.

    ``rules_at[state]`` are the rules that accept there, by number; a screen doesn't tell them apart.
    """

    def __init__(self, rules: tuple[Rule, ...], screen: bool):
        """``screen``: search anywhere and stay in the accepting state, else match from the first byte on."""
        net = _Net()
        root = net.state()
        for k, rule in enumerate(rules):
            reader = _Reader(net, rule, screen)
            net.ends[reader.either(root)] = k
            if reader.i < len(rule.pattern):
                raise ValueError(f"can't read {rule.pattern} from {reader.i} on")
        self._subsets(net, root, screen)
        self._minimise()

    def _closed(self, net: _Net, states: set[int]) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for t in net.empty[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        # Of the threads in one counted repeat, the furthest accepts all that the others accept.
        most: dict[int, int] = {}
        for s in found & net.count.keys():
            loop, times = net.count[s]
            most[loop] = max(times, most.get(loop, 0))
        return frozenset(s for s in found if s not in net.count or net.count[s][1] == most[net.count[s][0]])

    def _subsets(self, net: _Net, root: int, screen: bool) -> None:
        sets = {m for steps in net.steps for m, _ in steps}
        kinds: dict[tuple[bool, ...], list[int]] = {}
        for b in range(256):
            kinds.setdefault(tuple(bool(m >> b & 1) for m in sets), []).append(b)
        first = self._closed(net, {root})
        numbers, todo, rows, rules_at = {first: 0}, [first], [], []
        sink = frozenset({-1})
        while todo:
            now = todo.pop(0)
            row = np.zeros(256, np.int32)
            rows.append(row)
            rules_at.append((-1,) if now == sink else tuple(sorted({net.ends[s] for s in now if s in net.ends})))
            for group in kinds.values():
                if now == sink:
                    then = sink
                else:
                    then = self._closed(net, {t for s in now for m, t in net.steps[s] if m >> group[0] & 1} | ({root} if screen else set()))
                    if screen and any(s in net.ends for s in then):
                        then = sink
                if then not in numbers:
                    numbers[then] = len(numbers)
                    todo.append(then)
                row[group] = numbers[then]
        self.table, self.rules_at = np.array(rows), rules_at
        dead = numbers.get(frozenset())
        self.dead = -1 if dead is None else dead

    def _minimise(self) -> None:
        """Merge states that no string tells apart, by refining those that accept for the same rules."""
        kinds = {r: k for k, r in enumerate(dict.fromkeys(self.rules_at))}
        block = np.array([kinds[r] for r in self.rules_at], np.int64)
        while True:
            seen = np.column_stack([block, block[self.table]])
            _, refined = np.unique(seen, axis=0, return_inverse=True)
            refined = refined.reshape(-1)
            if refined.max() == block.max():
                break
            block = refined
        # The first state keeps number 0.
        order = {b: k for k, b in enumerate(dict.fromkeys(block.tolist()))}
        block = np.array([order[b] for b in block.tolist()])
        _, chosen = np.unique(block, return_index=True)
        self.table = block[self.table[chosen]].astype(np.int32)
        self.rules_at = [self.rules_at[c] for c in chosen.tolist()]
        self.accepts = np.array([bool(r) for r in self.rules_at])
        self.dead = int(block[self.dead]) if self.dead >= 0 else -1


class Scanner:
    """The compiled rules: their automaton as a search that screens, and from a begin on, which cuts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        search = Automaton(rules, screen=True)
        self.table = search.table.reshape(-1)
        self.rows = search.table.tolist()
        self.hit = int(np.flatnonzero(search.accepts)[0])
        free = np.ones(len(search.table), bool)
        free[self.hit] = False
        #: Bytes after which the automaton is where it began, whatever came before.
        self.resets = (search.table[free] == 0).all(axis=0)
        exact = Automaton(rules, screen=False)
        self.exact, self.rules_at, self.dead = exact.table.tolist(), exact.rules_at, exact.dead
        self.begins = frozenset(b for b in range(256) if exact.table[0, b] != exact.dead)
        self.tails = [_tail(r) for r in rules]
        least, front = 1, {0}
        while self.hit not in (front := {t for s in front for t in self.rows[s]}):
            least += 1
        self.least = least

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the stretches between resets in which the automaton accepts."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh = np.zeros(len(data) + 1, bool)
        fresh[1:] = self.resets[data]
        fresh[offsets] = True
        begins = np.flatnonzero(fresh[:-1])
        ends = np.append(begins[1:], len(data))
        long = ends - begins >= self.least
        begins, ends = begins[long], ends[long]
        order = np.argsort(begins - ends, kind="stable")
        begins, ends = begins[order], ends[order]
        length = ends - begins
        state = np.zeros(len(begins), np.int32)
        # Stretches side by side, one byte of each at a time; the few longest one by one.
        alive, j = len(begins), 0
        while alive >= 32:
            state[:alive] = self.table[state[:alive] * 256 + data[begins[:alive] + j]]
            j += 1
            alive = int(np.searchsorted(-length, -j, side="left"))
        for k in range(alive):
            s, rows = int(state[k]), self.rows
            for b in data[begins[k] + j : ends[k]].tobytes():
                s = rows[s][b]
            state[k] = s
        found = state == self.hit
        begins, ends = begins[found], ends[found]
        order = np.argsort(begins)
        return begins[order], ends[order]

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """Kept matches in a stretch as (start, rule, end) in bytes, those of a rule by start.

        Each byte that can begin a match begins a try. Tries in the same state have
        the same future, so the younger one joins the older and no more than one try
        a state goes on: the time is linear in the stretch.
        """
        rows, rules_at, dead, first, many = self.exact, self.rules_at, self.dead, self.begins, len(self.rules)
        found: list[tuple[int, int, int]] = []
        free = [0] * many  # of each rule: where its next match may begin
        live: dict[int, int] = {}  # state: its try, the oldest ones first
        starts, older, joined = array("q"), array("q"), array("q")
        ends: dict[int, int] = {}  # try and rule: the last byte at which it accepted by itself
        for j, b in enumerate(data):
            if b in first:
                if 0 in live:
                    older.append(live[0])
                else:
                    live[0] = len(starts)
                    older.append(-1)
                starts.append(j)
                joined.append(j)
            then: dict[int, int] = {}
            for s, t in live.items():
                s = rows[s][b]
                if s == dead:
                    continue
                if s in then:
                    older[t], joined[t] = then[s], j + 1
                else:
                    then[s] = t
                    for k in rules_at[s]:
                        ends[t * many + k] = j + 1
            live = then
            if not live and starts:
                if ends:
                    self._settle(data, starts, older, joined, ends, free, found)
                    ends.clear()
                starts, older, joined = array("q"), array("q"), array("q")
        if ends:
            self._settle(data, starts, older, joined, ends, free, found)
        return found

    def _settle(self, data: bytes, starts: array, older: array, joined: array, ends: dict[int, int], free: list[int], found: list[tuple[int, int, int]]) -> None:
        """Add the leftmost and longest matches of finished tries to ``found``."""
        many = len(self.rules)
        for k in sorted({x % many for x in ends}):
            rule, tail = self.rules[k], self.tails[k]
            for t, start in enumerate(starts):
                if start < free[k]:
                    continue
                end, since = ends.get(t * many + k, 0), joined[t]
                up = older[t]
                while up >= 0:
                    # What the older try accepted before the younger one joined isn't the younger one's.
                    later = ends.get(up * many + k, 0)
                    if later >= since:
                        end = later
                    since, up = joined[up], older[up]
                if not end:
                    continue
                if end - start >= rule.least and (not rule.last_least or tail(data[start:end]) >= rule.last_least):
                    found.append((start, k, end))
                free[k] = end

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Of each text: (start, rule, end) of all matches in code points, by start, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        begins, ends = self.stretches(data, offsets)
        owner = np.searchsorted(offsets, begins, side="right") - 1
        points, at = None, -1
        for begin, end, text in zip(begins.tolist(), ends.tolist(), owner.tolist(), strict=True):
            if text != at:
                at = text
                own = data[offsets[text] : offsets[text + 1]]
                points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            stretch, base = data[begin:end].tobytes(), begin - int(offsets[text])
            out[text] += [(int(points[base + i]), k, int(points[base + j])) for i, k, j in self.matches(stretch)]
        for found in out:
            found.sort()
        return out


def _tail(rule: Rule):
    """How many characters the final repeat of a match took."""
    if not rule.last_least:
        return len
    before = Automaton((Rule("", rule.pattern[: rule.pattern.rindex("([")], rule.any_case),), screen=False)
    rows, accepts, dead = before.table.tolist(), before.accepts.tolist(), before.dead

    def count(data: bytes) -> int:
        # What stands before the repeat is as long as it can be.
        s, end = 0, 0
        for j, b in enumerate(data):
            s = rows[s][b]
            if s == dead:
                break
            if accepts[s]:
                end = j + 1
        return len(data) - end

    return count


SPANS = "array<struct<start:bigint,kind:string,end:bigint>>"


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", spans: str = "spans", masked: str | None = None) -> DataFrame:
    """Every row with the spans of its secrets, by start, then kind as listed; code points, end exclusive.

    ``masked`` names a column for the text with each secret, overlapping ones
    together, replaced by ``[kind]``; it may be the text column itself, and a null
    text stays null. A null or empty text has no spans. Rows are handled one by
    one; a column called like a result is replaced by it.
    """
    held = docs.sparkSession.sparkContext.broadcast({"rules": [astuple(r) for r in rules]})
    made = {spans: SPANS} | ({masked: "string"} if masked else {})
    aside, give_back = set_aside(docs, text)
    kept = aside.select("*", whole_text(text).alias("_whole_text"), F.col(text).isNull().alias("_no_text")).drop(*made)
    fields = [f for f in kept.schema.fields if f.name not in ("_whole_text", "_no_text")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{n}` {t}" for n, t in made.items())])
    kinds = [r.kind for r in rules]
    kind_of = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "scanner" not in held.value:
            held.value["scanner"] = Scanner(tuple(Rule(*r) for r in held.value["rules"]))
        column = batch.column("_whole_text")
        found = held.value["scanner"].spans(*utf8_view(column))
        columns = [batch.column(f.name) for f in fields]
        columns.append(pa.array([[{"start": i, "kind": kinds[k], "end": j} for i, k, j in x] for x in found], pa.list_(kind_of)))
        if masked:
            absent = batch.column("_no_text").to_pylist()
            texts = [None if no else mask(column[i].as_py(), found[i], kinds) if found[i] else column[i].as_py() for i, no in enumerate(absent)]
            columns.append(pa.array(texts, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), *made])

    return give_back(map_batches(kept, scan, schema))


def mask(text: str, found: list[tuple[int, int, int]], kinds: list[str]) -> str:
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[{kinds[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as kind:start:end, comma-joined; of the given kinds only."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
