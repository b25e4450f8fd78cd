"""Secret scans with one combined deterministic automaton.

Every rule is a regular expression over bytes. Thompson's construction gives each rule's states,
subset construction joins all rules' triggers into one search automaton, partition refinement
minimises it, and the result is a flat transition array: state x byte class -> state. Texts are cut
into lanes of `LANE` bytes that are scanned in lock step, one byte of every lane at a time, so the inner
loop is two array look-ups, whatever the number of rules and however long a text is. A lane starts a
little earlier than its bytes; if its state at their beginning isn't the one in which the lane
before ended, it is scanned again from there, so lanes never decide what is found.

The pass names the ends of triggers. From an end, the rule's reversed automaton walks back to where
the trigger begins, and from there the rule's own automaton walks on to the longest match, telling where
the measured group begins. Matches are leftmost and non-overlapping for each rule; failing ones are
dropped after they have taken their bytes. What follows inside a match is never walked again.

`assign`, `access` and `hex` are the base kinds; the other rules add spans of their own kinds.
Null texts count as empty. Spans are in code points, end exclusive. Repeated rows give their spans each;
extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.texts import code_points, map_rows, raw_text


@dataclass(frozen=True)
class Rule:
    """`spans` is the rule; `trigger` a shorter expression that every match which can pass begins with.

    A trigger shortens counted repeats, for in a search a repeat that can hold its own beginning multiplies the automaton's
    states. Of two triggers of a rule the one that begins first must not end last. A match passes if group `group` has at
    least `least` characters.
    """

    kind: str
    spans: str
    trigger: str
    group: int = 0
    least: int = 0


#: Base rules first, in the order of the contract.
RULES = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{4}", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{4}", 0, 18),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{16}", 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\."),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{4}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]{3}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}", r"AIza[A-Za-z0-9_-]{3}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@\"'<>]+:[^\x20\x09-\x0D/:@\"'<>]+@", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@\"'<>]+:[^\x20\x09-\x0D/:@\"'<>]+@"),
)
BASE = ("assign", "access", "hex")


# --- regular expressions to automata


class Nfa:
    """Thompson's construction for literals, classes, groups, alternation, ? * + {n} and {n,}."""

    def __init__(self, pattern: str):
        self.empty: list[list[int]] = []
        self.steps: list[list[tuple[frozenset, int]]] = []
        #: The states created for each group.
        self.groups: list[range] = []
        self.text, self.at = pattern, 0
        self.first, self.last = self._either()
        if self.at < len(pattern):
            raise ValueError(f"can't read {pattern!r} at {self.at}")
        self.groups.insert(0, range(len(self.empty)))

    def state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def _either(self) -> tuple[int, int]:
        ways = [self._row()]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            ways.append(self._row())
        if len(ways) == 1:
            return ways[0]
        first, last = self.state(), self.state()
        for a, b in ways:
            self.empty[first].append(a)
            self.empty[b].append(last)
        return first, last

    def _row(self) -> tuple[int, int]:
        first = last = self.state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            began = self.at
            a, b = self._atom()
            ended = self.at
            mark = self.text[self.at] if self.at < len(self.text) else ""
            if mark == "{":
                close = self.text.index("}", self.at)
                least, comma, _ = self.text[self.at + 1 : close].partition(",")
                for _ in range(int(least) - 1):
                    self.at = began
                    c, d = self._atom()
                    self.empty[b].append(c)
                    b = d
                if comma:
                    self.at = began
                    c, d = self._atom()
                    self.empty[b].append(c)
                    self.empty[d].append(b)
                assert self.at == ended
                self.at = close + 1
            elif mark and mark in "?*+":
                self.at += 1
                c, d = self.state(), self.state()
                self.empty[c].append(a)
                self.empty[b].append(d)
                if mark in "?*":
                    self.empty[c].append(d)
                if mark in "*+":
                    self.empty[b].append(a)
                a, b = c, d
            self.empty[last].append(a)
            last = b
        return first, last

    def _atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            place, began = len(self.groups), len(self.empty)
            self.groups.append(range(0))
            out = self._either()
            self.groups[place] = range(began, len(self.empty))
            self.at += 1
            return out
        chars = self._class() if c == "[" else frozenset([self._char()])
        a, b = self.state(), self.state()
        self.steps[a].append((chars, b))
        return a, b

    def _char(self) -> int:
        c = self.text[self.at]
        if c != "\\":
            self.at += 1
            return ord(c)
        if self.text[self.at + 1] == "x":
            self.at += 4
            return int(self.text[self.at - 2 : self.at], 16)
        self.at += 2
        return ord(self.text[self.at - 1])

    def _class(self) -> frozenset:
        self.at += 1
        invert = self.text[self.at] == "^"
        self.at += invert
        chars: set[int] = set()
        while self.text[self.at] != "]":
            low = high = self._char()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                high = self._char()
            chars |= set(range(low, high + 1))
        self.at += 1
        return frozenset(range(256)) - chars if invert else frozenset(chars)

    def reversed(self) -> Nfa:
        """The automaton of all matches read backwards."""
        out = object.__new__(Nfa)
        out.first, out.last, out.groups = self.last, self.first, self.groups
        out.empty, out.steps = [[] for _ in self.empty], [[] for _ in self.steps]
        for a, (to, moves) in enumerate(zip(self.empty, self.steps, strict=True)):
            for b in to:
                out.empty[b].append(a)
            for chars, b in moves:
                out.steps[b].append((chars, a))
        return out


#: Subsets before minimisation. Counted parts that can overlap themselves multiply subsets.
MOST_STATES = 50_000


def subsets(rules: list[Nfa], search: bool, keep: int = 0) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
    """Subset construction over all rules: rows of states by byte class, rules accepted by each state (bits), its NFA states (bits), byte classes.

    State 0 is the start; state -1 is none. A search starts anew at every byte. NFA states of `keep` tell sets apart, too.
    """
    base, shift = [], 0
    for nfa in rules:
        base.append(shift)
        shift += len(nfa.empty)
    moves = [(b + a, chars, b + to) for nfa, b in zip(rules, base, strict=True) for a, own in enumerate(nfa.steps) for chars, to in own]
    sets = sorted({chars for _, chars, _ in moves}, key=sorted)
    traits: dict[tuple, int] = {}
    byte_class = np.array([traits.setdefault(tuple(b in s for s in sets), len(traits)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(traits))]
    closed: list[int] = []
    for nfa, b in zip(rules, base, strict=True):
        for s in range(len(nfa.empty)):
            seen, todo = {s}, [s]
            while todo:
                new = [x for x in nfa.empty[todo.pop()] if x not in seen]
                seen.update(new)
                todo += new
            closed.append(sum(1 << (b + x) for x in seen))
    to: dict[int, list[int]] = {}  # by NFA state: where each byte class leads, as bits
    for a, chars, b in moves:
        own = to.setdefault(1 << a, [0] * len(sample))
        for c, byte in enumerate(sample):
            if byte in chars:
                own[c] |= closed[b]
    starts, ends = sum(closed[b + nfa.first] for nfa, b in zip(rules, base, strict=True)), [1 << (b + nfa.last) for nfa, b in zip(rules, base, strict=True)]
    moving = sum(to)
    # of a set only the states that move or accept matter
    matter = moving | sum(ends) | keep
    number, masks, rows = {starts & matter: 0}, [starts & matter], []
    for here in masks:
        if len(masks) > MOST_STATES:
            raise ValueError("the triggers overlap too much; shorten their counted parts")
        row, left = [starts if search else 0] * len(sample), here & moving
        while left:
            bit = left & -left
            left ^= bit
            row = [x | y for x, y in zip(row, to[bit], strict=True)]
        out = []
        for there in row:
            there &= matter
            if not there:
                out.append(-1)
                continue
            if there not in number:
                number[there] = len(masks)
                masks.append(there)
            out.append(number[there])
        rows.append(out)
    accept = np.array([sum(1 << k for k, e in enumerate(ends) if m & e) for m in masks], np.int64)
    return np.array(rows), accept, masks, byte_class


#: Bytes of a lane, and bytes before them that it reads to find its state.
LANE, BEFORE = 4096, 64


class Automaton:
    """The minimal search automaton of all `patterns`: `next[state + byte_class[byte]]`, states in steps of `classes`.

    States that accept come last, from `accepting` on; `accept` has the bits of their rules.
    """

    def __init__(self, patterns: tuple[str, ...]):
        rows, accept, _, self.byte_class = subsets([Nfa(p) for p in patterns], search=True)
        self.subsets, self.classes = len(rows), rows.shape[1]
        block = np.unique(accept, return_inverse=True)[1]
        while True:  # splits blocks of states by what they accept and where they lead, until none splits
            _, finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        _, first = np.unique(block, return_index=True)
        order = np.argsort(accept[first] != 0, kind="stable")
        place = np.argsort(order)
        self.states = len(first)
        self.start = int(place[block[0]]) * self.classes
        self.next = (place[block[rows[first[order]]]] * self.classes).reshape(-1).astype(np.int32)
        self.accept = accept[first[order]]
        self.accepting = int((self.accept == 0).sum()) * self.classes
        self.slow: tuple[list[int], list[int]] | None = None

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, end, bits of the rules) wherever triggers end, in order; one pass over all bytes."""
        sizes = np.array([len(x) for x in texts], np.int64)
        parts = -(-sizes // LANE)
        n = int(parts.sum())
        data = self.byte_class[np.frombuffer(b"".join(texts), np.uint8)]
        text = np.repeat(np.arange(len(texts)), parts)
        base = (np.cumsum(sizes) - sizes)[text]
        bound = base + (np.arange(n) - (np.cumsum(parts) - parts)[text]) * LANE
        end = np.minimum(bound + LANE, base + sizes[text])
        later = bound > base
        begin = bound - np.where(later, BEFORE, 0)
        order = np.argsort(begin - end, kind="stable")  # longest first
        start_at, length, is_later = begin[order], (end - begin)[order], later[order]
        state, met, final = np.full(n, self.start, np.int32), np.full(n, -1, np.int32), np.full(n, self.start, np.int32)
        found: list[tuple[np.ndarray, int, np.ndarray]] = []
        live, k, ascending = n, 0, length[::-1]
        while live:
            upto = int(length[live - 1])
            at = start_at[:live]
            while k < upto:
                if k == BEFORE:
                    met[:live] = np.where(is_later[:live], state, -1)
                state = self.next[state + data[at + k]]
                k += 1
                if int(state.max()) >= self.accepting:
                    hit = np.flatnonzero(state >= self.accepting)
                    found.append((hit, k, state[hit]))
            left = n - int(np.searchsorted(ascending, k, "right"))
            final[left:live] = state[left:live]
            live, state = left, state[:left]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        met, final = met[place], final[place]
        lane = order[np.concatenate([h for h, _, _ in found])] if found else np.zeros(0, np.int64)
        where = begin[lane] + (np.repeat([k for _, k, _ in found], [len(h) for h, _, _ in found]) if found else 0)
        bits = self.accept[np.concatenate([x for _, _, x in found]) // self.classes] if found else np.zeros(0, np.int64)
        good = where > bound[lane]
        wrong = self._again(data, bound, end, later, met, final)
        if wrong:
            good &= ~np.isin(lane, [i for i, _ in wrong])
            more = [(i, p, b) for i, own in wrong for p, b in own]
            lane, where, bits = (np.concatenate([x[good], np.array([m[c] for m in more], np.int64)]) for c, x in enumerate((lane, where, bits)))
        else:
            lane, where, bits = lane[good], where[good], bits[good]
        sort = np.argsort(where, kind="stable")
        lane, where, bits = lane[sort], where[sort], bits[sort]
        return text[lane], where - base[lane], bits

    def _again(self, data: np.ndarray, bound: np.ndarray, end: np.ndarray, later: np.ndarray, met: np.ndarray, final: np.ndarray) -> list[tuple[int, list]]:
        """Lanes that didn't find their state in time, scanned from where the lane before ended: (lane, its hits)."""
        out = []
        todo = np.flatnonzero(later[1:] & (met[1:] != final[:-1])) + 1 if len(later) > 1 else []
        for i in todo:
            while i < len(later) and later[i] and met[i] != final[i - 1] and not (out and out[-1][0] >= i):
                if self.slow is None:
                    self.slow = self.next.tolist(), self.accept.tolist()
                (step, accept), state, own = self.slow, int(final[i - 1]), []
                for at, c in enumerate(data[bound[i] : end[i]].tolist(), int(bound[i]) + 1):
                    state = step[state + c]
                    if state >= self.accepting:
                        own.append((at, accept[state // self.classes]))
                out.append((int(i), own))
                final[i] = state
                i += 1
        return out

    def scan(self, texts: list[bytes]) -> np.ndarray:
        """Bit set of the rules whose triggers each text holds."""
        out = np.zeros(len(texts), np.int64)
        which, _, bits = self.hits(texts)
        np.bitwise_or.at(out, which, bits)
        return out


class Walk:
    """One rule's automaton from a fixed place, for single steps; state -1 is none."""

    def __init__(self, nfa: Nfa, group: int = 0):
        own = set(nfa.groups[group])
        inside = sum(1 << s for s in {to for a in own for _, to in nfa.steps[a]} & own)
        rows, accept, masks, byte_class = subsets([nfa], search=False, keep=inside)
        self.rows = [[int(row[c]) for c in byte_class] for row in rows]
        self.accept = (accept > 0).tolist()
        self.inside = [bool(m & inside) for m in masks]

    def longest(self, raw: bytes, start: int) -> tuple[int, int]:
        """(end of the longest match from `start`, or -1; begin of its group)."""
        rows, accept, inside = self.rows, self.accept, self.inside
        state, end, begin = 0, -1, -1
        for i in range(start, len(raw)):
            state = rows[state][raw[i]]
            if state < 0:
                break
            if begin < 0 and inside[state]:
                begin = i
            if accept[state]:
                end = i + 1
        return end, begin

    def backwards(self, raw: bytes, end: int, least: int) -> list[int]:
        """Where matches that end at `end` begin, from `least` on, leftmost first."""
        rows, accept, state, out = self.rows, self.accept, 0, []
        for i in range(end - 1, least - 1, -1):
            state = rows[state][raw[i]]
            if state < 0:
                break
            if accept[state]:
                out.append(i)
        return out[::-1]


# --- spans


class Scanner:
    """All automata of the rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.automaton = Automaton(tuple(r.trigger for r in rules))
        self.forwards = [Walk(Nfa(r.spans), r.group) for r in rules]
        self.back = [Walk(Nfa(r.trigger).reversed()) for r in rules]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) of each text's secrets, by start, then rule."""
        out: list[list] = [[] for _ in texts]
        which, ends, bits = self.automaton.hits(texts)
        cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)] if len(which) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            raw = texts[which[a]]
            out[which[a]] = sorted(_in_code_points(raw, self._own(raw, ends[a:b], bits[a:b])))
        return out

    def _own(self, raw: bytes, ends: np.ndarray, bits: np.ndarray) -> list[tuple[int, int, int]]:
        out, present = [], int(np.bitwise_or.reduce(bits))
        for k, rule in enumerate(self.rules):
            if not present >> k & 1:
                continue
            at, i, taken = ends[bits >> k & 1 == 1], 0, 0
            while i < len(at):
                end = -1
                for start in self.back[k].backwards(raw, int(at[i]), taken):
                    end, begin = self.forwards[k].longest(raw, start)
                    if end > 0:
                        break
                if end > 0:
                    taken = end
                    if code_points(raw[begin:end]) >= rule.least:
                        out.append((start, k, end))
                    i = int(np.searchsorted(at, end, "right"))
                else:
                    i += 1
        return out


def _in_code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or raw.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


#: Bytes scanned at once: enough to amortise a step, little enough to bound memory. A longer text is scanned alone.
BLOCK_BYTES = 8 << 20


def _blocks(texts: list[bytes]):
    part, size = [], 0
    for raw in texts:
        part.append(raw)
        size += len(raw)
        if size >= BLOCK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Returns doc_id and secrets, an array of (kind, start, end), for every row of `docs`."""
    # built once, and broadcast: its size depends on the rules alone
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def rows(batch: pa.RecordBatch) -> dict:
        own = shared.value
        found = [s for part in _blocks([x or b"" for x in batch.column("text").to_pylist()]) for s in own.spans(part)]
        return {"doc_id": batch.column("doc_id"), "secrets": pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in own] for own in found], kind)}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(docs)), rows, "doc_id long, secrets array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of found secrets."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("secrets", lambda s: s.kind.isin(*BASE))
    of = lambda kind: F.filter("secrets", lambda s: s.kind == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
