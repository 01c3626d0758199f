"""Secret scans with one deterministic automaton for all rules.

Every rule's regex becomes an automaton over bytes by subset construction, the
rules' automata become one by taking states together, and that is minimised
into a transition array.  Texts are laid one after the other and cut behind
bytes that lead to the same state from everywhere (line ends always do); the
pieces are scanned side by side, one array step for a byte of each.  Where a
rule stops accepting a match ends; its start is found by running the reversed
rule back from there.

Matches of a rule are leftmost, as long as possible and do not overlap.  Rules
whose accepting states lead to states that do not accept would need a second
look at some bytes and are refused, as are rules that match a line end.

Null texts count as empty and have no spans.  Texts are scanned whole.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventweir.llm.text import column, fields, text_chunks


@dataclass(frozen=True)
class Rule:
    """``group`` of the regex must have ``at_least`` characters, else the match is dropped."""

    kind: str
    regex: bytes
    group: int = 0
    at_least: int = 0


#: The length of a run is part of its regex where the run is all that follows.
BASE = (
    Rule(
        "assign",
        rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        at_least=12,
    ),
    Rule("access", rb"AKIA[A-Z0-9]{14,}"),
    Rule("hex", rb"[0-9a-f]{16,}"),
)
MORE = (
    Rule("hosting", rb"gh[oprsu]_[A-Za-z0-9]{20,}"),
    Rule("private_key", rb"-----BEGIN [A-Z ]{0,16}PRIVATE KEY-----"),
)


class Nfa:
    """States with byte edges and free moves, built from a parsed regex."""

    def __init__(self, regex: bytes, reverse: bool = False):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.reverse = reverse
        self.start = self._state()
        self.accept = self._sequence(self.start, parser.parse(regex), 0)

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _sequence(self, at: int, items, flags: int) -> int:
        for item in reversed(list(items)) if self.reverse else items:
            at = self._item(at, item, flags)
        return at

    def _item(self, at: int, item, flags: int) -> int:
        kind, value = item
        if kind is op.SUBPATTERN:
            return self._sequence(at, value[3], (flags | value[1]) & ~value[2])
        if kind is op.BRANCH:
            end = self._state()
            for branch in value[1]:
                self.free[self._sequence(at, branch, flags)].append(end)
            return end
        if kind is op.MAX_REPEAT:
            least, most, body = value
            for _ in range(least):
                at = self._sequence(at, body, flags)
            if most is op.MAXREPEAT:
                loop = self._state()
                self.free[at].append(loop)
                self.free[self._sequence(loop, body, flags)].append(loop)
                return loop
            end = self._state()
            for _ in range(most - least):
                self.free[at].append(end)
                at = self._sequence(at, body, flags)
            self.free[at].append(end)
            return end
        end = self._state()
        self.edges[at].append((self._bytes(kind, value, flags), end))
        return end

    def _bytes(self, kind, value, flags: int) -> frozenset[int]:
        if kind is op.LITERAL:
            found = {value}
        elif kind is op.IN:
            found = set()
            for k, v in value:
                if k not in (op.LITERAL, op.RANGE):
                    raise ValueError(f"not supported in a class: {k}")
                found |= {v} if k is op.LITERAL else set(range(v[0], v[1] + 1))
        else:
            raise ValueError(f"not supported: {kind}")
        if flags & re.IGNORECASE:
            found |= {ord(f(chr(b))) for b in found if b < 128 for f in (str.lower, str.upper)}
        return frozenset(found)

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({end for s in states for found, end in self.edges[s] if byte in found})


def byte_classes(automata: list[Nfa]) -> tuple[np.ndarray, list[int]]:
    """Class of every byte, and one byte of each class."""
    marks = [tuple(b in found for nfa in automata for edges in nfa.edges for found, _ in edges) for b in range(256)]
    number = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    classes = np.array([number[m] for m in marks])
    return classes, [int(np.flatnonzero(classes == i)[0]) for i in range(len(number))]


def explore(first, step, accepts, examples: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Transition array (state, byte class) and accept marks of all states that can be reached."""
    number, todo, rows = {first: 0}, [first], []
    for state in todo:
        row = []
        for byte in examples:
            after = step(state, byte)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    return np.array(rows), np.array([accepts(s) for s in todo])


def minimise(moves: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join states that no input tells apart; state 0 stays the first."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        seen = np.concatenate([block[:, None], block[moves]], axis=1)
        finer = np.unique(seen, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = list(dict.fromkeys(block.tolist()))
    names = np.empty(len(order), np.int64)
    names[order] = np.arange(len(order))
    block = names[block]
    firsts = np.array([int(np.flatnonzero(block == i)[0]) for i in range(len(order))])
    return block[moves[firsts]], accepts[firsts]


def search_automaton(nfa: Nfa, examples: list[int], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Of one rule, for matches that start anywhere.

    A state is the sets of places that the tries have reached, earlier starts
    first; a place that an earlier start has reached says nothing for a later one."""
    begin = nfa.closure({nfa.start})
    if nfa.accept in begin:
        raise ValueError(f"{kind} matches nothing at all")

    def step(tries, byte):
        matched = bool(tries) and nfa.accept in tries[0]
        after, seen = [], frozenset()
        for t in tries if matched else (*tries, begin):
            if t := nfa.step(t, byte) - seen:
                after.append(t)
                seen |= t
        if matched and not after:  # the match is over, and this byte may start another
            after = [t for t in [nfa.step(begin, byte)] if t]
        elif matched and nfa.accept not in after[0]:
            raise ValueError(f"{kind} can accept, go on and fail")
        if any(nfa.accept in t for t in after[1:]):
            raise ValueError(f"{kind} can match within a try that is not over")
        if after and nfa.accept in after[0]:
            if not matched and nfa.accept in nfa.step(begin, byte):
                raise ValueError(f"{kind} matches a single byte")
            after = after[:1]
        return tuple(after)

    return minimise(*explore((), step, lambda tries: bool(tries) and nfa.accept in tries[0], examples))


class Scanner:
    """The automaton of some rules."""

    def __init__(self, rules: tuple[Rule, ...], lane: int = 2048):
        self.rules, self.lane = rules, lane
        automata = [Nfa(r.regex) for r in rules]
        classes, examples = byte_classes(automata)
        index = range(len(examples))
        single = [search_automaton(nfa, examples, r.kind) for nfa, r in zip(automata, rules, strict=True)]
        bits = lambda states: sum(int(a[s]) << k for k, ((_, a), s) in enumerate(zip(single, states, strict=True)))
        together = lambda states, c: tuple(int(m[s, c]) for (m, _), s in zip(single, states, strict=True))
        moves, accepts = minimise(*explore((0,) * len(rules), together, bits, list(index)))
        self.moves = moves[:, classes].astype(np.uint16)  # state, byte
        self.accepts = accepts.astype(np.uint32)
        self.flat = self.moves.reshape(-1)
        self.resets = (self.moves == self.moves[0]).all(axis=0)
        if not self.resets[ord("\n")] or self.moves[0, ord("\n")] != 0:
            raise ValueError("a rule matches a line end")
        # A reset byte that starts no try leaves the automaton in its first state.
        self.resets &= self.moves[0] == 0
        self.back = []
        for r in rules:
            nfa = Nfa(r.regex, reverse=True)
            own, own_examples = byte_classes([nfa])
            m, a = explore(nfa.closure({nfa.start}), nfa.step, lambda s, nfa=nfa: (bool(s), nfa.accept in s), own_examples)
            self.back.append((m[:, own].tolist(), a.tolist()))
        self.exact = [re.compile(r.regex) for r in rules]

    def states(self, data: np.ndarray) -> np.ndarray:
        """State behind every byte, from a start in the first state."""
        out = np.empty(len(data), np.uint16)
        ends = np.flatnonzero(self.resets[data]) + 1
        wanted = np.arange(self.lane, len(data), self.lane)
        at = np.searchsorted(ends, wanted)
        cuts = np.unique(ends[at[at < len(ends)]])
        starts = np.unique(np.concatenate([[0], cuts[cuts < len(data)]]))
        lengths = np.diff(np.concatenate([starts, [len(data)]]))
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        live = len(starts) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")
        state, place = np.zeros(len(starts), np.int64), starts.copy()
        for n in live.tolist():
            here = place[:n]
            now = self.flat[(state[:n] << 8) + data[here]]
            out[here] = now
            state[:n] = now
            here += 1
        return out

    def matches(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """``(rule, start, end)`` in bytes, by end."""
        marks = self.accepts[self.states(data)]
        after = np.concatenate([marks[1:], [0]])
        found = []
        raw = data.tobytes()
        for k, rule in enumerate(self.rules):
            last = 0
            for end in (np.flatnonzero((marks >> k) & ~(after >> k) & 1) + 1).tolist():
                start = self._start(k, raw, end, last)
                last = end
                if rule.at_least and len(self.exact[k].fullmatch(raw, start, end)[rule.group]) < rule.at_least:
                    continue
                found.append((k, start, end))
        return sorted(found, key=lambda f: f[2])

    def _start(self, k: int, raw: bytes, end: int, least: int) -> int:
        moves, accepts = self.back[k]
        state, best, at = 0, end, end
        while at > least:
            at -= 1
            state = moves[state][raw[at]]
            alive, complete = accepts[state]
            if complete:
                best = at
            if not alive:
                break
        return best

    def spans(self, texts: list[str | None]) -> list[list[dict]]:
        """Spans of each text in code points, by start and then by rule."""
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
        out: list[list[dict]] = [[] for _ in texts]
        found = self.matches(data)
        if found:
            upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
            for k, start, end in found:
                doc = int(np.searchsorted(starts, start, side="right")) - 1
                base = int(upto[starts[doc]])
                out[doc].append({"rule": k, "start": int(upto[start]) - base, "end": int(upto[end]) - base})
        for spans in out:
            spans.sort(key=lambda s: (s["start"], s["rule"]))
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One per Python worker."""
    return Scanner(rules)


def scan(df: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", out: str = "spans") -> DataFrame:
    """Replace ``text`` by its spans, an array of ``kind, start, end``; other columns stay."""
    others = [c for c in df.columns if c not in (text, out)]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = scanner(rules)
        for batch in batches:
            for chunk in text_chunks(batch, text, 4_000_000):
                found = automaton.spans(column(chunk, text).to_pylist())
                named = [[{"kind": rules[s["rule"]].kind, "start": s["start"], "end": s["end"]} for s in spans] for spans in found]
                yield pa.RecordBatch.from_arrays([*[column(chunk, c) for c in others], pa.array(named, kind)], [*others, out])

    spans = f"`{out}` array<struct<kind: string, start: bigint, end: bigint>>"
    return df.mapInArrow(run, ", ".join(filter(None, [fields(df, *others), spans])))
