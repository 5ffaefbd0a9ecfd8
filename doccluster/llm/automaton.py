"""Several regular expressions compiled into one deterministic byte automaton.

The patterns are parsed by the standard library, turned into one
nondeterministic automaton each, joined by subset construction, minimised by
partition refinement and laid out as a flat transition array. A scan reads each
byte once for all rules together. A rule's match is leftmost, as long as
possible, and does not overlap the rule's other matches.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

BYTES = 256


@dataclass(frozen=True)
class Rule:
    """A named ASCII pattern. ``min_tail`` drops a match, after it has been
    taken from the text, whose open-ended last part is shorter than that."""

    name: str
    pattern: str
    min_tail: int = 0


class _Nfa:
    """Thompson automaton of one pattern; state 0 starts, ``accept`` ends."""

    def __init__(self, pattern: str) -> None:
        self.empty: list[set[int]] = []
        self.arcs: list[list[tuple[frozenset[int], int]]] = []
        self.known: dict = {}
        start = self._state()
        tree = parser.parse(pattern)
        self.accept = self._sequence(tree, start, bool(tree.state.flags & C.SRE_FLAG_IGNORECASE))

    def _state(self) -> int:
        self.empty.append(set())
        self.arcs.append([])
        return len(self.empty) - 1

    def _sequence(self, items, at: int, fold: bool) -> int:
        for op, value in items:
            at = self._item(op, value, at, fold)
        return at

    def _item(self, op, value, at: int, fold: bool) -> int:
        if op in (C.LITERAL, C.IN):
            end = self._state()
            self.arcs[at].append((_byte_set(op, value, fold), end))
            return end
        if op is C.SUBPATTERN:
            _, add, drop, inner = value
            fold = (fold or bool(add & C.SRE_FLAG_IGNORECASE)) and not drop & C.SRE_FLAG_IGNORECASE
            return self._sequence(inner, at, fold)
        if op is C.BRANCH:
            end = self._state()
            for branch in value[1]:
                first = self._state()
                self.empty[at].add(first)
                self.empty[self._sequence(branch, first, fold)].add(end)
            return end
        if op is C.MAX_REPEAT:
            low, high, inner = value
            for _ in range(low):
                at = self._sequence(inner, at, fold)
            if high is C.MAXREPEAT:
                loop, end = self._state(), self._state()
                self.empty[at] |= {loop, end}
                self.empty[self._sequence(inner, loop, fold)] |= {loop, end}
                return end
            end = self._state()
            self.empty[at].add(end)
            for _ in range(high - low):
                at = self._sequence(inner, at, fold)
                self.empty[at].add(end)
            return end
        raise ValueError(f"unsupported in a rule: {op}")

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for n in self.empty[todo.pop()] - found:
                found.add(n)
                todo.append(n)
        return frozenset(found)

    def step(self, states, byte: int) -> frozenset[int]:
        if (states, byte) not in self.known:
            self.known[states, byte] = self.closure(
                {t for s in states for b, t in self.arcs[s] if byte in b}
            )
        return self.known[states, byte]

    def reversed(self) -> _Nfa:
        """The automaton of the pattern read backwards."""
        other = object.__new__(_Nfa)
        size = len(self.empty)
        # the roles of first and last state are swapped by renumbering
        name = {0: self.accept, self.accept: 0}
        other.empty = [set() for _ in range(size)]
        other.arcs = [[] for _ in range(size)]
        for s in range(size):
            for t in self.empty[s]:
                other.empty[name.get(t, t)].add(name.get(s, s))
            for b, t in self.arcs[s]:
                other.arcs[name.get(t, t)].append((b, name.get(s, s)))
        other.accept, other.known = self.accept, {}
        return other


def _byte_set(op, value, fold: bool) -> frozenset[int]:
    if op is C.LITERAL:
        found, negate = {value}, False
    else:
        found, negate = set(), False
        for kind, item in value:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                found.add(item)
            elif kind is C.RANGE:
                found |= set(range(item[0], item[1] + 1))
            else:
                raise ValueError(f"unsupported in a character class: {kind}")
    if any(b > 127 for b in found) or negate:
        raise ValueError("rules match listed ASCII characters only")
    if fold:
        found |= {ord(x) for b in found for x in (chr(b).lower(), chr(b).upper())}
    return frozenset(found)


class _Leftmost:
    """Subset states of one rule in a running text.

    A state is ``(matched, groups)``: groups are the live state sets of the
    possible starts, earliest first. Once the earliest has matched, it alone
    goes on; when it dies, the search starts again at the byte it died on.
    """

    def __init__(self, rule: Rule) -> None:
        self.rule, self.nfa = rule, _Nfa(rule.pattern)
        self.first = self.nfa.closure({0})
        if self.nfa.accept in self.first:
            raise ValueError(f"rule {rule.name} matches the empty string")
        self.start = (False, ())

    def _unmatched(self, groups, byte: int):
        live, seen = [], set()
        for group in (*groups, self.first):
            after = self.nfa.step(group, byte) - seen
            if self.nfa.accept in after:
                if live:
                    raise ValueError(f"rule {self.rule.name}: two starts compete for one match")
                return True, (after,)
            seen |= after
            if after:
                live.append(after)
        return False, tuple(live)

    def step(self, state, byte: int):
        matched, groups = state
        if matched:
            after = self.nfa.step(groups[0], byte)
            if after and self.nfa.accept not in after:
                raise ValueError(f"rule {self.rule.name} must end in an open-ended class")
            if after:
                return True, (after,)
            state = self._unmatched((), byte)
            if state[0]:
                raise ValueError(f"rule {self.rule.name} can match a single byte")
            return state
        return self._unmatched(groups, byte)


def _byte_classes(nfas) -> list[list[int]]:
    """Bytes that no rule tells apart."""
    classes: dict[tuple, list[int]] = {}
    sets = sorted({b for n in nfas for arcs in n.arcs for b, _ in arcs}, key=sorted)
    for byte in range(BYTES):
        classes.setdefault(tuple(byte in s for s in sets), []).append(byte)
    return list(classes.values())


def _construct(start, step, classes) -> tuple[list, list[list[int]]]:
    """All reachable states and, per state, the next state by byte class."""
    number, states, rows = {start: 0}, [start], []
    for state in states:
        row = []
        for members in classes:
            after = step(state, members[0])
            if after not in number:
                number[after] = len(states)
                states.append(after)
            row.append(number[after])
        rows.append(row)
    return states, rows


def _minimise(outputs: list, rows: list[list[int]]) -> list[int]:
    """Block of each state in the coarsest partition that keeps the outputs."""
    ids: dict = {}
    block = [ids.setdefault(o, len(ids)) for o in outputs]
    while True:
        ids = {}
        finer = [
            ids.setdefault((block[s], *(block[t] for t in row)), len(ids))
            for s, row in enumerate(rows)
        ]
        if len(ids) == len(set(block)):
            return block
        block = finer


def _flat(outputs: list, rows, classes, start: int) -> tuple[array, list]:
    """Minimised transition array and the states' outputs.

    States are premultiplied by 256; the start state comes first.
    """
    block = _minimise(outputs, rows)
    sample = {}
    for s, b in enumerate(block):
        sample.setdefault(b, s)
    order = sorted(sample, key=lambda b: (b != block[start], b))
    place = {b: n for n, b in enumerate(order)}
    table = array("i", bytes(4 * BYTES * len(order)))
    for b in order:
        row = rows[sample[b]]
        for members, target in zip(classes, row):
            for byte in members:
                table[place[b] * BYTES + byte] = place[block[target]] * BYTES
    return table, [outputs[sample[b]] for b in order]


class Scanner:
    """All rules in one automaton; see :meth:`scan`."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = tuple(rules)
        parts = [_Leftmost(r) for r in rules]
        classes = _byte_classes([p.nfa for p in parts])
        steps = [functools.cache(p.step) for p in parts]
        states, rows = _construct(
            tuple(p.start for p in parts),
            lambda s, byte: tuple(step(x, byte) for step, x in zip(steps, s)),
            classes,
        )
        outputs = [sum(1 << n for n, x in enumerate(s) if x[0]) for s in states]
        self.table, self.mask = _flat(outputs, rows, classes, 0)
        # per rule the automaton that reads a match backwards to its start
        self.back = []
        for p in parts:
            other = p.nfa.reversed()
            found, rows = _construct(other.closure({0}), other.step, classes)
            self.back.append(
                (
                    [[row[c] for c in _class_of(classes)] for row in rows],
                    [other.accept in s for s in found],
                    [not s for s in found],
                )
            )
        self._rows: list[list] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def _linked(self) -> list[list]:
        """The transition array as lists that hold the next state's list at
        each byte, and at the end the state's outputs."""
        rows: list[list] = [[] for _ in self.mask]
        for n, row in enumerate(rows):
            row += [rows[t >> 8] for t in self.table[n * BYTES : (n + 1) * BYTES]]
            row.append(self.mask[n])
        return rows

    def _start(self, rule: int, data: bytes, last: int, limit: int) -> int:
        """Smallest start of a match that ends with byte ``last``."""
        rows, accept, dead = self.back[rule]
        state, at, best = 0, last, last
        while at >= limit:
            state = rows[state][data[at]]
            if dead[state]:
                break
            if accept[state]:
                best = at
            at -= 1
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """``(start, rule, end)`` byte spans of all rules, ends exclusive, sorted."""
        if self._rows is None:
            self._rows = self._linked()
        first: dict[int, int] = {}  # rule -> first byte at which it had matched
        done = [0] * len(self.rules)
        spans: list[tuple[int, int, int]] = []
        state, mask = self._rows[0], 0

        def close(rule: int, end: int) -> None:
            seen = first.pop(rule)
            if end - seen >= self.rules[rule].min_tail:
                spans.append((self._start(rule, data, seen, done[rule]), rule, end))
            done[rule] = end

        for at, byte in enumerate(data):
            state = state[byte]
            if state[BYTES] != mask:
                now = state[BYTES]
                for rule in range(len(self.rules)):
                    bit = 1 << rule
                    if mask & bit and not now & bit:
                        close(rule, at)
                    elif now & bit and not mask & bit:
                        first[rule] = at
                mask = now
        for rule in list(first):
            close(rule, len(data))
        return sorted(spans)


def _class_of(classes) -> Iterator[int]:
    where = {b: n for n, members in enumerate(classes) for b in members}
    return (where[b] for b in range(BYTES))
