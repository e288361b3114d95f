"""Regular expressions as one deterministic automaton over bytes.

Rules are parsed, made into a nondeterministic automaton, and all of them together into one transition
table by subset construction and minimisation. The table is run over many stretches of a byte
stream at once: a stretch begins in a guessed state, and is run again where the one before it ended
in another.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import numpy as np

ALL = (1 << 256) - 1
#: A byte that no UTF-8 text has; it returns every state to the start.
BREAK = 0xFF


def _bits(values) -> int:
    out = 0
    for v in values:
        if v > 127:
            raise ValueError("rules are in ASCII")
        out |= 1 << v
    return out


def _folded(mask: int) -> int:
    for a, b in zip(range(65, 91), range(97, 123)):
        if mask >> a & 1 or mask >> b & 1:
            mask |= 1 << a | 1 << b
    return mask


class Nfa:
    """Edges by byte sets (as 256-bit numbers; 0 is an empty move) from ``start`` to ``end``."""

    def __init__(self, pattern: str):
        self.edges: list[tuple[int, int, int]] = []
        self.size = 0
        tree = _parser.parse(pattern)
        self.fold = bool(tree.state.flags & re.IGNORECASE)
        self.start, self.end = self._sequence(tree)

    def _node(self) -> int:
        self.size += 1
        return self.size - 1

    def _edge(self, mask: int) -> tuple[int, int]:
        a, b = self._node(), self._node()
        self.edges.append((a, _folded(mask) if self.fold and mask != ALL else mask, b))
        return a, b

    def _join(self, a: int, b: int) -> None:
        self.edges.append((a, 0, b))

    def _sequence(self, items) -> tuple[int, int]:
        start = end = self._node()
        for item in items:
            a, b = self._one(*item)
            self._join(end, a)
            end = b
        return start, end

    def _set(self, items) -> int:
        mask, negated = 0, False
        for op, value in items:
            if op is C.NEGATE:
                negated = True
            elif op is C.LITERAL:
                mask |= _bits([value])
            elif op is C.RANGE:
                mask |= _bits(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not supported in a rule: {op}")
        if self.fold:
            mask = _folded(mask)
        return (ALL & ~mask & ~(1 << BREAK)) if negated else mask

    def _one(self, op, value) -> tuple[int, int]:
        if op is C.LITERAL:
            return self._edge(_bits([value]))
        if op is C.IN:
            return self._edge(self._set(value))
        if op is C.SUBPATTERN:
            return self._sequence(value[3])
        if op is C.BRANCH:
            start, end = self._node(), self._node()
            for branch in value[1]:
                a, b = self._sequence(branch)
                self._join(start, a)
                self._join(b, end)
            return start, end
        if op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, items = value
            start = end = self._node()
            for _ in range(least):
                a, b = self._sequence(items)
                self._join(end, a)
                end = b
            if most is C.MAXREPEAT:
                a, b = self._sequence(items)
                self._join(end, a)
                self._join(b, end)
                return start, end
            last = self._node()
            for _ in range(most - least):
                self._join(end, last)
                a, b = self._sequence(items)
                self._join(end, a)
                end = b
            self._join(end, last)
            return start, last
        raise ValueError(f"not supported in a rule: {op}")


class Dfa:
    """``step[state, byte]`` and ``accepts[state]`` (a bit for each rule); state 0 is the start, -1 in
    ``dead`` terms: ``dead`` is the state that nothing leaves, or None."""

    def __init__(self, step: np.ndarray, accepts: np.ndarray):
        self.step, self.accepts = step, accepts
        stuck = (step == np.arange(len(step))[:, None]).all(axis=1) & (accepts == 0)
        self.dead = int(np.flatnonzero(stuck)[0]) if stuck.any() else None
        self.rows, self.marks = step.tolist() if len(step) < 2000 else None, accepts.tolist()


def compile_rules(rules: list[Nfa], anchored: bool, backwards: bool = False) -> Dfa:
    """Subset construction of all rules together, then minimisation. Not ``anchored``: a match may
    start anywhere."""
    empty: list[list[int]] = []
    moves: list[list[tuple[int, int]]] = []
    starts, ends = [], {}
    for r, nfa in enumerate(rules):
        base = len(empty)
        empty += [[] for _ in range(nfa.size)]
        moves += [[] for _ in range(nfa.size)]
        for a, mask, b in nfa.edges:
            a, b = (b, a) if backwards else (a, b)
            if mask:
                moves[base + a].append((mask, base + b))
            else:
                empty[base + a].append(base + b)
        start, end = (nfa.end, nfa.start) if backwards else (nfa.start, nfa.end)
        starts.append(base + start)
        ends[base + end] = 1 << r
    # Bytes that no rule tells apart are one class.
    masks = {m for ms in moves for m, _ in ms}
    kinds: dict[tuple, int] = {}
    order = sorted(masks)
    of = [kinds.setdefault(tuple(m >> b & 1 for m in order), len(kinds)) for b in range(256)]
    examples = [of.index(k) for k in range(len(kinds))]

    def closed(nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for b in empty[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return frozenset(n for n in seen if moves[n] or n in ends)

    first = closed(starts)
    closures: dict[int, frozenset] = {}
    numbers, todo, table = {first: 0}, [first], []
    while todo:
        state = todo.pop()
        row = []
        for byte in examples:
            after = set() if anchored else set(first)
            for n in state:
                for mask, b in moves[n]:
                    if mask >> byte & 1:
                        if b not in closures:
                            closures[b] = closed([b])
                        after |= closures[b]
            after = frozenset(after)
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row.append(numbers[after])
        table.append((numbers[state], row))
    step = np.zeros((len(numbers), len(kinds)), dtype=np.int32)
    for state, row in table:
        step[state] = row
    accepts = np.array([sum({ends[n] for n in s if n in ends}) for s in numbers], dtype=np.int64)
    # Minimisation: states stay together while they accept alike and step alike.
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    names = np.concatenate([[group[0]], np.setdiff1d(np.unique(group), [group[0]])])
    new = np.empty(len(names), dtype=np.int32)
    new[names] = np.arange(len(names))
    some = np.zeros(len(names), dtype=np.int64)
    some[new[group]] = np.arange(len(group))
    return Dfa(new[group[step[some]]][:, of].astype(np.int32), accepts[some])


class Scanner:
    """Runs an unanchored automaton over a stream and reports where a rule accepts."""

    def __init__(self, dfa: Dfa, lanes: int = 2048):
        order = np.argsort(dfa.accepts != 0, kind="stable")  # accepting states last
        new = np.empty(len(order), dtype=np.int64)
        new[order] = np.arange(len(order))
        step = new[dfa.step[order]]
        step[:, BREAK] = new[0]
        self.table = (step * 256).astype(np.int32).ravel()
        self.start = np.int32(new[0] * 256)
        self.from_ = np.int32(int((dfa.accepts == 0).sum()) * 256)
        self.accepts, self.lanes = dfa.accepts[order], lanes

    def _run(self, columns, states):
        """States after the last row; places (row, lane) and states of accepting steps."""
        found = []
        for i in range(len(columns)):
            states = self.table[states + columns[i]]
            if states.max() >= self.from_:
                hit = np.flatnonzero(states >= self.from_)
                found.append((np.full(len(hit), i), hit, states[hit]))
        return states, found

    def events(self, stream: np.ndarray):
        """Ends (exclusive) of accepting prefixes, ascending, and the rules' bits."""
        n = len(stream)
        lanes = max(1, min(self.lanes, n // 64))
        rows = -(-n // lanes)
        padded = np.full(lanes * rows, BREAK, dtype=np.uint8)
        padded[:n] = stream
        columns = np.ascontiguousarray(padded.reshape(lanes, rows).T).astype(np.int32)
        begins = np.full(lanes, self.start, dtype=np.int32)
        warm = min(rows, 48)
        if lanes > 1:
            begins[1:] = self._run(columns[-warm:, :-1], begins[1:])[0]
        ends, found = self._run(columns, begins)
        parts = [(lane * rows + row + 1, lane, state) for row, lane, state in found]
        while True:
            wrong = np.flatnonzero(begins[1:] != ends[:-1]) + 1
            if not len(wrong):
                break
            begins[wrong] = ends[wrong - 1]
            parts = [(p[k], lane[k], s[k]) for p, lane, s in parts if (k := ~np.isin(lane, wrong)).any()]
            ends[wrong], found = self._run(columns[:, wrong], begins[wrong])
            parts += [(wrong[lane] * rows + row + 1, wrong[lane], state) for row, lane, state in found]
        if not parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        places = np.concatenate([p for p, _, _ in parts])
        marks = self.accepts[np.concatenate([s for _, _, s in parts]) // 256]
        order = np.argsort(places, kind="stable")
        return places[order], marks[order]
