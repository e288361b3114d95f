"""Find secrets by rules, all in one pass over the bytes of a text."""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.automata import BREAK, Nfa, Scanner, compile_rules
from casemill.llm.common import map_chunks, text_bytes


class Rule(NamedTuple):
    """``find`` is matched leftmost and longest, without overlap; a match counts if all of it fits ``keep``."""

    kind: str
    find: str
    keep: str | None = None
    base: bool = False


# The three base rules, with their least sizes.
_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
BASE_RULES = (
    Rule("assign", _ASSIGN % "+", _ASSIGN % "{6,}", True),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16,}", True),
    Rule("hex", r"[0-9a-f]{24,}", None, True),  # with a least size, else it would end at every letter
)
#: Public forms of keys that the base rules miss or cut short. Sizes stand in ``keep``: counters of several
#: rules that run side by side would multiply the states of the table.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class SecretScanner:
    """One table for all rules tells where a match can end; for a text with such an end, the rule's
    table over reversed bytes finds the start, and its own table the longest end."""

    def __init__(self, rules=BASE_RULES + MORE_RULES):
        self.rules = rules
        nfas = [Nfa(r.find) for r in rules]
        self.all = Scanner(compile_rules(nfas, anchored=False))
        self.states = len(self.all.accepts)
        self.forward = [compile_rules([n], anchored=True) for n in nfas]
        self.back = [compile_rules([n], anchored=True, backwards=True) for n in nfas]
        self.keep = [r.keep and compile_rules([Nfa(r.keep)], anchored=True) for r in rules]

    @staticmethod
    def _furthest(dfa, data: bytes, at: int, stop: int, by: int) -> int | None:
        """Furthest place from ``at`` towards ``stop`` where the automaton accepts."""
        state, best, rows, marks, dead = 0, None, dfa.rows, dfa.marks, dfa.dead
        while at != stop:
            state = rows[state][data[at] if by > 0 else data[at - 1]]
            if state == dead:
                break
            at += by
            if marks[state]:
                best = at
        return best

    def _spans(self, rule: int, data: bytes, ends: list[int]):
        at = 0
        for end in ends:
            if end <= at:
                continue
            start = self._furthest(self.back[rule], data, end, at, -1)
            if start is None:
                continue
            at = self._furthest(self.forward[rule], data, start, len(data), 1)
            keep = self.keep[rule]
            if keep is None or self._furthest(keep, data, start, at, 1) == at:
                yield start, at

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule, end) in bytes, in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        stream = np.frombuffer(bytes([BREAK]).join(texts), dtype=np.uint8)
        if not len(stream):
            return found
        places, marks = self.all.events(stream)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        owner = np.searchsorted(starts, places - 1, side="right") - 1
        for i in np.unique(owner).tolist():
            own = owner == i
            for r in range(len(self.rules)):
                ends = (places[own & (marks >> r & 1 == 1)] - starts[i]).tolist()
                found[i] += [(a, r, b) for a, b in self._spans(r, texts[i], ends)]
            found[i].sort()
        return found


def code_points(data: bytes, places: list[int]) -> list[int]:
    """Byte places as numbers of code points."""
    first = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
    return first[places].tolist()


def redacted(data: bytes, spans, rules, mark: str = "<{}>") -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind."""
    out, at, end = [], 0, 0
    for a, r, b in spans:
        if a >= end:
            out += [data[at:a], mark.format(rules[r].kind).encode()]
        end = max(end, b)
        at = end
    return b"".join([*out, data[at:]]).decode()


def scan_secrets(
    df: DataFrame, rules=BASE_RULES + MORE_RULES, key: str = "doc_id", text: str = "text", redact: bool = False, carry: list[str] | tuple = ()
) -> DataFrame:
    """Spans of secrets in each whole text, one row for each row: ``key``, ``n_<kind>`` for each base
    kind, ``base_sha256`` (of the base spans as ``spans`` writes them), and ``spans``: ``kind:start:end`` by
    start and order of the rules, comma-joined, in code points. With ``redact`` also ``redacted``, the
    text without its secrets (a null stays null); and ``carried``, a struct of the columns ``carry``.

    A null or empty text has no spans. Repeated rows and null keys each give a row. No shuffle.
    """
    kind = dict(df.dtypes)[key]
    base = [r for r, rule in enumerate(rules) if rule.base]
    counts = {f"n_{rules[r].kind}": r for r in base}

    def make():
        scanner = SecretScanner(rules)

        def work(batch):
            texts = text_bytes(batch.column("_text"))
            rows = scanner.scan(texts)
            written, whole = [], []
            for data, spans in zip(texts, rows):
                places = code_points(data, [x for a, _, b in spans for x in (a, b)]) if spans else []
                names = [f"{rules[r].kind}:{places[2 * i]}:{places[2 * i + 1]}" for i, (_, r, _) in enumerate(spans)]
                whole.append(",".join(names))
                written.append(",".join(n for n, (_, r, _) in zip(names, spans) if rules[r].base))
            out = {n: [sum(x[1] == r for x in spans) for spans in rows] for n, r in counts.items()}
            out |= {"_key": batch.column("_key"), "base_sha256": [sha256(x.encode()).hexdigest() for x in written], "spans": whole}
            if redact:
                nulls = batch.column("_text").is_null().to_pylist()
                out["redacted"] = [None if n else redacted(d, s, rules) for n, d, s in zip(nulls, texts, rows)]
            return out | ({"_rest": batch.column("_rest")} if carry else {})

        return work

    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_rest")] if carry else []
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *rest)
    schema = f"_key {kind}, " + ", ".join(f"{n} long" for n in counts) + ", base_sha256 string, spans string"
    schema += (", redacted string" if redact else "") + (f", _rest {dict(rows.dtypes)['_rest']}" if carry else "")
    out = map_chunks(rows, "_text", make, schema)
    return out.select(F.col("_key").alias(key), *counts, "base_sha256", "spans", *(["redacted"] if redact else []), *([F.col("_rest").alias("carried")] if carry else []))
