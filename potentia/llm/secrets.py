"""Secret scans through trigram inverted indexes.

Each rule's regular expression yields a Boolean trigram query: a conjunction of clauses,
each clause a disjunction of trigram sets every match must contain. Documents are indexed
in segments of bounded size (one slice of an Arrow batch): trigram -> sorted document
ordinals, over the ASCII-lower-cased UTF-8 bytes. Postings are intersected inside an
alternative, united over a clause, intersected over the clauses; the surviving candidates
are verified with the expression itself. A rule whose expression has no mandatory trigram
scans every document.

The segments never leave their task, so the scan has no shuffle, holds at most one segment
in memory, and a lost executor repeats only its own segments.

Defined results: a null or empty text has no spans; a repeated row gives a repeated result;
an empty table gives an empty one; extra columns are ignored (``redact`` passes them on).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from potentia.llm.textio import per_slice, utf8_buffer


@dataclass(frozen=True)
class Rule:
    """An ASCII expression; matches whose ``group`` has under ``least`` characters are dropped."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern.encode("ascii"), re.IGNORECASE if self.ignore_case else 0)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)

EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

RULES = BASE_RULES + EXTRA_RULES

SPANS = "array<struct<kind:string,start:long,end:long>>"

_MAX_STRINGS = 64  # alternatives followed before a piece of an expression counts as unknown


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i:i + 3] for i in range(len(s) - 2))


def _clause(strings: set[str]) -> list[frozenset[str]]:
    """The alternatives of one clause, or nothing if some string has no trigram."""
    found = {_trigrams(s) for s in strings}
    if not found or not all(found):
        return []
    return [a for a in found if not any(b < a for b in found)]  # a superset adds nothing to a disjunction


def trigram_query(rule: Rule) -> list[list[frozenset[str]]]:
    """Conjunction of clauses every match of the rule satisfies; empty: no mandatory trigram."""
    from re import _parser as parser  # the standard library's own syntax tree

    def walk(nodes) -> tuple[set[str] | None, list]:
        """(all strings the nodes can match, or None if too many; clauses found)."""
        run, whole, clauses = {""}, True, []

        def close():
            nonlocal run, whole
            clause = _clause(run)
            if clause:
                clauses.append(clause)
            run, whole = {""}, False

        for op, arg in nodes:
            name, exact, inner = str(op), None, []
            if name == "LITERAL":
                exact = {chr(arg).lower()}
            elif name == "IN":
                exact = set()
                for o, a in arg:
                    if str(o) != "LITERAL":
                        exact = None
                        break
                    exact.add(chr(a).lower())
            elif name == "SUBPATTERN":
                exact, inner = walk(arg[-1])
            elif name == "BRANCH":
                parts = [walk(b) for b in arg[1]]
                if all(p[0] is not None for p in parts):
                    exact = set().union(*(p[0] for p in parts))
                elif all(p[1] or (p[0] and _clause(p[0])) for p in parts):
                    inner = [[a for p in parts for a in (p[1][0] if p[1] else _clause(p[0]))]]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, body = arg
                strings, found = walk(body)
                if strings is not None and int(high) <= 2:
                    exact = {"".join(x) for n in range(low, int(high) + 1) for x in product(strings, repeat=n)}
                elif low:
                    inner = found
            elif name == "AT":
                continue
            if exact is not None and len(exact) * len(run) <= _MAX_STRINGS:
                run = {a + b for a in run for b in exact}
            else:
                close()
                clauses += inner
                if exact is not None and len(exact) <= _MAX_STRINGS:
                    run = set(exact)
        if whole:
            return run, clauses
        close()
        return None, clauses

    strings, clauses = walk(parser.parse(rule.pattern))
    if strings is not None and _clause(strings):
        clauses = [*clauses, _clause(strings)]
    return clauses


class _Segment:
    """Trigram -> sorted ordinals of the documents of one slice, for the trigrams asked for."""

    def __init__(self, wanted: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        self.postings: dict[int, np.ndarray] = {}
        if len(raw) < 3:
            return
        low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(wanted[code])
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique((code[at[inside]].astype(np.int64) << 32) | row[inside])
        grams, first = np.unique(pairs >> 32, return_index=True)
        for gram, rows in zip(grams.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:])):
            self.postings[gram] = rows

    def candidates(self, clauses: list[list[list[int]]], n: int) -> np.ndarray:
        if not clauses:
            return np.arange(n)
        none, left = np.zeros(0, np.int64), None
        for clause in clauses:
            found = none
            for grams in clause:
                rows = self.postings.get(grams[0], none)
                for gram in grams[1:]:
                    rows = np.intersect1d(rows, self.postings.get(gram, none), assume_unique=True)
                found = np.union1d(found, rows)
            left = found if left is None else np.intersect1d(left, found, assume_unique=True)
        return left


def _code(gram: str) -> int:
    a, b, c = gram.encode("ascii")
    return a << 16 | b << 8 | c


def _code_points(text: bytes, at: np.ndarray) -> np.ndarray:
    """Code points before each of the ascending byte positions ``at``, all leads of characters, in one pass."""
    if text.isascii():
        return at
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    cuts = np.append(0, at)
    some = np.flatnonzero(np.append(cuts[1:] > cuts[:-1], False))  # an empty stretch would count one
    held = np.zeros(len(at), np.int64)
    if len(some):
        held[some] = np.add.reduceat(lead[:at[-1]], cuts[some], dtype=np.int64)
    return np.cumsum(held)


def _scanner(rules: tuple[Rule, ...]):
    """slice of texts -> per row a list of (start, rule number, end) in code points."""
    plans = [[[[_code(g) for g in sorted(alt)] for alt in clause] for clause in trigram_query(r)] for r in rules]
    compiled = [r.compiled() for r in rules]
    wanted = np.zeros(1 << 24, bool)
    for plan in plans:
        for clause in plan:
            for alt in clause:
                wanted[alt] = True

    def scan(column: pa.Array) -> list[list[tuple[int, int, int]]]:
        raw, offsets = utf8_buffer(column)
        segment, data = _Segment(wanted, raw, offsets), raw.tobytes()
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for k, (rule, plan, pattern) in enumerate(zip(rules, plans, compiled)):
            for row in segment.candidates(plan, len(column)).tolist():
                text = data[offsets[row]:offsets[row + 1]]
                spans = [m.span() for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]
                if spans:
                    s, e = np.array(spans).T
                    first = _code_points(text, s)
                    found[row] += zip(first.tolist(), [k] * len(s), (first + e - s).tolist())
        for spans in found:
            spans.sort()
        return found

    return scan


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): spans in code points, end exclusive, by start, then as rules are listed."""
    kinds = [r.kind for r in rules]

    def run(batches):
        scan = _scanner(rules)
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

        def one(piece):
            spans = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in row] for row in scan(piece.column("text"))]
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])
        yield from per_slice(one)(batches)

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; every found span (overlaps joined) replaced by ``mark``,
    ``n_chars`` following the text where the table has it. Rows without spans stay as they are."""
    names = docs.columns

    def run(batches):
        scan = _scanner(rules)

        def one(piece):
            column = piece.column("text")
            new, lengths = column.to_pylist(), piece.column("n_chars").to_pylist() if "n_chars" in names else None
            for i, spans in enumerate(scan(column)):
                if not spans:
                    continue
                text, out, at = new[i], [], 0
                for start, _, end in spans:
                    if end <= at:
                        continue
                    if start >= at:
                        out += [text[at:start], mark]
                    at = end
                new[i] = "".join([*out, text[at:]])
                if lengths is not None:
                    lengths[i] = len(new[i])
            changed = {"text": pa.array(new, column.type)}
            if lengths is not None:
                changed["n_chars"] = pa.array(lengths, piece.column("n_chars").type)
            return pa.RecordBatch.from_arrays([changed.get(c, piece.column(c)) for c in names], names)
        yield from per_slice(one)(batches)

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_secrets`` rows, as the registered query returns them."""
    base = [r.kind for r in BASE_RULES]

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in base],
                        F.sha2(line(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
                        line(F.col("spans")).alias("spans"))
