"""Secret scans over a trigram inverted index.

Each Arrow batch of documents is an index segment: postings of the trigrams
that the rules' Boolean queries name, found in one pass over the batch's
bytes. A rule's query, derived from its regex, intersects and unites postings;
only candidates are verified with the regex. A rule without mandatory
trigrams scans every text of the segment. A private key's span goes on from
its BEGIN line through the body to the END line.

Defined cases: a null text counts as empty; equal rows are scanned alike; a very
long text is scanned whole, in time in proportion to its length; spans that
start together go by the rules' order; an empty table gives no rows; extra
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0  # characters of the group
    tail: str = ""  # what goes on from a match of the pattern and belongs to the secret

    def compiled(self) -> re.Pattern[bytes]:
        return re.compile(self.pattern.encode(), re.IGNORECASE if self.any_case else 0)


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),  # the runs of [0-9a-f]+ that are long enough
)
#: A key's body: all up to the END line before another key begins; without one, headers and base64 lines, the last one shorter.
PEM_BODY = (
    r"(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?:(?:[\s>\"',#|*]|\\[nrt])*(?:Proc-Type|DEK-Info):\x20(?:(?!\\[nr])\S)+)*"
    r"(?:(?:[\s>\"',#|*]|\\[nrt])*[A-Za-z0-9+/]{16,}={0,2})*"
    r"(?:(?<=[A-Za-z0-9+/=]{16})(?:\r?\n|\x20|(?:\\r)?\\n)[>|#*\x20]{0,4}[A-Za-z0-9+/]{1,15}={0,2})?"
)
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", tail=PEM_BODY),
)
RULES = BASE_RULES + MORE_RULES

#: A query is True (anything), a trigram, ("and", ...) or ("or", ...).
Query = object
#: Sets of exact strings larger than this are given up.
MOST_EXACT = 64


def _and(parts: Iterable[Query]) -> Query:
    parts = tuple(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: Iterable[Query]) -> Query:
    parts = tuple(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> Query:
    return _or(_and(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _exact(op: object, arg: object) -> set[str] | None:
    """The lower-case strings an element matches, if they are few."""
    if op is rc.LITERAL:
        return {chr(arg).lower()}
    if op is rc.AT:
        return {""}
    if op is rc.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                out.add(chr(x).lower())
            elif kind is rc.RANGE and x[1] - x[0] < 10:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 10 else None
    if op is rc.SUBPATTERN:
        return _exact_all(arg[-1])
    if op is rc.BRANCH:
        sets = [_exact_all(x) for x in arg[1]]
        return None if None in sets else set().union(*sets)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 4:
        one = _exact_all(arg[2])
        if one is None or sum(len(one) ** n for n in range(arg[0], arg[1] + 1)) > MOST_EXACT:
            return None
        return {"".join(t) for n in range(arg[0], arg[1] + 1) for t in product(sorted(one), repeat=n)}
    return None


def _exact_all(sequence: Iterable) -> set[str] | None:
    out = {""}
    for op, arg in sequence:
        one = _exact(op, arg)
        if one is None or len(out) * len(one) > MOST_EXACT:
            return None
        out = {a + b for a in out for b in one}
    return out


def _query(sequence: Iterable) -> Query:
    parts: list[Query] = []
    run = {""}
    for op, arg in sequence:
        one = _exact(op, arg)
        if one is not None and len(run) * len(one) <= MOST_EXACT:
            run = {a + b for a in run for b in one}
            continue
        parts.append(_of_strings(run))
        run = one if one is not None else {""}
        if one is None:
            if op is rc.SUBPATTERN:
                parts.append(_query(arg[-1]))
            elif op is rc.BRANCH:
                parts.append(_or(_query(x) for x in arg[1]))
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] >= 1:
                parts.append(_query(arg[2]))
    parts.append(_of_strings(run))
    return _and(parts)


def trigram_query(pattern: str) -> Query:
    """A Boolean query over lower-case trigrams that every text with a match of ``pattern`` satisfies."""
    return _query(rp.parse(pattern))


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*map(trigrams_of, query[1:]))


def lookup(query: Query, postings: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Rows of a segment that satisfy ``query``."""
    if query is True:
        return everything
    if isinstance(query, str):
        return postings[query]
    op, *parts = query
    rows = lookup(parts[0], postings, everything)
    for part in parts[1:]:
        rows = (np.intersect1d if op == "and" else np.union1d)(rows, lookup(part, postings, everything))
    return rows


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def segment_postings(data: np.ndarray, offsets: np.ndarray, trigrams: list[str], slab: int = 1 << 22) -> dict[str, np.ndarray]:
    """Rows that hold each of the (at most 254) trigrams, from the UTF-8 bytes of a segment's texts."""
    if len(trigrams) > 254:
        raise ValueError("the rules' queries name more than 254 trigrams")
    number = np.zeros(1 << 24, dtype=np.uint8)
    for k, t in enumerate(trigrams):
        a, b, c = t.encode()
        number[a << 16 | b << 8 | c] = k + 1
    found: list[list[np.ndarray]] = [[] for _ in trigrams]
    for at in range(0, max(0, len(data) - 2), slab):
        x = LOWER[data[at : at + slab + 2]].astype(np.uint32)
        hit = number[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
        place = np.flatnonzero(hit)
        row = np.searchsorted(offsets, place + at, side="right") - 1
        inside = place + at + 3 <= offsets[row + 1]
        for k in range(len(trigrams)):
            found[k].append(np.unique(row[inside & (hit[place] == k + 1)]))
    return {t: np.unique(np.concatenate(x)) if x else np.zeros(0, dtype=np.int64) for t, x in zip(trigrams, found, strict=True)}


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(k, r, r.compiled(), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        self.tails = {k: re.compile(r.tail.encode()) for k, r in enumerate(rules) if r.tail}
        self.trigrams = sorted(set().union(*(trigrams_of(q) for *_, q in self.rules)))

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) in code points for each text of a segment, in order."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        n = len(texts)
        raw = texts.buffers()[2] or pa.py_buffer(b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(raw, dtype=np.uint8)
        postings = segment_postings(data[offsets[0] : offsets[-1]], offsets - offsets[0], self.trigrams)
        everything = np.arange(n)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        view = memoryview(raw)
        for k, rule, regex, query in self.rules:
            for i in lookup(query, postings, everything).tolist():
                low, high = int(offsets[i]), int(offsets[i + 1])
                text = view[low:high]
                start, at = 0, 0  # code points up to a byte
                for m in regex.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        start, at = start + len(bytes(text[at : m.start()]).decode()), m.start()
                        end = self.tails[k].match(text, m.end()).end() if k in self.tails else m.end()
                        out[i].append((start, k, start + len(bytes(text[m.start() : end]).decode())))
        for x in out:
            x.sort()
        return out


def scan(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``.

    ``spans`` joins kind:start:end of all rules' matches, ``base_sha256``
    digests those of the base rules, by start, then in the rules' order.
    """
    base = {r.kind for r in BASE_RULES}
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = scanner.spans(batch.column(1))
            counts = {kind: [sum(kinds[k] == kind for _, k, _ in x) for x in found] for kind in ("assign", "access", "hex")}
            digest = [hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in x if kinds[k] in base).encode()).hexdigest() for x in found]
            spans = [",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[k], pa.int64()) for k in ("assign", "access", "hex")], pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by [kind]; overlapping spans count as one of the first kind.

    A null text stays null, an empty one empty; all rows and all other columns stay as they are; an empty table gives no rows.
    """
    names, at = docs.columns, docs.columns.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at)
            found = scanner.spans(texts)
            if any(found):
                new = texts.to_pylist()
                for i, spans in enumerate(found):
                    if spans:
                        parts, last = [], 0
                        for start, k, end in spans:
                            if start >= last:
                                parts += [new[i][last:start], f"[{rules[k].kind}]"]
                            last = max(last, end)
                        new[i] = "".join(parts) + new[i][last:]
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(len(names))], names=names)

    return docs.mapInArrow(run, schema)
