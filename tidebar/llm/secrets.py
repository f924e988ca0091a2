"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean query over the trigrams that every match must hold. Documents
are indexed in shards of a few megabytes: a shard's postings list, for each trigram that some rule asks for, the
documents that have it. A rule's query intersects and unites postings, and only the documents it leaves are
verified with the expression. A rule without mandatory trigrams is run over every document. Shards are
independent, so nothing is shuffled and a shard's memory does not grow with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_CHARS = 1 << 21
_EXACT = 64  # strings that one stretch of an expression may stand for before it is cut


@dataclass(frozen=True)
class Rule:
    """``kind``, its expression, and how long ``group`` must be; letters fold case (A-Z only) if ``fold``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))


#: The three base rules. A run of 24 or more is the same as a longest run that is long enough.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds of credentials with a public format.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + ADDED

# A query is True (says nothing), a trigram, ("and", parts) or ("or", parts).


def _all(parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _held(strings: set[str]):
    """What holding one of ``strings`` means in trigrams of their UTF-8 bytes, A-Z folded."""
    raw = [s.encode().lower() for s in sorted(strings)]
    return _any([_all([b[i:i + 3] for i in range(len(b) - 2)]) for b in raw])


def _sequence(items) -> tuple[set[str] | None, object]:
    """The strings that a stretch can be (None: too many), and its query."""
    now, parts, exact = {""}, [], True
    for code, arg in items:
        strings, query = _one(code, arg)
        if strings is not None and len(now) * len(strings) <= _EXACT:
            now = {a + b for a, b in product(now, strings)}
            continue
        exact = False
        parts += [_held(now), query if strings is None else _held(strings)]
        now = {""}
        if strings is None and code in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0]:
            continue
    parts.append(_held(now))
    return (now if exact else None), _all(parts)


def _one(code, arg) -> tuple[set[str] | None, object]:
    if code is op.LITERAL:
        return {chr(arg)}, True
    if code is op.IN and all(k is op.LITERAL for k, _ in arg):
        return {chr(v) for _, v in arg}, True
    if code is op.SUBPATTERN:
        return _sequence(arg[3])
    if code is op.BRANCH:
        found = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), True
        return None, _any([q for _, q in found])
    if code is op.MAX_REPEAT or code is op.MIN_REPEAT:
        low, high, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and high == 1:
            return (strings | {""}) if low == 0 else strings, True
        return None, True if low == 0 else query
    return (({""}, True) if code is op.AT else (None, True))


def trigram_query(rule: Rule):
    """The Boolean trigram query that every match of ``rule`` satisfies; True if it has no mandatory trigram."""
    return _sequence(_parser.parse(rule.pattern))[1]


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def candidates(query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """Rows of a shard that satisfy ``query``: intersections and unions of sorted postings."""
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, np.int64))
    kind, parts = query
    found = candidates(parts[0], postings)
    for part in parts[1:]:
        if kind == "and":
            if not len(found):
                break
            found = np.intersect1d(found, candidates(part, postings), assume_unique=True)
        else:
            found = np.union1d(found, candidates(part, postings))
    return found


class Indexer:
    """Postings of the wanted trigrams over shards of texts."""

    def __init__(self, wanted: set[bytes]):
        self.wanted = sorted(wanted)
        self.number = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.wanted, 1):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, texts: list[str], step: int = 1 << 22) -> dict[bytes, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        flat = np.frombuffer(b"\0".join(raw), np.uint8)
        pairs = []
        for lo in range(0, len(flat) - 2, step):
            b = flat[lo:lo + step + 2].astype(np.int32)
            number = self.number[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            at = np.flatnonzero(number)
            pairs.append(np.unique(number[at].astype(np.int64) << 40 | np.searchsorted(ends, at + lo, "right")))
        both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        number, row = both >> 40, both & ((1 << 40) - 1)
        cuts = np.flatnonzero(np.diff(number)) + 1
        return {self.wanted[int(n[0]) - 1]: r for n, r in zip(np.split(number, cuts), np.split(row, cuts)) if len(n)}


@lru_cache(maxsize=4)
def _plan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r) for r in rules]
    return [r.compiled() for r in rules], queries, Indexer(set().union(*map(trigrams_of, queries)))


def find(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of the verified matches in each text of one shard, in that order."""
    patterns, queries, indexer = _plan(rules)
    postings = indexer.postings(texts)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, pattern, query) in enumerate(zip(rules, patterns, queries)):
        for i in range(len(texts)) if query is True else candidates(query, postings):
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    spans[i].append((m.start(), k, m.end()))
    return [sorted(s) for s in spans]


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...], shard_chars: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found, shard, size = [], [], 0
        for text in batch.column("text"):
            shard.append(text.as_py() or "")
            size += len(shard[-1])
            if size >= shard_chars:
                found += find(shard, rules)
                shard, size = [], 0
        found += find(shard, rules) if shard else []
        spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in found]
        yield pa.record_batch([batch.column("row"), pa.array(spans, kind)], names=["row", "spans"])


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """All columns but ``text``, and ``spans``: kind, start and end (code points, end exclusive) of every secret.

    Spans are ordered by start, then by rule. A null or empty text has none; rows are independent of each other, so
    null or repeated ids do no harm; an existing ``spans`` column is replaced; an empty table gives an empty result.
    """
    others = [c for c in docs.columns if c not in {text, "spans"}]
    rows = docs.select(F.struct(F.lit(0).alias("__row"), *others).alias("row"), F.col(text).cast("string").alias("text"))
    row = rows.schema["row"].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(lambda it: _scan(it, rules, shard_chars), f"row {row}, spans {spans}").select("row.*", "spans").drop("__row")
