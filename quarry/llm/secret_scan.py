"""Secrets in texts: strong patterns, and weak parts linked within a scope.

Strong (base) kinds stand on their own: ``assign``, ``access`` and ``hex``.
Weak parts are common in clean prose, so none is reported alone.  Each part has
a role (identifier, secret or endpoint) and a scope: the part's span widened by
``scope`` code points on both sides.  An interval join of the parts of one
text, done as one sweep over their sorted starts, links parts whose scopes
meet; a weak part is reported only where a complementary role co-occurs: a
secret with an identifier or an endpoint.  The sweep goes over the starts
forwards and backwards and holds only the latest end, then the earliest start,
of each role, so it is linear however many parts a text has, and since a scope
never leaves its text, no rows move between tasks.

Null and empty texts have no spans, and an empty table gives an empty result;
very long texts are scanned whole.  Spans of one start are listed in the order of
their kinds.  Repeated rows give the same result each, null ids too.  Offsets are code points, ends
exclusive.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "weak_identifier", "weak_secret", "weak_endpoint")
IDENTIFIER, SECRET, ENDPOINT = range(3)
#: Role of each kind.
ROLES = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "weak_identifier": IDENTIFIER, "weak_secret": SECRET, "weak_endpoint": ENDPOINT}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

_WEAK = (
    ("weak_identifier", ("id", "user", "login"), re.compile(r"""\b(?:(?:client|access|account|tenant|app)[_-]?(?:key[_-]?)?id|user(?:_?name)?|login)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9@._-]{4,}""", re.ASCII | re.IGNORECASE)),
    ("weak_secret", ("pass", "pwd", "cred", "auth", "secret", "key"), re.compile(r"""\b(?:pass|pwd|passphrase|credential|auth|client[_-]secret|private[_-]key|secret[_-]?access[_-]?key)["']?\x20{0,8}[:=]\x20{0,8}["']?[^\s"']{6,}""", re.ASCII | re.IGNORECASE)),
    ("weak_endpoint", ("://", "host", "endpoint", "server"), re.compile(r"""\b(?:(?:jdbc:)?(?:postgres(?:ql)?|mysql|mongodb|redis|amqp|ldap|ftp|sftp|ssh)://[^\s"']{4,}|(?:endpoint|host|hostname|server)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9._:/-]{4,})""", re.ASCII | re.IGNORECASE)),
)

Span = tuple[int, int, str]  # start, end, kind


def base_spans(text: str, lower: str | None = None) -> list[Span]:
    """The strong spans of a text, leftmost and non-overlapping within each kind."""
    lower = text.lower() if lower is None else lower
    out: list[Span] = []
    if any(hint in lower for hint in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple:
    return span[0], KINDS.index(span[2]), span[1]


def linked_weak_spans(text: str, lower: str, base: list[Span], scope: int) -> list[Span]:
    """Weak parts that meet a complementary part within ``scope``; none overlaps a base span."""
    weak = [(m.start(), m.end(), kind) for kind, hints, pattern in _WEAK if any(h in lower for h in hints) for m in pattern.finditer(text)]
    if not weak:
        return []
    parts = sorted([*base, *weak], key=_order)
    found = set()
    for forward in (True, False):
        # for each role the latest end of the parts that start before, then (negative) the earliest start of those after
        reach: list[int | None] = [None] * 3
        for start, end, kind in parts if forward else reversed(parts):
            role = ROLES[kind]
            others = (IDENTIFIER, ENDPOINT) if role == SECRET else (SECRET,)
            near, far = (start, end) if forward else (-end, -start)
            if any(reach[o] is not None and near - reach[o] <= 2 * scope for o in others):
                found.add((start, end, kind))
            reach[role] = far if reach[role] is None else max(reach[role], far)
    starts, ends = [], []  # the base spans as disjoint intervals, so one search tells whether a part meets any
    for start, end, _ in base:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    free = lambda p: (k := bisect_left(starts, p[1])) == 0 or ends[k - 1] <= p[0]
    return [p for p in weak if p in found and free(p)]


def all_spans(text: str, scope: int) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both in order of start and kind."""
    # lower-casing only finds hints; offsets always refer to the text itself
    lower = text.lower()
    base = base_spans(text, lower)
    weak = linked_weak_spans(text, lower, base, scope)
    return base, sorted([*base, *weak], key=_order) if weak else base


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_SCAN = "spans array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 120) -> DataFrame:
    """(doc_id, spans): every span as kind, start, end and whether it is a base span."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "", scope)
                strong = set(base)
                rows.append([{"kind": s[2], "start": s[0], "end": s[1], "base": s in strong} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPAN_TYPE)], ["doc_id", "spans"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id long, {_SCAN}")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact_text(text: str, scope: int = 120, mark: str = "[REDACTED]") -> str:
    """The text with every found span replaced by ``mark``; overlapping spans become one mark."""
    out, at = [], 0
    for start, end, _ in all_spans(text, scope)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", scope: int = 120) -> DataFrame:
    """All rows and columns, with found spans redacted; the length column follows.

    A null text stays null; a text without spans keeps its bytes and its length column.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            before = batch.column(at).to_pylist()
            after = [None if t is None else redact_text(t, scope) for t in before]
            columns = list(batch.columns)
            columns[at] = pa.array(after, batch.column(at).type)
            if length_col and (k := batch.schema.get_field_index(length_col)) >= 0:
                old = batch.column(k).to_pylist()
                columns[k] = pa.array([n if a is b or a == b else len(a) for n, b, a in zip(old, before, after, strict=True)], batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
