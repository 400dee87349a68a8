"""Operator 5, personal data: anchors found by Aho-Corasick, expanded by local parsers.

One automaton finds at-signs, plus-signs, ``://``, digits and identifier cues in a text. Each anchor
calls the parser of its kind, which looks left and right of it as far as its own characters reach,
checks what it found (label structure, parts up to 255, Luhn, number of digits) and gives a span.
What a parser has taken is not looked at again by the same parser, so its spans don't overlap and
the work is linear in the text.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``: the leftmost non-overlapping matches of

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([ -]?[0-9])+, 14 to 19 digits, Luhn
    phone  \\+[0-9][ ().0-9-]+[0-9], 10 to 15 digits

The method adds ``address`` (a url with a user part before the host) and ``account`` (the value that
follows a cue such as IBAN, account or token). Offsets are code points, the end exclusive.

Null text is empty: no spans. Repeated rows, null ids: one row each. Empty table: no rows. Long texts
are processed whole. Columns other than doc_id and text are not read by ``find``; ``redact`` keeps
all, puts ``[EMAIL]`` and so on in the place of spans (of overlapping ones the first's), and sets
n_chars, if there is such a column, to the new length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from zonepack.llm.shared import documents, slices
from zonepack.llm.word_ids import take_turn

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
#: Words that announce an identifier; looked for in lower case, capitalised and in upper case.
CUES = ("account", "acct", "iban", "ssn", "passport", "token", "password", "api_key", "apikey", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
RUN = re.compile(r"[0-9]++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
WITH_USER = re.compile(r"[^\s/?#@\"'<>]++@[^\s/?#@\"'<>]++")
VALUE = re.compile(r"(?:[ _-]?(?:no|number|nr|id))?\.?[ \t]*+[:=#]?[ \t]*+[\"']?([A-Za-z0-9][A-Za-z0-9_-]{5,}+)")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


class Finder:
    """Spans as (start, index in ``KINDS``, end), sorted."""

    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for c in "0123456789":
            self.anchors.add_word(c, ("digit", 1))
        for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
            self.anchors.add_word(word, (kind, len(word)))
        for cue in CUES:
            for word in {cue, cue.capitalize(), cue.upper()}:
                self.anchors.add_word(word, ("cue", len(word)))
        self.anchors.make_automaton()

    def __call__(self, text: str) -> list[Span]:
        spans: list[Span] = []
        email_end = ip_end = card_end = phone_end = run_end = address_end = account_end = 0
        for last, (kind, size) in self.anchors.iter(text):
            at = last + 1 - size
            if kind == "digit":
                if at < run_end:
                    continue
                run_end = RUN.match(text, at).end()
                if at >= ip_end and (m := QUAD.match(text, at)):
                    ip_end = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        spans.append((at, 1, ip_end))
                if at >= card_end and (m := DIGITS.match(text, at)):
                    card_end = m.end()
                    if card_end - at <= 37 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                        spans.append((at, 2, card_end))
            elif kind == "at":
                start = at
                while start > email_end and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (m := DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    spans.append((start, 0, email_end))
            elif kind == "plus":
                if at >= phone_end and (m := PHONE.match(text, at)):
                    phone_end = m.end()
                    if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                        spans.append((at, 3, phone_end))
            elif kind == "scheme":
                start = at
                while start > address_end and text[start - 1] in SCHEME:
                    start -= 1
                if start < at and (m := WITH_USER.match(text, at + 3)):
                    address_end = m.end()
                    spans.append((start, 4, address_end))
            elif at >= account_end and (at == 0 or not text[at - 1].isalnum()) and (m := VALUE.match(text, last + 1)):
                if m.start(1) > last + 1 and any(map(str.isdigit, m[1])):
                    account_end = m.end(1)
                    spans.append((m.start(1), 5, account_end))
        return sorted(spans)


_finder: list[Finder] = []


def finder() -> Finder:
    if not _finder:
        _finder.append(Finder())
    return _finder[0]


def digest(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("personal data")
        spans_of = finder()
        for rows, texts in slices(batches):
            found = [spans_of(t) for t in texts]
            counts = [pa.array([sum([k == kind for _, k, _ in f]) for f in found], pa.int64()) for kind in range(len(BASE))]
            base = [hashlib.sha256(digest([s for s in f if s[1] < len(BASE)]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([digest(f) for f in found], pa.string())], names)

    return documents(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def without(text: str, spans: list[Span]) -> str:
    parts, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, spans replaced in ``text``; a null text stays null."""
    at = docs.columns.index("text")
    n_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("personal data")
        spans_of = finder()
        for rows, texts in slices(batches):
            columns = list(rows.columns)
            clean = [without(t, spans_of(t)) for t in texts]
            columns[at] = pc.if_else(rows.column(at).is_valid(), pa.array(clean, rows.schema.field(at).type), None)
            if n_chars is not None:
                old = columns[n_chars].to_pylist()
                columns[n_chars] = pa.array([n if t == c else len(c) for n, t, c in zip(old, texts, clean)], rows.schema.field(n_chars).type)
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
