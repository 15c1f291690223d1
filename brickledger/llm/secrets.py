"""Secrets in texts: keyword prefilter, anchored patterns near hits only, checksums where a kind has one.

An Aho-Corasick automaton passes over each text once.  Only where it finds a
keyword is a pattern tried, anchored at that place.  Kinds that embed a
checksum are reported only if it holds.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, utf8, whole_texts

# The three base kinds, in the order in which spans with the same start are listed.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN_VALUE = re.compile(r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ["assign", "access", "hex"]

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix_holds(token: str) -> bool:
    """The last six characters of a prefixed token are the base-62 CRC-32 of those between prefix and suffix."""
    body, suffix = token.rpartition("_")[2][:-6], token[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == suffix


def luhn_holds(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    doubled = [d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits), 1)]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def jwt_holds(token: str) -> bool:
    """Header and claims of a signed web token are JSON objects, and the header names an algorithm."""
    try:
        head, claims = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in token.split(".")[:2])
    except (ValueError, binascii.Error, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head and isinstance(claims, dict)


def always(_: str) -> bool:
    return True


@dataclass(frozen=True)
class Kind:
    """A kind that begins with a keyword: the pattern is tried where the keyword starts."""

    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    holds: Callable[[str], bool] = always


MORE_KINDS = (
    Kind("code_host", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), crc_suffix_holds),
    Kind("package_host", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), crc_suffix_holds),
    Kind("web_token", ("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), jwt_holds),
    Kind("private_key", ("-----begin ",), re.compile(
        r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----(?:(?!-----)[\s\S])*-----END (?:[A-Z]+ )?PRIVATE KEY-----")),
    Kind("card", ("card", "visa"), re.compile(r"[A-Za-z]+[^0-9\n]{0,16}((?:[0-9][ -]?){12,18}[0-9])(?![0-9])"), luhn_holds),
)
ORDER = {name: i for i, name in enumerate([*BASE_KINDS, *(k.name for k in MORE_KINDS)])}

Span = tuple[str, int, int]


class Scanner:
    def __init__(self, more: tuple[Kind, ...] = MORE_KINDS):
        self.automaton = ahocorasick.Automaton()
        claims: dict[str, list] = {}
        for word in ASSIGN_WORDS:
            claims.setdefault(word, []).append(None)
        claims.setdefault("akia", []).append(BASE_KINDS[1])
        for kind in more:
            for word in kind.keywords:
                claims.setdefault(word, []).append(kind)
        for word, kinds in claims.items():
            self.automaton.add_word(word, (len(word), kinds))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """All spans, by start and then by kind.  Spans of one kind do not overlap: the leftmost stays."""
        found: list[Span] = [("hex", *m.span()) for m in HEX.finditer(text)]
        # A-Z alone is lowered, so places stay the same
        low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        hits = sorted((end + 1 - length, length, kinds) for end, (length, kinds) in self.automaton.iter(low))
        free: dict[str, int] = {}
        for start, length, kinds in hits:
            for kind in kinds:
                name = "assign" if kind is None else kind if isinstance(kind, str) else kind.name
                if start < free.get(name, 0):
                    continue
                if kind is None:
                    match = ASSIGN_VALUE.match(text, start + length)
                    good = match and len(match[1]) >= ASSIGN_LEAST
                elif kind == "access":
                    match = ACCESS.match(text, start)
                    good = match and len(match[0]) >= ACCESS_LEAST
                else:
                    match = kind.pattern.match(text, start)
                    good = match and kind.holds(match[1] if kind.pattern.groups else match[0])
                    if not good:
                        match = None  # a failed checksum must not hide a later match
                if match:
                    free[name] = match.end()
                if good:
                    found.append((name, start, match.end()))
        return sorted(found, key=lambda s: (s[1], ORDER[s[0]]))


_scanner: Scanner | None = None


def scanner() -> Scanner:
    """The scanner of this Python worker, kept from one task to the next."""
    global _scanner
    _scanner = _scanner or Scanner()
    return _scanner


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans)`` of every row: structs of kind, start and end in code points, end exclusive, in order.

    Null and empty texts have an empty list.  Ids may be null or repeated;
    whole texts are scanned, whatever their length.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().spans
        for batch in source:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan((t or b"").decode("utf-8", "replace"))]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["id", "spans"])

    source = whole_texts(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    return source.mapInArrow(run, "id long, spans array<struct<kind string, start long, end long>>")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all secrets in the text replaced by ``[kind]``; texts without any, and null texts, stay as they are.

    In a text with secrets, bytes that are not UTF-8 become the replacement
    character.  Other columns may have any name; repeated rows stay repeated,
    and an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def clean(raw: bytes | None) -> bytes | None:
        text = (raw or b"").decode("utf-8", "replace")
        spans = scanner().spans(text)
        return redacted(text, spans).encode() if spans else raw

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        field = batch.schema.field(at)
        made = pa.array([clean(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
        return batch.set_column(at, field, made.view(field.type) if field.type == pa.string() else made.cast(field.type))
    return map_rows(docs, run)
