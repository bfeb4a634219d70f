"""Secret scan: an Aho-Corasick keyword prefilter, anchored regular expressions at its hits only, embedded checksums last.

A text's UTF-8 bytes are lowered (ASCII only, so offsets stay) and go through one automaton of all keywords. Each hit,
in order of its start, is tried by its kind's anchored expression on the original bytes; a kind's next match starts at
or after the end of its last one, which gives the leftmost non-overlapping matches that a scan of the whole text would
give. Hexadecimal runs have no keyword, so every four hex digits are one: a run of 24 cannot avoid them.

Kinds with a checksum inside (tokens of two public registries, JSON web tokens, payment cards) only count if it holds.
A JSON web token starts where its run of token characters does.

The time is linear in the text: a match of a base kind moves that kind's start past itself, whether it counts or not;
registry tokens and cards have bounded length; a run of token characters has one place where a JSON web token may start,
so it is read three times at most (as head, body or signature).

Null text counts as empty: no spans. Repeated rows each give their own row. Other columns are kept, except that columns
named as this operator's results are replaced. Texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import aside, slices

BASE_KINDS = ("assign", "access", "hex")
#: Kinds in the order that breaks ties of their starts.
KINDS = (*BASE_KINDS, "forge", "registry", "jwt", "card")
#: Lower-case keywords of each kind but hex.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "registry": ("npm_",),
    "jwt": ("eyj",),
    "card": ("card",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PATTERNS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]+"),
    "forge": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "registry": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+"),
    "card": re.compile(rb"card[a-z]{0,6}(?: (?:no|number))?[ .:=#]{0,3}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.IGNORECASE),
}
MIN_LENGTH = {"assign": 6, "access": 20, "hex": 24}


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _crc_base62(body: bytes) -> bytes:
    value, out = zlib.crc32(body), ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(6, "0").encode()


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = (d - 48) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _jwt_header(token: bytes) -> bool:
    head = token.split(b".", 1)[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(found, dict) and "alg" in found


def _holds(kind: str, match: re.Match) -> bool:
    """Lengths of the base kinds, embedded checksums of the others."""
    if kind == "assign":
        return len(match[2]) >= MIN_LENGTH[kind]
    if kind in MIN_LENGTH:
        return match.end() - match.start() >= MIN_LENGTH[kind]
    if kind in ("forge", "registry"):
        return _crc_base62(match[0][4:34]) == match[0][34:40]
    if kind == "jwt":
        return _jwt_header(match[0])
    return _luhn(re.sub(rb"[^0-9]", b"", match[1]))


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, tuple[str, ...]] = {"".join(x): ("hex",) for x in itertools.product("0123456789abcdef", repeat=4)}
    for kind, words in KEYWORDS.items():
        for word in words:
            kinds[word] = (*kinds.get(word, ()), kind)
    for word, names in kinds.items():
        found.add_word(word, (len(word), names))
    found.make_automaton()
    return found


def find_secrets(text: str | None) -> list[Span]:
    """All spans (code points, end exclusive) of a whole text, by start, then kind."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    free = dict.fromkeys(KINDS, 0)
    found: list[Span] = []
    # Keywords of one kind that start elsewhere end in the order of their starts, except that a longer one may end later
    # than one that starts inside it; none of the assign words contains another, so hits of a kind come by start.
    for end, (length, kinds) in _automaton().iter(data.lower().decode("latin-1")):
        start = end - length + 1
        for kind in kinds:
            if start >= free[kind] and (match := PATTERNS[kind].match(data, start)):
                if kind in BASE_KINDS:
                    free[kind] = match.end()
                if _holds(kind, match):
                    free[kind] = match.end()
                    found.append(Span(kind, *(match.span(1) if kind == "card" else match.span())))
    if found and len(data) != len(text):
        found = _code_points(data, found)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s.start, order[s.kind], s.end))


def _code_points(data: bytes, spans: list[Span]) -> list[Span]:
    """Byte offsets to code points, counting between neighbouring offsets only."""
    at, chars, where = 0, 0, {}
    for x in sorted({x for s in spans for x in s[1:]}):
        chars += len(data[at:x].decode("utf-8", "surrogatepass"))
        at, where[x] = x, chars
    return [Span(s.kind, where[s.start], where[s.end]) for s in spans]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s in spans:
        if s.end <= at:
            continue
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = s.end
    return "".join([*out, text[at:]])


RESULT = (("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string()))
RESULT_DDL = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "redacted": "string"}


def scan_secrets(df: DataFrame, text: str = "text", with_redacted: bool = True) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256, spans and, unless it is not wanted, the redacted text."""
    names = [c for c in RESULT_DDL if with_redacted or c != "redacted"]
    df = df.drop(*(c for c in names if c != text))
    keep = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{c} {RESULT_DDL[c]}" for c in names])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: dict[str, list] = {c: [] for c in RESULT_DDL}
            for value in batch.column(keep.index(text)):
                value = value.as_py()
                spans = find_secrets(value)
                base = [s for s in spans if s.kind in BASE_KINDS]
                for kind in BASE_KINDS:
                    rows[f"n_{kind}"].append(sum(s.kind == kind for s in base))
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                rows["spans"].append(joined(spans))
                if with_redacted:
                    rows["redacted"].append(redact(value, spans) if spans else value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[c], t) for c, t in RESULT if c in names)], names=[*keep, *names])

    return df.mapInArrow(scan, schema)


def redacted(df: DataFrame) -> DataFrame:
    """Documents with every secret replaced; ``n_chars`` follows the new text, all other columns stay, whatever their names."""
    own = aside(df, RESULT_DDL)

    def column(name: str) -> Column:
        if name == "text":
            return F.col("redacted").alias(name)
        if name == "n_chars":
            return F.length("redacted").cast(df.schema[name].dataType).alias(name)
        return F.col(f"`{name}`")

    return scan_secrets(own).select(*map(column, own.columns)).toDF(*df.columns)
