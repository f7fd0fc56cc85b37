"""Secret scan: keyword automaton first, anchored patterns at its hits, then embedded checksums.

Every text is read once by an Aho-Corasick automaton over the fixed keywords. Patterns are tried only at the
positions it reports, anchored there. Hexadecimal runs have no keyword; every run of 24 digits covers one of the
positions 23, 47, 71, ..., so only those are probed and a run is grown around a hit. Tokens of the kinds in
``CHECKED`` carry a CRC-32 of their body in their last six characters and count only if it agrees.

Rows: one per input row, in any number, whatever its id. A null or empty text has no spans. Equal rows give equal
results. Other columns are ignored. An empty table gives an empty table. Spans of one kind never overlap; spans of
different kinds may.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tables import lower_in_place, type_of, with_rows

#: The order in which kinds are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
#: Keyword in lower case, kind it may start.
KEYWORDS = (
    ("password", "assign"), ("passwd", "assign"), ("secret", "assign"), ("token", "assign"), ("apikey", "assign"),
    ("api_key", "assign"), ("akia", "access"), ("ghp_", "github"), ("gho_", "github"), ("ghu_", "github"),
    ("ghs_", "github"), ("ghr_", "github"), ("npm_", "npm"),
)
#: Patterns, least length of their group 1, and whether a checksum closes the token.
PATTERNS = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 6),
    "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 20),
    "github": (re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), 36),
    "npm": (re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"), 36),
}
CHECKED = ("github", "npm")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_LENGTH = 24
HEX = frozenset("0123456789abcdef")
HEX_DIGIT = re.compile("[0-9a-f]")
HEX_RUN = re.compile("[0-9a-f]+")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS:
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    rest, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits


def _hex_spans(text: str) -> list[tuple[int, int]]:
    spans, done = [], 0
    for m in HEX_DIGIT.finditer(text[HEX_LENGTH - 1::HEX_LENGTH]):
        at = HEX_LENGTH * (m.start() + 1) - 1
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in HEX:
            start -= 1
        done = HEX_RUN.match(text, at).end()
        if done - start >= HEX_LENGTH:
            spans.append((start, done))
    return spans


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) in order; code points, end exclusive."""
    if not text:
        return []
    starts: dict[str, list[int]] = {}
    for last, (length, kind) in automaton().iter(lower_in_place(text)):
        starts.setdefault(kind, []).append(last + 1 - length)
    spans = [(a, 2, b) for a, b in _hex_spans(text)]
    for kind, places in starts.items():
        pattern, least = PATTERNS[kind]
        done, rank = 0, KINDS.index(kind)
        for start in sorted(places):
            if start < done:
                continue
            m = pattern.match(text, start)
            if m is None:
                continue
            done = m.end()  # a match that is dropped still uses up its characters
            value = m.group(1)
            if len(value) >= least and (kind not in CHECKED or checksum(value[:-6]) == value[-6:]):
                spans.append((start, rank, done))
    return sorted(spans)


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, spans array<struct<kind, start, end>>)`` for every row, spans by start, then kind as listed."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_rows(batches):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=[id_column, "spans"])

    schema = f"`{id_column}` {type_of(docs, id_column)}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base kinds and all spans as text, from the spans of ``find_secrets``."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"))
