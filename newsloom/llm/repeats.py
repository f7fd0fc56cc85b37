"""Removing repeated passages with a suffix order built column by column over many documents.

A byte is removed if a string of ``SPAN`` = 100 bytes that covers it also starts earlier: in a document with a smaller
id, or earlier in its own. Strings are judged on the input.

1. Dealing. Every 100-byte window picks its smallest 32-byte gram by hash (the leftmost of equal ones); windows in a
   row that pick the same gram form a segment of at most 168 bytes. Equal windows pick equal grams at equal places, so
   strings can only repeat among segments of one gram, and segments are dealt by gram. Before that, equal segments of
   a batch are folded to the earliest: all windows of the others start earlier there. So a passage that stands in a
   third of all documents meets its task as one row per batch. After the shuffle the same holds for equal segments.
2. Suffix order. Different segments of one gram are where partly equal passages begin and end. They form a collection
   that is built right to left, one symbol per segment and round. Segments are aligned on their gram and a symbol is
   tagged with gram and column, as strings can only repeat at the same distance from their gram. So the suffixes that
   a round inserts form a block of their own in the collection's order; the blocks of earlier rounds stay as they are
   and the next round only needs the last one: its Burrows-Wheeler symbols (the next column, in the block's order) and
   the common prefixes of its neighbours. A round sorts the block stably by symbol and takes each new common prefix as
   one more than the least old one between two neighbours. Symbols lie column by column in an anonymous scratch file
   that is written once and read front to back; a task holds a few numbers per segment. Neighbours that share
   100 bytes are the repeats; the earliest of each run stays. Tags make this the positional form of the construction:
   without them every round would rewrite the whole transform, which took over six times the time allowed.
   A gram with more than ``HOT`` different segments, say where a passage of very many documents meets as many
   different surroundings, is dealt anew window by window, by gram and the first and last 32 bytes of the window:
   equal windows still meet, and windows that reach into different surroundings part. Nothing is left out.
3. Cutting. Spans are merged per document and cut from its bytes.

The scratch file is no shared data: no other task reads it, and a lost task makes it again.

Null text: as empty. Texts under 100 bytes lose nothing. A row without id is compared with nothing and kept whole. Rows
that repeat an id are one document read several times: equal places of them do not count as earlier, and what is
removed from one is removed from all. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.links import run_starts
from newsloom.llm.tables import with_rows
from newsloom.plans.components import join_hot
from newsloom.plans.lineage import cut_lineage

SPAN = 100
GRAM = 32
REACH = SPAN - GRAM + 1
CHUNK = 1 << 20
COLLECTION = 16_384
HOT = 20_000
BLOCK = 4096
_LETTERS = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEPS = np.random.default_rng(8).integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from every position, by doubling."""
    h, width, step = _LETTERS[data], 1, 0
    while width < GRAM:
        h = h[:-width] * _STEPS[step] + h[width:]
        width, step = width * 2, step + 1
    h ^= h >> np.uint64(29)
    h *= _STEPS[6]
    return h ^ h >> np.uint64(32)


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window, windows, bytes before the gram) of a text's segments, a chunk of windows at a time."""
    found = []
    for at in range(0, max(0, len(data) - SPAN + 1), CHUNK):
        part = data[at:at + CHUNK + SPAN - 1]
        h = gram_hashes(part)
        low = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)  # leftmost of equal hashes
        width = 1
        while width * 2 <= REACH:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:len(low) - (REACH - width)], low[REACH - width:])
        picked = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(picked[1:] != picked[:-1]) + 1])
        found.append((h[picked[first]].view(np.int64), first + at, np.diff(np.append(first, len(picked))), picked[first] - first))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Union of (document, start, end) rows as disjoint rows in order."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    starts = run_starts(spans, 1)
    # ends grow within a document; a document's ends are lifted above those of the ones before
    lift = np.zeros(len(spans), dtype=np.int64)
    lift[starts] = 1
    lift = np.cumsum(lift) * (int(spans[:, 2].max(initial=0)) + 1)
    reach = np.maximum.accumulate(spans[:, 2] + lift)
    fresh = np.ones(len(spans), dtype=bool)
    fresh[1:] = spans[1:, 1] + lift[1:] > reach[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(spans) - 1) if len(spans) else np.zeros(0, np.int64)
    return np.column_stack([spans[fresh, 0], spans[fresh, 1], (reach - lift)[last]])


#: ``shape`` holds the number of windows and, above 8 bits, the bytes before the gram; -end if the row is a span.
_DEALT = ["gram", "content", "doc", "first", "shape"]


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to segments, equal ones of a batch folded; what that settles goes as spans."""
    for batch in with_rows(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            gram, first, windows, lead = segments(np.frombuffer(raw, np.uint8))
            if len(gram):
                ends = (first + windows + SPAN - 1).tolist()
                content = np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), ends, strict=True)], dtype=np.uint64)
                rows.append(np.column_stack([gram, content.view(np.int64), np.full(len(gram), doc), first, windows + (lead << 8)]))
        if not rows:
            continue
        rows = np.concatenate(rows)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        earliest, again = _folded(rows)
        spans = _merged(np.column_stack([again[:, 2], again[:, 3], _ends(again)]))
        done = np.column_stack([spans[:, 0] * 0x9E3779B1, spans[:, 1], spans[:, 0], spans[:, 1], -spans[:, 2]])  # any even deal
        out = np.concatenate([rows[earliest], done])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=_DEALT)


_PIECE = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_FOUND = ["doc", "gram", "first", "shape"]


def _ends(rows: np.ndarray) -> np.ndarray:
    return rows[:, 3] + (rows[:, 4] & 255) + SPAN - 1


def _folded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of sorted rows are the earliest of their content, and the later ones at another place."""
    starts = run_starts(rows, 2)
    earliest = np.zeros(len(rows), dtype=bool)
    earliest[starts] = True
    of = np.repeat(starts, np.diff(np.append(starts, len(rows))))
    return earliest, rows[np.any(rows[:, 2:4] != rows[of][:, 2:4], axis=1)]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dealt rows in order to spans and to segments whose gram has different contents."""

    def rows_of(kept: np.ndarray, ends: np.ndarray | None = None) -> pa.RecordBatch:
        columns = kept[:, 2], kept[:, 0], kept[:, 3], kept[:, 4] if ends is None else -ends
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=_FOUND)

    last, shared = None, False  # the earliest row of the content last seen; whether its gram had another before
    for batch in with_rows(batches):
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        done = rows[:, 4] < 0
        if done.any():
            yield rows_of(rows[done])
            rows = rows[~done]
        if not len(rows):
            continue
        rows = rows if last is None else np.concatenate([last, rows])
        earliest, again = _folded(rows)
        if len(again):
            yield rows_of(again, _ends(again))
        firsts = rows[earliest]
        same = firsts[1:, 0] == firsts[:-1, 0]
        before = np.concatenate([[shared], same])
        mixed = before[:-1] | same  # of all but the last, which is still open
        if mixed.any():
            yield rows_of(firsts[:-1][mixed])
        last, shared = firsts[-1:], bool(before[-1])
    if last is not None and shared:
        yield rows_of(last)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Found rows in order of document: spans merged as far as a document's batch reaches, segments as they are."""
    for batch in with_rows(batches):
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        span = rows[:, 3] < 0
        merged = _merged(np.column_stack([rows[span, 0], rows[span, 2], -rows[span, 3]])) if span.any() else np.zeros((0, 3), np.int64)
        out = np.concatenate([rows[~span], np.column_stack([merged[:, 0], merged[:, 0] * 0, merged[:, 1], -merged[:, 2]])])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=_FOUND)


def _symbol_columns(pieces: list[bytes], first_column: np.ndarray, columns: int) -> list[np.ndarray]:
    """The symbols of aligned pieces, column by column, in an unnamed scratch file; a view of it per ``BLOCK`` pieces."""
    file = tempfile.TemporaryFile()
    views = []
    for at in range(0, len(pieces), BLOCK):
        part = pieces[at:at + BLOCK]
        sizes = np.array([len(p) for p in part])
        flat = np.frombuffer(b"".join(part), dtype=np.uint8)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first_column[at:at + BLOCK], sizes)
        block = np.zeros((columns, len(part)), dtype=np.uint8)
        block[row, np.repeat(np.arange(len(part)), sizes)] = flat
        block.tofile(file)
        views.append(block.shape)
    file.flush()
    offset, maps = 0, []
    for shape in views:
        maps.append(np.memmap(file, np.uint8, "r", offset=offset, shape=shape))
        offset += shape[0] * shape[1]
    return maps


def _least_between(prefix: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Least of ``prefix`` over (after, upto] for each pair; pairs from the right make every gap one step long."""
    order = np.argsort(-after, kind="stable")
    bounds = np.column_stack([after[order] + 1, upto[order] + 1]).ravel()
    out = np.empty(len(after), dtype=prefix.dtype)
    out[order] = np.minimum.reduceat(np.append(prefix, 0), bounds)[::2] if len(after) else 0
    return out


def suffix_rounds(pieces: list[bytes], lead: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rounds of the construction, right to left: (column, pieces in suffix order, common prefix with the one before).

    Pieces are aligned on the end of their ``lead``; those of one ``gram`` (small numbers) are ordered by the bytes from
    the column on, prefixes are told up to ``SPAN``. The first piece of a gram has prefix 0.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    begin = int(lead.max()) - lead
    end = begin + sizes
    columns = int(end.max())
    symbols = _symbol_columns(pieces, begin, columns)
    kind = np.uint16 if int(gram.max()) < 1 << 16 else np.int64
    entering = np.argsort(-end, kind="stable")
    entered, order, prefix = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for column in range(columns - 1, -1, -1):
        upto = int(np.searchsorted(-end[entering], -column))
        if upto > entered:  # their suffix is empty so far: before all others of their gram
            order = np.concatenate([np.sort(entering[entered:upto]), order])
            prefix = np.concatenate([np.zeros(upto - entered, np.int64), prefix])
            by_gram = np.argsort(gram[order].astype(kind), kind="stable")
            order, prefix, entered = order[by_gram], prefix[by_gram], upto
        at = np.flatnonzero(begin[order] <= column)
        inside = order[at]
        letter = np.concatenate([block[column] for block in symbols])[inside]
        by_letter = np.argsort(letter, kind="stable")
        sort = by_letter[np.argsort(gram[inside][by_letter].astype(kind), kind="stable")]
        inside, at, letter = inside[sort], at[sort], letter[sort]
        same = np.flatnonzero((letter[1:] == letter[:-1]) & (gram[inside[1:]] == gram[inside[:-1]])) + 1
        fresh = np.zeros(len(inside), dtype=np.int64)
        fresh[same] = np.minimum(SPAN, 1 + _least_between(prefix, at[same - 1], at[same]))
        order, prefix = inside, fresh
        yield column, order, prefix


def later_windows(pieces: list[bytes], lead: np.ndarray, gram: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of 100-byte windows that equal one of an earlier piece of the gram at another ``place``."""
    begin = int(lead.max()) - lead
    found = []
    for column, order, prefix in suffix_rounds(pieces, lead, gram):
        goes_on = prefix >= SPAN
        if goes_on.any():
            starts = np.flatnonzero(~goes_on)
            low = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, len(order))))
            later = order[np.any(place[order] != place[low], axis=1)]
            found.append(np.column_stack([later, column - begin[later]]))
    found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return found[:, 0], found[:, 1]


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc, first, lead, piece) sorted by gram to spans of windows that start earlier elsewhere."""

    def repeated(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda x: (x[1], x[2] + x[3]))  # earlier pieces get smaller numbers
        _, gram = np.unique([x[0] for x in held], return_inverse=True)
        doc, first, lead = (np.array([x[k] for x in held], dtype=np.int64) for k in (1, 2, 3))
        piece, offset = later_windows([x[4] for x in held], lead, gram, np.column_stack([doc, first + lead]))
        spans = np.column_stack([doc[piece], first[piece] + offset, first[piece] + offset + SPAN])
        spans = _merged(spans) if len(spans) else spans
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in spans.T], names=["doc", "start", "end"])

    held, same = [], []  # grams with several pieces; pieces of the gram at hand
    for batch in with_rows(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if same and row[0] != same[0][0]:
                if len(same) > 1:
                    held += same
                if len(held) >= COLLECTION:
                    yield repeated(held)
                    held = []
                same = []
            same.append(row)
    if len(same) > 1:
        held += same
    if held:
        yield repeated(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, wanted) to the bytes of the wanted segments, those of hot grams window by window."""
    for batch in with_rows(batches):
        for doc, text, wanted in zip(*(batch.column(k) for k in range(3)), strict=True):
            raw, doc, rows = text.as_py().encode(), doc.as_py(), []
            for w in wanted.as_py():
                first = w["first"]
                if not w["hot"]:
                    rows.append((w["gram"], doc, first, w["shape"] >> 8, raw[first:first + (w["shape"] & 255) + SPAN - 1]))
                    continue
                for at in range(first, first + (w["shape"] & 255)):
                    piece = raw[at:at + SPAN]
                    gram = xxhash.xxh3_64_intdigest(piece[:GRAM] + piece[-GRAM:], w["gram"] & (1 << 64) - 1) >> 1
                    rows.append((gram, doc, at, 0, piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PIECE, strict=True)], names=["gram", "doc", "first", "lead", "piece"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, spans) to what is left: sizes and digest of the remaining bytes."""
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in with_rows(batches):
        out = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = (text.as_py() or "").encode()
            digest, at, removed, runs = hashlib.sha256(), 0, 0, 0
            rows = np.array([(0, s["start"], min(s["end"], len(raw))) for s in spans or () if s["start"] < len(raw)], dtype=np.int64).reshape(-1, 3)
            for _, start, end in _merged(rows).tolist() if len(rows) else ():
                digest.update(raw[at:start])
                removed, runs, at = removed + end - start, runs + 1, end
            digest.update(raw[at:])
            out.append((doc, len(raw), removed, runs, digest.hexdigest()))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``(doc, text)`` to spans ``(doc, start, end)`` that cover every byte to remove; they may overlap."""
    dealt = texts.mapInArrow(_deal, "gram long, content long, doc long, first long, shape long")
    folded = dealt.repartition("gram").sortWithinPartitions(*_DEALT[:4]).mapInArrow(_fold, "doc long, gram long, first long, shape long")
    found = cut_lineage(folded.repartition("doc").sortWithinPartitions("doc", "first").mapInArrow(_gather, "doc long, gram long, first long, shape long"))
    whole = found.filter("shape < 0").select("doc", F.col("first").alias("start"), (-F.col("shape")).alias("end"))
    mixed = found.filter("shape > 0")
    hot = mixed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("gram", F.lit(True).alias("hot"))
    mixed = join_hot(mixed, cut_lineage(hot), "gram").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = mixed.groupBy("doc").agg(F.collect_list(F.struct("gram", "first", "shape", "hot")).alias("wanted"))
    pieces = texts.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_pieces, "gram long, doc long, first long, lead long, piece binary")
    ordered = pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(_order, "doc long, start long, end long")
    return whole.unionByName(ordered)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    named = docs.select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    texts = named.filter("doc IS NOT NULL")
    spans = repeated_spans(texts).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marked = texts.join(spans, "doc", "left").select("doc", "text", "spans")
    without = named.filter("doc IS NULL").select("doc", "text", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return marked.unionByName(without).mapInArrow(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("doc", id_column)
