"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of the model's pieces.

Spaces become the marker U+2581 and a text gets one in front, as the model expects; nothing else is changed, so
decoding gives the text back exactly. The best segmentation maximises the sum of the pieces' scores. A character that no
piece spells alone costs 10 less than the lowest score and comes out as its UTF-8 bytes, through the byte pieces;
so does a marker that stands in the text itself.

No piece has a marker after another character, nor a line break, so the best path of a text is made of the best paths
of its words; each is searched once and kept, up to ``CACHE`` words a process. A word longer than ``LONG`` characters
is searched every time. The trie and scores have the size of the model, not of the data, and are broadcast.

Null or empty text: no ids, decoded as empty. Ties between paths: the longer first piece. Null ids, repeated rows and
very long texts: rows like any other. Empty table: empty result. ``encode_pieces`` keeps the columns it is told to keep.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from newsloom.llm.tables import with_rows

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_COST = 10.0
CACHE = 400_000
GROUP = 8192
LONG = 64


def build_double_array(words: Sequence[bytes], values: Sequence[int]) -> tuple[array, array, array]:
    """``base``, ``check`` and ``value`` of a trie: the child of node ``t`` by byte ``c`` is ``base[t] + c``.

    A leaf has base 0; no place below 256 is given out, so no check agrees there.
    """
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, value in zip(words, values, strict=True):
        node = 0
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = value
    room = 2 * len(children) + 1024
    base, check, value = array("i", [0]) * room, array("i", [-1]) * room, array("i", [-1]) * room
    used = bytearray(room)
    used[:256] = b"\1" * 256
    gap, front = 256, 256  # first free place; where the search for a node with several children begins
    queue = [(0, 0)]  # node of the plain trie, its place
    while queue:
        node, place = queue.pop()
        value[place] = ends[node]
        codes = sorted(children[node])
        if not codes:
            continue
        if len(codes) == 1:
            while used[gap]:
                gap += 1
            start = max(gap - codes[0], 1)
            while used[start + codes[0]]:
                start += 1
        else:
            start, tries = front, 0
            while any(used[start + c] for c in codes):
                start, tries = start + 1, tries + 1
                if tries > 32:  # too crowded here
                    front += 1
        grow = start + 1024 - len(used)
        if grow > 0:
            grow += len(used) // 2
            base.extend([0] * grow)
            check.extend([-1] * grow)
            value.extend([-1] * grow)
            used.extend(bytes(grow))
        base[place] = start
        for c in codes:
            used[start + c] = 1
            check[start + c] = place
            queue.append((children[node][c], start + c))
    return base, check, value


WORDS = re.compile(f"\n|{MARKER}*[^{MARKER}\n]+|{MARKER}+")
CUT = re.compile(f"(?<=[^{MARKER}]){MARKER}")
#: Characters of a text that are split into words at a time.
SLICE = 1 << 20


@dataclass
class Pieces:
    """A model made ready for search; sent to tasks as it is, the cache stays in each process."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    gain: np.ndarray  # score of the piece that ends at a place of the trie, or minus infinity
    spelled: list[bytes]  # what an id decodes to
    byte_ids: np.ndarray
    unknown: float
    whole: bool  # pieces may cross words: search texts as one
    _kept: dict[str, bytes] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_kept": {}}

    def _paths(self, texts: list[bytes]) -> list[bytes]:
        """Ids of the best path of each text, as bytes of 32-bit integers; all texts advance together."""
        sizes = np.array([len(t) for t in texts])
        width = int(sizes.max())
        letters = np.zeros((len(texts), width + 4), dtype=np.int32)
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        letters[np.repeat(np.arange(len(texts)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        top = np.full((len(texts), width + 5), -np.inf)
        top[:, 0] = 0.0
        back, by = np.zeros((len(texts), width + 5), dtype=np.int32), np.full((len(texts), width + 5), -1, dtype=np.int32)
        lead = np.searchsorted([0x80, 0xE0, 0xF0], np.arange(256), side="right") + 1  # bytes of a character by its first
        for i in range(width):
            begun = np.flatnonzero((sizes > i) & (top[:, i] > -np.inf))
            rows, node, here = begun, np.zeros(len(begun), dtype=np.int32), top[begun, i]
            alone = np.zeros(len(texts), dtype=bool)
            for j in range(i, width):
                child = self.base[node] + letters[rows, j]
                ok = self.check[child] == node  # no piece holds the zero byte that fills up short texts
                if not ok.any():
                    break
                rows, node, here = rows[ok], child[ok], here[ok]
                score = here + self.gain[node]
                alone[rows[(score > -np.inf) & (lead[letters[rows, i]] == j + 1 - i)]] = True
                better = score > top[rows, j + 1]
                r = rows[better]
                top[r, j + 1], back[r, j + 1], by[r, j + 1] = score[better], i, self.value[node[better]]
            rows = begun[~alone[begun]]
            end = i + lead[letters[rows, i]]
            better = top[rows, i] + self.unknown > top[rows, end]
            r, end = rows[better], end[better]
            top[r, end], back[r, end], by[r, end] = top[r, i] + self.unknown, i, -1
        out = []
        for text, size, starts, ids in zip(texts, sizes.tolist(), back.tolist(), by.tolist(), strict=True):
            path = array("i")
            while size:
                if ids[size] >= 0:
                    path.append(ids[size])
                else:
                    path.extend(self.byte_ids[list(text[starts[size]:size])][::-1].tolist())
                size = starts[size]
            path.reverse()
            out.append(path.tobytes())
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Best paths of words, searched in groups of like length."""
        by_length = sorted((w.encode(), w) for w in words)
        by_length.sort(key=lambda x: len(x[0]))
        found, at = {}, 0
        while at < len(by_length):
            longest = min(len(by_length) - 1, at + GROUP - 1)
            while longest > at and (len(by_length[longest][0]) + 8) * (longest - at) > GROUP * 64:
                longest = at + (longest - at) // 2
            part = by_length[at:longest + 1]
            found.update(zip((w for _, w in part), self._paths([t for t, _ in part]), strict=True))
            at = longest + 1
        return found

    def _words(self, text: str) -> Iterator[list[str] | None]:
        """The words of a text a slice at a time; None for a marker that the text itself holds."""
        for k, part in enumerate(text.split(MARKER)):
            if k:
                yield None
            marked = (MARKER if k == 0 else "") + part.replace(" ", MARKER)
            if self.whole:
                yield [marked] if marked else []
                continue
            start = 0
            while start < len(marked):
                cut = CUT.search(marked, start + SLICE)
                end = cut.start() if cut else len(marked)
                yield WORDS.findall(marked, start, end)
                start = end

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text. Words not met before are searched together, a slice of the text at a time."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        out, kept = [], self._kept
        literal = self.byte_ids[list(MARKER.encode())].tobytes()
        for words in self._words(text):
            if words is None:
                out.append(literal)
                continue
            new = {w for w in words if w not in kept}
            found = self.learn(new) if new else {}
            kept.update((w, ids) for w, ids in found.items() if len(w) <= LONG)
            out += [kept[w] if w in kept else found[w] for w in words]
            if len(kept) > CACHE:
                kept.clear()
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of several texts; words that are new to this process are searched together."""
        if len(self._kept) > CACHE // 2:
            self._kept.clear()
        short = [t for t in texts if t and len(t) <= SLICE]
        new = {w for t in short for words in self._words(t) if words for w in words if w not in self._kept and len(w) <= LONG}
        self._kept.update(self.learn(new))
        return [self.encode(t) for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode()
        return text[1:] if len(ids) else text


def load_pieces(path: str | None = None) -> Pieces:
    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
    byte_ids, spelled, words, values, scores = [-1] * 256, [], [], [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            spelled.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            spelled.append(piece.replace(MARKER, " ").encode())
            words.append(piece)
            values.append(i)
            scores.append(model.get_score(i))
    base, check, value = (np.array(x, dtype=np.int32) for x in build_double_array([w.encode() for w in words], values))
    gain = np.full(len(value), -np.inf)
    by_id = dict(zip(values, scores, strict=True))
    ends = np.flatnonzero(value >= 0)
    gain[ends] = [by_id[v] for v in value[ends].tolist()]
    crossing = any("\n" in w or MARKER in w.lstrip(MARKER) for w in words)
    return Pieces(base, check, value, gain, spelled, np.array(byte_ids, dtype=np.int32), min(scores) - UNKNOWN_COST, crossing)


def batches_of(texts: list[str | None], chars: int = SLICE) -> Iterator[list[str | None]]:
    """Consecutive texts, together at most ``chars`` characters unless one alone is longer."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text or "") > chars:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def encode_pieces(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_column: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep``, then ``ids array<int>``. A kept column of that name gets an underscore at its end."""
    names = _renamed(keep, ("ids",))
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in with_rows(batches):
            at = 0
            for texts in batches_of(batch.column(width).to_pylist()):
                found = pieces.encode_many(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns[:width], ids], names=[*names, "ids"])
                at += len(texts)

    schema = ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))
    return docs.select(*[docs[c] for c in keep], docs[text_column]).mapInArrow(run, f"{schema}, ids array<int>")


def _renamed(names: Sequence[str], own: Sequence[str]) -> list[str]:
    """``names`` with as many underscores at the end of those among ``own`` as it takes to be new."""
    taken, out = {*names, *own}, []
    for name in names:
        if name in own:
            while name in taken:
                name += "_"
            taken.add(name)
        out.append(name)
    return out


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text that ``ids`` spell, and ``n_byte_pieces``, the number of byte pieces among them.

    Columns that have one of these names already get an underscore at their end.
    """
    encoded = encoded.toDF(*_renamed(encoded.columns, ("decoded", "n_byte_pieces")))
    shared = encoded.sparkSession.sparkContext.broadcast(load_pieces(path))
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        is_byte = np.zeros(len(pieces.spelled), dtype=bool)
        is_byte[pieces.byte_ids] = True
        for batch in with_rows(batches):
            ids = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([pieces.decode(x) for x in ids], pa.string()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64())],
                names=[*batch.schema.names, "decoded", "n_byte_pieces"])

    schema = StructType(list(encoded.schema.fields)).add("decoded", StringType()).add("n_byte_pieces", LongType())
    return encoded.mapInArrow(run, schema)
