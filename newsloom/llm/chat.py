"""Chat formatting at token level.

A turn becomes ``[TURN] role [TEXT] text [END]``. Role and text are encoded on their own with a byte-level BPE, so no
token crosses a border, and the three markers are ids beyond the vocabulary, spliced in between: no text can spell
them. Control strings that occur in a role or text are escaped reversibly: a backslash goes after their first
character, one more if there are some already. The loss mask is the prefix sum of +1 where an assistant text starts
and -1 where it ends.

A conversation comes out as pieces of at most ``PIECE`` tokens (a single longer turn makes a longer piece), numbered
from 0, so a conversation of any length streams through a task that sees its turns in order and holds one piece.
Encoding, the heavy part, runs before the turns are dealt by conversation.

Null text or role: empty. Null turn: before the others; equal turns: by role, then digest of the text. Rows that repeat are turns
of their own. Null conversation id: one conversation of its own. Empty table: no pieces. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tables import with_rows

VOCABULARY = "byte_bpe_50k.tiktoken"
#: What a text must never be able to spell. Each starts with < or [ and holds neither again.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
MARKERS = ("<|turn|>", "<|text|>", "<|end|>")
PIECE = 1 << 16
_ESCAPE = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROL))
_UNESCAPE = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, int]:
    """The tokenizer of a ranks file and its first free id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def assemble(segments: list[tuple[list[int], list[int], bool]], first_free: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of turns given as (role ids, text ids, learned): markers spliced in, mask by prefix sum."""
    turn, text, end = range(first_free, first_free + len(MARKERS))
    ids, marks = [], {}
    for role, body, learned in segments:
        ids += [turn, *role, text]
        if learned:
            marks[len(ids)] = marks.get(len(ids), 0) + 1
        ids += body
        if learned:
            marks[len(ids)] = marks.get(len(ids), 0) - 1
        ids.append(end)
    steps = np.zeros(len(ids) + 1, dtype=np.int8)
    for at, step in marks.items():
        steps[at] += step
    return np.array(ids, dtype=np.int32), np.cumsum(steps[:-1]).astype(bool)


def format_chats(turns: DataFrame, learned_role: str = "assistant", path: str | None = None, piece: int = PIECE) -> DataFrame:
    """``(conv_id, piece, ids array<int>, loss array<boolean>)``."""
    file = path or public_tokenizers.path(VOCABULARY)
    ints = pa.list_(pa.int32())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _ = encoder(file)
        for batch in with_rows(batches):
            roles, texts = ([escape(x or "") for x in batch.column(k).to_pylist()] for k in (2, 3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(map(tokens.encode_ordinary, roles), ints),
                 pa.array(map(tokens.encode_ordinary, texts), ints), batch.column(4)],
                names=["conv_id", "nth", "role", "role_ids", "text_ids", "text_order"])

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first_free = encoder(file)

        def out(conv, number, held):
            ids, loss = assemble(held, first_free)
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([number], pa.int64()), pa.array([ids], ints), pa.array([loss], pa.list_(pa.bool_()))],
                names=["conv_id", "piece", "ids", "loss"])

        conv, number, held, size = None, 0, [], 0
        for batch in with_rows(batches):
            for row in batch.select(["conv_id", "role", "role_ids", "text_ids"]).to_pylist():
                long = len(row["role_ids"]) + len(row["text_ids"]) + len(MARKERS)
                if held and (row["conv_id"] != conv or size + long > piece):
                    yield out(conv, number, held)
                    number, held, size = number + 1 if row["conv_id"] == conv else 0, [], 0
                elif not held:
                    number = 0
                conv, size = row["conv_id"], size + long
                held.append((row["role_ids"], row["text_ids"], row["role"] == learned_role))
        if held:
            yield out(conv, number, held)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("nth"), "role", "text", F.sha2("text", 256).alias("text_order"))
    encoded = rows.mapInArrow(encode, "conv_id long, nth long, role string, role_ids array<int>, text_ids array<int>, text_order string")
    return (encoded.repartition("conv_id").sortWithinPartitions("conv_id", "nth", "role", "text_order")
            .mapInArrow(splice, "conv_id long, piece long, ids array<int>, loss array<boolean>"))


def _turns(ids: np.ndarray, loss: np.ndarray, tokens: tiktoken.Encoding, first_free: int) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the mask) of a piece, all still escaped."""
    turn, text, end = range(first_free, first_free + len(MARKERS))
    for a, b, c in zip(np.flatnonzero(ids == turn), np.flatnonzero(ids == text), np.flatnonzero(ids == end), strict=True):
        body = ids[b + 1:c]
        yield tokens.decode(ids[a + 1:b].tolist()), tokens.decode(body.tolist()), tokens.decode(body[loss[b + 1:c]].tolist())


def read_back(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """Per conversation, decoded from the tokens: turns and their digest, text under the mask, length as text."""
    file = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, first_free = encoder(file)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        done, state = [], None

        def flush() -> Iterable[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], pa.schema(
                    [(n, pa.string() if n.endswith("256") else pa.int64()) for n in names]))
                done.clear()

        def close():
            conv, n, all_turns, chars, learned, total = state
            done.append((conv, n, all_turns.hexdigest(), chars, learned.hexdigest(), total))

        for batch in with_rows(batches):
            for conv, ids, loss in zip(*(batch.column(n) for n in ("conv_id", "ids", "loss")), strict=True):
                conv = conv.as_py()
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, under in _turns(ids.values.to_numpy(), np.array(loss.as_py(), dtype=bool), tokens, first_free):
                    plain, learned = unescape(text), unescape(under)
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{plain}\n".encode())
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                    state[5] += len(role) + len(text) + sum(map(len, MARKERS))
            yield from flush()
        if state is not None:
            close()
        yield from flush()

    ordered = pieces.select("conv_id", "piece", "ids", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
