"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels.

Features of a sentence are its different words and their first 4, 5 and 6 letters. One with a feature of the
vocabulary scores ``p = sigmoid(bias + sum of the weights of its features)``; one without scores 0. A document scores ``1 - (1 - leak) * prod(1 - p)``; the leak takes up labels that no
sentence explains. Only whole documents carry labels, the gradient of their log loss reaches the sentences through
the product. Offending sentences are those that score ``OFFENDING`` or more.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those first in the order of a hash of their id; their
ids are broadcast, which that bound allows; an id that several documents share stands for one of them. The vocabulary is
all features that stand in toxic documents significantly more often than in others, and ``LEAST_RATIO`` times as often: a
bound on the effect, as in a large sample mere length makes common words significant. What reaches the driver is the sample's vocabulary features per
sentence, folded into counted patterns. Scoring is one pass over whole texts without a shuffle.

Null or empty text: the leak. Null id: scored, never held out. Labels: a null label is left out, several labels of
one id count as the largest, a label without a document is ignored. Without labels of both kinds the score is the
share of toxic labels (0 without any). Repeated rows score alike. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.tables import lower_in_place, type_of, with_rows
from newsloom.plans.lineage import cut_lineage

SAMPLE = 20_000
LEAST_Z = 4.0
LEAST_RATIO = 3.0
LEAST_DOCS = 4
OFFENDING = 0.5
THRESHOLD = 0.7
ROUNDS = 600
STEMS = (4, 5, 6)
DECAY = 0.05
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    leak: float

    @cached_property
    def starts(self) -> frozenset[str]:
        """First letters that a word needs to have any feature of the model."""
        return frozenset(f[:STEMS[0]] for f in self.weights)


def features(words: list[str]) -> set[str]:
    """The different words, and their longer stems marked with a star."""
    different = set(words)
    return different | {w[:k] + "*" for w in different for k in STEMS if len(w) > k}


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, rows: int) -> DataFrame:
    """``(id, text, toxic)`` of the sampled labels, written out: the sample is bounded, the corpus is read once for it."""
    given = labels.select(F.col(id_column).alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out(F.col("id")))
    first = given.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # one text per id, whatever the number of documents that share it: copies in a task are one row before they leave it
    return cut_lineage(texts.join(F.broadcast(first), "id").groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in with_rows(batches):
        seen: Counter = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.update((w, toxic) for w in features(WORD.findall(lower_in_place(text))))
        if seen:
            words, toxic = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(toxic, pa.int32()), pa.array(seen.values(), pa.int64())], names=["word", "toxic", "n"])


def _vocabulary(sample: DataFrame, toxic: int, clean: int) -> list[str]:
    """Words with a higher document rate among toxic documents, by the z value of the difference of the two rates."""
    counts = sample.select("text", "toxic").mapInArrow(_count_words, "word string, toxic int, n long")
    by_word = counts.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n"))
    rate = F.col("n") / (toxic + clean)
    z = (F.col("t") / toxic - (F.col("n") - F.col("t")) / clean) / F.sqrt(rate * (1 - rate) * (1 / toxic + 1 / clean))
    best = by_word.filter((F.col("t") >= LEAST_DOCS) & (F.col("n") < toxic + clean)).withColumn("z", z).filter(
        (F.col("z") >= LEAST_Z) & (F.col("t") / toxic >= LEAST_RATIO * (F.col("n") - F.col("t")) / clean))
    return [r["word"] for r in best.orderBy(F.desc("z"), "word").select("word").collect()]


def _patterns(sample: DataFrame, vocabulary: list[str]) -> pa.Table:
    """Per document its label and its sentences as counted sets of vocabulary words, as plain columns: no object per word."""
    place = {w: k for k, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_rows(batches):
            found = []
            for text in batch.column(0).to_pylist():
                low, seen = lower_in_place(text), Counter()
                for m in SENTENCE.finditer(low):
                    if hits := {place[w] for w in features(WORD.findall(m[0])) if w in place}:
                        seen[tuple(sorted(hits))] += 1
                found.append([{"words": k, "n": n} for k, n in seen.items()])
            kind = pa.list_(pa.struct([("words", pa.list_(pa.int32())), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, kind)], names=["toxic", "sentences"])

    return sample.select("text", "toxic", "id").orderBy("id").select("text", "toxic").mapInArrow(
        run, "toxic int, sentences array<struct<words:array<int>,n:bigint>>").toArrow()


def fit_noisy_or(rows: pa.Table, words: int, rounds: int = ROUNDS, decay: float = DECAY) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak by Adam on the mean log loss of the documents."""
    label = rows["toxic"].to_numpy().astype(float)
    sentences = pa.concat_arrays(rows["sentences"].chunks)
    each = sentences.flatten()  # one entry per sentence
    doc = np.repeat(np.arange(len(rows)), sentences.value_lengths().to_numpy(zero_copy_only=False))
    times = each.field("n").to_numpy(zero_copy_only=False)
    member = np.repeat(np.arange(len(doc)), each.field("words").value_lengths().to_numpy(zero_copy_only=False))
    word = each.field("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    state = np.concatenate([np.ones(words), [-2.0, -4.0]])  # weights, bias, logit of the leak
    first, second = np.zeros_like(state), np.zeros_like(state)
    for turn in range(1, rounds + 1):
        z = np.bincount(member, state[word], len(doc)) + state[-2]
        leak = 1 / (1 + math.exp(-state[-1]))
        load = np.bincount(doc, times * np.logaddexp(0, z), len(rows))
        miss = np.clip((1 - leak) * np.exp(-load), 1e-12, 1 - 1e-12)  # the chance that nothing offends
        by_load = ((1 - label) - label * miss / (1 - miss)) / len(rows)
        by_z = by_load[doc] * times / (1 + np.exp(-z))
        slope = np.concatenate([np.bincount(word, by_z[member], words) + decay / len(rows) * state[:-2], [by_z.sum(), by_load.sum() * leak]])
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        state = state - 0.05 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-9)
    return state[:-2], float(state[-2]), 1 / (1 + math.exp(-state[-1]))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE) -> Model:
    sample = _sample(docs, labels, id_column, text_column, sample_rows)
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = kinds.get(1, 0), kinds.get(0, 0)
    if not toxic or not clean:
        return Model({}, 0.0, float(toxic > 0))
    vocabulary = _vocabulary(sample, toxic, clean)
    if not vocabulary:
        return Model({}, 0.0, toxic / (toxic + clean))
    weights, bias, leak = fit_noisy_or(_patterns(sample, vocabulary), len(vocabulary))
    return Model(dict(zip(vocabulary, map(float, weights), strict=True)), bias, leak)


def score_text(model: Model, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """Score of a text, and (start, end, score) of its offending sentences."""
    low, known, starts = lower_in_place(text or ""), model.weights, model.starts
    if not any(w[:STEMS[0]] in starts for w in WORD.findall(low)):
        return model.leak, []
    miss, found = 1 - model.leak, []
    for m in SENTENCE.finditer(low):
        if hits := {f for f in features([w for w in WORD.findall(m[0]) if w[:STEMS[0]] in starts]) if f in known}:
            z = model.bias + sum(known[w] for w in sorted(hits))
            p = 1 / (1 + math.exp(-z)) if z > -700 else 0.0
            miss *= 1 - p
            if p >= OFFENDING:
                found.append((m.start(), m.end(), p))
    return 1 - miss, found


def score_documents(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, score, offending array<struct<start, end, score>>)`` for every row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_rows(batches):
            scores, spans = [], []
            for text in batch.column(1):
                score, found = score_text(model, text.as_py())
                scores.append(score)
                spans.append([{"start": a, "end": b, "score": p} for a, b, p in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=[id_column, "score", "offending"])

    schema = f"`{id_column}` {type_of(docs, id_column)}, score double, offending array<struct<start:bigint,end:bigint,score:double>>"
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more, all columns kept; one pass, no join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in with_rows(batches):
            at = batch.schema.get_field_index(text_column)
            yield batch.filter(pa.array([score_text(model, t.as_py())[0] < threshold for t in batch.column(at)]))

    return docs.mapInArrow(run, docs.schema)
