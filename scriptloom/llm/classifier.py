"""Quality classifier with supervised subword embeddings.

Words and the character n-grams inside them hash to rows of a table of learned vectors; a
document is their average, and a softmax layer turns that into class probabilities. Both are
trained by stochastic gradient descent in numpy, in one task, on a bounded sample of labelled
rows. As the average is linear, scoring needs one number for each row of the table: what its
vector adds to the log odds. Scoring runs over whole texts, in the tasks that read them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptloom.llm.common import remove, stored
from scriptloom.llm.words import chunks, mixed, span_hashes, text_bytes, word_spans

#: Rows of the table of vectors, their length, and the lengths of character n-grams.
BUCKETS = 1 << 18
WIDTH = 8
GRAMS = (3, 4, 5)
#: Bytes of text whose features a task holds at a time.
FEATURE_BYTES = 1 << 20
#: Hash of the feature that stands for any word said twice running.
REPEAT = np.uint64(0x5DEECE66D1B5A3F7)
#: At most so many labelled rows of each class are trained on, taken by a hash of their id.
SAMPLE_PER_CLASS = 1500
EPOCHS = 8
RATE = 0.5
THRESHOLD = 0.7


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with remainder 2 are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1))


def features(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of the words and n-grams of each text, end to end, and the row each belongs to."""
    raw, at = text_bytes(column)
    starts, ends, row = word_spans(raw, at)
    words = span_hashes(raw, starts, ends, False)
    found, owner = [words], [row]
    # A word that repeats the one before it is a feature of its own, whatever the word.
    again = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1])) + 1
    found.append(np.full(len(again), REPEAT, np.uint64))
    owner.append(row[again])
    # Code points, with a blank before every text and after the last, as edges of words. One
    # before a text counts as its own, so that n-grams do not depend on the neighbours.
    joined = np.insert(raw, at, 0x20)
    points = np.frombuffer(joined.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    limits = lead[at[:-1]] + np.arange(len(at) - 1)
    blank = (points == 0x20) | ((points >= 9) & (points <= 13))
    code = mixed(np.where(blank, 0x20, points).astype(np.uint64))
    inner = np.concatenate([[0], np.cumsum(blank)])
    for n in GRAMS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        grams = np.zeros(m, np.uint64)
        for k in range(n):
            grams = grams * np.uint64(0x100000001B3) + code[k : k + m]
        place = np.flatnonzero(inner[n - 1 : n - 1 + m] == inner[1 : 1 + m])
        found.append(mixed(grams[place]))
        owner.append(np.searchsorted(limits, place, "right") - 1)
    index = (np.concatenate(found) & np.uint64(buckets - 1)).astype(np.int32)
    return index, np.concatenate(owner)


def feature_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """(label, index, times): the distinct features of each (label, text) row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", FEATURE_BYTES):
            index, owner = features(batch.column("text"), buckets)
            key, times = np.unique(owner.astype(np.int64) * buckets + index, return_counts=True)
            cut = np.searchsorted(key, np.arange(batch.num_rows + 1, dtype=np.int64) * buckets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    pa.array([(key[a:b] % buckets).astype("<i4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                    pa.array([times[a:b].astype("<i4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                ],
                ["label", "index", "times"],
            )

    return docs.select("label", "text").mapInArrow(extract, "label int, index binary, times binary")


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, seed: int = 42) -> np.ndarray:
    """What each table row adds to the log odds of label 1; the last number is the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (buckets, WIDTH)).astype(np.float32)
    out = np.zeros((2, WIDTH), np.float32)
    bias = np.zeros(2, np.float32)
    rows = [(y, i, t / t.sum()) for y, i, t in rows if len(i)]
    total, step = EPOCHS * max(len(rows), 1), 0
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)).tolist():
            label, index, share = rows[r]
            rate = RATE * (1 - step / total)
            step += 1
            hidden = share @ vectors[index]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * p
            # The mean share of a feature is tiny: as usual for averaged vectors, each gets the whole step.
            vectors[index] -= (rate * np.minimum(share * len(share), 4.0))[:, None] * back[None, :]
    return np.append(vectors @ (out[1] - out[0]), bias[1] - bias[0]).astype(np.float32)


def train(labelled: DataFrame, buckets: int = BUCKETS, per_class: int = SAMPLE_PER_CLASS, seed: int = 42) -> bytes | None:
    """A model from rows (doc_id, text, label 0 or 1), or None where there is none of a class.

    At most `per_class` rows of each label are used, those with the smallest hashes.
    """
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    sample = None
    for label in (0, 1):
        part = labelled.where(F.col("label") == label).orderBy(*order).limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    path = None
    try:
        kept, path = stored(feature_rows(sample, buckets), "classifier-sample")

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = []
            for batch in batches:
                for label, index, times in zip(*[c.to_pylist() for c in batch.columns]):
                    rows.append((label, np.frombuffer(index, "<i4"), np.frombuffer(times, "<i4").astype(np.float32)))
            rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
            if len({r[0] for r in rows}) == 2:
                data = io.BytesIO()
                np.save(data, fit(rows, buckets, seed))
                yield pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], ["model"])

        model = kept.coalesce(1).mapInArrow(one, "model binary").first()
    finally:
        if path:
            remove(labelled.sparkSession, path)
    return bytes(model["model"]) if model else None


def score(docs: DataFrame, model: bytes | None, buckets: int = BUCKETS) -> DataFrame:
    """The rows with `score`, the probability of label 1; 0.5 without a model.

    A null or empty text has no features and gets what the bias alone says.
    """
    names = [c for c in docs.columns if c != "score"]
    schema = docs.select(*names).withColumn("score", F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.load(io.BytesIO(sent.value)) if sent.value else np.zeros(buckets + 1, np.float32)
        for batch in chunks(batches, "text", FEATURE_BYTES):
            index, owner = features(batch.column("text"), buckets)
            sums = np.bincount(owner, weights[index], batch.num_rows)
            counts = np.bincount(owner, minlength=batch.num_rows)
            odds = sums / np.maximum(counts, 1) + float(weights[-1])
            values = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(values, pa.float64())], [*names, "score"]
            )

    return docs.select(*names).mapInArrow(rate, schema)


def quality_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (doc_id, text, label): labelled 0 or 1 and not held out.

    The few ids of the sample are chosen before any text is read: `labels` is cut to
    `SAMPLE_PER_CLASS` rows of each label, by a hash of the id.
    """
    rows = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(remainder(F.col("doc_id")) != 2)
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    chosen = None
    for label in (0, 1):
        part = rows.where(F.col("label") == label).orderBy(F.xxhash64(F.lit(42), "doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * SAMPLE_PER_CLASS narrow rows.
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")


def rate_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with held_out, score and predicted (1 from THRESHOLD on).

    Labels other than 0 and 1, contradicting ones and those of null ids are not used.
    Repeated rows are scored each; an empty table stays empty; other columns are carried.
    """
    model = train(quality_labels(docs, labels))
    return score(docs, model).withColumns(
        {
            "held_out": remainder(F.col("doc_id")) == 2,
            "predicted": F.when(F.col("score") >= THRESHOLD, 1).otherwise(0),
        }
    )
