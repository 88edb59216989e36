"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs, triples, pairs with one or two words between, and the first bytes of words
(which the forms of one word share), hashed to a fixed number of coordinates. Learning rates are per coordinate and an L1 term keeps weights at exactly zero unless evidence adds up,
so the model is a short list of coordinates that is broadcast to score every whole text without a shuffle.

The fit takes a bounded sample of labelled rows (``MAX_LABELLED``, those with the least hash of their id, and of those as
many as have ``MAX_COORDINATES`` features together, the first at least). Their features are found in many tasks; one
task, which holds at most 4 bytes a feature, learns from them. Scoring reads everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravox.llm.words import ALNUM, Words, beginnings, chunks, give_back, gram_hash, ragged, words
from terravox.plans.storage import bound_batches, cut, discard

#: Labelled rows that a model is fitted on, at most.
MAX_LABELLED = 16_384
#: Features of all rows that a model is fitted on, at most (the first row's are always taken).
MAX_COORDINATES = 64_000_000
#: Coordinates: 2 ** BITS, the last of which is the bias.
BITS = 20
#: Offsets of the words in a feature.
SHAPES = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))
#: Bytes of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6, 8)


class Settings(NamedTuple):
    alpha: float = 1.0  #: rate
    beta: float = 1.0  #: how slowly a coordinate's rate falls
    l1: float = 5.0
    l2: float = 0.1
    epochs: int = 4


def features(data: np.ndarray, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind the coordinates of its features in a chunk, and the index of each one's first word."""
    for seed, shape in enumerate(SHAPES, 1):
        at = ragged(w.first[:-1], np.maximum(np.diff(w.first) - shape[-1], 0))
        yield _coordinates(gram_hash([w.hashes[at + k] for k in shape], seed)), at
    for h, at in beginnings(data, w, ALNUM, BEGINNINGS):
        yield _coordinates(h), at


def _coordinates(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(64 - BITS)) % np.uint64((1 << BITS) - 1)).astype(np.int32)


def text_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct coordinates of each text, the bias among them."""
    for lo, hi, data, off in chunks(texts):
        w = words(data, off, ALNUM)
        found = list(features(data, w))
        bounds = [np.searchsorted(at, w.first) for _, at in found]
        for i in range(hi - lo):
            yield np.append(np.unique(np.concatenate([x[b[i] : b[i + 1]] for (x, _), b in zip(found, bounds, strict=True)])), (1 << BITS) - 1)


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, settings: Settings = Settings()) -> np.ndarray:
    """Weights by coordinate, learned from rows of active coordinates in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    a, b, l1, l2, epochs = settings

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((b + np.sqrt(ni)) / a + l2))

    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            zi, ni = z[x], n[x]
            wi = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35))) - y
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / a * wi
            n[x] = ni + g * g
    return weights(z, n)


def _found(texts: pa.Array) -> pa.Array:
    """The coordinates of each text as bytes."""
    out = pa.array([x.astype(np.int32).tobytes() for x in text_features(texts)], pa.binary())
    give_back()
    return out


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels = [], []
    for batch in batches:
        rows += [np.frombuffer(x, np.int32) for x in batch.column("found").to_pylist()]
        labels += batch.column("label").to_pylist()
    if rows:
        w = fit_ftrl(rows, np.array(labels, float))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(w[kept])], ["coordinate", "weight"])
        if not len(kept):  # nothing was learned: a weight of zero still says that rows were there
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0.0])], ["coordinate", "weight"])
    rows.clear()
    give_back()


def fit(labelled: DataFrame, max_rows: int = MAX_LABELLED, max_coordinates: int = MAX_COORDINATES) -> tuple[np.ndarray, np.ndarray] | None:
    """(coordinates, weights) learned from rows (doc_id, text, label 0 or 1), at most ``max_rows`` of them with at most
    ``max_coordinates`` features, in the order of a hash of the id; None without any row that has a label and an id."""
    some = labelled.where("label is not null and doc_id is not null").select("text", "label", F.xxhash64("doc_id").alias("o"), "doc_id")
    some = some.orderBy("o", "doc_id", "label", "text").limit(max_rows)
    tasks = max(1, max_rows // 512)
    found = F.arrow_udf(_found, "binary").asNondeterministic()
    rows = cut(some.repartition(tasks, "o").select("o", "doc_id", "label", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("t"), found(F.coalesce("text", F.lit(""))).alias("found")))
    # At most max_rows lengths: one task adds them up.
    order = Window.orderBy("o", "doc_id", "label", "t")
    sizes = rows.select("o", "doc_id", "label", "t", (F.octet_length("found") / 4).alias("n"))
    used = sizes.withColumn("nth", F.row_number().over(order)).withColumn("sum", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("sum") <= max_coordinates) | (F.col("nth") == 1))
    last = used.agg(F.max(F.struct("o", "doc_id", "label", "t")).alias("last")).first()["last"]
    if last is None:
        return None
    key = F.struct("o", "doc_id", "label", "t")
    taken = rows.where(key <= F.struct(*[F.lit(last[c]).cast(rows.schema[c].dataType).alias(c) for c in ("o", "doc_id", "label", "t")]))
    got = taken.repartition(1).sortWithinPartitions("o", "doc_id", "label", "t").select("found", "label").mapInArrow(_fit_task, "coordinate int, weight double").toPandas()
    discard(rows)
    return got.coordinate.to_numpy(), got.weight.to_numpy()


def scores(texts: pa.Array, coordinates: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each text: every distinct feature counts once."""
    dense = np.zeros(1 << BITS)
    dense[coordinates] = weights
    out = []
    for lo, hi, data, off in chunks(texts):
        w = words(data, off, ALNUM)
        found = []
        for x, at in features(data, w):
            active = np.flatnonzero(dense[x])
            found.append(((np.searchsorted(w.first, at[active], "right") - 1) << BITS) | x[active])
        distinct = np.unique(np.concatenate(found))
        total = np.bincount(distinct >> BITS, dense[distinct & ((1 << BITS) - 1)], minlength=hi - lo)
        out.append(1 / (1 + np.exp(-np.clip(total + dense[-1], -35, 35))))
    give_back()
    return np.concatenate(out) if out else np.zeros(0)


def held_out(id_column: str = "doc_id"):
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string")) % 5 == 0, F.lit(True))


def with_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", fit_on: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Labels are learned from the rows of ``fit_on`` (``docs`` unless given) that are labelled and not held out; a row with
    several labels counts as the largest, rows without a label, and ids without a row, are not learned from. Null and
    empty texts have only the bias; texts of any length are scored whole; repeated rows are scored alike, and of those
    that carry a label each is learned from. Without any labelled row nothing is known and every score is 0. Ids are of
    any one type. Columns of the added names are replaced, all others stay; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    learn = labels.where(F.col(label_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(f"`{id_column}`").alias("doc_id")).agg(F.max(label_column).alias("label"))
    learn = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * MAX_LABELLED)  # ids without a text leave gaps
    texts = (docs if fit_on is None else fit_on).select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    model = fit(texts.join(F.broadcast(learn), "doc_id"))
    if model is None:
        score = F.lit(0.0)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)
        score = F.arrow_udf(lambda t: pa.array(scores(t, *sent.value)), "double")(F.col(f"`{text_column}`").cast("string"))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    scored = docs.withColumn("score", score)
    return scored.select(*own, held_out(id_column).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
