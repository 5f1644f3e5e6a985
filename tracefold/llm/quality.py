"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 for toxic, 1 for low quality, 2 for good. One weight vector over hashed words is shared by ordered
thresholds: P(grade <= k) = sigmoid(threshold_k - w . x). The regression is fitted to at most ``MAX_LABELLED`` labelled documents (those with the
least hash of their key), by proximal gradient steps with L1, so that words without evidence weigh nothing. Scoring
reads whole texts of all documents and gives the expected grade and the tail probability P(grade >= 2), by which documents are kept.

Features of a text, each counted once: its lower-case words, its runs of symbols, and binned shares (symbols, word length,
distinct words). Defined cases: null and empty text have only the binned features; labels that are null, or of unknown documents, are ignored;
of several labels the worst counts; without labels of at least two grades everything is kept; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bytes as B
from tracefold.llm.common import table

U64 = np.uint64
BITS = 18
SIZE = 1 << BITS
GRADES = 3
MAX_LABELLED = 16_000
EPOCHS, BATCH, RATE, SPARSITY = 12, 128, 0.15, 2e-4
#: Steps that small samples get at least, by more epochs.
STEPS = 800
MIN_DOCS = 4

_WORDY = np.zeros(256, dtype=bool)
_WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = ~_WORDY & ~_SPACE


def _spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offs] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    return starts, ends


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct feature numbers, and the rows' bounds."""
    rows = len(offs) - 1
    n = np.maximum(np.diff(offs), 1)
    if len(raw):
        ws, we = _spans(_WORDY[raw], offs)
        ss, se = _spans(_SYMBOL[raw], offs)
        keys = np.concatenate([B.span_hashes(raw, ws, we), B.span_hashes(raw, ss, se) ^ U64(0x51)])
        owner = np.searchsorted(offs, np.concatenate([ws, ss]), "right") - 1
        words = np.bincount(owner[: len(ws)], minlength=rows)
        letters = np.bincount(owner[: len(ws)], weights=we - ws, minlength=rows)
        symbols = np.bincount(owner[len(ws) :], weights=se - ss, minlength=rows)
    else:
        keys, owner = np.empty(0, U64), np.empty(0, np.int64)
        words = letters = symbols = np.zeros(rows)
    codes = owner * SIZE + (keys & U64(SIZE - 1)).astype(np.int64)
    codes = np.unique(codes)
    distinct = np.diff(np.searchsorted(codes, np.arange(rows + 1) * SIZE))
    binned = [np.minimum(symbols / n * 40, 15), np.minimum(letters / np.maximum(words, 1), 15), np.minimum(distinct / np.maximum(words, 1) * 10, 15), np.minimum(np.log2(words + 1), 15)]
    extra = [np.arange(rows) * SIZE + (B.mix(np.full(rows, 7919 * (i + 1), U64) + x.astype(np.int64).astype(U64)) & U64(SIZE - 1)).astype(np.int64) for i, x in enumerate(binned)]
    codes = np.unique(np.concatenate([codes, *extra]))
    return (codes % SIZE).astype(np.int32), np.searchsorted(codes, np.arange(rows + 1) * SIZE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """What a broadcast carries."""
        return self.weights, self.thresholds

    def tails(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ..; one row a text."""
        sums = np.diff(np.r_[0.0, np.cumsum(self.weights[ids])][bounds])
        return _sigmoid(sums[:, None] - self.thresholds[None, :])


def fit(ids: np.ndarray, bounds: np.ndarray, grade: np.ndarray, seed: int = 11) -> Model:
    """Cumulative logits by Adagrad with L1; features of fewer than ``MIN_DOCS`` texts weigh nothing."""
    share = np.array([(grade >= k).mean() if len(grade) else 0.5 for k in range(1, GRADES)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    weights = np.zeros(SIZE)
    if len(np.unique(grade)) < 2:
        return Model(weights, np.full(GRADES - 1, -35.0))
    usable = np.bincount(ids, minlength=SIZE) >= MIN_DOCS
    seen, cut_seen = np.full(SIZE, 1e-2), np.full(GRADES - 1, 1e-2)
    rng = np.random.default_rng(seed)
    batch = int(np.clip(len(grade) // 16, 16, BATCH))
    for _ in range(max(EPOCHS, min(100, STEPS * batch // len(grade)))):
        order = rng.permutation(len(grade))
        for lo in range(0, len(order), batch):
            docs = order[lo : lo + batch]
            sizes = bounds[docs + 1] - bounds[docs]
            at = np.repeat(bounds[docs] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            f = ids[at]
            z = np.add.reduceat(weights[f], np.r_[0, np.cumsum(sizes)[:-1]])
            upper = np.concatenate([np.ones((len(docs), 1)), _sigmoid(z[:, None] - cuts), np.zeros((len(docs), 1))], axis=1)
            slope = upper * (1 - upper)
            y = grade[docs]
            row = np.arange(len(docs))
            p = np.maximum(upper[row, y] - upper[row, y + 1], 1e-9)
            dz = -(slope[row, y] - slope[row, y + 1]) / p
            dcut = np.zeros(GRADES + 1)
            np.add.at(dcut, y, slope[row, y] / p)
            np.add.at(dcut, y + 1, -slope[row, y + 1] / p)
            g = np.bincount(f, weights=np.repeat(dz, sizes), minlength=SIZE) / len(docs)
            g[~usable] = 0
            seen += g * g
            step = RATE / np.sqrt(seen)
            weights -= step * g
            weights = np.sign(weights) * np.maximum(np.abs(weights) - step * SPARSITY * (g != 0), 0)
            d = dcut[1:GRADES] / len(docs)
            cut_seen += d * d
            cuts = np.maximum.accumulate(cuts - RATE / np.sqrt(cut_seen) * d + 1e-9 * np.arange(GRADES - 1))
    return Model(weights, cuts)


def _extract():
    schema = pa.schema([("grade", pa.int32()), ("ids", pa.binary())])

    def run(batches):
        for rows, raw, offs in B.chunks(batches, "text"):
            ids, bounds = features(raw, offs)
            yield B.record(schema, rows.column(rows.schema.get_field_index("grade")), pa.array([ids[bounds[i] : bounds[i + 1]].tobytes() for i in range(rows.num_rows)], pa.binary()))

    return run


def _score(model):
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.float64())])

    def run(batches):
        for rows, raw, offs in B.chunks(batches, "text"):
            tails = Model(*model.value).tails(*features(raw, offs))
            yield B.record(schema, rows.column(rows.schema.get_field_index("key")), rows.column(rows.schema.get_field_index("h")), tails.sum(axis=1), tails[:, -1])

    return run


def train(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = labels.select(F.col("doc_id").alias("key"), grade.alias("grade")).where(F.col("grade").isNotNull() & F.col("key").isNotNull()).groupBy("key").agg(F.min("grade").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("key"), "key").limit(max_labelled)
    rows = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key").select("grade", "text")
    # a document's features are a fraction of its text; at most max_labelled rows, ordered so that reruns fit alike, are fitted in one task
    sample = rows.mapInArrow(_extract(), "grade int, ids binary").orderBy(F.xxhash64("ids", "grade")).limit(max_labelled)
    fitted = sample.mapInArrow(_fitted, "weights binary, thresholds binary").collect()
    if not fitted:
        return fit(np.empty(0, np.int32), np.zeros(1, np.int64), np.empty(0, np.int64))
    return Model(*(np.frombuffer(x, dtype=np.float64) for x in fitted[0]))


def _fitted(batches):
    """The model of all rows of the task, as bytes."""
    grades, ids = [np.empty(0, np.int64)], []
    for batch in batches:
        names = batch.schema.get_field_index
        grades.append(batch.column(names("grade")).to_numpy(zero_copy_only=False).astype(np.int64))
        ids += [np.frombuffer(x, dtype=np.int32) for x in batch.column(names("ids")).to_pylist()]
    model = fit(np.concatenate(ids) if ids else np.empty(0, np.int32), np.cumsum([0, *map(len, ids)]), np.concatenate(grades))
    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (model.weights, model.thresholds)], names=["weights", "thresholds"])


def classify(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row: ``key, h`` (hash of the text), ``expected_grade, tail, keep``."""
    model = train(docs, labels, key_col, text_col, max_labelled)
    shown = docs.sparkSession.sparkContext.broadcast(model.arrays())
    rows = docs.select(F.col(key_col).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(shown), "key long, h long, expected_grade double, tail double").withColumn("keep", F.col("tail") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected documents, columns unchanged."""
    model = train(docs, labels, key_col, text_col)
    shown = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def run(batches):
        for batch in batches:
            kept = [np.empty(0, bool)]
            for _, raw, offs in B.chunks([batch], text_col):
                kept.append(Model(*shown.value).tails(*features(raw, offs))[:, -1] >= 0.5)
            yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("key").alias("doc_id"), F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail_probability"), "keep")


QUERIES = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
