"""LM scoring with a hidden Markov language model over word classes.

Counting: each task counts its training words and the counts are summed by word over all documents. The number of classes grows with the number
of distinct words (``class_counts``): half of them belong to the most frequent words, one each, all other words fall into the rest by their hash. A class
emits its words in proportion to count + 0.5, with one unit of 0.5 for unknown words, so probabilities of all texts still sum to one at most.

Training: Baum-Welch over all training tokens. The starting point comes from all of them too: the most frequent words ("anchors") are clustered by
which other anchors they share pieces with. Every round, each task runs scaled forward-backward recursions over its documents' pieces
(``PIECE`` tokens, which bounds memory) and emits expected counts, which Spark sums by class; the driver holds the model only. A piece is read with ``MARGIN``
tokens of its neighbours on both sides, whose states are weighed in but not counted, so transitions across pieces are counted once, like all others.
Emissions are shrunk towards the class frequencies by as many tokens as predict left-out tokens best, so small corpora don't overfit. Rounds end when the
likelihood settles.

Scoring: the scaled forward recursion over the whole text, exact. Words outside the ``KNOWN`` most frequent ones (a broadcast of
bounded size) get their counts by a join on the word, summed by document first.

Defined cases: null and empty text is the single token "end"; without training documents all counts are 0 and the classes are
uniform; a null key trains; repeated rows are scored each; keys must be whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bytes as B
from tracefold.llm.common import most_frequent, stored, table, whole_key

U64 = np.uint64
STATES = 8
#: Words with a class of their own, as a power of two: one for so many distinct words, at least and at most (the model has twice as many classes).
WORDS_PER_CLASS, OWN_BITS = 64, (13, 16)
#: Words whose counts are broadcast (16 bytes each); the rest are joined.
KNOWN = 1 << 18
PIECE, MARGIN = 128, 16
#: Baum-Welch rounds at most, and the relative gain of likelihood below which they end.
ROUNDS, SETTLED = 8, 1e-3
#: Frequent words that are clustered for the starting point.
ANCHORS = 256
#: Weights of the class frequencies in a state's emissions that are tried, in tokens.
PRIORS = tuple(float(250 * 2**i) for i in range(14))
#: The end of a text, as a word.
END = int(B.mix(np.array([0xE4D0], dtype=U64))[0])
BLOCK_TOKENS = 2_000_000
#: Training tokens of a task, about, where there are more tasks than twice the cores: each task sends a row a class and round.
TASK_TOKENS = 20_000_000


def held_out(key: Column) -> Column:
    """Whether crc32(key as text) mod 5 is 1."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 1, F.lit(False))


def class_counts(types: int) -> tuple[int, int]:
    """Own and shared classes for so many distinct words; with the end's class a power of two."""
    bits = min(max((types // WORDS_PER_CLASS).bit_length(), OWN_BITS[0]), OWN_BITS[1])
    return (1 << bits) - 1, 1 << bits


def _tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each row's words, and the rows' bounds."""
    starts, ends, bounds = B.word_spans(raw, offs)
    out = np.full(len(starts) + len(offs) - 1, U64(END), dtype=U64)
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    out[np.arange(len(starts)) + rows] = B.span_hashes(raw, starts, ends)
    return out, bounds + np.arange(len(offs))


def _count():
    schema = pa.schema([("w", pa.int64()), ("n", pa.int64())])

    def run(batches):
        held: list[np.ndarray] = []
        many = 0

        def flush():
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for i in range(0, len(words), 1 << 17):
                yield B.record(schema, words[i : i + (1 << 17)].view(np.int64), counts[i : i + (1 << 17)])

        for _, raw, offs in B.chunks(batches, "text"):
            held.append(_tokens(raw, offs)[0])
            many += len(held[-1])
            if many > 2 * BLOCK_TOKENS:
                yield from flush()
                many = 0
        if held:
            yield from flush()

    return run


class Vocabulary:
    """The ``KNOWN`` most frequent words, sorted by hash: counts and classes. Classes: 0 end, then own words, then shared ones."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, own: np.ndarray, log_mass: np.ndarray):
        self.words, self.counts, self.own, self.log_mass = words, counts, own, log_mass
        self.first_shared = len(log_mass) // 2

    @staticmethod
    def arrays(words: np.ndarray, counts: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, ...]:
        """What a broadcast carries."""
        rank = np.lexsort((words, -counts))
        words, counts = words[rank], counts[rank]
        ids = np.arange(1, len(words) + 1)
        ids[ids >= len(mass) // 2] = 0
        order = np.argsort(words)
        return words[order], counts[order], ids[order].astype(np.int32), np.log10(np.maximum(mass, 1e-300))

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, count, and whether the word is here."""
        cls = (self.first_shared + (words % U64(len(self.log_mass) - self.first_shared)).astype(np.int64)).astype(np.int32)
        if not len(self.words):
            return np.where(words == U64(END), 0, cls), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        here = self.words[at] == words
        own = np.where(here, self.own[at], 0)
        cls = np.where(own > 0, own, cls)
        cls[words == U64(END)] = 0
        return cls, np.where(here, self.counts[at], 0), here


ENCODED = "kind int, rid long, key long, held boolean, n_tokens long, n_known long, base double, inner double, ids binary, w long, tf long"


def _encode(vocabulary):
    """Kind 0: a row a document with its class numbers; kind 1: its words outside the vocabulary with their frequency in it."""
    schema = pa.schema([("kind", pa.int32()), ("rid", pa.int64()), ("key", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("inner", pa.float64()), ("ids", pa.binary()), ("w", pa.int64()), ("tf", pa.int64())])

    def run(batches):
        v = Vocabulary(*vocabulary.value)
        for rows, raw, offs in B.chunks(batches, "text"):
            words, bounds = _tokens(raw, offs)
            n, n_rows = np.diff(bounds), rows.num_rows
            cls, counts, here = v.look_up(words)
            # logarithms of count + 0.5, and of the class masses that shared classes divide by
            log = np.where(here | (words == U64(END)), np.log10(counts + 0.5), 0.0)
            shared = cls >= v.first_shared
            inner = np.where(shared, log - v.log_mass[cls], 0.0)
            total = lambda x: np.add.reduceat(x, bounds[:-1])
            ids = cls.astype("<u4").tobytes()
            blobs = pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer((4 * bounds).astype(np.int32).tobytes()), pa.py_buffer(ids)])
            rid = rows.column(rows.schema.get_field_index("rid"))
            none = lambda t, k: pa.nulls(k, t)
            yield B.record(schema, np.zeros(n_rows, np.int32), rid, rows.column(rows.schema.get_field_index("key")), rows.column(rows.schema.get_field_index("held")), n, total((counts > 0).astype(np.int64)), total(log), total(inner), blobs, none(pa.int64(), n_rows), none(pa.int64(), n_rows))
            far = np.flatnonzero(~here & (words != U64(END)))
            if len(far):
                doc = np.repeat(np.arange(n_rows), n)[far]
                order = np.lexsort((words[far], doc))
                d, w = doc[order], words[far][order]
                first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])])
                k = len(first)
                yield B.record(schema, np.ones(k, np.int32), rid.to_numpy()[d[first]], none(pa.int64(), k), none(pa.bool_(), k), none(pa.int64(), k), none(pa.int64(), k), none(pa.float64(), k), none(pa.float64(), k), none(pa.binary(), k), w[first].view(np.int64), np.diff(np.r_[first, len(d)]))

    return run


class Model:
    """start[2, K] (of a text, of a later piece), step[K, K], emit[C, K]."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.start, self.step, self.emit


def _classes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = B.text_bytes(batch.column(batch.schema.get_field_index("ids")))
    return raw.view("<u4"), offs // 4


def _blocks(batches: Iterator[pa.RecordBatch]):
    for rows, raw, offs in B.chunks(batches, "ids", 1 << 21):
        yield rows, np.ascontiguousarray(raw).view("<u4"), offs // 4


def pieces(offs: np.ndarray, width: int = PIECE, margin: int = MARGIN) -> tuple[np.ndarray, ...]:
    """Pieces with their margins, longest first: where they begin, their length, the offset and end of what they count, and whether they begin a text (0) or not (1)."""
    n = np.diff(offs)
    per = -(-n // width)
    row = np.repeat(np.arange(len(n)), per)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offs[:-1][row] + k * width
    stop = np.minimum(start + width, offs[1:][row])
    begin, end = np.maximum(start - margin, offs[:-1][row]), np.minimum(stop + margin, offs[1:][row])
    order = np.argsort(begin - end, kind="stable")
    return tuple(x[order] for x in (begin, end - begin, start - begin, stop - begin, (k > 0).astype(np.int64)))


def expect(model: Model, ids: np.ndarray, offs: np.ndarray, block: int = 4096):
    """Expected start, step and emission counts of the texts' tokens, and their log-likelihood."""
    k, classes = model.step.shape[0], len(model.emit)
    emit, step = model.emit.astype(np.float32), model.step.astype(np.float32)
    starts, steps, emits, total = np.zeros((2, k)), np.zeros((k, k)), np.zeros((classes, k)), 0.0
    begin, length, inner, outer, kind = pieces(offs)
    for i in range(0, len(begin), block):
        b, n, lo, hi, s = (x[i : i + block] for x in (begin, length, inner, outer, kind))
        most = int(n[0])
        live = np.searchsorted(-n, -np.arange(1, most + 1), "right")
        alpha, scale, seen = [], [], []
        for t in range(most):
            m = live[t]
            c = ids[b[:m] + t]
            a = (model.start[s[:m]].astype(np.float32) if t == 0 else alpha[-1][:m] @ step) * emit[c]
            z = np.maximum(a.sum(axis=1), np.float32(1e-30))
            a /= z[:, None]
            alpha.append(a), scale.append(z), seen.append(c)
            total += float(np.log(z[(lo[:m] <= t) & (t < hi[:m])].astype(np.float64)).sum())
        beta = np.ones((live[-1], k), dtype=np.float32)
        gammas, counted = [None] * most, []
        for t in range(most - 1, -1, -1):
            mine = (lo[: live[t]] <= t) & (t < hi[: live[t]])
            g = alpha[t] * beta
            g /= np.maximum(g.sum(axis=1, keepdims=True), np.float32(1e-30))
            gammas[t] = g
            counted.append(mine)
            if t:
                onward = beta * emit[seen[t]] / scale[t][:, None]
                before = alpha[t - 1][: len(onward)]
                steps += (before[mine].T @ onward[mine]).astype(np.float64) * model.step
                beta = np.ones((live[t - 1], k), dtype=np.float32)
                beta[: len(onward)] = onward @ step.T
        for j in (0, 1):
            starts[j] += gammas[0][s == j].sum(axis=0)
        mine = np.concatenate(counted[::-1])
        flat, c = np.concatenate(gammas)[mine], np.concatenate(seen)[mine]
        for j in range(k):
            emits[:, j] += np.bincount(c, weights=flat[:, j], minlength=classes)
    return starts, steps, emits, total


def _expectation(model, k: int):
    """Rows (what, at, K sums): what 0 emissions by class, 1 steps, 2 starts, 3 log-likelihood. Sums of one task fit in 32 bits."""
    schema = pa.schema([("what", pa.int32()), ("at", pa.int32()), *((f"s{j}", pa.float32()) for j in range(k))])

    def run(batches):
        sums = None
        for _, ids, offs in _blocks(batches):
            new = expect(Model(*model.value), ids, offs)
            sums = new if sums is None else tuple(a + b for a, b in zip(sums, new, strict=True))
        if sums is None:
            return
        starts, steps, emits, total = sums
        at = np.flatnonzero(emits.sum(axis=1))
        values = np.concatenate([emits[at], steps, starts, np.eye(1, k) * total])
        what = np.repeat([0, 1, 2, 3], [len(at), k, 2, 1])
        where = np.concatenate([at, np.arange(k), np.arange(2), [0]])
        yield B.record(schema, what.astype(np.int32), where.astype(np.int32), *values.T.astype(np.float32))

    return run


def shrinkage(mass: np.ndarray, emits: np.ndarray) -> float:
    """The weight of the class frequencies by which tokens that are left out, one at a time, are predicted best."""
    fits, total = np.zeros(len(PRIORS)), mass.sum()
    for column in emits.T:  # state by state, to hold little
        at = np.flatnonzero(column)
        n, others = column[at], np.maximum(mass[at] - 1, 0.5) / total
        left, size = np.maximum(n - 1, 0), max(column.sum() - 1, 0.0)
        fits += [(n * np.log((left + w * others) / (size + w))).sum() for w in PRIORS]
    return PRIORS[int(np.argmax(fits))]


def maximise(mass: np.ndarray, starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, prior: float | None = None) -> Model:
    unit = mass / mass.sum()
    weight = shrinkage(mass, emits) if prior is None else prior
    emit = (emits + weight * unit[:, None]) / (emits.sum(axis=0) + weight)
    step = (steps + 1.0) / (steps.sum(axis=1, keepdims=True) + steps.shape[1])
    start = (starts + 1.0) / (starts.sum(axis=1, keepdims=True) + starts.shape[1])
    return Model(start, step, emit)


def meetings(ids: np.ndarray, offs: np.ndarray, block: int = 4096) -> np.ndarray:
    """How often each pair of anchors (classes 1 to ``ANCHORS``) shares a piece."""
    out = np.zeros((ANCHORS, ANCHORS))
    begin, length, *_ = pieces(offs, margin=0)
    for i in range(0, len(begin), block):
        b, n = begin[i : i + block], length[i : i + block]
        rows = np.repeat(np.arange(len(b)), n)
        c = ids[np.arange(len(rows)) + np.repeat(b - (np.cumsum(n) - n), n)].astype(np.int64)
        use = (c > 0) & (c <= ANCHORS)
        x = np.zeros((len(b), ANCHORS), dtype=np.float32)
        np.add.at(x, (rows[use], c[use] - 1), np.float32(1))
        out += x.T @ np.minimum(x, 1)
    return out


def _meetings():
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.float64())])

    def run(batches):
        sums = np.zeros((ANCHORS, ANCHORS))
        for _, ids, offs in _blocks(batches):
            sums += meetings(ids, offs)
        a, b = np.nonzero(sums)
        if len(a):
            yield B.record(schema, a.astype(np.int32), b.astype(np.int32), sums[a, b])

    return run


def seed_model(mass: np.ndarray, met: np.ndarray, k: int, rounds: int = 20) -> Model:
    """From clusters of the anchors: far apart ones first, then by the other anchors that they meet; each state prefers its cluster's words and rather stays."""
    unit, weight = mass / mass.sum(), met.sum(axis=1)
    used = np.flatnonzero(weight > 0)
    counts = np.tile(unit[:, None], (1, k)) * 1000.0
    if len(used) >= k:
        common = weight[used] / weight.sum()
        x = met[used][:, used] + 5 * common
        x = np.sqrt(x / x.sum(axis=1, keepdims=True))
        heads = [int(np.argmax(weight[used]))]
        while len(heads) < k:
            near = (x @ x[heads].T).max(axis=1)
            heads.append(int(np.argmax((1 - near) * np.sqrt(weight[used]))))
        centres = x[heads]
        for _ in range(rounds):
            of = (x @ centres.T).argmax(axis=1)
            for j in range(k):
                if (of == j).any():
                    mean = (x[of == j] * weight[used][of == j][:, None]).sum(axis=0)
                    centres[j] = mean / np.linalg.norm(mean)
        for j in range(k):
            counts[used[of == j] + 1, j] *= 20.0
    return maximise(mass, np.ones((2, k)), np.eye(k) * 90.0 * k, counts, prior=50.0)


def forward(model: Model, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The log10-likelihood of each text, exact: all texts step together, longest first."""
    n = np.diff(offs)
    order = np.argsort(-n, kind="stable")
    begin, n = offs[:-1][order], n[order]
    live = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), "right") if len(n) else []
    out = np.zeros(len(n))
    a = None
    for t, m in enumerate(live):
        a = (np.broadcast_to(model.start[0], (m, model.step.shape[0])) if t == 0 else a[:m] @ model.step) * model.emit[ids[begin[:m] + t]]
        z = a.sum(axis=1)
        a = a / z[:, None]
        out[:m] += np.log10(z)
    back = np.empty(len(n))
    back[order] = out
    return back


def _score(model):
    schema = pa.schema([("rid", pa.int64()), ("key", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("inner", pa.float64())])
    names = schema.names

    def run(batches):
        held, many = [], 0

        def flush():
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            ids, offs = _classes(t.to_batches()[0])
            got = t.column("inner").to_numpy() + forward(Model(*model.value), ids, offs)
            yield B.record(schema, *(t.column(c).combine_chunks() for c in names[:-1]), got)

        for rows, ids, _ in _blocks(batches):
            held.append(pa.table({c: rows.column(rows.schema.get_field_index(c)) for c in [*names, "ids"]}))
            many += len(ids)
            if many > BLOCK_TOKENS:
                yield from flush()
                many = 0
        if held:
            yield from flush()

    return run


def lm_scores(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Per row: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``; the model learns from rows not held out."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), whole_key(docs, key_col).alias("key"), held_out(F.col(key_col)).alias("held"), F.col(text_col).alias("text"))
    counts = stored(rows.where("not held").select("text").mapInArrow(_count(), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-counts")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end_key = np.array([END], dtype=U64).view(np.int64)[0].item()
    top = most_frequent(counts.where(F.col("w") != end_key), KNOWN).toPandas()
    ends = counts.where(F.col("w") == end_key).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words, n = top["w"].to_numpy(dtype=np.int64).view(U64), top["n"].to_numpy(dtype=np.int64)
    # mass of a class: its counts and half a token for each type, shared classes with one unknown type
    own_classes, shared_classes = class_counts(types)
    classes = 1 + own_classes + shared_classes
    mass = np.full(classes, 0.5)
    mass[0] += ends
    own = np.lexsort((words, -n))[:own_classes]
    mass[1 : len(own) + 1] += n[own]
    half = F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))
    unsigned = F.pmod(F.col("w"), F.lit(shared_classes))  # a power of two divides 2^64
    shared = counts.where(F.col("w") != end_key).groupBy(unsigned.alias("m")).agg(half.alias("s")).select("m", "s.*").toPandas()
    at = 1 + own_classes + shared["m"].to_numpy(dtype=np.int64)
    mass[at] += shared["n"].to_numpy(dtype=np.int64) + 0.5 * shared["k"].to_numpy(dtype=np.int64)
    np.subtract.at(mass, 1 + own_classes + (words[own] % U64(shared_classes)).astype(np.int64), n[own] + 0.5)
    # the end is looked up apart; its count enters the base score below
    known = sc.broadcast(Vocabulary.arrays(words, n, mass))
    encoded = stored(rows.mapInArrow(_encode(known), ENCODED), "lm-tokens")
    texts = encoded.where("kind = 0")
    train = texts.where("not held").select("ids").coalesce(max(2 * sc.defaultParallelism, -(-int(tokens) // TASK_TOKENS)))
    met = np.zeros((ANCHORS, ANCHORS))
    pairs = train.mapInArrow(_meetings(), "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).toPandas()  # ANCHORS squared at most
    met[pairs["a"].to_numpy(dtype=np.int64), pairs["b"].to_numpy(dtype=np.int64)] = pairs["n"].to_numpy(dtype=float)
    model, before = seed_model(mass, met, states), None
    for _ in range(rounds if tokens else 0):
        shown = sc.broadcast(model.arrays())
        sums = train.mapInArrow(_expectation(shown, states), "what int, at int, " + ", ".join(f"s{j} float" for j in range(states)))
        got = sums.groupBy("what", "at").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(states))).toPandas()  # a row a class
        parts = []
        for what, size in ((2, 2), (1, states), (0, classes)):
            part = np.zeros((size, states))
            mine = got[got["what"] == what]
            part[mine["at"].to_numpy(dtype=np.int64)] = mine[[f"s{j}" for j in range(states)]].to_numpy()
            parts.append(part)
        shown.unpersist()
        model = maximise(mass, *parts)
        reached = float(got.loc[got["what"] == 3, "s0"].sum())
        if before is not None and reached - before < SETTLED * abs(before):
            break
        before = reached
    scored = texts.select("rid", "key", "held", "n_tokens", "n_known", "base", "inner", "ids").mapInArrow(_score(sc.broadcast(model.arrays())), "rid long, key long, held boolean, n_tokens long, n_known long, base double, inner double")
    rare = encoded.where("kind = 1").select("rid", "w", "tf").join(counts, "w", "left").groupBy("rid").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("found"))
    logs = F.coalesce("logs", F.lit(0.0))
    log_all = float(np.log10(tokens + 0.5 * (types + 1)))
    # the end's logarithm was taken with count 0 in the encoding
    end = float(np.log10(ends + 0.5) - np.log10(0.5))
    return scored.join(rare, "rid", "left").select(
        "key", F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + logs + end - F.col("n_tokens") * log_all).alias("base_score"), (F.col("inner") + logs).alias("score"))


def op2_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base scores of ``op2_hmm_lm``, which have SQL."""
    out = lm_scores(table(spark, sf_dir, "documents"), rounds=0).withColumnRenamed("key", "doc_id")
    return out.select("doc_id", "n_tokens", "n_known", "held_out", "train_tokens", F.round("base_score", 5).alias("base_score"))


def _held_out_sql() -> str:
    """Whether crc32 of the key's text mod 5 is 1: the usual bytewise form with the table made from its polynomial."""
    return """crc AS (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc),
h AS (SELECT doc_id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
 lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 5 = 1 AS held_out FROM (SELECT DISTINCT doc_id FROM documents), tab)"""


QUERIES = {"op2_hmm_lm": op2_hmm_lm, "lm_base": lm_base}
SQL = {
    "lm_base": "WITH " + _held_out_sql() + r""",
d AS (SELECT doc_id, held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') || [' '] AS w FROM documents JOIN h USING (doc_id)),
t AS (SELECT doc_id, held_out, unnest(w) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
a AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST((SELECT n FROM a) AS BIGINT) AS train_tokens,
 round(sum(log10((coalesce(c, 0) + 0.5) / ((SELECT n FROM a) + 0.5 * ((SELECT v FROM a) + 1)))), 5) AS base_score
FROM t LEFT JOIN c USING (w) GROUP BY 1, 2
""",
}
