"""Suffix-array dedup: bytes covered by a long string that also starts in an earlier document.

A string of ``WIDTH`` bytes is filed under its minimiser (the least hash of its runs of ``SEED`` bytes), so equal strings meet in one bucket. The
maximal piece of a text whose windows share one minimiser is a "stretch"; the windows of a stretch are strings of the collection.

1. Texts are dealt into hash groups. Each group sends the distinct minimisers it has, packed by bucket; a bucket answers, a bit each, which
   are also in another document.
2. Each group sends its distinct stretches of those minimisers, with the least document of each: copies travel once a group.
3. A bucket aligns the stretches at their minimiser and builds the order of their suffixes by columns, from the right: each round
   puts one symbol before every stretch, stably sorts the previous order by it (the Burrows-Wheeler step) and updates the common prefix of
   neighbours. Runs of neighbours with a common prefix of ``WIDTH`` or more are the occurrences of one string; its least document is their minimum.
   The columns are visited strictly in sequence and only the current order, common prefixes and symbols are held, so a bucket needs a few bytes a symbol.
4. The groups get the least documents back and mark the covered bytes.

The full construction would need one pass over all files for each byte of the longest text; alignment at the minimisers bounds the rounds at
2 * WIDTH - SEED columns for any input and changes no result.

Defined cases: null and empty texts have no bytes; a null key counts as the largest and is returned null; rows that share a key are
not copies of one another (no smaller key); texts under ``WIDTH`` bytes keep everything; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bytes as B
from tracefold.llm.common import table, whole_key

U64 = np.uint64
WIDTH, SEED = 50, 16
#: Bytes of text in a hash group, and of minimisers or stretches in a bucket, about.
GROUP_BYTES, BUCKET_BYTES = 2_000_000, 8_000_000
LAST = np.iinfo(np.int64).max


#: Windows whose minimisers are found together, so that their arrays stay in the processor's cache.
PART = 1 << 15


def minimisers(raw: np.ndarray, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``width`` bytes where its minimiser begins, and the seeds' hashes; the same for equal runs wherever they lie."""
    n, span = len(raw), width - seed + 1
    at, seeds = np.empty(n - width + 1, dtype=np.int64), np.empty(n - seed + 1, dtype=U64)
    up, down = B.powers(PART + width)
    bits = U64((PART + width).bit_length())
    for b in range(0, n - width + 1, PART):
        piece = raw[b : b + PART + width - 1]
        m = len(piece)
        with np.errstate(over="ignore"):
            sums = np.empty(m + 1, dtype=U64)
            sums[0] = 0
            np.cumsum(B._BYTE[piece] * up[:m], out=sums[1:])
            hashed = (sums[seed:] - sums[:-seed]) * down[: m - seed + 1]
            hashed ^= hashed >> U64(32)
            hashed *= U64(0xD6E8FEB86659FD93)
        low = (hashed >> bits << bits) | np.arange(len(hashed), dtype=U64)
        # least over ``span`` successive seeds, by doubling
        have = 1
        while have * 2 <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: m - width + 1], low[span - have : span - have + m - width + 1])
        at[b : b + len(low)] = (low & ((U64(1) << bits) - U64(1))).astype(np.int64) + b
        seeds[b : b + len(hashed)] = hashed
    return at, seeds


def stretches(raw: np.ndarray, offs: np.ndarray, width: int = WIDTH, seed: int = SEED):
    """Start, number of windows, minimiser hash and its offset in the stretch, in text order."""
    none = np.empty(0, np.int64)
    n = len(raw)
    if n < width:
        return none, none, np.empty(0, U64), none
    at, seeds = minimisers(raw, width, seed)
    # windows inside one text: from its start to ``width`` bytes before its end
    edge = np.zeros(n - width + 2, dtype=np.int32)
    long = np.flatnonzero(np.diff(offs) >= width)
    np.add.at(edge, offs[long], 1)
    np.add.at(edge, offs[long + 1] - width + 1, -1)
    whole = np.cumsum(edge[:-1]) > 0
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (at[1:] != at[:-1])
    new[offs[long]] = True  # texts that follow one another without a gap between their windows
    starts = np.flatnonzero(new)
    if not len(starts):
        return none, none, np.empty(0, U64), none
    last = offs[np.searchsorted(offs, starts, "right")] - width + 1
    return starts, np.minimum(np.r_[starts[1:], n], last) - starts, seeds[at[starts]], at[starts] - starts


class Group:
    """A hash group's stretches; the same at every call, whatever the order of rows."""

    def __init__(self, t: pa.Table):
        keys = t.column("key").combine_chunks().fill_null(LAST).to_numpy()
        raw, offs = B.text_bytes(t.column("text").combine_chunks())
        self.table, self.keys, self.raw, self.offs = t, keys, raw, offs
        self.start, self.windows, self.seed, self.lead = stretches(raw, offs)
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.key = keys[self.row] if len(keys) else np.empty(0, np.int64)

    def seeds(self):
        """Distinct minimisers ascending, and whether two documents of the group have them."""
        order = np.argsort(self.seed, kind="stable")
        s, k = self.seed[order], self.key[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
        if not len(first):
            return s, np.empty(0, bool)
        return s[first], np.minimum.reduceat(k, first) != np.maximum.reduceat(k, first)

    def strings(self, shared: np.ndarray):
        """Of stretches with shared minimisers: their numbers sorted by identity, the first of each distinct one, and its least key."""
        pick = np.flatnonzero(np.isin(self.seed, shared))
        ends = self.start[pick] + self.windows[pick] + WIDTH - 1
        name = B.span_hashes(self.raw, self.start[pick], ends, lower=False)
        order = np.lexsort((self.lead[pick], self.windows[pick], name, self.seed[pick]))
        pick, name = pick[order], name[order]
        if not len(pick):
            return pick, pick, pick
        new = np.r_[True, (name[1:] != name[:-1]) | (self.windows[pick][1:] != self.windows[pick][:-1]) | (self.seed[pick][1:] != self.seed[pick][:-1]) | (self.lead[pick][1:] != self.lead[pick][:-1])]
        first = np.flatnonzero(new)
        return pick, first, np.minimum.reduceat(self.key[pick], first)


def _bucket(seeds: np.ndarray, buckets: int) -> np.ndarray:
    return (B.mix(seeds ^ U64(0x1234567)) % U64(buckets)).astype(np.int64)


def _cut(order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by bucket, the buckets that occur, and where each begins (one more at the end). Work grows with the items, not with the buckets."""
    order = np.argsort(order_by, kind="stable")
    sorted_by = order_by[order]
    first = np.flatnonzero(np.r_[True, sorted_by[1:] != sorted_by[:-1]]) if len(order) else np.empty(0, np.int64)
    return order, sorted_by[first], np.r_[first, len(order)]


def _of_bucket(order: np.ndarray, names: np.ndarray, cut: np.ndarray, bucket: int) -> np.ndarray:
    i = int(np.searchsorted(names, bucket))
    return order[cut[i] : cut[i + 1]]


SENT = pa.schema([("cid", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
SENT_SQL = "cid long, bucket long, a binary, b binary, c binary, d binary"


def _sent(rows: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, SENT, strict=True)], schema=SENT)


def _pack(seeds: np.ndarray) -> bytes:
    """The upper 48 bits of each: fewer bytes to send; a chance equality only makes a string travel for nothing."""
    return seeds.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def _send_seeds(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        g = Group(t)
        seeds, many = g.seeds()
        order, names, cut = _cut(_bucket(seeds, buckets))
        cid = t.column("cid")[0].as_py()
        rows = []
        for i, b in enumerate(names.tolist()):
            o = order[cut[i] : cut[i + 1]]
            rows.append((cid, b, _pack(seeds[o]), np.packbits(many[o]).tobytes(), b"", b""))
        return _sent(rows)

    return run


def _answer_seeds(t: pa.Table) -> pa.Table:
    parts = [_unpack(x) for x in t.column("a").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=len(p)).astype(bool) for x, p in zip(t.column("b"), parts, strict=True)]
    every, where, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[where[np.concatenate(many)]] = True
    hit = shared[where]
    cut = np.cumsum([0, *map(len, parts)])
    return _sent([(c.as_py(), b.as_py(), np.packbits(hit[cut[i] : cut[i + 1]]).tobytes(), b"", b"", b"") for i, (c, b) in enumerate(zip(t.column("cid"), t.column("bucket"), strict=True))])


def _shared_seeds(g: Group, answers: pa.Table, buckets: int) -> np.ndarray:
    seeds, _ = g.seeds()
    placed = _cut(_bucket(seeds, buckets))
    kept = [np.empty(0, U64)]
    for b, a in zip(answers.column("bucket").to_pylist(), answers.column("a").to_pylist(), strict=True):
        o = _of_bucket(*placed, b)
        kept.append(seeds[o][np.unpackbits(np.frombuffer(a, dtype=np.uint8), count=len(o)).astype(bool)])
    return np.sort(np.concatenate(kept))


def _send_strings(buckets: int):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return _sent([])
        g = Group(t)
        shared = _shared_seeds(g, answers, buckets)
        pick, first, least = g.strings(shared)
        lead = pick[first]
        order, names, cut = _cut(_bucket(g.seed[lead], buckets))
        cid, rows = t.column("cid")[0].as_py(), []
        for j, b in enumerate(names.tolist()):
            o = order[cut[j] : cut[j + 1]]
            i = lead[o]
            size = g.windows[i] + WIDTH - 1
            at = np.repeat(g.start[i] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            shape = np.stack([g.windows[i], g.lead[i]], axis=1).astype(np.uint8)
            rows.append((cid, b, g.seed[i].tobytes(), least[o].tobytes(), shape.tobytes(), pa.compress(g.raw[at].tobytes(), codec="zstd", asbytes=True)))
        # the shared minimisers themselves, for step 4
        rows.append((cid, -1, shared.tobytes(), b"", b"", b""))
        return _sent(rows)

    return run


def column_order(matrix: np.ndarray, group: np.ndarray, low: np.ndarray, width: int = WIDTH):
    """For each aligned string and column, the least key of the window that starts there; ``matrix``: symbols, 0 where there is none.

    Yields (column, strings, least keys) from the right. Strings are ordered by group, then by the suffix that starts in the column.
    """
    n, columns = matrix.shape
    order = np.argsort(group, kind="stable")
    same = np.r_[False, group[order][1:] == group[order][:-1]]
    prefix = np.zeros(n, dtype=np.int16)
    place = np.empty(n, dtype=np.int64)
    base = group.astype(np.int64) * 257
    for x in range(columns - 1, -1, -1):
        symbol = matrix[:, x]
        place[order] = np.arange(n)
        key = (base + symbol)[order]
        if (key[1:] < key[:-1]).any():
            order = order[np.argsort(key, kind="stable")]
        s = symbol[order]
        here = place[order]
        equal = np.r_[False, s[1:] == s[:-1]] & same & (s > 0)
        near = np.r_[False, here[1:] == here[:-1] + 1]
        after = np.zeros(n, dtype=np.int16)
        direct = equal & near
        after[direct] = prefix[here[direct]] + 1
        far = np.flatnonzero(equal & ~near)
        if len(far):
            # neighbours that were apart before: their common prefix by comparison
            p, q = matrix[order[far], x:], matrix[order[far - 1], x:]
            differ = (p != q) | (p == 0)
            after[far] = np.where(differ.any(axis=1), differ.argmax(axis=1), columns - x)
        prefix = after
        if columns - x >= width and (prefix >= width).any():
            first = np.flatnonzero(prefix < width)
            counts = np.diff(np.r_[first, n])
            least = np.repeat(np.minimum.reduceat(low[order], first), counts)
            better = np.flatnonzero(least < low[order])
            if len(better):
                yield x, order[better], least[better]


def _answer_strings(t: pa.Table) -> pa.Table:
    seeds = [np.frombuffer(x, dtype=U64) for x in t.column("a").to_pylist()]
    count = np.array([len(s) for s in seeds])
    if t.column("bucket")[0].as_py() < 0 or not count.sum():
        return _sent([])
    seed = np.concatenate(seeds)
    low = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in t.column("b").to_pylist()])
    shape = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in t.column("c").to_pylist()]).reshape(-1, 2).astype(np.int64)
    size = shape[:, 0] + WIDTH - 1
    upto = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(count)]]
    raw = np.frombuffer(b"".join(pa.decompress(x, int(n), codec="zstd", asbytes=True) for x, n in zip(t.column("d").to_pylist(), np.diff(upto), strict=True)), dtype=np.uint8)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    # equal stretches of several groups become one
    name = B.span_hashes(raw, begin, begin + size, lower=False)
    order = np.lexsort((shape[:, 1], size, name, seed))
    differs = lambda v: v[order][1:] != v[order][:-1]
    first = np.flatnonzero(np.r_[True, differs(seed) | differs(name) | differs(size) | differs(shape[:, 1])])
    one_of = np.empty(len(order), dtype=np.int64)
    one_of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    head = order[first]
    least = np.minimum.reduceat(low[order], first)
    columns = 2 * WIDTH - SEED
    group = np.cumsum(np.r_[False, seed[head][1:] != seed[head][:-1]])
    owner = np.full((0, 3), 0, dtype=np.int64)
    found = [owner]
    step = 200_000
    edges = [0]
    while edges[-1] < len(head):  # whole minimiser groups at a time
        end = min(edges[-1] + step, len(head))
        end = int(np.searchsorted(group, group[end - 1], "right"))
        edges.append(end)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        h = head[lo:hi]
        matrix = np.zeros((hi - lo, columns), dtype=np.uint16, order="F")  # columns are read one by one
        left = WIDTH - SEED - shape[h, 1]
        at = np.repeat(np.arange(hi - lo), size[h])
        inner = np.arange(size[h].sum()) - np.repeat(np.r_[0, np.cumsum(size[h])[:-1]], size[h])
        matrix[at, left[at] + inner] = raw[begin[h][at] + inner].astype(np.uint16) + 1
        for x, strings, keys in column_order(matrix, group[lo:hi], least[lo:hi]):
            found.append(np.stack([strings + lo, x - left[strings], keys], axis=1))
    found = np.concatenate(found)
    found = found[np.argsort(found[:, 0], kind="stable")]
    cut = np.searchsorted(found[:, 0], np.arange(len(head) + 1))
    rows, row_of = [], np.repeat(np.arange(len(seeds)), count)
    local = np.arange(len(seed)) - np.repeat(np.cumsum(count) - count, count)
    cid, bucket = t.column("cid").to_pylist(), t.column("bucket").to_pylist()
    for r in range(len(seeds)):
        mine = np.flatnonzero(row_of == r) if len(seeds) < 2 else np.arange(count[:r].sum(), count[: r + 1].sum())
        one = one_of[mine]
        # the whole string's least key where it beats the group's own, then the windows' where they beat that
        better = np.flatnonzero(least[one] < low[mine])
        many = cut[one + 1] - cut[one]
        i = np.repeat(np.arange(len(mine)), many)
        f = found[np.repeat(cut[one], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        use = f[:, 2] < low[mine][i]
        number = np.concatenate([local[mine][better], local[mine][i[use]]]).astype(np.int32)
        window = np.concatenate([np.full(len(better), 255), f[use, 1]]).astype(np.uint8)
        keys = np.concatenate([least[one][better], f[use, 2]]).astype(np.int64)
        if len(number):
            rows.append((cid[r], bucket[r], number.tobytes(), window.tobytes(), keys.tobytes(), b""))
    return _sent(rows)


RESULT = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RESULT_SQL = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(buckets: int, with_text: bool):
    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return RESULT.empty_table()
        g = Group(t)
        removed = np.zeros(len(g.raw) + 1, dtype=np.int32)
        kinds = answers.column("bucket").to_pylist()
        if -1 in kinds:
            shared = np.frombuffer(answers.column("a")[kinds.index(-1)].as_py(), dtype=U64)
            pick, first, least = g.strings(shared)
            if len(pick):
                many = np.diff(np.r_[first, len(pick)])
                string = np.repeat(np.arange(len(first)), many)
                placed = _cut(_bucket(g.seed[pick[first]], buckets))
                whole = least.copy()
                parts = [np.zeros((0, 3), np.int64)]
                for b, a, w, k in zip(kinds, *(answers.column(c).to_pylist() for c in "abc"), strict=True):
                    if b < 0:
                        continue
                    number = _of_bucket(*placed, b)[np.frombuffer(a, dtype=np.int32)]
                    window, keys = np.frombuffer(w, dtype=np.uint8), np.frombuffer(k, dtype=np.int64)
                    all_of = window == 255
                    whole[number[all_of]] = keys[all_of]
                    parts.append(np.stack([number[~all_of], window[~all_of].astype(np.int64), keys[~all_of]], axis=1))
                # stretches whose every window is in a smaller document
                gone = g.key[pick] > whole[string]
                s, size = g.start[pick[gone]], g.windows[pick[gone]] + WIDTH - 1
                np.add.at(removed, s, 1)
                np.add.at(removed, s + size, -1)
                part = np.concatenate(parts)
                part = part[np.argsort(part[:, 0], kind="stable")]
                at = np.searchsorted(part[:, 0], np.arange(len(first) + 1))
                left = np.flatnonzero(~gone & (at[string + 1] > at[string]))
                per = (at[string + 1] - at[string])[left]
                row = np.repeat(left, per)
                p = part[np.repeat(at[string][left], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)]
                hit = p[:, 2] < g.key[pick[row]]
                s = g.start[pick[row[hit]]] + p[hit, 1]
                np.add.at(removed, s, 1)
                np.add.at(removed, s + WIDTH, -1)
        gone = np.cumsum(removed[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = g.offs[:-1][g.offs[:-1] < len(gone)]
        begins[edge] = gone[edge]
        total = lambda m: np.diff(np.r_[0, np.cumsum(m)][g.offs])
        n_removed, n_spans = total(gone), total(begins)
        kept, hashes = [], []
        for i in range(t.num_rows):
            lo, hi = g.offs[i], g.offs[i + 1]
            rest = (g.raw[lo:hi] if not n_removed[i] else g.raw[lo:hi][~gone[lo:hi]]).tobytes()
            hashes.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest if with_text else None)
        return pa.Table.from_arrays([t.column("key").combine_chunks(), pa.array(np.diff(g.offs)), pa.array(n_removed.astype(np.int64)), pa.array(n_spans.astype(np.int64)), pa.array(hashes), pa.array(kept, type=pa.binary())], schema=RESULT)

    return run


def remove_repeats(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row: ``key, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes, null without ``with_text``)."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    groups, buckets = int(max(64, size // GROUP_BYTES)), int(max(64, size // BUCKET_BYTES))
    key = whole_key(docs, key_col)
    # the text takes part in the hash, so that rows without a key, or with one key, are spread as well
    group = F.pmod(F.xxhash64(key, F.col(text_col)), F.lit(groups)).cast("long")
    dealt = docs.select(key.alias("key"), F.col(text_col).alias("text"), group.alias("cid"))
    by = lambda df: df.groupBy("cid")
    seeds = by(dealt).applyInArrow(_send_seeds(buckets), SENT_SQL)
    shared = seeds.groupBy("bucket").applyInArrow(_answer_seeds, SENT_SQL)
    strings = by(dealt).cogroup(by(shared)).applyInArrow(_send_strings(buckets), SENT_SQL)
    answers = strings.where("bucket >= 0").groupBy("bucket").applyInArrow(_answer_strings, SENT_SQL)
    every = answers.unionByName(strings.where("bucket < 0"))
    return by(dealt).cogroup(by(every)).applyInArrow(_apply(buckets, with_text), RESULT_SQL)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
SQL: dict[str, str] = {}
