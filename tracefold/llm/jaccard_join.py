"""N-gram Jaccard join: which documents' shingle sets are alike, and the components that the links form.

Equal sets fall together by their hash. Of the other sets each emits only the prefix of its shingles (rare ones first) that any
partner must share one of, so every link has a common posting list. The order is the same for all sets: shingles that many
documents share come last, then those of frequent words. Posting lists are cut into size-banded tiles: sizes of one band lie
within the threshold's factor of one another, and a tile holds a band and the next one, so any two sets that can link share a tile.

1. Leaders: in each (list, band) the set of highest degree leads; a set is tested against the leader that it shares most lists
   with. That merges groups of near copies without pairing their members with each other.
2. Tiles: of each tile the sets outside its largest component ("probes") meet all others of different components. Tiles of more
   than ``TILE_ROWS`` rows are cut into blocks, and block pairs are rows of their own, so no task holds more than two blocks.
   Hashed parity bitmaps bound the overlap from above; of what passes, the nearest sets of each component go on first.
3. Tiles that had more to give are tested once more in full, with the components merged so far.

What passes is intersected exactly as sorted arrays, and the links become components. Links inside a component change nothing, so
only those are left out. Sets, shingles and words are known by 64-bit hashes: among n different sets some n * n / 2^65 pairs fall
together wrongly (one in 37 for 10^9 documents).

Defined cases: null and empty texts have an empty set and are linked with nothing; documents of fewer words than a shingle have
one shingle; repeated rows link; a null key is kept as a row of its own; keys must be whole numbers (text keys are refused); no
rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bytes as B
from tracefold.llm.common import most_frequent, stored, table, whole_key
from tracefold.llm.components import components

WIDTH = 4
#: A link has PARTS_OF * intersection >= THRESHOLD * union.
THRESHOLD, PARTS_OF = 85, 100
#: Shingles that so many different sets of one piece of a task share are counted as common.
LOCAL_COMMON = 3
#: Common shingles and frequent words that are broadcast for the order (16 bytes each; any order gives all links).
MAX_COMMON, MAX_WORDS = 200_000, 1 << 17
#: A parity bitmap has this many bits for each member of the set, rounded up to a power of two.
BITS_PER_MEMBER = 1
#: Sets of each other component that a probe goes on with in the first round.
NEAREST = 2
#: Rows of a block of a tile, and pairs that are looked at together.
TILE_ROWS, TOGETHER = 512, 1 << 20
#: Rows of a list of common shingles, and pairs of one set, that one task takes at most, about.
SPREAD = 512
#: Longs of the broadcast bitmap of wanted sets, at least and at most.
WANTED_LONGS = (1 << 10, 1 << 20)
#: Bits of a shingle's place in the order: commonness, then the frequency of its words.
COMMON_BITS, WORD_BITS = 5, 11

U64 = np.uint64


def _sets(batches: Iterator[pa.RecordBatch], width: int, weigh=None):
    """Chunks of rows with their sets; ``weigh`` gives each word's share of the last column (its length otherwise)."""
    for rows, raw, offs in B.chunks(batches, "text"):
        starts, ends, bounds = B.word_spans(raw, offs)
        hashes = B.span_hashes(raw, starts, ends)
        values, cuts, weight = B.word_shingles(hashes, bounds, width, weigh(hashes) if weigh else ends - starts)
        # the set's identity: an order-free sum of scrambled members, together with its size
        with np.errstate(over="ignore"):
            sums = np.concatenate([[U64(0)], np.cumsum(B.mix(values ^ U64(0xA5A5A5A55A5A5A5A)))])
            sizes = np.diff(cuts)
            sid = B.mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ B.mix(sizes.astype(U64)))
        yield rows, hashes, values, cuts, sizes, sid.view(np.int64), weight


def _unseen(seen: set[int], sid: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which rows are the first of this task with their (filled) set."""
    new = np.zeros(len(sid), dtype=bool)
    for i, (s, n) in enumerate(zip(sid.tolist(), sizes.tolist(), strict=True)):
        if n and s not in seen:
            seen.add(s)
            new[i] = True
    return new


def bitmap_longs(size: int) -> int:
    return max(2, 1 << max(0, (BITS_PER_MEMBER * size - 1).bit_length() - 6))


def parity_bits(values: np.ndarray, size: int) -> np.ndarray:
    """The parity bitmap as longs; more bits for larger sets, always a power of two."""
    longs = bitmap_longs(size)
    at = B.mix(values ^ U64(0x5851F42D4C957F2D))
    odd = np.bincount((at & U64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def fold(bits: np.ndarray, longs: int) -> np.ndarray:
    """The bitmap that ``longs`` longs would have given."""
    while bits.shape[-1] > longs:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


PROFILE = "kind int, key long, sid long, size long, n long, bits binary"


def _profile(width: int):
    """Kind 0: a row a document (with the bitmap where its set is new here); 1: common shingles; 2: words; with their counts."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("sid", pa.int64()), ("size", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def counted(kind: int, parts: list[np.ndarray], least: int):
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        values, counts = values[counts >= least], counts[counts >= least]
        parts.clear()
        for i in range(0, len(values), 1 << 17):
            v, c = values[i : i + (1 << 17)], counts[i : i + (1 << 17)]
            zero = np.zeros(len(v), np.int64)
            yield B.record(schema, np.full(len(v), kind, np.int32), zero, v.view(np.int64), zero, c, pa.nulls(len(v), pa.binary()))

    def run(batches):
        seen: set[int] = set()
        shingles: list[np.ndarray] = []
        words: list[np.ndarray] = []
        held = 0
        for rows, hashes, values, cuts, sizes, sid, _ in _sets(batches, width):
            new = _unseen(seen, sid, sizes)
            bits = [parity_bits(values[cuts[i] : cuts[i + 1]], int(sizes[i])).tobytes() if new[i] else None for i in range(len(sid))]
            zero = np.zeros(len(sid), np.int64)
            yield B.record(schema, zero.astype(np.int32), rows.column(0), sid, sizes, zero, pa.array(bits, pa.binary()))
            shingles.append(values[np.repeat(new, sizes)])
            words.append(hashes)
            held += len(shingles[-1]) + len(hashes)
            if held > 8_000_000:
                yield from counted(1, shingles, LOCAL_COMMON)
                yield from counted(2, words, 2)
                held = 0
        if held:
            yield from counted(1, shingles, LOCAL_COMMON)
            yield from counted(2, words, 2)

    return run


class Order:
    """Places of shingles: commonness (logarithm of the count), then the sum of its words' logarithms of frequency."""

    def __init__(self, shingles: np.ndarray, times: np.ndarray, words: np.ndarray, counts: np.ndarray, width: int):
        self.shingles, self.times, self.words, self.counts = shingles, times, words, counts
        self.most = (1 << WORD_BITS) // width - 1

    @staticmethod
    def arrays(shingles: DataFrame, words: DataFrame) -> tuple[np.ndarray, ...]:
        """What a broadcast carries: hashes sorted, and logarithms of counts."""
        out = []
        for counts, scale in ((shingles, 1), (words, 8)):
            got = counts.toPandas()  # MAX_COMMON and MAX_WORDS rows at most
            keys = got["sid"].to_numpy(dtype=np.int64).view(U64)
            order = np.argsort(keys)
            logs = np.floor(np.log2(got["n"].to_numpy(dtype=float) + 1) * scale).astype(np.int64)
            out += [keys[order], logs[order]]
        return tuple(out)

    @staticmethod
    def _of(keys: np.ndarray, logs: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(values), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        return np.where(keys[at] == values, logs[at], 0)

    def weigh(self, words: np.ndarray) -> np.ndarray:
        return np.minimum(self._of(self.words, self.counts, words), self.most)

    def common(self, values: np.ndarray) -> np.ndarray:
        return np.minimum(self._of(self.shingles, self.times, values), (1 << COMMON_BITS) - 1)


def _postings(width: int, threshold: int, shown):
    """The prefix of each set; ``salt`` spreads the lists of common shingles, which are shared for certain, and is 0 for others."""
    schema = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("sid", pa.int64()), ("size", pa.int32())])

    def run(batches):
        order = Order(*shown.value, width)
        seen: set[int] = set()
        for _, _, values, cuts, sizes, sid, weight in _sets(batches, width, order.weigh):
            times = order.common(values)
            owner = np.repeat(np.arange(len(sid)), sizes)
            placed = B.order_within(owner, values, len(sid), (times << WORD_BITS) + weight, COMMON_BITS + WORD_BITS)
            # the position of each shingle in its document's order
            place = np.arange(len(values)) - np.repeat(cuts[:-1], sizes)
            need = sizes - -(-threshold * sizes // PARTS_OF) + 1
            take = (place < need[owner]) & _unseen(seen, sid, sizes)[owner]
            mine, at = owner[take], placed[take]
            salt = np.where(times[at] > 0, 1 + (B.mix(sid[mine].view(U64)) % U64(1 << 12)).astype(np.int64), 0)
            yield B.record(schema, values[at].view(np.int64), salt.astype(np.int32), sid[mine], sizes[mine].astype(np.int32))

    return run


def _shared():
    """Of rows sorted by token, salt and set: each (token, set) once, if the token is a common one or another set has it too."""
    schema = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("size", pa.int32())])
    names = ["token", "salt", "sid", "size"]

    def run(batches):
        # the last row waits for the next one; ``met`` says whether its token was met with another set before
        last, met = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names]
            if last is not None:
                cols = [np.r_[a, b] for a, b in zip(last, cols, strict=True)]
            token, salt, sid, size = cols
            same = token[1:] == token[:-1]
            fresh = np.r_[True, ~same | (sid[1:] != sid[:-1])]
            ends = np.flatnonzero(np.r_[fresh[1:], False])  # the last rows of their (token, set), without the batch's last row
            before = np.r_[False, same & (sid[1:] != sid[:-1])]
            before[0] = met
            # copies of a row carry on what its first one knows
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(token)), 0))
            before = before[first]
            keep = ends[(salt[ends] > 0) | before[ends] | same[ends]]
            if len(keep):
                yield B.record(schema, token[keep], sid[keep], size[keep])
            last, met = [c[-1:] for c in cols], bool(before[-1])
        if last is not None and (last[1][0] > 0 or met):
            yield B.record(schema, last[0], last[2], last[3])

    return run


def band_of(size: Column, threshold: int) -> Column:
    """The size band; sets that can link are in the same band or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / math.log(1.001 * PARTS_OF / threshold)).cast("int")


def _may_link(bits: list[np.ndarray], one: np.ndarray, two: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], threshold: int):
    """For pairs of bitmaps (row numbers ``one`` and ``two``): whether the bound allows a link, and the share of members apart."""
    flat, offs = bits
    longs = np.diff(offs)
    apart = np.zeros(len(one), dtype=np.int64)
    least = np.minimum(longs[one], longs[two])
    both = np.stack([longs[one], longs[two]], axis=1)
    for a, b in np.unique(both, axis=0) if len(both) else ():
        at = np.flatnonzero((both[:, 0] == a) & (both[:, 1] == b))
        k = int(least[at[0]])
        x, y = (fold(flat[offs[rows[at]][:, None] + np.arange(n)], k) for rows, n in ((one, a), (two, b)))
        apart[at] = np.bitwise_count(x ^ y).sum(axis=1)
    total = sizes[0].astype(np.int64) + sizes[1]
    # the overlap is at most (total - apart) / 2
    return PARTS_OF * (total - apart) >= threshold * (total + apart), apart / total


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = B.text_bytes(column)
    return np.ascontiguousarray(raw).view(U64), offs // 8


def _plausible(threshold: int):
    """Pairs whose bitmaps allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, m, n, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "m", "n", "x", "y"))
            (xf, xo), (yf, yo) = _longs(x), _longs(y)
            rows = np.arange(batch.num_rows)
            ok, _ = _may_link((np.r_[xf, yf], np.r_[xo, yo[1:] + len(xf)]), rows, rows + len(rows), (m.to_numpy(), n.to_numpy()), threshold)
            yield B.record(schema, a.to_numpy()[ok], b.to_numpy()[ok])

    return run


def _whole_runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: list[str]):
    """Tables of whole runs of equal ``keys`` from input sorted by them; a run is a block of bounded rows."""
    rest: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table({n: batch.column(batch.schema.get_field_index(n)) for n in names})
        if rest:
            t = pa.concat_tables([*rest, t]).combine_chunks()
        new = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield t.slice(0, last).combine_chunks()
        rest = [t.slice(last)]
    if rest:
        yield rest[0].combine_chunks()


#: Roles of a row in a block.
PROBE, BASE, MINOR = 1, 2, 4
BLOCK = ["token", "tile", "c", "d"]


def _tile_pairs(threshold: int, nearest: int):
    """Kind 0: pairs (a, b) of one block whose bitmaps allow a link; with ``nearest``, so many a probe and component, and kind 1: tiles (token, band) that had more."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    names = [*BLOCK, "band", "sid", "size", "comp", "role", "bits"]

    def run(batches):
        for t in _whole_runs(batches, names, BLOCK):
            token, tile, c, d, band, sid, size, comp, role = (t[n].to_numpy() for n in names[:-1])
            bits = _longs(t["bits"])
            new = np.r_[True, (token[1:] != token[:-1]) | (tile[1:] != tile[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])]
            starts = np.flatnonzero(new)
            begin, many = starts[np.cumsum(new) - 1], np.diff(np.r_[starts, len(token)])[np.cumsum(new) - 1]
            probes = np.flatnonzero(role & PROBE)
            upto = np.r_[0, np.cumsum(many[probes])]
            lo = 0
            while lo < len(probes):
                hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + TOGETHER, "right")) - 1)
                mine = probes[lo:hi]
                p = np.repeat(mine, many[mine])
                q = np.arange(len(p)) - np.repeat(upto[lo:hi] - upto[lo], many[mine]) + begin[p]
                lo = hi
                small, large = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
                ok = ((role[q] & BASE) > 0) & (comp[p] != comp[q]) & (threshold * large <= PARTS_OF * small)
                ok &= ((band[p] == tile[p]) | (band[q] == tile[q])) & (((role[q] & MINOR) == 0) | (sid[p] < sid[q]))
                p, q = p[ok], q[ok]
                ok, apart = _may_link(bits, p, q, (size[p], size[q]), threshold)
                p, q, apart = p[ok], q[ok], apart[ok]
                if nearest and len(p):
                    order = np.lexsort((apart, comp[q], p))
                    p, q = p[order], q[order]
                    group = np.r_[True, (p[1:] != p[:-1]) | (comp[q][1:] != comp[q][:-1])]
                    first = np.flatnonzero(group)[np.cumsum(group) - 1]
                    keep = np.arange(len(p)) - first < nearest
                    more = np.unique(np.stack([token[p[~keep]], tile[p[~keep]]], axis=1), axis=0)
                    if len(more):
                        yield B.record(schema, np.ones(len(more), np.int32), more[:, 0], more[:, 1])
                    p, q = p[keep], q[keep]
                if len(p):
                    yield B.record(schema, np.zeros(len(p), np.int32), sid[p], sid[q])

    return run


def _wanted(width: int, cells):
    """Members of the documents whose set is in the wanted bitmap."""
    schema = pa.schema([("sid", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches):
        bits = cells.value
        seen: set[int] = set()
        for _, _, values, cuts, sizes, sid, _ in _sets(batches, width):
            u = sid.view(U64)
            hit = (bits[((u >> U64(6)) & U64(len(bits) - 1)).astype(np.int64)] >> (u & U64(63))) & U64(1) == 1
            at = np.flatnonzero(hit & _unseen(seen, sid, sizes * hit))
            if len(at):
                flat = np.concatenate([values[cuts[i] : cuts[i + 1]] for i in at]).view(np.int64)
                bounds = np.r_[0, np.cumsum(sizes[at])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], schema=schema)

    return run


def wanted_members(docs: DataFrame, sids: DataFrame, width: int) -> DataFrame:
    """``sid, members`` for the wanted sids (and a few more): a bitmap of bounded size is broadcast; once it is full, all sets pass and the joins drop them."""
    longs = int(min(max(1 << sids.count().bit_length(), WANTED_LONGS[0]), WANTED_LONGS[1]))
    cell = F.shiftrightunsigned("sid", 6).bitwiseAND(longs - 1)
    filled = sids.groupBy(cell.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sid & 63 as int))")).alias("cell")).toPandas()
    bits = np.zeros(longs, dtype=np.int64)
    bits[filled["at"].to_numpy(dtype=np.int64)] = filled["cell"].to_numpy(dtype=np.int64)
    cells = docs.sparkSession.sparkContext.broadcast(bits.view(U64))
    out = docs.mapInArrow(_wanted(width, cells), "sid long, members array<long>")
    return out.groupBy("sid").agg(F.first("members").alias("members"))


def _intersect(threshold: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(n)) for n in ("a", "b", "x", "y"))
            xv, xo = x.values.to_numpy().view(U64), x.offsets.to_numpy()
            yv, yo = y.values.to_numpy().view(U64), y.offsets.to_numpy()
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep[i] = PARTS_OF * common >= threshold * (len(p) + len(q) - common)
            if keep.any():
                yield B.record(schema, a.to_numpy()[keep], b.to_numpy()[keep])

    return run


def verified(docs: DataFrame, pairs: DataFrame, width: int, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) of sids that link, by exact intersection of their sorted sets.

    Each set travels once, and once more a pair for ``a``; a set ``b`` of many pairs is repeated so that a task has ``SPREAD`` of them.
    """
    sids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    sets = stored(wanted_members(docs, sids, width).join(sids, "sid", "left_semi"), "jaccard-members")
    busy = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / SPREAD).alias("parts")).where("parts > 1"), "jaccard-busy")
    salted = pairs.join(busy, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1)))).select("a", "b", "salt")
    right = sets.select(F.col("sid").alias("b"), F.col("members").alias("y")).join(busy, "b", "left")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    left = salted.join(sets.select(F.col("sid").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(right, ["b", "salt"]).select("a", "b", "x", "y")
    return stored(both.mapInArrow(_intersect(threshold), "a long, b long"), "jaccard-links")


def _led(lists: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    """``a, b``: each set with the leader that it shares most lists with, where the bitmaps allow a link."""
    banded = lists.withColumn("band", band_of(F.col("size"), threshold))
    degrees = lists.groupBy("sid").agg(F.count("*").alias("degree"))
    ranked = stored(banded.join(degrees, "sid"), "jaccard-degrees")
    leaders = ranked.groupBy("token", "band").agg(F.max(F.struct("degree", "sid")).alias("l"))
    led = ranked.join(leaders, ["token", "band"]).where(F.col("l.sid") != F.col("sid")).groupBy("sid", "l").agg(F.count("*").alias("n"))
    led = led.groupBy("sid").agg(F.max(F.struct("n", "l")).alias("m"))
    pairs = led.select(F.col("sid").alias("a"), F.col("m.l.sid").alias("b"))
    left = pairs.join(bits.select(F.col("sid").alias("a"), F.col("size").alias("m"), F.col("bits").alias("x")), "a")
    both = left.join(bits.select(F.col("sid").alias("b"), F.col("size").alias("n"), F.col("bits").alias("y")), "b")
    return stored(both.mapInArrow(_plausible(threshold), "a long, b long"), "jaccard-pairs")


def _crossing(lists: DataFrame, bits: DataFrame, joined: DataFrame, threshold: int, nearest: int, parts: int, only: DataFrame | None = None) -> DataFrame:
    """Candidates between components (``_tile_pairs``) of all tiles, or of the tiles ``only``."""
    named = joined.select(F.col("node").alias("sid"), "component")
    marked = stored(bits.join(named, "sid", "left").select("sid", "size", F.coalesce("component", "sid").alias("comp"), "bits"), "jaccard-bits")
    band = band_of(F.col("size"), threshold)
    placed = lists.join(marked.select("sid", "comp"), "sid").withColumn("band", band).withColumn("tile", F.explode(F.array(F.col("band"), F.col("band") - 1)))
    if only is not None:
        placed = placed.join(only, ["token", "tile"], "left_semi")
    placed = stored(placed, "jaccard-tiles")
    by_comp = placed.groupBy("token", "tile", "comp").agg(F.count("*").alias("n"), F.count_if(F.col("band") == F.col("tile")).alias("own"))
    stats = by_comp.groupBy("token", "tile").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.max(F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"))
    mixed = stats.where("comps > 1 AND own > 0").select("token", "tile", "n", F.col("main.comp").alias("main"), (F.col("n") - F.col("main.n")).alias("minors"))
    rows = placed.join(mixed, ["token", "tile"])
    minor = F.col("comp") != F.col("main")
    bases, probes = F.ceil(F.col("n") / TILE_ROWS).cast("int"), F.ceil(F.col("minors") / TILE_ROWS).cast("int")
    hashed = lambda parts, seed: F.pmod(F.xxhash64("sid", F.lit(seed)), parts).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda c, d, role: F.struct(c.cast("int").alias("c"), d.cast("int").alias("d"), F.lit(role).alias("role"))
    alone = F.array(F.when(minor, place(F.lit(0), F.lit(0), PROBE | BASE | MINOR)).otherwise(place(F.lit(0), F.lit(0), BASE)))
    as_base = lambda role: F.transform(upto(probes), lambda c: place(c, hashed(bases, 1), role))
    as_probe = F.transform(upto(bases), lambda d: place(hashed(probes, 2), d, PROBE | MINOR))
    cut = F.when(minor, F.concat(as_base(BASE | MINOR), as_probe)).otherwise(as_base(BASE))
    rows = rows.withColumn("at", F.explode(F.when(F.col("n") <= TILE_ROWS, alone).otherwise(cut)))
    rows = rows.select("token", "tile", "at.c", "at.d", "at.role", "band", "sid", "size", "comp").join(marked.select("sid", "bits"), "sid")
    blocks = rows.repartition(parts, *BLOCK).sortWithinPartitions(*BLOCK, "sid")
    return stored(blocks.mapInArrow(_tile_pairs(threshold, nearest), "kind int, a long, b long"), "jaccard-crossing")


def jaccard_components(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """Per document: ``key, n_shingles, component`` (smallest key reachable by links)."""
    spark = docs.sparkSession
    docs = docs.select(whole_key(docs, key_col).alias("key"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(docs.mapInArrow(_profile(width), PROFILE), "jaccard-sets")
    keyed = rows.where("kind = 0").select("key", "sid", "size")
    counts = lambda kind: rows.where(F.col("kind") == kind).groupBy("sid").agg(F.sum("n").alias("n"))
    shown = spark.sparkContext.broadcast(Order.arrays(most_frequent(counts(1), MAX_COMMON), most_frequent(counts(2), MAX_WORDS)))
    lists = docs.mapInArrow(_postings(width, threshold, shown), "token long, salt int, sid long, size int")
    lists = lists.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "sid")
    lists = stored(lists.mapInArrow(_shared(), "token long, sid long, size int"), "jaccard-lists")
    sids = lists.select("sid").distinct()
    bits = rows.where("kind = 0 AND bits IS NOT NULL").groupBy("sid").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    bits = stored(bits.join(sids, "sid", "left_semi"), "jaccard-bits")
    every = verified(docs, _led(lists, bits, threshold), width, threshold)
    only = None
    for nearest in (NEAREST, 0):
        found = _crossing(lists, bits, components(every), threshold, nearest, parts, only)
        pairs = found.where("kind = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        every = every.unionByName(verified(docs, stored(pairs, "jaccard-pairs"), width, threshold))
        only = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").cast("int").alias("tile")).distinct()
        if only.isEmpty():
            break
    # from sets to documents: a set stands for the smallest key that has it
    least = stored(keyed.where("size > 0").groupBy("sid").agg(F.min("key").alias("least")), "jaccard-least")
    named = every.join(least.select(F.col("sid").alias("a"), F.col("least").alias("u")), "a").join(least.select(F.col("sid").alias("b"), F.col("least").alias("v")), "b").select("u", "v")
    whole = components(named, "u", "v")
    classes = least.join(whole.withColumnRenamed("node", "least"), "least", "left").select("sid", F.coalesce("component", "least").alias("component"))
    # stored first, so that Spark can split the copies of one set in the last join
    out = keyed.join(stored(classes, "jaccard-classes"), "sid", "left")
    return out.select("key", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("component", "key")).otherwise(F.col("key")).alias("component"))


def one_of_each(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` without near duplicates: the smallest key of each component stays.

    A document is a key with its text: rows that share a key are judged each by their text; of rows equal in both, one stays. Rows without a key stay.
    """
    one = F.when(F.col(key_col).isNotNull(), F.xxhash64(key_col, F.coalesce(text_col, F.lit(""))))
    marked = docs.withColumn("_one", one)
    rows = marked.where("_one is not null").select(F.col("_one"), F.col(text_col).alias("text"), F.col(key_col).alias("_key"))
    groups = stored(jaccard_components(rows, "_one", "text", width, threshold).select(F.col("key").alias("_one"), "component"), "jaccard-groups")
    members = groups.distinct().join(rows.select("_one", "_key").distinct(), "_one")
    first = members.groupBy("component").agg(F.min(F.struct("_key", "_one"))["_one"].alias("first"))
    later = members.join(first, "component").where("_one <> first").select("_one").distinct()
    out = marked.join(later, "_one", "left_anti")
    many, distinct = groups.agg(F.count("*"), F.count_distinct("_one")).first()
    if many > distinct:
        out = out.where("_one is not null").dropDuplicates(["_one"]).unionByName(out.where("_one is null"))
    return out.select(docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
SQL = {
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.o)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(o) FROM r WHERE r.doc_id = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
""",
}
