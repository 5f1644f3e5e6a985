"""Spelling variants: each word's near words (one inserted, deleted or replaced code point), its form among them, and its root.

Words are counted natively, summed by word on the map side. Two near words of ``s`` and ``s`` or ``s + 1`` letters differ at their first difference, so with the
letters cut into two halves they share the left half (the difference is in the right one) or the right half: both are filed under the shared
letters. A group of more than ``GROUP`` words is cut again: its stretch ``[lo, hi)`` of letters that may hold the difference is halved, round by round, until
groups are small or the stretch is one letter (such a group has at most as many words as pairs of letters). Each near pair has one first difference and so
meets in exactly one group; no group is dropped or thinned out.

Within a task, groups of one stretch are packed into tiles with a bit-sliced index: a bitset over the tile's words for each (position, letter). All words of ``s``
letters are looked up at once by word-parallel recurrences over the stretch, from the set of a word's own group on:

* Z, no error yet:            Z & at[i][c]
* R, one letter replaced:     R & at[i][c]   or newly   Z & ~at[i][c]
* X, one letter extra:        X & at[i+1][c] or newly   Z & ~at[i][c] & at[i+1][c]   (positions shifted by one from there)

A tile sends a row a word that has near words (their number and the best of them), never pairs.

Defined cases: null and empty texts have no words; a null key counts as an empty text before the colon; repeated rows count each; empty tables
give no rows; a word of any length is one word (a group's letters are bounded too, at ``LETTERS``, by the same halving).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bytes as B
from tracefold.llm.common import LOWER, UPPER, ascii_lower, stored, table
from tracefold.llm.conversation_trie import CRC_TABLE, crc32_sql

U64 = np.uint64
SHORTEST, LEAST_COUNT, TIMES = 7, 2, 10
#: Words and letters of a group beyond which its stretch is halved; words of a tile; words that are looked up at once.
GROUP, LETTERS, TILE, LOOKED_UP = 4096, 4_000_000, 1024, 1024
#: Words are runs of these letters, all of them in Latin-1.
RUN = f"[a-zÀ-ÿ]{{{SHORTEST},}}"


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words of at least ``shortest`` letters and ``least`` occurrences; by the crc32 of key and word one in 31 occurrences loses a letter."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _filed(rows: DataFrame, *stretches: tuple[Column, Column]) -> DataFrame:
    """``s, lo, hi, key, word, n``: each row under the letters outside of each stretch; ``s`` is the length of the shorter word of a pair."""
    out = rows.withColumn("stretch", F.explode(F.array(*(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for lo, hi in stretches))))
    lo, hi = F.col("stretch.lo"), F.col("stretch.hi")
    shared = F.xxhash64(F.substring("word", F.lit(1), lo), F.substring("word", F.length("word") - (F.col("s") - hi) + 1, F.col("s") - hi))
    return out.select("s", lo.alias("lo"), hi.alias("hi"), shared.alias("key"), "word", "n")


def grouped(counts: DataFrame, shortest: int = SHORTEST, group: int = GROUP) -> DataFrame:
    """The words under the keys of all groups that are looked up."""
    by = ["s", "lo", "hi", "key"]
    based = counts.withColumn("s", F.explode(F.array(F.length("word"), F.length("word") - 1))).where(F.col("s") >= shortest)
    half = F.floor(F.col("s") / 2)
    left, ready = _filed(based, (F.lit(0), half), (half, F.col("s"))), []
    while True:
        sizes = left.groupBy(by).agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("letters"))
        large = stored(sizes.where(((F.col("words") > group) | (F.col("letters") > LETTERS)) & (F.col("hi") - F.col("lo") > 1)).select(by), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*ready, left])
        ready.append(left.join(large, by, "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        left = _filed(left.join(large, by, "left_semi"), (F.col("lo"), middle), (middle, F.col("hi")))


def _set_bits(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bit of all set bits."""
    rows, cells = np.nonzero(sets)
    if not len(rows):
        return rows, cells
    bits = np.unpackbits(np.ascontiguousarray(sets[rows, cells]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return rows[which], cells[which] * 64 + bit


def near_pairs(letters: np.ndarray, lengths: np.ndarray, group: np.ndarray, s: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that differ by one code point within the stretch, each once.

    ``letters``: a row a word of ``s`` or ``s + 1`` letters (the last is 0 in shorter ones); ``group``: ascending numbers from 0.
    """
    many, cells = len(letters), -(-len(letters) // 64)

    def packed(marks: np.ndarray) -> np.ndarray:
        out = np.zeros((len(marks), cells * 8), dtype=np.uint8)
        out[:, : -(-many // 8)] = np.packbits(marks, axis=1, bitorder="little")
        return out.view(U64)

    short = packed((lengths == s)[None])
    own = packed(group[None] == np.arange(group[-1] + 1)[:, None])
    known, code = np.unique(letters[:, lo : hi + 1], return_inverse=True)
    code = code.reshape(many, -1)
    index = [packed(code[:, i][None] == np.arange(len(known))[:, None]) for i in range(hi - lo + 1)] if hi - lo < 64 else None
    at = lambda i: index[i] if index else packed(code[:, i][None] == np.arange(len(known))[:, None])  # noqa: E731  long words: one position at a time
    found = []
    queries = np.flatnonzero(lengths == s)
    for b in range(0, len(queries), LOOKED_UP):
        q = queries[b : b + LOOKED_UP]
        zero, here = own[group[q]], at(0)
        replaced, extra = np.zeros_like(zero), np.zeros_like(zero)
        for i in range(hi - lo):
            there = at(i + 1)
            same, shifted = here[code[q, i]], there[code[q, i]]
            fresh = zero & ~same
            replaced = replaced & same | fresh
            extra = (extra | fresh) & shifted
            zero = zero & same
            here = there
        if hi == s:
            extra |= zero
        for sets, kind in ((replaced, short), (extra, ~short)):
            row, bit = _set_bits(sets & kind)
            keep = bit < many
            found.append((q[row[keep]], bit[keep]))
    a, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    long = lengths[c] > s
    keep = long | (a < c)  # two words of one length find each other
    # groups are told by a hash of the shared letters, so these are compared
    keep &= (letters[a, :lo] == letters[c, :lo]).all(axis=1)
    tail = np.where(long[:, None], letters[c, hi + 1 : s + 1], letters[c, hi:s])
    keep &= (letters[a, hi:s] == tail).all(axis=1)
    return a[keep], c[keep]


def _tiles():
    schema = pa.schema([("word", pa.binary()), ("n_near", pa.int64()), ("best", pa.binary()), ("best_n", pa.int64())])

    def solve(words, counts, group, s, lo, hi):
        raw, offs = B.text_bytes(pa.array(words, pa.binary()))
        lengths, counts = np.diff(offs), np.array(counts)
        letters = np.zeros((len(words), s + 1), dtype=np.uint8)
        letters[np.arange(s + 1) < lengths[:, None]] = raw
        a, c = near_pairs(letters, lengths, np.array(group), s, lo, hi)
        if not len(a):
            return None
        a, c = np.r_[a, c], np.r_[c, a]
        rank = np.empty(len(words), dtype=np.int64)
        rank[np.array(sorted(range(len(words)), key=words.__getitem__))] = np.arange(len(words))
        order = np.lexsort((rank[c], -counts[c], a))
        a, c = a[order], c[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        return B.record(schema, [words[i] for i in a[first]], np.diff(np.r_[first, len(a)]), [words[i] for i in c[first]], counts[c[first]])

    def run(batches):
        words, counts, group, key = [], [], [], None
        for batch in batches:
            names = batch.schema.get_field_index
            for *k, word, n in zip(*(batch.column(names(c)).to_pylist() for c in ("s", "lo", "hi", "key", "word", "n")), strict=True):
                if k != key:
                    # a tile ends between groups
                    if words and (k[:3] != key[:3] or len(words) >= TILE or len(words) * k[0] > LETTERS):
                        if len(words) > 1 and (done := solve(words, counts, group, *key[:3])):
                            yield done
                        words, counts, group = [], [], []
                    group_now = group[-1] + 1 if group else 0
                    key = k
                words.append(word)
                counts.append(n)
                group.append(group_now)
        if len(words) > 1 and (done := solve(words, counts, group, *key[:3])):
            yield done

    return run


def near_words(counts: DataFrame, shortest: int = SHORTEST, group: int = GROUP) -> DataFrame:
    """``word, n_near, best, best_n``: words that have near words, how many, and the one of largest count (ties: smallest)."""
    latin = lambda c: F.encode(c, "ISO-8859-1")  # noqa: E731  a byte a letter
    text = lambda c: F.decode(c, "ISO-8859-1")
    keys = ["s", "lo", "hi", "key"]
    rows = grouped(counts, shortest, group).repartition(*keys).sortWithinPartitions(*keys, "word").select(*keys, latin(F.col("word")).alias("word"), "n")
    parts = rows.mapInArrow(_tiles(), "word binary, n_near long, best binary, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), text(F.col("best")).alias("w"))).alias("b")
    return parts.groupBy(text(F.col("word")).alias("word")).agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a ``form``: forms are followed by pointer doubling (counts grow along them, so there are no circles)."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = stored(after.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def variants(counts: DataFrame, shortest: int = SHORTEST, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``counts`` (``word, n``)."""
    counts = stored(counts, "words")
    near = near_words(counts, shortest, group)
    out = stored(counts.join(near, "word", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False))), "near")
    out = out.join(roots(out.where("is_form").select("word", F.col("best").alias("form"))), "word", "left")
    form = lambda c: F.when(F.col("is_form"), F.col(c))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form("best").alias("form"), form("best_n").alias("form_n"), F.coalesce("root", "word").alias("root"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling": op12}
SQL = {
    "op12_spelling": f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents),
hashed AS (SELECT run, {crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, {CRC_TABLE}),
results AS (SELECT CASE WHEN h % 31 = 0 THEN run[: (h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2 :] ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM results WHERE length(word) >= {SHORTEST} GROUP BY word HAVING count(*) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
          UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
near AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM pairs GROUP BY a),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.best_n >= {TIMES} * w.n THEN r.best END AS form, CASE WHEN r.best_n >= {TIMES} * w.n THEN r.best_n END AS form_n
           FROM words w LEFT JOIN near r ON r.word = w.word),
steps AS (SELECT word, word AS root FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s ON s.word = f.word JOIN formed r ON r.word = s.root AND r.form IS NULL"""
}
