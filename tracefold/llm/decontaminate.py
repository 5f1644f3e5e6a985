"""Benchmark decontamination: documents that hold word windows of a benchmark.

The windows of the benchmark (``width`` consecutive words; shorter items are one window) become a hash set. Each document's
windows are hashed in their row, tested against a bitmap of that set, and the few that pass are joined to the windows' words,
so that every reported hit is an equality of words. The benchmark is broadcast only up to ``max_windows`` windows; beyond
that, the windows that pass the bitmap (of bounded size) are shuffled to it. DataFrame functions only.

Defined cases: null or empty text has no words and no hits; a null item or one without words has no window; rows that repeat
key and text have a result each; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import ascii_lower, let, table

WIDTH = 13
#: Windows of the benchmark up to which they are broadcast (at most some 150 bytes each).
MAX_WINDOWS = 200_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap for each window; one in so many foreign windows passes it.
BITS_PER_WINDOW = 64


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``gram, len, items``: the distinct windows and the sorted items that have them."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where((F.size("w") > 0) & F.col("item").isNotNull())
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    grams = items.select("item", F.least(F.size("w"), F.lit(width)).alias("len"), F.explode(let(F.col("w"), lambda w: F.transform(starts, lambda i: F.array_join(F.slice(w, i, width), " ")))).alias("gram"))
    return grams.groupBy("gram", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def gram_hash(hashes: Column) -> Column:
    return F.xxhash64(hashes)


def bitmap(windows: DataFrame, count: int) -> tuple[Column, int]:
    """A literal array of longs with a bit for each window, and its number of longs, a power of two."""
    longs = 1 << max(6, (count * BITS_PER_WINDOW // 64 - 1).bit_length())
    key = gram_hash(F.transform(F.split("gram", " "), lambda w: F.xxhash64(w)))
    place = windows.select(F.shiftrightunsigned(key, 6).bitwiseAND(longs - 1).alias("at"), key.bitwiseAND(63).cast("int").alias("bit"))
    cells = place.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("cell")).collect()  # one row a window at most
    filled = [0] * longs
    for at, cell in cells:
        filled[at] = cell
    return F.split(F.lit(",".join(map(str, filled))), ",").cast("array<long>"), longs


def window_hits(docs: DataFrame, windows: DataFrame, key_cols: list[str], text_col: str, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: the key, ``text_hash, n_words, starts`` (array of start, len) and ``item_sets``."""
    count, lengths = windows.agg(F.count("*"), F.array_sort(F.collect_set("len"))).first()
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = count <= max_windows
    # the bitmap has a bounded size: with more windows more candidates pass it, and the join decides
    bits, longs = bitmap(windows, max(min(count, MAX_WINDOWS), 1))

    def candidates(w: Column) -> Column:
        def of_length(h: Column, length: int) -> Column:
            at = F.when(F.size(h) >= length, F.sequence(F.lit(1), F.size(h) - length + 1)).otherwise(F.array().cast("array<int>"))
            tested = F.filter(at, lambda i: passes(gram_hash(F.slice(h, i, length))))
            return F.transform(tested, lambda i: F.struct(i.alias("start"), F.lit(length).alias("len"), F.array_join(F.slice(w, i, length), " ").alias("gram")))

        def passes(k: Column) -> Column:
            cell = F.get(bits, F.shiftrightunsigned(k, 6).bitwiseAND(longs - 1).cast("int"))
            return F.call_function("shiftrightunsigned", cell, k.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

        if not lengths:
            return F.array().cast("array<struct<start:int,len:int,gram:string>>")
        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.concat(*(of_length(h, n) for n in lengths)))

    # rows are told apart by number, so that each keeps its own result
    found = docs.select(*key_cols, F.monotonically_increasing_id().alias("_row"), F.xxhash64(text).alias("text_hash"), let(words(F.col(text_col)), lambda w: F.struct(F.size(w).alias("n"), candidates(w).alias("c"))).alias("s"))
    found = found.select(*key_cols, "_row", "text_hash", F.col("s.n").cast("long").alias("n_words"), F.explode_outer("s.c").alias("c"))
    found = found.select(*key_cols, "_row", "text_hash", "n_words", "c.start", "c.len", "c.gram")
    grams = windows.select("gram", "items")
    hits = found.join(F.broadcast(grams) if small else grams, "gram", "left")
    hits = hits.select(*key_cols, "_row", "text_hash", "n_words", F.when(F.col("items").isNotNull(), F.struct("start", "len")).alias("at"), F.explode_outer("items").alias("item"))
    found = hits.groupBy(*key_cols, "_row", "text_hash", "n_words").agg(F.array_sort(F.collect_set("at")).alias("starts"), F.array_sort(F.collect_set("item")).alias("items"))
    return found.drop("_row")


def covered(starts: Column) -> Column:
    """Words in the union of sorted (start, len) runs."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("free"))
    return F.aggregate(
        starts, zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["start"] + s["len"] - F.greatest(s["start"], a["free"]), F.lit(0))).cast("long").alias("n"),
            F.greatest(a["free"], s["start"] + s["len"]).alias("free")),
        lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, key_cols=("doc_id",), text_col: str = "text", width: int = WIDTH, min_share: float = 0.05, item_col: str = "item_id", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Per document: ``n_words, n_hit, starts`` (the hit windows: word offset from 1, length), ``items`` and ``contaminated``.

    ``starts`` are the spans to cut where documents are repaired; ``contaminated`` marks those to drop whole.
    """
    keys = list(key_cols)
    hits = window_hits(docs, benchmark_windows(benchmark, width, item_col), keys, text_col, max_windows)
    hits = hits.withColumn("n_hit", covered(F.col("starts")))
    parts = round(1 / min_share)
    return hits.select(*keys, "text_hash", "n_words", "n_hit", "starts", "items", ((F.col("n_hit") > 0) & (parts * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents."""
    bad = decontaminate(docs, benchmark, (key_col,), text_col).where("contaminated").select(F.col(key_col).alias("_bad_key"), F.col("text_hash").alias("_bad_hash"))
    same = docs[key_col].eqNullSafe(bad["_bad_key"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op3_decontaminate": op3_decontaminate}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw USING (g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""",
}
