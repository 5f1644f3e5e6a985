"""Document fingerprints: a homomorphic multiset hash that also measures likeness.

A document is the multiset of its paragraphs' pieces (lines, cut into runs of ``PIECE`` words). Each piece hashes to a wide vector: two lanes of the
full 60 bits, and 120 lanes of one bit. A fingerprint is the sum of those vectors modulo powers of two: the full lanes modulo 2^60, the others in lanes of 20
bits, three to a 60-bit number. Order doesn't matter; inserting or deleting a paragraph adds or subtracts its vector (``combine``), so fingerprints
are kept up to date without the text. The full lanes make unequal multisets differ; with n pieces a narrow lane counts the pieces that have its bit, so
2 * count - n is the sum of independent signs, and the cosine of two such vectors estimates the cosine of the two multisets. DataFrame
functions only, all within a row.

Defined cases: null and empty text have the fingerprint of the empty multiset; two empty ones are alike (1), an empty and another
are not (0); lanes wrap beyond 2^20 pieces (equality holds on, likeness is then lost); rows of equal key come in the order of their texts;
null keys come last; a single row is its own next one; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import let, table

#: Words in a piece of a paragraph.
PIECE = 4
PIECES = r"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+){0,%d}" % (PIECE - 1)
LANE = 20
LANES = 3
SEEDS = (11, 12)
ONES = sum(1 << (LANE * i) for i in range(LANES))
MODULUS_BITS = LANE * LANES
MASK = (1 << MODULUS_BITS) - 1


def fingerprint(text: Column) -> Column:
    """Array of longs: the number of pieces, the sums of the narrow lanes, those of the full ones."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))
    hashed = F.transform(pieces, lambda p: F.struct(*(F.xxhash64(p, F.lit(s)).alias(f"h{s}") for s in SEEDS)))

    def sums(h: Column) -> Column:
        lane = lambda seed, i: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a + F.shiftrightunsigned(x[f"h{seed}"], i).bitwiseAND(ONES)).bitwiseAND(MASK))
        full = lambda seed: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: (a + x[f"h{seed}"].bitwiseAND(MASK)).bitwiseAND(MASK))
        return F.array(F.size(h).cast("long"), *(lane(s, i) for s in SEEDS for i in range(LANE)), *(full(s) for s in SEEDS))

    return let(hashed, sums)


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint after insertion (1) or deletion (-1) of what ``b`` stands for."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: (z["a"] + F.lit(sign) * z["b"]).bitwiseAND(MASK))


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the estimated cosine of the multisets."""
    equal = F.when(a == b, 1.0)
    empty = F.when((F.element_at(a, 1) == 0) | (F.element_at(b, 1) == 0), 0.0)
    lane = lambda x, j: F.shiftrightunsigned(x, LANE * j).bitwiseAND((1 << LANE) - 1)

    def signs(fp: Column) -> Column:
        n = F.element_at(fp, 1)
        return F.flatten(F.transform(F.slice(fp, 2, LANE * len(SEEDS)), lambda x: F.array(*(2 * lane(x, j) - n for j in range(LANES)))))

    def cosine(p: Column, q: Column) -> Column:
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: (u * v).cast("double")), F.lit(0.0), lambda s, z: s + z)
        return dot(p, q) / F.greatest(F.sqrt(dot(p, p) * dot(q, q)), F.lit(1e-9))

    value = let(F.struct(signs(a).alias("p"), signs(b).alias("q")), lambda s: cosine(s["p"], s["q"]))
    return F.round(F.coalesce(equal, empty, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))), 6)


def with_next(docs: DataFrame, key: str, text: str, derived: dict[str, Callable[[Column], Column]], chars_per_block: int = 1_000_000, max_edges: int = 20_000) -> DataFrame:
    """``docs`` with the ``derived`` columns and ``next``: a struct of the text and its derived columns of the next document in descending key order; the first follows the last.

    Documents are dealt into blocks of consecutive keys, so the texts are shuffled once and no task sees all rows: by at most ``max_edges`` quantiles, and
    between those in equal steps of the key, as many as keep a block at about ``chars_per_block``. Only a block's last row needs another block's first row;
    those few are joined by block, on the partitioning that is there. Derived columns (functions of the text) are made before the shuffle, and once more for those first rows only.
    """
    chars, rows, low, high = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)), F.count("*"), F.min(key), F.max(key)).first()
    blocks = max(64, chars // chars_per_block)
    steps = -(-blocks // max_edges)
    blocks = int(min(blocks, max_edges))
    cuts = []
    if rows > 1:
        shares = F.split(F.lit(",".join(str(i / blocks) for i in range(1, blocks))), ",").cast("array<double>")
        cuts = sorted(set(docs.agg(F.percentile_approx(key, shares, F.lit(20 * blocks)).alias("q")).first().q or []))
    edges = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>") if cuts else F.array().cast("array<long>")
    # the number of edges at or above the key: descending keys have ascending blocks
    block = F.when(F.col(key).isNull(), F.lit(len(cuts) + 1)).otherwise(_upper(edges, F.col(key), len(cuts)))
    dealt = docs.withColumn("block", block)
    step = F.lit(0)
    if steps > 1:
        # keys of block b are at most edges[n - b] and above edges[n - b - 1]
        top = F.coalesce(F.get(edges, len(cuts) - F.col("block")), F.lit(high)).cast("double")
        bottom = F.coalesce(F.get(edges, len(cuts) - F.col("block") - 1), F.lit(low)).cast("double")
        step = F.coalesce(F.floor((top - F.col(key)) * steps / (top - bottom + 1)), F.lit(0)).cast("int")
    dealt = dealt.withColumn("step", step)
    w = Window.partitionBy("block", "step").orderBy(F.col(key).desc_nulls_last(), F.col(text))
    made = {name: of(F.col(text)) for name, of in derived.items()}
    rowed = dealt.withColumns(made).withColumn("_next", F.lead(F.struct(text, *derived)).over(w))
    first = F.min_by(F.col(text), F.struct((-F.col(key)).alias("k"), F.col(text).alias("t"))).alias("_first")
    firsts = dealt.groupBy("block", "step").agg(first)
    # a step is followed by the next one of its block, the last one by the first of the next block
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy("block").orderBy("step")))
    ids = sorted(r.block for r in docs.select(block.alias("block")).distinct().collect())  # at most max_edges + 2 numbers
    before = [(ids[(i + 1) % len(ids)], b) for i, b in enumerate(ids)]
    link = docs.sparkSession.createDataFrame(before or [(0, 0)], "block int, before int")
    heads = firsts.groupBy("block").agg(F.min_by("_first", "step").alias("_head")).join(F.broadcast(link), "block")  # link: two numbers a block
    ends = after.join(heads.select(F.col("before").alias("block"), "_head"), "block").select("block", "step", F.coalesce("_after", "_head").alias("_first"))
    late = F.struct(F.col("_first").alias(text), *(of(F.col("_first")).alias(name) for name, of in derived.items()))
    return rowed.join(ends, ["block", "step"], "left").withColumn("next", F.coalesce("_next", late)).drop("_next", "_first", "block", "step")


def _upper(edges: Column, value: Column, count: int) -> Column:
    """How many of the ascending edges are at least ``value``, by binary search."""
    steps = max(count, 1).bit_length()
    start = F.struct(F.lit(0).alias("lo"), F.lit(count).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(edges, mid) < value, F.lit(False))
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, step, lambda s: F.lit(count) - s["lo"])


def edited(text: Column, next_text: Column) -> Column:
    """The last third of the code points replaced by as many first ones (or all) of the next text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(next_text, F.lit(1), third))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(docs, "doc_id", "text", {"fp": fingerprint})
    changed = let(edited(F.col("text"), F.col("next.text")), lambda e: F.struct(F.sha2(e, 256).alias("sha"), fingerprint(e).alias("fp")))
    df = df.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.col("fp"), F.col("next.fp").alias("next_fp"), changed.alias("e"))
    return df.select("doc_id", "n_chars", let(F.struct("fp", "next_fp", "e"), lambda s: F.struct(
        s["e"]["sha"].alias("edited_sha256"), as_text(s["fp"]).alias("fingerprint"), as_text(s["e"]["fp"]).alias("edited_fingerprint"),
        likeness(s["fp"], s["e"]["fp"]).alias("near_edited"), likeness(s["fp"], s["next_fp"]).alias("near_next"))).alias("o")).select("doc_id", "n_chars", "o.*")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op4_fingerprint`` says of the texts themselves, which has SQL."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(docs, "doc_id", "text", {})
    return df.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited(F.col("text"), F.col("next.text")), 256).alias("edited_sha256"))


QUERIES = {"op4_fingerprint": op4_fingerprint, "edited_texts": edited_texts}
SQL = {
    "edited_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nx FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, t))
SELECT doc_id, length(t) AS n_chars, sha256(concat(substr(t, 1, length(t) - length(t) // 3), substr(nx, 1, length(t) // 3))) AS edited_sha256 FROM n
""",
}
