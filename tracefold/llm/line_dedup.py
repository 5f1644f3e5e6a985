"""Line dedup: later copies of repeated runs of lines are deleted.

The corpus is a sequence of line IDs, one sequence a document (blank lines are left out of it). Suffixes of these sequences are ranked by
distributed prefix doubling: the ranks of the first h lines at p and at p + h, as a pair, are sorted by range partitions and numbered, which gives the
ranks of the first 2h lines in suffix-array order (up to ``min_lines`` the prefixes grow by one line, so that every length is ranked). Suffixes of equal
rank form an interval whose common prefix is at least h lines; an interval of one suffix is dropped at once, so only repeated lines take part after
the first round, and rounds go on until no interval is left, whatever the length of the runs. A suffix whose interval has an earlier place repeats that
place's lines; it counts once the common prefix has ``min_words`` words, or else ``min_lines`` lines. The union of a document's counted prefixes are its maximal
repeated runs, and these are deleted. DataFrame functions only; a class of lines is only ever counted, never gathered.

Defined cases: null and empty texts have no lines; lines compare by their text without spaces at the ends; rows that repeat key and text are one
document and get one result each; null keys come last; no rows give no rows; other columns pass through ``delete_repeated_lines``, but for those
called like its results, whose names can be chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import let, stored, table, word_count

MIN_LINES, MIN_WORDS = 3, 40


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(line)


def line_ids(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """``key, th, pos`` (among lines that aren't blank), ``h1, h2, words``."""
    filled = F.filter(F.transform(lines_of(F.col(text_col)), _bare), lambda line: line != "")
    rows = docs.select(F.col(key_col).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.posexplode(filled).alias("pos", "line"))
    return rows.select("key", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.reverse("line"), F.lit(5)).alias("h2"), word_count(F.col("line")).cast("int").alias("words"))


def _place() -> Column:
    return F.struct(F.col("key").isNull().alias("z"), F.col("key").alias("key"), F.col("th").alias("th"), F.col("pos").alias("pos"))


def _ahead(column: str, lines: int) -> Column:
    """The value ``lines`` lines on, null where that line isn't a start of the last round."""
    # repeated rows share a position, so look for the position rather than for the row
    return F.max(column).over(Window.partitionBy("key", "th").orderBy("pos").rangeBetween(lines, lines))


def repeated_prefixes(docs: DataFrame, key_col: str, text_col: str, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, th, pos, lines``: starts whose next ``lines`` lines an earlier place has too, the most that a round tells (the whole common prefix has under twice as many)."""
    df, by, lines, out = line_ids(docs, key_col, text_col).withColumn("upto", F.col("words")), ["h1", "h2"], 1, None
    while True:
        classes = df.groupBy(*by).agg(F.count("*").alias("c"), F.min(_place()).alias("first")).where("c > 1").drop("c")
        ranks = stored(classes.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "line-ranks")
        if out is not None and ranks.isEmpty():
            break
        # the ranks are a table of their own, so that Spark can split the rows of one line that is everywhere
        df = stored(df.join(ranks, by).drop(*by), "line-repeats")
        enough = F.lit(True) if lines >= min_lines else F.col("upto") >= min_words
        found = df.where(enough & (F.col("first") < _place())).select("key", "th", "pos", F.lit(lines).alias("lines"))
        out = found if out is None else out.unionByName(found)
        step = 1 if lines < min_lines else lines
        upto = {"upto": F.col("words") + _ahead("upto", 1)} if lines < min_lines else {}
        df = df.withColumns({"on": _ahead("rank", step), **upto}).where("on IS NOT NULL").drop("first")
        df = df.withColumnRenamed("rank", "before")
        by, lines = ["before", "on"], lines + step
    return out.groupBy("key", "th", "pos").agg(F.max("lines").alias("lines"))


def repeated_runs(docs: DataFrame, key_col: str, text_col: str, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, th, start, lines``: each document's maximal runs of lines (counted without blank ones) that earlier places have."""
    starts = repeated_prefixes(docs, key_col, text_col, min_lines, min_words)
    order = Window.partitionBy("key", "th").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("lines")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach >= F.col("pos"), 0).otherwise(1)
    runs = starts.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("key", "th", "run").agg(F.min("pos").alias("start"), (F.max(F.col("pos") + F.col("lines")) - F.min("pos")).alias("lines")).drop("run")


def delete_repeated_lines(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, names: tuple[str, str, str] = ("n_lines", "n_removed", "longest_run")) -> DataFrame:
    """``docs`` with ``text`` cut, and, as ``names`` says, its lines, the removed ones, and those of the longest repeated run (without blank ones). Blank lines inside a run go with it."""
    runs = repeated_runs(docs, key_col, text_col, min_lines, min_words).groupBy("key", "th").agg(F.collect_set(F.struct("start", "lines")).alias("_line_runs"))
    runs = stored(runs.select(F.col("key").alias("_line_key"), F.col("th").alias("_line_hash"), "_line_runs"), "line-runs")
    hashed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    # runs grow with the corpus, so texts and runs meet by a shuffle at every size
    runs = runs.hint("merge")
    joined = hashed.join(runs, (hashed["_text_hash"] == runs["_line_hash"]) & hashed[key_col].eqNullSafe(runs["_line_key"]), "left").drop("_line_key", "_line_hash", "_text_hash")
    pieces = lines_of(F.col(text_col))

    def cut(p: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: _bare(F.get(p, i)) != "")
        gone = let(filled, lambda f: F.flatten(F.transform("_line_runs", lambda r: F.sequence(F.get(f, r["start"]), F.get(f, r["start"] + r["lines"] - 1)))))
        kept = let(gone, lambda g: F.struct(F.size(g).alias("n"), F.array_except(F.sequence(F.lit(0), F.size(p) - 1), g).alias("order")))
        return let(kept, lambda k: F.struct(k["n"].alias("n"), F.array_join(F.transform(k["order"], lambda i: F.get(p, i)), "\n").alias("text")))

    done = F.when(F.col("_line_runs").isNotNull(), let(pieces, cut))
    n_lines = F.when(F.coalesce(F.col(text_col), F.lit("")) == "", 0).otherwise(F.size(pieces)).cast("long")
    longest = F.coalesce(F.array_max(F.transform("_line_runs", lambda r: r["lines"])), F.lit(0)).cast("long")
    out = joined.withColumns({names[0]: n_lines, names[2]: longest, "_line_cut": done}).drop("_line_runs")
    text = F.when(F.col("_line_cut").isNull(), F.col(text_col)).otherwise(F.col("_line_cut.text"))
    return out.withColumns({names[1]: F.coalesce("_line_cut.n", F.lit(0)).cast("long"), text_col: text}).drop("_line_cut")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = delete_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op1_line_dedup": op1_line_dedup}
SQL = {
    "op1_line_dedup": rf"""
WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS idx, unnest(p) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
n AS (SELECT doc_id, idx, trim(raw, ' ') AS line, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM l WHERE trim(raw, ' ') <> ''),
k AS (SELECT *, CASE WHEN w >= {MIN_WORDS} THEN 1 WHEN w + lead(w) OVER o >= {MIN_WORDS} THEN 2 ELSE 3 END AS least, line AS l1, lead(line) OVER o AS l2, lead(line, 2) OVER o AS l3, idx AS u1, lead(idx) OVER o AS u2, lead(idx, 2) OVER o AS u3 FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, pos, idx, len, l1, CASE WHEN len > 1 THEN l2 ELSE '' END AS m, CASE WHEN len > 2 THEN l3 ELSE '' END AS r, CASE len WHEN 1 THEN u1 WHEN 2 THEN u2 ELSE u3 END AS until FROM k, (SELECT unnest([1, 2, 3]) AS len) WHERE len >= least),
f AS (SELECT *, min(row(doc_id, pos)) OVER (PARTITION BY len, l1, m, r) AS first FROM g WHERE m IS NOT NULL AND r IS NOT NULL AND until IS NOT NULL),
x AS (SELECT DISTINCT doc_id, unnest(range(idx, until + 1)) AS idx FROM f WHERE first < row(doc_id, pos)),
c AS (SELECT l.doc_id, count(x.idx) AS gone, coalesce(string_agg(raw, chr(10) ORDER BY l.idx) FILTER (x.idx IS NULL), '') AS kept, count(*) AS n FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.idx = l.idx GROUP BY l.doc_id)
SELECT d.doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n END AS BIGINT) AS n_lines, CAST(gone AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM documents d JOIN c USING (doc_id)
""",
}
