"""Saved runs of a study: CSV shards and combined files found by their places, with the types and keys that these leave out.

A study's folder has ``<xmin setting>/raw_results/<concept>/<model>/summary.csv`` and, from parallel runs, ``log-results/summary_<log>.csv`` beside it. All files are
read by one scan for each distinct header; what a place says becomes columns, and absent files are simply absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The adaptive setting's folder and name, the folders of results, and what shards and combined files are compared by.
ADAPTIVE, ADAPTIVE_NAME = "xmin-adaptive", "None"
PLACE = r"/(xmin[0-9]{2,}|xmin-adaptive)/raw_results/([^/]+)/([^/]+)/(?:log-results/summary_[^/]+|summary)\.csv$"
COMPARED = {"xmin": "double", "n_fitted_types": "long", "fit_valid": "boolean", "gof_p": "double", "gof_kind": "string"}
#: Cells that are missing where a column turns out to hold numbers or truth values; as labels they stay.
ABSENT = ("", "NA", "N/A", "NaN", "nan", "null", "None")
FILE = "_file"


def read_shards(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """All CSV files below ``path`` as text columns by name, and ``_file``; columns that a file lacks are null, files without a line are left out."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    headers = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()  # a row a distinct header
    parts = []
    for g in sorted(groups, key=lambda g: g["header"]):
        rows = spark.read.option("header", True).option("inferSchema", False).option("escape", "\"").csv(g["files"])
        parts.append(rows.select("*", F.col("_metadata.file_path").alias(FILE)))
    if not parts:
        return spark.createDataFrame([], f"{FILE} string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def column_types(rows: DataFrame, by: str = FILE) -> dict[str, str]:
    """``boolean, bigint, double`` or ``string`` for each column of text, from what each shard's cells look like.

    As the shards' own reader would infer: truth values and whole numbers only where no cell is missing, else decimals or text. A column is boolean if any
    shard's is, whole if any shard's is and none has a fraction (what else a shard holds there is lost, as it is in the study's own tables), decimal if all are
    numbers, and text otherwise. One aggregate over all cells.
    """
    names = [c for c in rows.columns if c != by]
    cells = rows.unpivot([by], names, "column", "cell")
    cell = F.trim("cell")
    gone = F.col("cell").isNull() | cell.isin(*ABSENT)
    number = F.when(~gone, cell.try_cast("double"))
    whole = cell.rlike(r"^[+-]?[0-9]+$")
    here = lambda c: F.bool_and(F.when(~gone, c))
    shard = cells.groupBy("column", by).agg(
        F.bool_or(gone).alias("gaps"), F.bool_or(~gone).alias("any"), here(F.lower(cell).isin("true", "false")).alias("truth"), here(whole).alias("whole"),
        here(number.isNotNull()).alias("numeric"), F.bool_or(number != F.rint(number)).alias("fraction"))
    no = F.lit(False)
    is_bool, is_whole = F.bool_or(F.col("truth") & ~F.col("gaps")), F.bool_or(F.col("whole") & ~F.col("gaps"))
    fraction = F.coalesce(F.bool_or(F.col("numeric") & F.col("fraction")), no)
    numeric = F.coalesce(F.bool_and(F.when(F.col("any"), F.col("numeric"))), no)
    kind = F.when(F.coalesce(is_bool, no), "boolean").when(F.coalesce(is_whole, no) & ~fraction, "bigint").when(numeric, "double").otherwise("string")
    return {r["column"]: r["kind"] for r in shard.groupBy("column").agg(kind.alias("kind")).collect()}


def as_boolean(cell: Column) -> Column:
    """``true/1/1.0/yes`` and ``false/0/0.0/no`` in any case; anything else is null."""
    text = F.lower(F.trim(cell))
    return F.when(text.isin("true", "1", "1.0", "yes"), True).when(text.isin("false", "0", "0.0", "no"), False)


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns cast to ``types``; whole numbers may be written as decimals, absent cells become null except in text columns."""

    def cast(c: str) -> Column:
        kind, cell = types.get(c, "string"), F.col(f"`{c}`")
        if kind == "boolean":
            return as_boolean(cell)
        if kind == "bigint":
            return F.rint(F.trim(cell).try_cast("double")).cast("long")
        return F.nanvl(F.trim(cell).try_cast("double"), F.lit(None)) if kind == "double" else cell

    return rows.select(*(cast(c).alias(c) for c in rows.columns))


def combined_shards(spark: SparkSession, path: str, order: list[str], glob: str = "*.csv") -> DataFrame:
    """The shards below ``path`` as one typed table in order; ``_file`` is left out."""
    rows = read_shards(spark, path, glob)
    out = typed(rows, column_types(rows)).drop(FILE) if len(rows.columns) > 1 else rows
    present = [c for c in order if c in out.columns]
    return out.orderBy(*(F.col(c).asc_nulls_last() for c in present)) if present else out


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """Every result row below a study's folder: ``xmin_setting, concept, model, log, source`` (``shard`` or ``combined``), what is compared, and ``input_path``."""
    rows = read_shards(spark, root, "summary*.csv")
    for c in ("log_name", *COMPARED):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    part = lambda i: F.regexp_extract(FILE, PLACE, i)
    setting = F.when(part(1) == ADAPTIVE, ADAPTIVE_NAME).otherwise(F.substring(part(1), 5, 9).cast("int").cast("string"))
    concept = F.regexp_replace(part(2), r"^n0*([0-9]+)$", "n$1")
    source = F.when(F.col(FILE).contains("/log-results/"), "shard").otherwise("combined")
    kinds = {c: "bigint" if t == "long" else t for c, t in COMPARED.items()}
    fields = typed(rows.where(part(1) != "").select("log_name", FILE, *COMPARED), kinds)
    return fields.select(setting.alias("xmin_setting"), concept.alias("concept"), part(3).alias("model"), F.trim("log_name").alias("log"), source.alias("source"), *COMPARED, F.col(FILE).alias("input_path")).where("log is not null")


def reconciled(found: DataFrame, key: tuple[str, ...] = ("xmin_setting", "concept", "model", "log"), tolerance: float = 1e-8) -> DataFrame:
    """One row a key: its fields (a shard's before the combined file's), ``disagrees`` and ``repeated``.

    A key in both sources must be once in each and agree in all fields; disagreeing sources are repeated only if one of them repeats the key itself. One aggregate.
    """
    shard = F.col("source") == "shard"
    ns, nc = F.count_if(shard), F.count_if(~shard)
    both = [*COMPARED, "input_path"]
    a, b = ({c: F.first(F.when(own, F.struct(c)), ignorenulls=True)[c].alias(f"{p}_{c}") for c in both} for p, own in (("a", shard), ("b", ~shard)))
    rows = found.groupBy(*key).agg(ns.alias("ns"), nc.alias("nc"), *a.values(), *b.values())
    agree = (F.col("ns") == 1) & (F.col("nc") == 1)
    for c, kind in COMPARED.items():
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        agree = agree & (x.eqNullSafe(y) | (F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if kind == "double" else F.lit(False)))
    disagrees = (F.col("ns") > 0) & (F.col("nc") > 0) & ~agree
    many = F.when(agree, 1).when(disagrees, F.col("ns") + F.col("nc")).otherwise(F.greatest("ns", "nc"))
    rows = rows.withColumns({"disagrees": disagrees, "repeated": (many > 1) & (~disagrees | (many > 2))})
    pick = lambda c: F.when(F.col("ns") > 0, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
    return rows.select(*key, *(pick(c) for c in both), "disagrees", "repeated")
