"""Event logs as DataFrames.

The flat event log has ``log, case_id, event_pos, activity, ts``; cases without events may be listed apart. File sources are XES (plain or gzip, by Spark's own
XML source), CSV and Parquet; the driver's tables serve as logs by naming a case, an activity and an order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAT = "log string, case_id string, event_pos long, activity string, ts timestamp"

_PAIR = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())])
_PAIRS = T.ArrayType(_PAIR)
_KINDS = ("string", "date", "int", "float", "boolean", "id")
XES_TRACE = T.StructType([*(T.StructField(k, _PAIRS) for k in _KINDS), T.StructField("event", T.ArrayType(T.StructType([T.StructField(k, _PAIRS) for k in _KINDS])))])
XES_CLASSIFIER = T.StructType([T.StructField("_name", T.StringType()), T.StructField("_keys", T.StringType())])


def _attributes(of: str | None = None, element: Column | None = None) -> Column:
    """The typed attribute elements of a trace or event as one map of text."""
    part = (lambda k: element[k]) if element is not None else (lambda k: F.col(k))
    empty = F.array().cast(_PAIRS)
    entries = F.concat(*(F.coalesce(part(k), empty) for k in _KINDS))
    unique = F.filter(entries, lambda e: e["_key"].isNotNull())
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(unique, lambda e: e["_key"])), lambda k: F.struct(k, F.element_at(F.filter(unique, lambda e: e["_key"] == k), 1)["_value"])))


def read_xes(spark: SparkSession, path: str, log: str) -> DataFrame:
    """Traces of an XES or XES.GZ file: ``log, case_pos, case_id, case_attrs, events`` (array of ``pos, ts, attrs``) in time order, ties in file order."""
    raw = spark.read.format("xml").option("rowTag", "trace").schema(XES_TRACE).load(path)
    events = F.transform(F.coalesce("event", F.array().cast(XES_TRACE["event"].dataType)), lambda e, i: F.struct(i.cast("long").alias("pos"), _attributes(element=e).alias("attrs")))
    rows = raw.select(F.lit(log).alias("log"), F.monotonically_increasing_id().alias("case_pos"), _attributes().alias("case_attrs"), events.alias("events"))
    named = F.nullif(F.trim(F.col("case_attrs")["concept:name"]), F.lit(""))
    return rows.withColumn("events", in_time_order(F.col("events"))).withColumn("case_id", F.coalesce(named, F.concat(F.lit("case_"), F.col("case_pos").cast("string"))))


def in_time_order(events: Column) -> Column:
    """Events (``pos, attrs``) with their ``ts``, ordered by it and then by place; without a time they come last."""
    timed = F.transform(events, lambda e: F.struct(F.try_to_timestamp(e["attrs"]["time:timestamp"]).alias("ts"), e["pos"].alias("pos"), e["attrs"].alias("attrs")))
    return F.array_sort(timed, lambda a, b: F.when(a["ts"] < b["ts"], -1).when(a["ts"] > b["ts"], 1).when(a["ts"].isNull() & b["ts"].isNotNull(), 1).when(a["ts"].isNotNull() & b["ts"].isNull(), -1).when(a["pos"] < b["pos"], -1).otherwise(1))


def classifier_keys(spark: SparkSession, path: str, name: str = "Activity classifier") -> list[str] | None:
    """The keys of the named XES classifier, None where the log has none."""
    rows = spark.read.format("xml").option("rowTag", "classifier").schema(XES_CLASSIFIER).load(path).where(F.col("_name") == name).limit(1).collect()
    return rows[0]["_keys"].split() if rows else None


def activity_label(attrs: Column, keys: Sequence[str] | None) -> Column:
    """Values of the classifier's keys joined by ``+``, a missing one empty; without keys the concept name."""
    parts = [F.coalesce(attrs[k], F.lit("")) for k in (keys or ["concept:name"])]
    return F.array_join(F.array(*parts), "+")


def flatten(traces: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """XES traces as a flat event log."""
    rows = traces.select("log", "case_id", F.posexplode("events").alias("event_pos", "e"))
    return rows.select("log", "case_id", F.col("event_pos").cast("long"), activity_label(F.col("e.attrs"), keys).alias("activity"), F.col("e.ts").alias("ts"))


def read_csv_log(spark: SparkSession, path: str, log: str, case: str, activity: str, timestamp: str, sep: str = ",", format: str | None = None, max_cases: int | None = None) -> DataFrame:
    """A CSV log with its columns renamed; ``max_cases`` keeps the first cases by first event (a sample is the feature there)."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    ts = F.to_timestamp(F.col(timestamp), format) if format else F.to_timestamp(F.col(timestamp))
    rows = raw.select(F.lit(log).alias("log"), F.col(case).cast("string").alias("case_id"), F.monotonically_increasing_id().alias("event_pos"), F.col(activity).cast("string").alias("activity"), ts.alias("ts"))
    if max_cases is not None:
        first = rows.groupBy("case_id").agg(F.min(F.struct("ts", "event_pos")).alias("f")).orderBy("f").limit(max_cases).select("case_id")
        rows = rows.join(first, "case_id", "left_semi").select("log", "case_id", "event_pos", "activity", "ts")
    return rows


def read_registry(spark: SparkSession, path: str, real: bool = True, synthetic: bool = False) -> DataFrame:
    """The JSON data dictionary ``{key: {name, short_name, type, path, description?}}`` as rows, filtered by type."""
    entry = "struct<name:string,short_name:string,type:string,path:string,description:string>"
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("key", "e")).select("key", "e.*")
    wanted = [k for k, on in (("real", real), ("synthetic", synthetic)) if on]
    return rows.where(F.col("type").isin(wanted)) if wanted else rows.limit(0)


def registry_path(registry: DataFrame, key: str) -> str:
    rows = registry.where(F.col("key") == key).limit(1).collect()
    if not rows:
        raise KeyError(key)
    return rows[0]["path"]


def parse_dataset_inputs(values: Sequence[str]) -> list[tuple[str, str]]:
    """``name=path`` pairs; empty halves and repeated names raise ValueError."""
    out: dict[str, str] = {}
    for value in values:
        name, eq, path = value.partition("=")
        if not eq or not name.strip() or not path.strip():
            raise ValueError(f"expected <name>=<path>, got {value!r}")
        if name.strip() in out:
            raise ValueError(f"dataset named twice: {name.strip()}")
        out[name.strip()] = path.strip()
    return list(out.items())


def table_log(spark: SparkSession, sf_dir: str, name: str = "events_by_day") -> DataFrame:
    """A driver table as a flat event log: ``case_id, activity, ts`` and the order key ``o``."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lit = F.lit(name).alias("log")
    if name in ("events_by_day", "events_by_user"):
        day = F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyy-MM-dd")) if name == "events_by_day" else F.col("user_id").cast("string")
        return read("events").select(lit, day.alias("case_id"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("ts"), F.struct("ts", "event_id").alias("o"))
    if name == "lineitem":
        label = F.concat("l_returnflag", F.lit("+"), "l_linestatus")
        return read("lineitem").select(lit, F.col("l_orderkey").cast("string").alias("case_id"), label.alias("activity"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.struct(F.col("l_shipdate"), F.col("l_linenumber"), label.alias("label")).alias("o"))
    if name == "conversations":
        return read("conversations").select(lit, F.col("conv_id").cast("string").alias("case_id"), F.col("role").alias("activity"), F.lit(None).cast("timestamp").alias("ts"), F.struct("turn", "role").alias("o"))
    if name == "orders":
        return read("orders").select(lit, F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderpriority").alias("activity"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.struct("o_orderdate", "o_orderkey").alias("o"))
    raise KeyError(name)
