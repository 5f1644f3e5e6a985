"""Queries: saturation, transitions, case attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.storage import stored
from tracefold.operators import attributes as at
from tracefold.operators import dates
from tracefold.operators import saturation as sa
from tracefold.operators import traces as tr
from tracefold.operators import transitions as tn
from tracefold.plans.core import _BASE, _nodes_sql, log_traces
from tracefold.sources import semi
from tracefold.sources.logs import table_log


def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_traces(spark, sf_dir, "events_by_day").unionByName(log_traces(spark, sf_dir, "lineitem")).unionByName(log_traces(spark, sf_dir, "conversations"))
    out = sa.diagnose(sa.histogram(rows))
    return out.select("log", F.col("k").cast("long").alias("k"), *(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c not in ("log", "k")))


_SATURATION = " UNION ALL ".join(f"SELECT '{k}' AS log, seq FROM ({_BASE[k]})" for k in ("events_by_day", "lineitem", "conversations"))
_DIAGNOSED = f"""WITH t AS (SELECT log, len(seq) AS l, array_to_string(seq, '|') AS v FROM ({_SATURATION}) WHERE len(seq) > 0),
x AS (SELECT log, k, l, v, CASE WHEN k = 1 THEN l ELSE greatest(1, l + 3 - k) END AS w FROM t, (SELECT unnest([1, 2, 3, 5, 10, 15, 20]) AS k)),
d AS (SELECT log, CAST(k AS BIGINT) AS k, count(*) AS n_cases, count(DISTINCT v) AS n_variants, median(l) AS median_length, max(l) AS max_length, count(*) FILTER (w = 1) AS complete_cases, count(DISTINCT v) FILTER (w = 1) AS complete_variants, CAST(sum(w) AS BIGINT) AS n_occurrences FROM x GROUP BY 1, 2)"""


def cross_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_traces(spark, sf_dir, "events_by_day").unionByName(log_traces(spark, sf_dir, "lineitem")).unionByName(log_traces(spark, sf_dir, "conversations"))
    out = sa.cross_log(sa.diagnose(sa.histogram(rows)))
    return out.select(F.col("k").cast("long").alias("k"), "logs", F.round("median_share", 9).alias("median_share"), *(f"logs_{t}" for t in sa.THRESHOLDS))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero rows: the identities hold."""
    return sa.violations(sa.diagnose(sa.histogram(log_traces(spark, sf_dir, "events_by_day")))).select("log", "k")


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log_traces(spark, sf_dir, "events_by_day")
    counted = None
    for k in sa.KS:
        part = tr.occurrences(rows, f"n{k}").groupBy("log").agg(F.count("*").alias("extracted")).withColumn("k", F.lit(k))
        counted = part if counted is None else counted.unionByName(part)
    out = sa.checked_totals(counted, sa.diagnose(sa.histogram(rows)))
    return out.select(F.col("k").cast("long").alias("k"), "n_occurrences", "extracted", "agrees")


def transition(k: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tn.summary(log_traces(spark, sf_dir, "events_by_day"), k).drop("log", "k")

    names = lambda n: f"SELECT case_id, unnest(n) AS node, unnest(range(len(n))) AS pos, l FROM (SELECT case_id, {_nodes_sql(f'n{n}')} AS n, len(seq) AS l FROM t)"
    complete = lambda n: f"l + 2 <= {n}" if n >= 2 else "false"
    back = 1 if k == 1 else 0
    sql = f"""WITH t AS ({_BASE["events_by_day"]}), s AS (SELECT case_id, pos, array_to_string(node, '|') AS node, {complete(k)} AS c FROM ({names(k)})),
g AS (SELECT case_id, array_to_string(node, '|') AS node, {complete(k + 1)} AS c, {"pos = 0" if k == 1 else "false"} AS intro, CASE WHEN {complete(k + 1)} THEN 0 ELSE pos - {back} END AS at FROM ({names(k + 1)})),
j AS (SELECT g.*, CASE WHEN NOT intro THEN s.node END AS parent FROM g LEFT JOIN s ON s.case_id = g.case_id AND s.pos = g.at),
ch AS (SELECT parent AS node, count(DISTINCT node) AS children, count(*) AS linked FROM j WHERE parent IS NOT NULL GROUP BY 1),
st AS (SELECT node, count(*) AS n, bool_or(c) AS c FROM s GROUP BY 1),
p AS (SELECT st.*, coalesce(children, 0) AS children, coalesce(linked, 0) AS linked FROM st LEFT JOIN ch USING (node)),
tt AS (SELECT node, count(*) AS n, bool_or(c) AS c, bool_or(intro) AS intro FROM j GROUP BY 1)
SELECT count(*) AS source_types, CAST(sum(n) AS BIGINT) AS source_occurrences, count(*) FILTER (c) AS complete_types, count(*) FILTER (NOT c AND children > 1) AS branching_types, count(*) FILTER (NOT c AND children = 1) AS single_types, count(*) FILTER (NOT c AND children = 0) AS exhausted_types, CAST(sum(linked) AS BIGINT) AS linked_occurrences,
 (SELECT count(*) FROM tt) AS target_types, (SELECT CAST(sum(n) AS BIGINT) FROM tt) AS target_occurrences, (SELECT count(*) FROM tt WHERE c) AS target_complete_types, (SELECT CAST(coalesce(sum(n) FILTER (intro), 0) AS BIGINT) FROM tt) AS introduced_occurrences,
 (SELECT count(*) FROM tt WHERE c AND node NOT IN (SELECT node FROM st WHERE c)) AS newly_complete_types FROM p"""
    return run, sql


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tn.overview(log_traces(spark, sf_dir, "events_by_day"), [1, 2, 3])


def _overview_sql(ks: tuple[int, ...] = (1, 2, 3)) -> str:
    long = " UNION ALL ".join(f"SELECT {k} AS k, metric, value FROM (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM ({transition(k)[1]})) ON COLUMNS(*) INTO NAME metric VALUE value)" for k in ks)
    return "SELECT 'events_by_day' AS log, metric, " + ", ".join(f'max(value) FILTER (k = {k}) AS "{k}"' for k in ks) + f" FROM ({long}) GROUP BY metric"


def _orders_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of orders, with the customer's segment-like status as variant."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return at.long_form(orders, "o_orderkey", ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"], "o_orderstatus")


def attribute_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = at.recommend(at.inventory(_orders_long(spark, sf_dir)))
    return out.select("attribute", "n_cases", "n_missing", "n_distinct", "n_numeric", F.round("minimum", 6).alias("minimum"), F.round("maximum", 6).alias("maximum"), F.round("median", 6).alias("median"), F.round("largest_share", 9).alias("largest_share"))


def attribute_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = at.recommend(at.inventory(_orders_long(spark, sf_dir)))
    return out.select("attribute", "inferred_type", "include_suggested", "binning_suggested", "reason_suggested")


#: Ways to write the orders' dates: attribute, Spark's layout, the same in SQL, and what the layout found must be.
_WRITTEN = (
    ("iso", "yyyy-MM-dd", "%Y-%m-%d", "yyyy-M-d"),
    ("dotted", "dd.MM.yyyy", "%d.%m.%Y", "d.M.yyyy"),
    ("slashed", "MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p", "M/d/yyyy h:m a"),
    ("dashed", "d-M-yyyy", "%-d-%-m-%Y", "d-M-yyyy"),
    ("named", "dd MMM yyyy", "%d %b %Y", "d MMM yyyy"),
    ("spelled", "MMMM d, yyyy", "%B %-d, %Y", "MMM d, yyyy | MMMM d, yyyy"),  # May is its own short form
)


def date_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' dates written in six ways, and with offsets: the layout that each attribute turns out to have, and the days that come out of it."""
    day = F.col("o_orderdate").cast("timestamp")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    texts = [F.struct(F.lit(a).alias("attribute"), F.date_format(day, p).alias("value")) for a, p, _, _ in _WRITTEN]
    texts.append(F.struct(F.lit("offset").alias("attribute"), F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("value")))
    texts.append(F.struct(F.lit("key").alias("attribute"), F.concat(F.col("o_orderkey").cast("string"), F.lit("-1-2")).alias("value")))
    rows = orders.select(F.explode(F.array(*texts)).alias("t")).select("t.*")
    layouts = dates.date_layouts(rows)
    found = spark.createDataFrame([(a, p) for a, _, p, _ in layouts], "attribute string, layout string").groupBy("attribute").agg(F.array_join(F.array_sort(F.collect_set("layout")), " | ").alias("layout"))
    out = dates.with_moments(rows, layouts).groupBy("attribute").agg(F.count("*").alias("n"), F.count("moment").alias("n_dates"), F.min("moment").cast("string").alias("first"), F.max("moment").cast("string").alias("last"), F.count_distinct("moment").alias("days"))
    return out.where("n_dates >= 0.8 * n").join(found, "attribute", "left")


def _date_layouts_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{a}' AS attribute, '{p}' AS layout, strptime(strftime(CAST(o_orderdate AS TIMESTAMP), '{f}'), '{f}') AS t FROM orders" for a, _, f, p in _WRITTEN)
    zoned = """SELECT 'offset' AS attribute, 'yyyy-M-d''T''H:m:sxxx' AS layout, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 2 HOUR AS t FROM orders"""
    return f"SELECT attribute, count(*) AS n, count(t) AS n_dates, strftime(min(t), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last, count(DISTINCT t) AS days, layout FROM ({each} UNION ALL {zoned}) GROUP BY attribute, layout"


def _props_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case table of a user's days: first values of whatever the events' ``props`` hold, and of their ``value``; the day's event types are its variant."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    case = F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyy-MM-dd")).alias("case_id")
    rows = semi.parsed(events.select(case, "ts", "event_id", "event_type", "value", "props"), "props")
    keys = ["case_id", "ts", "event_id"]
    plain = rows.select(*keys, F.lit("value").alias("attribute"), F.col("value").cast("string").alias("value"))
    found = semi.first_of_case(semi.attribute_rows(rows, keys).drop("type").unionByName(plain), ["case_id"], F.struct("ts", "event_id"))
    variants = tr.traces(table_log(spark, sf_dir, "events_by_day")).select("case_id", F.array_join("seq", "|").alias("variant"))
    return semi.with_absent(stored(found, "case-attributes"), variants, ["case_id"])


def props_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = at.recommend(at.inventory(_props_cases(spark, sf_dir)))
    numbers = (F.round(c, 6).alias(c) for c in ("minimum", "maximum", "average", "median"))
    return out.select("attribute", "level", "n_cases", "n_missing", "n_distinct", "n_numeric", *numbers, F.round("largest_share", 9).alias("largest_share"), "inferred_type", "include_suggested", "binning_suggested", "reason_suggested")


def props_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case attributes end to end: inventory, recommendation, bins of what is continuous, association with variants, and whether a power law is worth a test."""
    cases = stored(_props_cases(spark, sf_dir), "cases")
    inv = at.recommend(at.inventory(cases))
    wanted = inv.where("include_suggested").select("attribute", "inferred_type")
    used = cases.join(wanted, "attribute")
    cut = at.edges(used.where("inferred_type = 'continuous'"), "log", 10)
    binned = at.binned(used, cut).withColumn("value", F.when(F.col("inferred_type") == "continuous", F.col("bin")).otherwise(F.col("value")))
    joined = inv.join(at.associations(binned.select("attribute", "value", "variant")).drop("n_cases"), "attribute")
    out = at.recommend_powerlaw(joined)
    return out.select("attribute", "inferred_type", *(F.round(c, 7).alias(c) for c in ("h_variant", "h_attribute", "h_conditional", "ner")), "powerlaw_include", "powerlaw_discrete", "powerlaw_reason")


def _typed_sql(rows: str, level: bool = False) -> str:
    """Inventory, type and recommendation of ``r`` (attribute, level, v), in the order of the rules."""
    own = "attribute, level" if level else "attribute"
    event = "level = 'event'" if level else "false"
    suffixes = " OR ".join(f"ends_with(attribute, '{s}')" for s in at.EXCLUDED_SUFFIXES)
    return f"""{rows},
c AS (SELECT {own}, v, count(*) AS n, TRY_CAST(replace(trim(v), ',', '') AS DOUBLE) AS x, v IS NOT NULL AND lower(trim(v)) IN ('true', 'false', '0', '1') AS b FROM r GROUP BY ALL),
i AS (SELECT {own}, CAST(sum(n) AS BIGINT) AS n_cases, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS n_missing, count(v) AS n_distinct, CAST(coalesce(sum(n) FILTER (x IS NOT NULL), 0) AS BIGINT) AS n_numeric,
 coalesce(sum(n) FILTER (b), 0) AS n_bool, coalesce(sum(n) FILTER (x IS NULL AND TRY_CAST(v AS TIMESTAMP) IS NOT NULL), 0) AS n_dates, min(x) AS minimum, max(x) AS maximum, sum(x * n) / sum(n) FILTER (x IS NOT NULL) AS average,
 coalesce(max(n) FILTER (v IS NOT NULL) / sum(n), 0) AS largest_share, coalesce(bool_and(abs(x - round(x)) <= 1e-9), false) AS whole FROM c GROUP BY ALL),
md AS (SELECT attribute, median(TRY_CAST(replace(trim(v), ',', '') AS DOUBLE)) AS median FROM r GROUP BY attribute),
k AS (SELECT i.*, median, n_cases - n_missing AS present, CASE WHEN n_cases = n_missing THEN 'unsupported' WHEN n_bool = n_cases - n_missing THEN 'boolean' WHEN n_dates >= 0.8 * (n_cases - n_missing) THEN 'datetime'
 WHEN n_distinct / (n_cases - n_missing) >= 0.95 OR (n_distinct / (n_cases - n_missing) >= 0.90 AND n_distinct >= 1000) OR (regexp_matches(attribute, '{at.ID_NAME}') AND n_distinct >= greatest(10, floor((n_cases - n_missing) * 0.5))) THEN 'identifier-like'
 WHEN n_numeric = n_cases - n_missing AND n_distinct >= 20 THEN 'continuous' ELSE 'categorical' END AS inferred_type FROM i JOIN md USING (attribute)),
x AS (SELECT *, CASE WHEN inferred_type = 'unsupported' THEN 'unsupported values' WHEN inferred_type = 'datetime' THEN 'datetime without a transformation' WHEN inferred_type = 'identifier-like' THEN 'identifier'
 WHEN n_distinct <= 1 OR largest_share >= 0.98 THEN 'constant or near constant' WHEN starts_with(attribute, 'org:resource') THEN 'resource' WHEN {suffixes} THEN 'not a first-value aggregate'
 WHEN {event} AND NOT ends_with(attribute, '{at.EVENT_AGGREGATE}') THEN 'event attribute without an aggregate' WHEN n_missing / n_cases >= 0.5 THEN 'mostly missing' END AS excluded FROM k),
typed AS (SELECT *, excluded IS NULL AS include_suggested, coalesce(excluded, concat(inferred_type, CASE WHEN {event} AND ends_with(attribute, '{at.EVENT_AGGREGATE}') THEN ' aggregate of an event attribute' ELSE ' case attribute' END)) AS reason_suggested,
 CASE WHEN excluded IS NULL AND inferred_type = 'continuous' THEN 'log:10' END AS binning_suggested FROM x)"""


_ORDER_ROWS = "WITH r AS (SELECT unnest(['o_custkey', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS attribute, unnest([CAST(o_custkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderpriority]) AS v FROM orders)"
_PROPS_ROWS = """WITH ev AS (SELECT concat(user_id, '_', strftime(ts, '%Y-%m-%d')) AS case_id, ts, event_id, event_type, value, TRY_CAST(props AS JSON) AS p FROM events),
leaf AS (SELECT case_id, ts, event_id, concat(name, '__first') AS attribute, json_extract_string(p, '$."' || name || '"') AS v FROM (SELECT *, unnest(json_keys(p)) AS name FROM ev)
 UNION ALL SELECT case_id, ts, event_id, 'value__first', CAST(value AS VARCHAR) FROM ev),
firsts AS (SELECT case_id, attribute, arg_min(v, row(ts, event_id)) AS v FROM leaf WHERE v IS NOT NULL GROUP BY 1, 2),
days AS (SELECT case_id, string_agg(event_type, '|' ORDER BY ts, event_id) AS variant FROM ev GROUP BY 1),
r AS (SELECT days.case_id, variant, n.attribute, 'event' AS level, firsts.v FROM days CROSS JOIN (SELECT DISTINCT attribute FROM firsts) n LEFT JOIN firsts ON firsts.case_id = days.case_id AND firsts.attribute = n.attribute)"""
_PROPS_BINS = """, u AS (SELECT r.*, typed.inferred_type, TRY_CAST(r.v AS DOUBLE) AS num FROM r JOIN typed USING (attribute) WHERE include_suggested),
ed AS (SELECT attribute, list(CASE WHEN i = 0 THEN a WHEN i = 10 THEN b ELSE pow(10, log10(a) + (log10(b) - log10(a)) * i / 10) END ORDER BY i) AS e
 FROM (SELECT attribute, min(num) FILTER (num > 0) AS a, max(num) FILTER (num > 0) AS b FROM u WHERE inferred_type = 'continuous' GROUP BY 1), (SELECT CAST(unnest(range(11)) AS DOUBLE) AS i) GROUP BY 1),
bn AS (SELECT u.attribute, variant, CASE WHEN inferred_type <> 'continuous' THEN coalesce(v, '__MISSING__') WHEN num IS NULL THEN '__MISSING__' WHEN num <= 0 THEN '__NONPOSITIVE__' ELSE CAST(greatest(len(list_filter(e, lambda y: y < num)), 1) AS VARCHAR) END AS a FROM u LEFT JOIN ed USING (attribute)),
cc AS (SELECT attribute, a, variant, CAST(count(*) AS DOUBLE) AS n FROM bn GROUP BY ALL), cx AS (SELECT attribute, a, sum(n) AS n, sum(n * log2(n)) AS s FROM cc GROUP BY ALL), cy AS (SELECT attribute, variant, sum(n) AS n FROM cc GROUP BY ALL),
ha AS (SELECT attribute, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h_attribute, sum(n * log2(n) - s) / sum(n) AS h_conditional FROM cx GROUP BY 1), hv AS (SELECT attribute, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h_variant FROM cy GROUP BY 1),
z AS (SELECT typed.*, h_variant, h_attribute, h_conditional, greatest(0, h_variant - h_conditional) / h_variant AS ner, CASE WHEN NOT include_suggested THEN 'not included in the first step' WHEN largest_share >= 0.98 THEN 'near constant'
 WHEN inferred_type = 'continuous' AND present < 50 THEN 'too few observations' WHEN inferred_type <> 'continuous' AND n_distinct < 50 THEN 'too few values' END AS barred FROM typed JOIN ha USING (attribute) JOIN hv USING (attribute))
SELECT attribute, inferred_type, round(h_variant, 7) AS h_variant, round(h_attribute, 7) AS h_attribute, round(h_conditional, 7) AS h_conditional, round(ner, 7) AS ner, barred IS NULL AS powerlaw_include, inferred_type <> 'continuous' OR whole AS powerlaw_discrete,
 coalesce(barred, concat(CASE WHEN ner >= 0.99 THEN 'may encode the variant; ' WHEN ner >= 0.05 THEN 'relevant to variants; ' ELSE '' END, CASE WHEN inferred_type = 'continuous' THEN 'magnitudes' ELSE 'frequencies' END)) AS powerlaw_reason FROM z"""


def attribute_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_month", F.date_format("o_orderdate", "MM"))
    out = at.associations(at.long_form(orders, "o_orderkey", ["o_orderpriority", "o_month"], "o_orderstatus"))
    return out.select("attribute", "n_cases", *(F.round(c, 7).alias(c) for c in ("h_variant", "h_attribute", "h_conditional", "er", "ner", "nmi")))


_ASSOCIATION = """WITH r AS (SELECT o_orderstatus AS v, unnest(['o_orderpriority', 'o_month']) AS attribute, unnest([o_orderpriority, strftime(o_orderdate, '%m')]) AS a FROM orders),
c AS (SELECT attribute, a, v, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY ALL), x AS (SELECT attribute, a, sum(n) AS n, sum(n * log2(n)) AS s FROM c GROUP BY ALL), y AS (SELECT attribute, v, sum(n) AS n FROM c GROUP BY ALL),
ha AS (SELECT attribute, sum(n) AS n, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h_attribute, sum(n * log2(n) - s) / sum(n) AS h_conditional FROM x GROUP BY 1), hv AS (SELECT attribute, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h_variant FROM y GROUP BY 1)
SELECT attribute, CAST(n AS BIGINT) AS n_cases, round(h_variant, 7) AS h_variant, round(h_attribute, 7) AS h_attribute, round(h_conditional, 7) AS h_conditional, round(greatest(0, h_variant - h_conditional), 7) AS er, round(greatest(0, h_variant - h_conditional) / h_variant, 7) AS ner, round(2 * greatest(0, h_variant - h_conditional) / (h_variant + h_attribute), 7) AS nmi FROM ha JOIN hv USING (attribute)"""


def attribute_bins(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = at.long_form(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey", ["o_totalprice"])
        return at.binned(rows, at.edges(rows, method, 10)).groupBy("bin").agg(F.count("*").alias("n"))

    low = {"log": "pow(10, log10(a) + (log10(b) - log10(a)) * i / 10)", "linear": "a + (b - a) * i / 10"}
    if method == "quantile":
        e = "SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM v"
    else:
        e = f"SELECT list(CASE WHEN i = 0 THEN a WHEN i = 10 THEN b ELSE {low[method]} END ORDER BY i) AS e FROM (SELECT min(x) AS a, max(x) AS b FROM v), (SELECT CAST(unnest(range(11)) AS DOUBLE) AS i)"
    sql = f"WITH v AS (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders), e AS ({e}) SELECT CAST(greatest(len(list_filter(e, lambda y: y < x)), 1) AS VARCHAR) AS bin, count(*) AS n FROM v, e GROUP BY 1"
    return run, sql


def attribute_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return at.permutation_p(at.long_form(orders, "o_orderkey", ["o_orderpriority"], "o_orderstatus"))


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero rows: no activity is called like the padding."""
    return tr.boundary_collisions(log_traces(spark, sf_dir, "events_by_day"))


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table_log(spark, sf_dir, "events_by_day").withColumn("event_pos", F.col("o.event_id"))
    return tr.relabelled(tr.prefixed(events, "a")).groupBy("case_id").agg(F.count("*").alias("n"), F.min("activity").alias("least"))


def build() -> tuple[dict, dict]:
    q = {"saturation": saturation, "saturation_cross_log": cross_log, "saturation_violations": violations, "saturation_extracted": extracted, "transition_overview": overview, "attribute_inventory": attribute_inventory, "attribute_types": attribute_types, "date_layouts": date_layouts, "props_inventory": props_inventory, "props_association": props_association, "attribute_association": attribute_association, "attribute_permutation": attribute_permutation, "boundary_collisions": collisions, "relabelled_cases": relabelled}
    s = {
        "saturation": _DIAGNOSED + " SELECT *, round(complete_cases / n_cases, 9) AS complete_case_share, round(complete_variants / n_variants, 9) AS complete_variant_share, round(complete_cases / n_occurrences, 9) AS complete_occurrence_share, n_occurrences - n_cases AS excess, round((n_occurrences - n_cases) / n_cases, 9) AS excess_per_case FROM d",
        "saturation_cross_log": _DIAGNOSED + ", s AS (SELECT k, complete_cases / n_cases AS h, CAST(printf('%.1f', 100 * complete_cases / n_cases) AS DOUBLE) AS p FROM d) SELECT k, count(*) AS logs, round(median(h), 9) AS median_share, " + ", ".join(f"count(*) FILTER (p >= {t}) AS logs_{t}" for t in sa.THRESHOLDS) + " FROM s GROUP BY k",
        "saturation_violations": "SELECT '' AS log, 0 AS k WHERE false",
        "saturation_extracted": _DIAGNOSED + " SELECT k, n_occurrences, n_occurrences AS extracted, true AS agrees FROM d WHERE log = 'events_by_day'",
        "attribute_inventory": """WITH r AS (SELECT unnest(['o_custkey', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS attribute, unnest([CAST(o_custkey AS VARCHAR), CAST(o_totalprice AS VARCHAR), CAST(o_orderdate AS VARCHAR), o_orderpriority]) AS v FROM orders),
c AS (SELECT attribute, v, count(*) AS n, TRY_CAST(v AS DOUBLE) AS x FROM r GROUP BY 1, 2) SELECT attribute, CAST(sum(n) AS BIGINT) AS n_cases, CAST(0 AS BIGINT) AS n_missing, count(*) AS n_distinct, CAST(coalesce(sum(n) FILTER (x IS NOT NULL), 0) AS BIGINT) AS n_numeric, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum,
 round((SELECT median(TRY_CAST(v AS DOUBLE)) FROM r WHERE r.attribute = c.attribute), 6) AS median, round(max(n) / sum(n), 9) AS largest_share FROM c GROUP BY attribute""",
        "attribute_types": _typed_sql(_ORDER_ROWS) + " SELECT attribute, inferred_type, include_suggested, binning_suggested, reason_suggested FROM typed",
        "date_layouts": _date_layouts_sql(),
        "transition_overview": _overview_sql(),
        "props_inventory": _typed_sql(_PROPS_ROWS, True) + " SELECT attribute, level, n_cases, n_missing, n_distinct, n_numeric, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(average, 6) AS average, round(median, 6) AS median, round(largest_share, 9) AS largest_share, inferred_type, include_suggested, binning_suggested, reason_suggested FROM typed",
        "props_association": _typed_sql(_PROPS_ROWS, True) + _PROPS_BINS,
        "attribute_association": _ASSOCIATION,
        "boundary_collisions": "SELECT 'events_by_day' AS log, event_type AS label FROM events WHERE event_type IN ('START', 'END')",
        "relabelled_cases": "WITH e AS (SELECT concat(user_id, '_', strftime(ts, '%Y-%m-%d')) AS c, event_id, event_type FROM events), g AS (SELECT c, min(event_id) AS f, count(*) AS n, concat('a:', min(event_type)) AS least FROM e GROUP BY 1) SELECT concat('case_', row_number() OVER (ORDER BY f, c)) AS case_id, n, least FROM g",
    }
    for k in (1, 2, 3, 5):
        q[f"transition_{k}"], s[f"transition_{k}"] = transition(k)
    for m in ("log", "linear", "quantile"):
        q[f"attribute_bins_{m}"], s[f"attribute_bins_{m}"] = attribute_bins(m)
    return q, s


QUERIES, SQL = build()
