"""Case attributes: inventory, type inference, binning, and association with variants."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.storage import stored
from tracefold.operators import dates

MISSING, NONPOSITIVE = "__MISSING__", "__NONPOSITIVE__"
RESERVED = frozenset(("case_id", "variant"))
NOISE_EVENT_KEYS = frozenset(("concept:name", "time:timestamp", "lifecycle:transition"))
# Names that suggest identifiers, and suffixes of event aggregates that are left out unless asked for.
ID_NAME = r"(?i)((^|[_:])id($|[_:])|uuid|case|concept:name|\bkey\b)"
EVENT_AGGREGATE = "__first"
EXCLUDED_SUFFIXES = ("__constant", "__last", "__mode", "__n_unique")


def case_table(traces: DataFrame, variant: Column | None = None, classifier: Sequence[str] = ()) -> DataFrame:
    """XES traces as long rows ``log, case_id, variant, attribute, level, value``: case attributes, and each event attribute's first value that isn't missing (``__first``).

    The fields of the activity ``classifier`` are what variants are made of, and no attributes.
    """
    rows = traces.where(F.size("events") > 0)
    named = F.array_join(F.transform("events", lambda e: F.coalesce(e["attrs"]["concept:name"], F.lit(""))), "|") if variant is None else variant
    base = rows.select("log", "case_id", named.alias("variant"), "case_attrs", "events")
    case = base.select("log", "case_id", "variant", F.explode("case_attrs").alias("attribute", "value")).where(F.col("attribute") != "concept:name").withColumn("level", F.lit("case"))
    event = base.select("log", "case_id", "variant", F.explode("events").alias("e")).select("log", "case_id", "variant", "e.pos", "e.ts", F.explode("e.attrs").alias("attribute", "value"))
    event = event.where(~F.col("attribute").isin(*NOISE_EVENT_KEYS, *classifier) & ~is_missing(F.col("value"))).groupBy("log", "case_id", "variant", "attribute").agg(F.min_by("value", F.struct("ts", "pos")).alias("value"))
    event = event.withColumns({"attribute": F.concat("attribute", F.lit("__first")), "level": F.lit("event")})
    return case.unionByName(event)


def long_form(cases: DataFrame, key: str, attributes: Sequence[str], variant: str | None = None) -> DataFrame:
    """A wide case table as rows ``case_id, variant, attribute, value`` (text)."""
    ids = [F.col(key).cast("string").alias("case_id"), (F.col(variant) if variant else F.lit(None).cast("string")).alias("variant")]
    kinds = dict(cases.dtypes)
    real = lambda a: F.nanvl(F.col(a), F.lit(None)) if kinds[a] in ("double", "float") else F.col(a)
    wide = cases.select(*ids, *(real(a).cast("string").alias(a) for a in attributes))
    return wide.unpivot(["case_id", "variant"], list(attributes), "attribute", "value")


def is_missing(value: Column) -> Column:
    """Null. Texts are values, ``nan`` and blanks too; not-a-number becomes null where numbers turn to text."""
    return value.isNull()


def number(value: Column) -> Column:
    """Text with or without thousands separators as a double, else null."""
    return F.try_cast(F.replace(F.trim(value), F.lit(","), F.lit("")), "double") if hasattr(F, "try_cast") else F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("double")


def candidates(rows: DataFrame) -> DataFrame:
    """The attributes' names, without the reserved columns, in order."""
    return rows.select("attribute").where(~F.col("attribute").isin(*RESERVED)).distinct().orderBy("attribute")


def source_levels(rows: DataFrame, event_keys: DataFrame | None = None) -> DataFrame:
    """``attribute, level``: case wins over event, anything else is unknown; ``event_keys`` adds event attributes that have no column of their own."""
    found = rows.select("attribute", "level")
    if event_keys is not None:
        found = found.unionByName(event_keys.select("attribute", F.lit("event").alias("level")))
    known = F.when(F.bool_or(F.col("level") == "case"), "case").when(F.bool_or(F.col("level") == "event"), "event").otherwise("unknown")
    return found.where(~F.col("attribute").isin(*RESERVED)).groupBy("attribute").agg(known.alias("level"))


def whole_valued(value: Column, tolerance: float = 1e-9) -> Column:
    """Aggregate: whether all finite values are whole; false where there is none."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.coalesce(F.bool_and(F.when(finite, F.abs(value - F.rint(value)) <= tolerance)), F.lit(False))


def examples(rows: DataFrame, position: str = "case_id", many: int = 5) -> DataFrame:
    """``attribute, example_values``: each attribute's first different values, by the least position that has them."""
    firsts = rows.where(~is_missing(F.col("value"))).groupBy("attribute", "value").agg(F.min(position).alias("at"))
    ranked = firsts.withColumn("i", F.row_number().over(Window.partitionBy("attribute").orderBy("at", "value"))).where(F.col("i") <= many)
    return ranked.groupBy("attribute").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("example_values"))


def flat_inventory(inv: DataFrame, shown: DataFrame) -> DataFrame:
    """The inventory as flat text-friendly rows: example values joined by ``|``."""
    return inv.join(shown, "attribute", "left").withColumn("example_values", F.array_join("example_values", "|"))


def value_counts(values: DataFrame, column: str) -> DataFrame:
    """``value, n``: how often each value occurs, as text, most frequent first."""
    return values.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def missing_share(value: Column) -> Column:
    """Aggregate: the share of rows labelled missing."""
    return F.avg(F.when(value == MISSING, 1.0).otherwise(0.0))


def inventory(rows: DataFrame) -> DataFrame:
    """Per attribute: cases, missing, distinct values, the largest value's share of all cases, numeric summary, and the inferred type.

    ``value`` counts come first, so an attribute with one dominant value is summed before it is shuffled.
    """
    value = F.when(~is_missing(F.col("value")), F.col("value"))
    by = ["attribute", *(["level"] if "level" in rows.columns else [])]
    counts = rows.where(~F.col("attribute").isin(*RESERVED)).select(*by, value.alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))
    counts = stored(counts, "values")  # shapes and dates are looked for in different values
    counts = dates.with_moments(counts, dates.date_layouts(counts, "n")).withColumnRenamed("moment", "_moment")
    num = number(F.col("value"))
    here = F.col("value").isNotNull()
    truth = F.lower(F.trim("value")).isin("true", "false", "0", "1")
    weigh = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = counts.groupBy(*by).agg(
        F.sum("n").alias("n_cases"), weigh(~here).alias("n_missing"), F.count("value").alias("n_distinct"),
        F.max(F.when(here, F.col("n"))).alias("largest"), F.max_by(F.col("value"), F.when(here, F.struct(F.col("n"), F.col("value")))).alias("mode"),
        weigh(here & truth).alias("n_bool"), weigh(here & num.isNotNull()).alias("n_numeric"),
        weigh(here & num.isNull() & F.col("_moment").isNotNull()).alias("n_dates"), whole_valued(num).alias("whole_numbers"),
        F.min(num).alias("minimum"), F.max(num).alias("maximum"), (F.sum(num * F.col("n")) / F.sum(F.when(num.isNotNull(), F.col("n")))).alias("average"), F.percentile(num, 0.5, F.col("n")).alias("median"))
    present = F.col("n_cases") - F.col("n_missing")
    share = F.col("n_distinct") / present
    by_share = (share >= 0.95) | ((share >= 0.90) & (F.col("n_distinct") >= 1000))
    named = F.col("attribute").rlike(ID_NAME) & (F.col("n_distinct") >= F.greatest(F.lit(10), F.floor(present * 0.5)))
    numeric = (F.col("n_numeric") == present) & (F.col("n_distinct") >= 20)
    kind = (
        F.when(present == 0, "unsupported").when(F.col("n_bool") == present, "boolean").when(F.col("n_dates") >= 0.8 * present, "datetime")
        .when(by_share | named, "identifier-like").when(numeric, "continuous").otherwise("categorical")
    )
    largest = F.coalesce(F.col("largest") / F.col("n_cases"), F.lit(0.0))
    out = out.withColumns({"inferred_type": kind, "missing_share": F.col("n_missing") / F.col("n_cases"), "distinct_share": F.col("n_distinct") / F.col("n_cases"), "largest_share": largest})
    return out.withColumns({"is_constant": F.col("n_distinct") <= 1, "is_near_constant": F.col("largest_share") >= 0.98}).drop("n_bool", "n_dates", "largest")


def recommend(inv: DataFrame) -> DataFrame:
    """``include_suggested, type_suggested, binning_suggested, reason_suggested``; the first rule that holds decides. A ``level`` column tells case from event attributes."""
    kind, name = F.col("inferred_type"), F.col("attribute")
    event = (F.col("level") == "event") if "level" in inv.columns else F.lit(False)
    resource = name.startswith("org:resource")
    other_suffix = F.lit(False)
    for suffix in EXCLUDED_SUFFIXES:
        other_suffix = other_suffix | name.endswith(suffix)
    aggregate = name.endswith(EVENT_AGGREGATE)
    excluded = (
        F.when(kind == "unsupported", "unsupported values").when(kind == "datetime", "datetime without a transformation").when(kind == "identifier-like", "identifier")
        .when(F.col("is_constant") | F.col("is_near_constant"), "constant or near constant").when(resource, "resource").when(other_suffix, "not a first-value aggregate")
        .when(event & ~aggregate, "event attribute without an aggregate").when(F.col("missing_share") >= 0.5, "mostly missing")
    )
    usable = F.concat(kind, F.when(event & aggregate, " aggregate of an event attribute").otherwise(" case attribute"))
    out = inv.withColumns({"include_suggested": excluded.isNull(), "reason_suggested": F.coalesce(excluded, usable), "type_suggested": kind})
    return out.withColumn("binning_suggested", F.when(F.col("include_suggested") & (kind == "continuous"), "log:10"))


def resolved(suggested: Column, override: Column, default: Column | None = None) -> Column:
    """Override, else suggestion, else default; blanks count as absent."""
    blank = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(blank(override), blank(suggested), *([default] if default is not None else []))


def merge_overrides(new: DataFrame, old: DataFrame, columns: Sequence[str], key: str = "attribute") -> DataFrame:
    """New rows with the old rows' filled override columns; rows only in the old table go, repeated old ones count once."""
    first = old.groupBy(key).agg(*(F.first(c, ignorenulls=True).alias(f"_{c}") for c in columns))
    joined = new.join(first, key, "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(f"_{c}")), F.lit("")), F.col(c)) for c in columns}).drop(*(f"_{c}" for c in columns))


def edges(rows: DataFrame, method: str = "log", bins: int = 10) -> DataFrame:
    """``attribute, edges``: ``log``, ``linear`` or ``quantile``; degenerate ranges are padded, equal edges merged."""
    num = number(F.col("value"))
    if method == "quantile":
        shares = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
        return rows.groupBy("attribute").agg(F.array_sort(F.array_distinct(F.percentile(num, shares))).alias("edges"))
    usable = num if method == "linear" else F.when(num > 0, num)
    low, high = F.col("lo"), F.col("hi")
    ends = rows.groupBy("attribute").agg(F.min(usable).alias("lo"), F.max(usable).alias("hi")).where("lo IS NOT NULL")
    if method == "linear":
        ends = ends.withColumns({"lo": F.when(low == high, low - 0.5).otherwise(low), "hi": F.when(low == high, high + 0.5).otherwise(high)})
        cut = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins)
    else:
        ends = ends.withColumns({"lo": F.when(low == high, low / 1.1).otherwise(low), "hi": F.when(low == high, high * 1.1).otherwise(high)})
        cut = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.pow(F.lit(10.0), F.log10(F.col("lo")) + (F.log10(F.col("hi")) - F.log10(F.col("lo"))) * i / bins))
    fixed = F.concat(F.array("lo"), F.slice(cut, 2, bins - 1), F.array("hi"))
    return ends.select("attribute", F.array_distinct(fixed).alias("edges"))


def binned(rows: DataFrame, cut: DataFrame, nonpositive: bool = True) -> DataFrame:
    """``bin``: the 1-based right-closed interval (the lowest edge belongs to the first), or the label of what has none."""
    num = number(F.col("value"))
    joined = rows.join(F.broadcast(cut), "attribute", "left")  # one row an attribute
    at = F.greatest(F.size(F.filter("edges", lambda e: e < num)), F.lit(1))
    inside = (num >= F.element_at("edges", 1)) & (num <= F.element_at("edges", -1))
    label = F.when(is_missing(F.col("value")) | num.isNull(), MISSING)
    if nonpositive:
        label = label.when(num <= 0, NONPOSITIVE)
    return joined.withColumn("bin", label.when(inside, at.cast("string")).otherwise(MISSING)).drop("edges")


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Base-2 entropy of the counts within ``by``: log2(N) - sum(n log2 n) / N, a plain aggregate."""
    return counts.groupBy(*by).agg((F.log2(F.sum(n)) - F.sum(F.col(n) * F.log2(n)) / F.sum(n)).alias("entropy"))


def associations(rows: DataFrame, handling: str = "separate_category") -> DataFrame:
    """Per attribute: H(V), H(V|A), H(A), the reduction ER, NER = ER / H(V), NMI = 2 ER / (H(V) + H(A)). All attributes in one pass."""
    gone = is_missing(F.col("value"))
    marked = rows.withColumn("value", F.when(gone, MISSING).otherwise(F.col("value")))
    if handling == "drop_cases":
        marked = marked.where(F.col("value") != MISSING)
    cells = marked.groupBy("attribute", "value", "variant").agg(F.count("*").alias("n"))
    variants = cells.groupBy("attribute", "variant").agg(F.sum("n").alias("n"))
    values = cells.groupBy("attribute", "value").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    hv = entropy(variants, ["attribute"]).withColumnRenamed("entropy", "h_variant")
    side = values.groupBy("attribute").agg(
        F.sum("n").alias("n_cases"), F.count("*").alias("n_values"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h_attribute"),
        (F.sum(F.col("n") * F.log2("n") - F.col("s")) / F.sum("n")).alias("h_conditional"), F.max(F.when(F.col("value") == MISSING, 1).otherwise(0)).alias("has_missing"))
    kinds = variants.groupBy("attribute").agg(F.count("*").alias("n_variants"))
    out = side.join(hv, "attribute").join(kinds, "attribute")
    ok = (F.col("n_cases") >= 2) & (F.col("n_values") >= 2) & (F.col("n_variants") >= 2) & ~((F.lit(handling) == "exclude_attribute") & (F.col("has_missing") == 1))
    er = F.when(ok, F.greatest(F.lit(0.0), F.col("h_variant") - F.col("h_conditional"))).otherwise(0.0)
    return out.withColumns({"status": F.when(ok, "ok").otherwise("not_applicable"), "er": er}).withColumns({"ner": F.when(ok & (F.col("h_variant") > 0), F.col("er") / F.col("h_variant")), "nmi": F.when(ok & (F.col("h_variant") + F.col("h_attribute") > 0), 2 * F.col("er") / (F.col("h_variant") + F.col("h_attribute")))}).drop("has_missing")


def permutation_p(rows: DataFrame, replicates: int = 200, seed: int = 42, block: int = 20) -> DataFrame:
    """``attribute, er, p_value`` = (1 + #(ER >= observed)) / (1 + replicates), the attribute's values shuffled over its cases.

    A shuffle only matters by its contingency table, so tables are drawn from the two margins, value by value: what goes to a task is the counts of an
    attribute's values and variants, never its cases (of which there may be 10^9). Replicates are dealt in blocks with seeds of their own.
    """
    base = rows.withColumn("value", F.when(is_missing(F.col("value")), MISSING).otherwise(F.col("value")))
    margin = lambda c: base.groupBy("attribute", c).agg(F.count("*").alias("n")).groupBy("attribute").agg(F.array_sort(F.collect_list("n")).alias(c))
    seen = associations(base).select("attribute", "er")
    units = margin("value").join(margin("variant"), "attribute").join(seen, "attribute")
    blocks = F.sequence(F.lit(0), F.lit(-(-replicates // block) - 1))
    dealt = units.withColumns({"block": F.explode(blocks), "unit": F.xxhash64("attribute")}).repartition("attribute", "block")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                size = min(block, replicates - r.block * block)
                rng = np.random.default_rng([seed, r.unit & 0x7FFFFFFFFFFFFFFF, r.block])
                drawn = [_drawn_reduction(np.asarray(r.value, np.int64), np.asarray(r.variant, np.int64), rng) for _ in range(size)]
                out.append([r.attribute, r.er, sum(x >= r.er - 1e-12 for x in drawn), size])
            yield pd.DataFrame(out, columns=["attribute", "er", "hits", "n"])

    hits = dealt.mapInPandas(run, "attribute string, er double, hits long, n long")
    return hits.groupBy("attribute", "er").agg(((1 + F.sum("hits")) / (1 + F.sum("n"))).alias("p_value"))


def _drawn_reduction(values: np.ndarray, variants: np.ndarray, rng: np.random.Generator) -> float:
    """The entropy reduction of a random contingency table with these margins."""
    def weight(n: np.ndarray) -> float:
        n = n[n > 0]
        return float((n * np.log2(n)).sum())

    if min(len(values), len(variants), values.sum()) < 2:
        return 0.0
    left, inner = variants.copy(), 0.0
    for n in values[::-1]:
        row = rng.multivariate_hypergeometric(left, int(n), method="marginals")
        left -= row
        inner += weight(row)
    total = float(values.sum())
    h_variant = np.log2(total) - weight(variants) / total
    return max(0.0, h_variant - (weight(values) - inner) / total)


def recommend_powerlaw(joined: DataFrame, min_observations: int = 50, min_distinct: int = 50) -> DataFrame:
    """Step two, on inventory joined with associations: is the attribute worth a power-law test, and why not.

    Continuous attributes need observations, others need distinct values; whole-numbered magnitudes are fitted as discrete.
    """
    kind = F.col("inferred_type")
    relevance = F.when(F.col("ner") >= 0.99, "may encode the variant; ").when(F.col("ner") >= 0.05, "relevant to variants; ").otherwise("")
    enough = F.when(kind == "continuous", F.col("n_cases") - F.col("n_missing") >= min_observations).otherwise(F.col("n_distinct") >= min_distinct)
    barred = (
        F.when(~F.col("include_suggested"), "not included in the first step").when(kind.isin("datetime", "identifier-like", "unsupported"), "unsuitable type")
        .when(F.col("is_near_constant"), "near constant").when(~enough & (kind == "continuous"), "too few observations").when(~enough, "too few values")
    )
    discrete = F.when(kind == "continuous", F.coalesce("whole_numbers", F.lit(False))).otherwise(True)
    reason = F.coalesce(barred, F.concat(relevance, F.when(kind == "continuous", "magnitudes").otherwise("frequencies")))
    return joined.withColumns({"powerlaw_reason": reason, "powerlaw_include": barred.isNull(), "powerlaw_discrete": discrete})
