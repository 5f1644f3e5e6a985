"""Dates in text, by their shape: what a value's tokens are says which layouts it can have, its attribute says which of them it has.

A value's shape names its tokens (``N4-N2-N2``, ``N2 MON N4``); shapes that the grammar knows are counted an attribute, natively. A shape fixes the layout but for the
order of day and month, which an attribute's values decide together: numbers above 12 can only be days. Every value is then parsed once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Characters beyond which a text is no date.
LONGEST = 48
_TOKEN = "[0-9]+|[A-Za-z]+|[^0-9A-Za-z]"
_ZONE = r"(Z|UTC|GMT|[+-]N2:N2|[+-]N4|[+-]N2)"
_TIME = r"N[12]:N2(:N2([.,]N[1-9])?)?( ?AP)?"
_DATE = r"(N4([-/.])N[12]\2N[12]|N[12]([-/.])N[12]\3N4|N[12]([-/. ])(MON|MONTH)\4N4|(MON|MONTH) N[12],? N4|N[12]\. (MON|MONTH) N4)"
GRAMMAR = rf"^{_DATE}((T| |, ){_TIME}( ?{_ZONE})?)?$"
_WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +"


def stripped(value: Column) -> Column:
    """The value without white space around it and without a weekday before it; null where it is too long for a date."""
    text = F.trim(value)
    return F.when(F.length(text) <= LONGEST, F.regexp_replace(text, _WEEKDAY, ""))


def shape_of(value: Column) -> Column:
    """``N4-N2-N2 N2:N2`` and the like of a stripped value: numbers with their lengths, names by kind, all else as it is."""
    tokens = F.regexp_extract_all(value, F.lit(_TOKEN), F.lit(0))

    def named(t: Column) -> Column:
        low = F.lower(t)
        short = [m[:3] for m in MONTHS]
        return (
            F.when(t.rlike("^[0-9]"), F.concat(F.lit("N"), F.length(t).cast("string"))).when(low.isin(*short), "MON").when(low.isin(*MONTHS), "MONTH")
            .when(low.isin("am", "pm"), "AP").when(low.isin("t", "z", "utc", "gmt"), F.upper(t)).when(t.rlike("^[A-Za-z]"), "W").otherwise(t)
        )

    return F.array_join(F.transform(tokens, named), "")


def layouts_of(shape: str) -> list[str]:
    """The layouts of a shape that the grammar knows: one, or day first and month first."""
    tokens = re.findall(r"N[0-9]+|MONTH|MON|AP|UTC|GMT|.", shape)
    named = any(t.startswith("MON") for t in tokens)
    orders = ["yMd"] if tokens[0] == "N4" else ["dy"] if named else ["dMy", "Mdy"]
    out = []
    for order in orders:
        date, clock = list(order), ["h" if "AP" in tokens else "H", "m", "s", "S"]
        layout, zone = "", False
        for i, t in enumerate(tokens):
            if t[0] == "N" and t[1:].isdigit():
                if date:
                    field = date.pop(0)
                    layout += "yyyy" if field == "y" else field
                elif zone:
                    layout += {"N2": "x", "N4": "xx"}[t] if layout[-1] != "x" else "xx"
                else:
                    field = clock.pop(0)
                    layout += field * int(t[1:]) if field == "S" else field
            elif t.startswith("MON"):
                layout += "MMMM" if t == "MONTH" else "MMM"
            elif t == "AP":
                layout += "a"
            elif t in ("Z", "UTC", "GMT"):
                layout, zone = layout + ("XXX" if t == "Z" else "z"), True
            elif t in "+-" and not date:
                zone = True  # the sign belongs to the offset
            elif t == ":" and zone:
                pass
            else:
                layout += "'T'" if t == "T" else t
        out.append(layout)
    return out


def date_layouts(rows: DataFrame, times: str | None = None) -> list[tuple[str, str, str, int]]:
    """``attribute, shape, layout, values`` of all shapes that can be dates; as many as attributes and shapes of the grammar. ``times``: the column that says how often a row's value occurs.

    Day and month: more values whose first number is above 12 than whose second is mean day first, fewer mean month first. Attributes without a majority
    go by their separator: day first for dots, else month first. Shapes with one separator decide together.
    """
    text = stripped(F.col("value"))
    times_of = F.col(times) if times else F.lit(1)
    shaped = rows.select("attribute", text.alias("text"), times_of.cast("long").alias("times")).where("text is not null").select("attribute", "text", "times", shape_of(F.col("text")).alias("shape")).where(F.col("shape").rlike(GRAMMAR))
    at = lambda i: F.regexp_extract("text", r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.][0-9]{4}", i).try_cast("int") > 12
    counts = shaped.groupBy("attribute", "shape").agg(F.sum("times").alias("n"), *(F.sum(F.when(at(i), F.col("times")).otherwise(0)).alias(c) for i, c in ((1, "first"), (2, "second")))).collect()
    votes: dict[tuple[str, str], int] = {}
    separator = lambda shape: re.sub("N[0-9]", "", shape)[:1]
    for r in counts:
        key = r["attribute"], separator(r["shape"])
        votes[key] = votes.get(key, 0) + r["first"] - r["second"]
    out = []
    for r in counts:
        layouts, vote = layouts_of(r["shape"]), votes[r["attribute"], separator(r["shape"])]
        month_first = len(layouts) > 1 and (vote < 0 or vote == 0 and separator(r["shape"]) != ".")
        out.append((r["attribute"], r["shape"], layouts[-1] if month_first else layouts[0], r["n"]))
    return sorted(out)


def with_moments(rows: DataFrame, layouts: list[tuple[str, str, str, int]] | None = None, name: str = "moment") -> DataFrame:
    """``rows`` (``attribute, value``) with the timestamp that each value is by its attribute's layout; null for what is no date. Plain numbers are none."""
    layouts = date_layouts(rows) if layouts is None else layouts
    if not layouts:
        return rows.withColumn(name, F.lit(None).cast("timestamp"))
    table = rows.sparkSession.createDataFrame([(a, s, p) for a, s, p, _ in layouts], "attribute string, _shape string, _layout string")
    shaped = rows.withColumn("_text", stripped(F.col("value"))).withColumn("_shape", shape_of(F.col("_text"))).join(table, ["attribute", "_shape"], "left")
    parsed = F.lit(None).cast("timestamp")
    for p in sorted({p for _, _, p, _ in layouts}):
        parsed = F.when(F.col("_layout") == p, F.try_to_timestamp("_text", F.lit(p))).otherwise(parsed)
    return shaped.withColumn(name, parsed).select(*rows.columns, name)
