"""SQL table functions over traces: n-grams, attachments and links for queries in SQL text.

Each is a SQL function whose body the optimizer puts in place of the call, so a lateral call has the same plan as the DataFrame operator and runs no Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_WHOLE = "CASE WHEN n >= 2 THEN concat(array('START'), seq, array('END')) ELSE seq END"
_NODES = f"""CASE WHEN size(seq) = 0 OR seq IS NULL THEN CAST(array() AS ARRAY<ARRAY<STRING>>) WHEN n >= 2 AND size(seq) + 2 <= n THEN array({_WHOLE})
 ELSE transform(sequence(1, size({_WHOLE}) - n + 1), i -> slice({_WHOLE}, i, n)) END"""
_COMPLETE = "n >= 2 AND size(seq) + 2 <= n"
FUNCTIONS = {
    # the n-grams of a trace by place
    "trace_ngrams": ("seq ARRAY<STRING>, n INT", "pos INT, node ARRAY<STRING>, is_complete BOOLEAN", f"SELECT g.pos, g.node, {_COMPLETE} FROM (SELECT posexplode({_NODES}) AS (pos, node)) g"),
    # its directly-follows pairs, without padding
    "trace_links": ("seq ARRAY<STRING>", "pos INT, src STRING, dst STRING", "SELECT i - 1, seq[i - 1], seq[i] FROM (SELECT explode(CASE WHEN size(seq) > 1 THEN sequence(1, size(seq) - 1) ELSE CAST(array() AS ARRAY<INT>) END) AS i)"),
    # the attachments of a completed trace: its time and each node, in order
    "trace_attachments": ("seq ARRAY<STRING>, completion TIMESTAMP, n INT", "attachment_time TIMESTAMP, pos INT, node ARRAY<STRING>", f"SELECT completion, g.pos, g.node FROM (SELECT posexplode({_NODES}) AS (pos, node)) g WHERE completion IS NOT NULL"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session (again, if need be)."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")
