"""All queries over the driver's tables and the SQL that they are held against."""

from __future__ import annotations

from tracefold.plans import behaviour, core, orders, outcomes, simulation, tables

MODULES = (core, behaviour, orders, outcomes, simulation, tables)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: s for m in MODULES for name, s in m.SQL.items()}
