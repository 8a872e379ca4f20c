"""Every registered query of the library and its DuckDB SQL, gathered from the query modules."""

from __future__ import annotations

from pegtrail.plans import captures, core, decide, payload, replays, scalar, tree, trees


MODULES = (core, tree, trees, decide, captures, replays, scalar, payload)


def queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
