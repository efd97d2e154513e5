"""Registered queries over the driver's tables and their DuckDB SQL."""

from quadrille.plans import extras, motion, rasters, spatial, statistics, tables  # noqa: F401
from quadrille.plans.registry import entries


def queries():
    return {e.name: e.run for e in entries().values()}


def oracle_sql():
    return {e.name: e.sql for e in entries().values() if e.sql is not None}
