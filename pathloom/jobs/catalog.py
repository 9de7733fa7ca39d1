"""Registry of queries and their SQL, gathered from the operator modules."""

from __future__ import annotations

from pathloom.operators import chains, commands, contours, curves, iterative, logs, long_jobs, mesh, raster, rings, spatial, structure, sweeps, tabs, textures, transforms
from pathloom.sources import documents
from pathloom.streaming import commands as streams

MODULES = (commands, long_jobs, rings, raster, spatial, mesh, logs, transforms, sweeps, contours, curves, structure, textures, tabs, chains, documents, iterative, streams)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
