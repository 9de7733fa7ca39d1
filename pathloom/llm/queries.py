"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from pathloom.llm import jaccard, language, mixing, ogg, packing, pii, quality, search, spelling, suffixes, url_filter, warc, whitening

MODULES = (language, mixing, url_filter, jaccard, quality, search, packing, warc, ogg, pii, whitening, spelling, suffixes)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
