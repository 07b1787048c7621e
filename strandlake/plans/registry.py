"""All non-corpus queries, gathered from the plan modules."""

from __future__ import annotations

from strandlake.plans import formats, genotypes, ranges, sites, streams, values

MODULES = (sites, genotypes, ranges, streams, values, formats)


def queries():
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
