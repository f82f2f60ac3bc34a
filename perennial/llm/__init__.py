"""Operators of a training-data pipeline, and their queries. Nothing else in the library imports this subpackage."""

from . import collocations, decontaminate, dimension_scan, fill_in_middle, jaccard, language_id, licences, packing, pii, quality_rules, substring_dedup, suffix_dedup, token_counts

_MODULES = (decontaminate, packing, suffix_dedup, jaccard, substring_dedup, pii, licences, token_counts, language_id, quality_rules, dimension_scan, fill_in_middle, collocations)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
