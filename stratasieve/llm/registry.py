"""Queries of this subpackage and the SQL that gives the same rows."""

from . import decontaminate, language_id, license_scan, mixing, near_dedup, quality_classifier, quality_rules, quote_links, suffix_dedup, url_filter

_MODULES = (language_id, quote_links, quality_classifier, mixing, decontaminate, url_filter, license_scan, suffix_dedup, quality_rules, near_dedup)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
