"""All registered queries of the subpackage and their SQL."""

from . import chat, collocations, decontaminate, exact_dedup, licences, line_dedup, near_dedup, packing, periodic, pii, quality, substring_dedup, warc

MODULES = (pii, packing, quality, decontaminate, licences, warc, near_dedup, line_dedup, chat, exact_dedup, periodic, substring_dedup, collocations)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
