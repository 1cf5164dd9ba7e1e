"""Training-data operators: PII, packing, quality, decontamination, licences, WARC, near and exact dedup, line dedup, chat, periodic runs,
substring dedup, collocations.

Nothing outside this subpackage imports it.
"""
