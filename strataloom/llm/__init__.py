"""Training-data operators: token counts, licence scans, BPE coding, fingerprints, WARC, token stores, dedup, packing, quality,
hard negatives, fill-in-middle, languages.

Nothing else in the library imports this subpackage.
"""
