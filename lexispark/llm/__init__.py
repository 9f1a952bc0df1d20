"""Training-data operators: media, dedup, filters, mixing, WARC, language ID and BPE.

Nothing outside this folder imports it; `registry` lists its queries.
"""
