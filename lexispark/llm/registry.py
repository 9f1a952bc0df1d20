"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, language_id, media, mixing, repeats, secrets, simhash, token_counts, url_filter, vector_codes, warc

QUERIES = {
    "op1_media_chunks": media.op1_media_chunks,
    "op2_simhash": simhash.op2_simhash,
    "op3_secrets": secrets.op3_secrets,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc_revisits": warc.op7_warc_revisits,
    "op8_language_id": language_id.op8_language_id,
    "op9_bpe": bpe.op9_bpe,
    "op10_repeats": repeats.op10_repeats,
    "op11_divergence": divergence.op11_divergence,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLES = {
    "op3_secrets": secrets.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_warc_revisits": warc.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
