"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import balltree, collocations, lexical, quality, warc
from .bytebpe import op3_byte_bpe
from .langid import op7_language_id
from .licenses import op4_license_scan
from .media import op6_media_columns
from .mixing import op2_mixing
from .pitmanyor import op10_lm_score
from .simhash import op1_simhash_near_dedup
from .tokencount import op9_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_mixing, op3_byte_bpe, op4_license_scan, quality.op5_quality_rules,
        op6_media_columns, op7_language_id, warc.op8_warc_revisits, op9_token_counts, op10_lm_score,
        collocations.op11_collocations, lexical.op12_lexical_search, balltree.op13_exact_top_k,
    )
}

ORACLE_SQL = {
    "op5_quality_rules": quality.ORACLE, "op8_warc_revisits": warc.ORACLE, "op11_collocations": collocations.ORACLE, "op12_lexical_search": lexical.ORACLE,
    "op13_exact_top_k": balltree.ORACLE,
}
