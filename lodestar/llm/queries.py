"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lodestar.llm.bpe import op6_bpe_round_trip
from lodestar.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from lodestar.llm.fill_in_middle import OP11_SQL, op11_fill_in_middle
from lodestar.llm.filter_audit import OP12_SQL, op12_filter_audit
from lodestar.llm.fingerprints import op2_fingerprint_edits
from lodestar.llm.html_extraction import op10_extract_pages
from lodestar.llm.language_id import op4_language_id
from lodestar.llm.language_model import op3_lm_score
from lodestar.llm.packing import op1_pack
from lodestar.llm.secret_scan import op13_secret_scan
from lodestar.llm.sharding import op5_ring_shards
from lodestar.llm.simhash_dedup import op8_simhash_components
from lodestar.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_pack": op1_pack,
    "op2_fingerprint_edits": op2_fingerprint_edits,
    "op3_lm_score": op3_lm_score,
    "op4_language_id": op4_language_id,
    "op5_ring_shards": op5_ring_shards,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_toxicity": op7_toxicity,
    "op8_simhash_components": op8_simhash_components,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_extract_pages": op10_extract_pages,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_secret_scan": op13_secret_scan,
}

SQL = {
    "op9_exact_dedup": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
