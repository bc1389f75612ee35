"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .copied import op13_suffix_dedup
from .fingerprints import op1_winnowing
from .manifest import OP12_SQL, op12_merkle_manifest
from .mixing import op2_sainte_lague
from .near_dups import OP9_SQL, op9_super_minhash
from .packing import op10_pattern_packing
from .quality import OP6_SQL, op6_quality_cascade
from .repeats import op4_sentence_spans
from .resampling import OP11_SQL, op11_importance_resampling
from .secrets import op8_trigram_secrets
from .token_counts import op3_token_counts
from .token_files import op7_token_files
from .warc import OP5_SQL, op5_warc_normaliser

QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_sainte_lague": op2_sainte_lague,
    "op3_token_counts": op3_token_counts,
    "op4_sentence_spans": op4_sentence_spans,
    "op5_warc_normaliser": op5_warc_normaliser,
    "op6_quality_cascade": op6_quality_cascade,
    "op7_token_files": op7_token_files,
    "op8_trigram_secrets": op8_trigram_secrets,
    "op9_super_minhash": op9_super_minhash,
    "op10_pattern_packing": op10_pattern_packing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_dedup": op13_suffix_dedup,
}
SQL: dict[str, str] = {"op5_warc_normaliser": OP5_SQL, "op6_quality_cascade": OP6_SQL, "op9_super_minhash": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
