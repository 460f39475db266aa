"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from . import license_scan, pivot_top_k, warc
from .audio_features import op10_audio_features
from .byte_bpe import op7_byte_bpe
from .language_id import op4_language_id
from .packing import op9_packing
from .pii import op1_pii
from .simhash_near_dedup import op8_simhash_near_dedup
from .suffix_array_dedup import op5_suffix_array_dedup

QUERIES = {
    "op1_pii": op1_pii,
    "op2_warc": warc.op2_warc,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_pivot_top_k": pivot_top_k.op6_pivot_top_k,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_packing": op9_packing,
    "op10_audio_features": op10_audio_features,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op3_license_scan": license_scan.SQL,
    "op6_pivot_top_k": pivot_top_k.SQL,
}
