"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe_encode_decode
from .fingerprints import op7_fingerprints
from .jaccard import op6_jaccard_join
from .language import op5_language_id
from .licenses import op8_license_scan
from .line_dedup import OP9_SQL, op9_line_dedup
from .packing import op10_packing
from .quality import op2_quality_rules
from .secrets import OP3_SQL, op3_secret_scans
from .token_files import op4_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scans": op3_secret_scans,
    "op4_token_files": op4_token_files,
    "op5_language_id": op5_language_id,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_fingerprints": op7_fingerprints,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op3_secret_scans": OP3_SQL,
    "op9_line_dedup": OP9_SQL,
}
