"""Queries and SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, itq, quality_rules
from .chat import op8_chat_format
from .hilbert import op6_hilbert_shards
from .itq import op7_itq_dedup
from .lattice import op10_lattice_lm
from .licenses import op3_license_scan
from .mil import op4_quality_classifier
from .mixing import op2_mix_sources
from .packing import op9_pack_sos
from .quality_rules import op1_quality_rules
from .simhash import op5_simhash_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_itq_dedup": op7_itq_dedup,
    "op8_chat_format": op8_chat_format,
    "op9_pack_sos": op9_pack_sos,
    "op10_lattice_lm": op10_lattice_lm,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op7_itq_dedup": itq.ORACLE,
    "op8_chat_format": chat.ORACLE,
}
