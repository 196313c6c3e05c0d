"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_mixing, op2_substrings, op8_decontamination, op9_revisits, op11_repair, op12_clusters
from .op3_licenses import op3_licenses
from .op4_tokens import op4_tokens
from .op5_language import op5_language
from .op6_simhash import op6_simhash
from .op7_extraction import op7_extraction
from .op10_quality import op10_quality
from .op13_scoring import op13_scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing.op1_mixing,
    "op2_substrings": op2_substrings.op2_substrings,
    "op3_licenses": op3_licenses,
    "op4_tokens": op4_tokens,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_extraction": op7_extraction,
    "op8_decontamination": op8_decontamination.op8_decontamination,
    "op9_revisits": op9_revisits.op9_revisits,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair.op11_repair,
    "op12_clusters": op12_clusters.op12_clusters,
    "op13_scoring": op13_scoring,
}
ORACLES: dict[str, str] = {
    "op1_mixing": op1_mixing.ORACLE,
    "op2_substrings": op2_substrings.ORACLE,
    "op8_decontamination": op8_decontamination.ORACLE,
    "op9_revisits": op9_revisits.ORACLE,
    "op11_repair": op11_repair.ORACLE,
    "op12_clusters": op12_clusters.ORACLE,
}
