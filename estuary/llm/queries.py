"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprint import op3_document_fingerprints
from .language_model import op5_lm_scoring
from .packing import op4_packing
from .quality import op10_quality_classifier
from .secrets import op8_secret_scans
from .sentencepiece_wfst import op1_sentencepiece
from .simhash_dedup import op7_simhash_near_dedup
from .topk import OP6_SQL, op6_exact_topk
from .toxicity import op2_toxicity
from .warc_fixity import OP9_SQL, op9_warc_fixity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_toxicity,
        op3_document_fingerprints,
        op4_packing,
        op5_lm_scoring,
        op6_exact_topk,
        op7_simhash_near_dedup,
        op8_secret_scans,
        op9_warc_fixity,
        op10_quality_classifier,
    )
}
ORACLES: dict[str, str] = {"op6_exact_topk": OP6_SQL, "op9_warc_fixity": OP9_SQL}
