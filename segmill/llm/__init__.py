"""Operations of a training-data pipeline. ``queries`` and ``oracle_sql`` are what __spark_entry__.py adds to its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, fingerprints, langid, licenses, neardup, ogg, packing, pieces, quality, runs, secrets, tokenfiles, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_piece_samples": pieces.op2_piece_samples,
        "op3_quality": quality.op3_quality,
        "op4_topk": topk.op4_topk,
        "op5_secrets": secrets.op5_secrets,
        "op6_ogg_media": ogg.op6_ogg_media,
        "op7_near_duplicates": neardup.op7_near_duplicates,
        "op8_licenses": licenses.op8_licenses,
        "op9_token_files": tokenfiles.op9_token_files,
        "op10_packing": packing.op10_packing,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_fingerprints": fingerprints.op12_fingerprints,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": topk.ORACLE, "op8_licenses": licenses.ORACLE}
