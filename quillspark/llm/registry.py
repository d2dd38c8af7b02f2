"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import collocations, decontaminate, htmltext, licenses, lm, mixing, neardup, pii, quality, ranked, tokens, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_forest": quality.op1_quality_forest,
        "op2_near_duplicates": neardup.op2_near_duplicates,
        "op3_warc_captures": warc.op3_warc_captures,
        "op4_personal_data": pii.op4_personal_data,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_benchmark_hits": decontaminate.op6_benchmark_hits,
        "op7_main_text": htmltext.op7_main_text,
        "op8_token_files": tokens.op8_token_files,
        "op9_source_mix": mixing.op9_source_mix,
        "op10_lm_scores": lm.op10_lm_scores,
        "op11_ranked_search": ranked.op11_ranked_search,
        "op12_url_filter": urlfilter.op12_url_filter,
        "op13_collocations": collocations.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": licenses.oracle(), "op11_ranked_search": ranked.oracle(), "op12_url_filter": urlfilter.oracle(), "op13_collocations": collocations.oracle()}
