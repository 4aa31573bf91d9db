"""Queries of the corpus operators, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import pipeline
from treeloom.llm.common import table
from treeloom.llm.fingerprint import op8
from treeloom.llm.html_text import op9
from treeloom.llm.language_id import op4
from treeloom.llm.license_scan import op7
from treeloom.llm.line_dedup import SQL as LINE_DEDUP_SQL
from treeloom.llm.line_dedup import op3
from treeloom.llm.media import op5
from treeloom.llm.mixing import op6
from treeloom.llm.packing import op1
from treeloom.llm.simhash import op10
from treeloom.llm.token_counts import op2


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline.run,
        "op1_best_fit_packing": lambda spark, d: op1(table(spark, d, "documents")),
        "op2_token_counts": lambda spark, d: op2(table(spark, d, "documents")),
        "op3_line_dedup": lambda spark, d: op3(table(spark, d, "documents")),
        "op4_language_id": lambda spark, d: op4(table(spark, d, "documents")),
        "op5_media_columns": lambda spark, d: op5(table(spark, d, "documents")),
        "op6_mixing_sources": lambda spark, d: op6(table(spark, d, "documents")),
        "op7_license_scans": lambda spark, d: op7(table(spark, d, "documents")),
        "op8_document_fingerprints": lambda spark, d: op8(table(spark, d, "documents")),
        "op9_html_extraction": lambda spark, d: op9(table(spark, d, "pages")),
        "op10_simhash_near_dedup": lambda spark, d: op10(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP_SQL}
