"""The queries of this subpackage by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import queries_frames as frames
from lodestone.llm import queries_images as images
from lodestone.llm import queries_texts as texts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": images.p1_found,
        "p1_links": images.p1_links,
        "p1_report": images.p1_report,
        "p3_found": images.p3_found,
        "p3_split": images.p3_split,
        "p4_found": frames.p4_found,
        "p5_found": images.p5_found,
        "p5_numbers": images.p5_numbers,
        "p6_pack": texts.p6_pack,
        "p7_found": texts.p7_found,
        "p7_items": texts.p7_items,
        "p8_found": texts.p8_found,
        "p8_sources": texts.p8_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": images.P1_SQL,
        "p1_links": images.P1_LINKS_SQL,
        "p1_report": images.P1_REPORT_SQL,
        "p3_found": images.P3_SQL,
        "p4_found": frames.P4_SQL,
        "p5_found": images.P5_SQL,
        "p5_numbers": images.P5_NUMBERS_SQL,
        "p7_found": texts.P7_SQL,
        "p7_items": texts.P7_ITEMS_SQL,
    }
