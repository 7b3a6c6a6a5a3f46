"""The named queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import alignment, format_duplicates, leakage, lookalikes, packing, pair_defects, reading_level


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": format_duplicates.p2_found, "p3_found": alignment.p3_found, "p4_found": pair_defects.p4_found, "p5_found": lookalikes.p5_found, "p6_pack": packing.p6_pack, "p7_found": leakage.p7_found, "p8_found": reading_level.p8_found}


def oracle_sql() -> dict[str, str]:
    return {}
