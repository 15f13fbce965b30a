"""Registry of this subpackage's queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op9_byte_bpe
from .decontaminate import op5_benchmark_decontamination
from .html_extract import op8_html_extraction
from .licenses import op1_license_scans
from .licenses import sql as licenses_sql
from .near_dup import op10_simhash_near_dedup
from .quality import op2_quality_rules
from .secrets import op3_secret_scans
from .substring_dedup import SQL as REPEATS_SQL
from .substring_dedup import op7_suffix_array_dedup
from .url_filter import op4_url_filters
from .warc import SQL as WARC_SQL
from .warc import op6_warc_salvage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scans": op3_secret_scans,
    "op4_url_filters": op4_url_filters,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_warc_salvage": op6_warc_salvage,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLES: dict[str, str] = {
    "op1_license_scans": licenses_sql(),
    "op6_warc_salvage": WARC_SQL,
    "op7_suffix_array_dedup": REPEATS_SQL,
}
