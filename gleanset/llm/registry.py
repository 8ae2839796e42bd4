"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, fill_middle, jaccard_join, language_id, licenses, pii, secrets, substring_dedup, toxicity, url_filter, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_license_scan": licenses.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_secret_scan": secrets.query,
    "op5_decontaminate": decontaminate.query,
    "op6_language_id": language_id.query,
    "op7_pii": pii.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_bpe": bpe.query,
    "op10_toxicity": toxicity.query,
    "op11_url_filter": url_filter.query,
    "op12_whitening": whitening.query,
    "op13_fill_middle": fill_middle.query,
}

SQL: dict[str, str] = {"op5_decontaminate": decontaminate.SQL, "op8_exact_dedup": exact_dedup.SQL, "op11_url_filter": url_filter.SQL, "op13_fill_middle": fill_middle.SQL}
