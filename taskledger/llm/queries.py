"""All registered queries of the subpackage, the pipeline among them."""

from __future__ import annotations

from taskledger.llm import (  # noqa: F401
    decontamination,
    language_id,
    lm_scoring,
    merkle_manifest,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    simhash_dedup,
    spelling_variants,
    substring_dedup,
    token_files,
    url_filters,
)
from taskledger.llm.registry import CHECKS, QUERIES, Query


def llm_queries() -> dict[str, Query]:
    return dict(QUERIES)


def llm_checks() -> dict[str, str]:
    return dict(CHECKS)
