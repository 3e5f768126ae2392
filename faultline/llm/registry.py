"""The corpus operators as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    collocations, forest, jaccard, merkle, mixing, packing, perplexity, quality, sharding, suffix, templates, tiers,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.query,
        "op2_pack": packing.query,
        "op3_mix_sources": mixing.query,
        "op4_line_dedup": templates.query,
        "op5_prefix_forest": forest.query,
        "op6_sharding": sharding.query,
        "op7_suffix_dedup": suffix.query,
        "op8_quality_rules": perplexity.query,
        "op9_toxicity": toxicity.query,
        "op10_jaccard_join": jaccard.query,
        "op11_collocations": collocations.query,
        "op12_merkle": merkle.query,
        "op13_pack_tiers": tiers.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": mixing.SQL,
        "op4_line_dedup": templates.SQL,
        "op10_jaccard_join": jaccard.SQL,
        "op11_collocations": collocations.SQL,
        "op12_merkle": merkle.SQL,
    }
