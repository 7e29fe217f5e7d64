"""Which rows count: evidence tiers and the three exclusion sets, which differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EXCLUDED_TIERS = ("debug_fallback", "mock")
STATISTICS_SOURCES = ("local_vlm_fallback", "mock", "mock_judge", "fallback", "mock_fallback")
HAZARD_SOURCES = ("local_vlm_fallback", "mock", "fallback", "mock_fallback")


def evidence_tier(source: Column, explicit: Column | None = None) -> Column:
    """An explicit tier as it stands; else by the source's name."""
    key = F.lower(F.trim(source))
    out = F.when(key.isin("artifact_reuse", "artifact", "cached_artifact"), "artifact").when(key.isin("mock", "mock_fallback"), "mock")
    out = out.when(key.contains("fallback"), "debug_fallback").otherwise("exploratory_fresh")
    return out if explicit is None else F.coalesce(F.nullif(F.trim(explicit), F.lit("")), out)


def _eligible(sources: tuple[str, ...], tier: Column, source: Column, fallback_used: Column | None, fresh_may_fall_back: bool) -> Column:
    low = F.lower(F.coalesce(tier, F.lit("")))
    used = F.coalesce(fallback_used, F.lit(False)) if fallback_used is not None else F.lit(False)
    if fresh_may_fall_back:
        used = used & (low != "exploratory_fresh")
    return ~used & ~low.isin(*EXCLUDED_TIERS) & ~F.lower(F.coalesce(source, F.lit(""))).isin(*sources)


def for_statistics(tier: Column, source: Column, fallback_used: Column | None = None) -> Column:
    return _eligible(STATISTICS_SOURCES, tier, source, fallback_used, False)


def for_ranking(tier: Column, source: Column, fallback_used: Column | None = None) -> Column:
    return _eligible(STATISTICS_SOURCES, tier, source, fallback_used, True)


def for_hazards(tier: Column, source: Column, fallback_used: Column | None = None) -> Column:
    return _eligible(HAZARD_SOURCES, tier, source, fallback_used, False)
