"""Noise filters: predicates over one entry, combined into one Boolean expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.config import EngineConfig
from vigilog.functions.text import contains_any


def is_static(config: EngineConfig) -> Column:
    """Path ends with an excluded extension."""
    if not config.filter_static:
        return F.lit(False)
    path = F.lower("path")
    plain = [e for e in config.extensions if e.count(".") == 1]
    ends = F.when(F.contains(path, F.lit(".")), F.concat(
        F.lit("."), F.substring_index(path, ".", -1))).isin(plain)
    for extension in config.extensions:
        if extension not in plain:
            ends = ends | F.endswith(path, F.lit(extension))
    return F.coalesce(ends, F.lit(False))


def is_excluded_path(config: EngineConfig) -> Column:
    return contains_any(F.lower("path"), config.paths)


def is_excluded_method(config: EngineConfig) -> Column:
    return F.coalesce(F.upper("method").isin(*config.methods), F.lit(False))


def is_override_method(config: EngineConfig) -> Column:
    return F.coalesce(F.upper("method").isin(*config.override_methods), F.lit(False))


def is_excluded_status(config: EngineConfig) -> Column:
    hit = F.col("status_code").isin(*config.status_codes) & (F.col("status_code") != 0)
    return F.coalesce(hit, F.lit(False))


def is_excluded_agent(config: EngineConfig) -> Column:
    return contains_any(F.lower("user_agent"), config.user_agents)


def drop_reason(config: EngineConfig) -> Column:
    """First rule that drops the entry, NULL when it is kept."""
    return (F.when(is_static(config), F.lit("static_asset"))
            .when(is_excluded_path(config), F.lit("path"))
            .when(is_excluded_method(config), F.lit("method"))
            .when(is_excluded_status(config) & ~is_override_method(config), F.lit("status"))
            .when(is_excluded_agent(config), F.lit("user_agent")))


def keep_entries(entries: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Entries worth analysing. The rules are independent, so their order is free."""
    config = config or EngineConfig()
    return entries.filter(
        ~is_static(config) & ~is_excluded_path(config) & ~is_excluded_method(config)
        & (is_override_method(config) | ~is_excluded_status(config))
        & ~is_excluded_agent(config))


def reason_counts(entries: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Entries per outcome: `kept` or the first rule that dropped them."""
    reason = F.coalesce(drop_reason(config or EngineConfig()), F.lit("kept"))
    return entries.groupBy(reason.alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))
