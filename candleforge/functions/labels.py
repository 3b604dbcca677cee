"""Grading expressions: mode labels, report status, heat colours, inventory codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from candleforge.operators.profile import EMPTY, FULL, GAP_RATIO, RED, Profile

COMPLETE, FAILED, VIA_FALLBACK = "✅ Complete", "❌ Failed", "✅ (Fallback)"
CAPITAL_ONLY, HYBRID = "CAPITAL_ONLY", "HYBRID"
# The choices that the inventory form offers.
CHOICES = ("HYBRID (Stock/ETF)", "CAPITAL_ONLY (Index/CFD)")


def mode_label(strategy: Column, primary_rows: Column, fallback_rows: Column, reg_runs: bool, profile: Profile = FULL) -> Column:
    """Which source served the regular session. A missing strategy counts as HYBRID."""
    raw = F.coalesce(strategy, F.lit(HYBRID))
    if not reg_runs:
        return raw
    neither = raw if profile.failed_label is None else F.lit(profile.failed_label)
    return (
        F.when(raw == CAPITAL_ONLY, raw).when(primary_rows > 0, F.lit("HYBRID (Yahoo)")).when(fallback_rows > 0, F.lit("HYBRID (Fallback)")).otherwise(neither)
    )


def status_label(total: Column, counts: dict[str, Column], mode: Column, harvest_mode: str, profile: Profile = FULL) -> Column:
    """Completeness of one ticker. counts: rows per session name, before de-duplication."""
    gaps = F.concat_ws(", ", *[F.when(counts[s.name] < F.lit(s.expected * GAP_RATIO), F.lit(s.label)) for s in profile.active(harvest_mode)])
    return (
        F.when(total == 0, F.lit(FAILED))
        .when(gaps != "", F.concat(F.lit("⚠️ Gappy ("), gaps, F.lit(")")))
        .when(mode.contains("Fallback"), F.lit(VIA_FALLBACK))
        .otherwise(F.lit(COMPLETE))
    )


def heat_colour(count: Column, session_filter: str = "Total", profile: Profile = FULL) -> Column:
    """Cell colour: first strict lower bound that the count exceeds, red below all, a neutral one for no data."""
    steps = profile.heat.get(session_filter, ())
    start = F.when(count.isNull(), F.lit(EMPTY))
    return reduce(lambda acc, step: acc.when(count > step[0], F.lit(step[1])), steps, start).otherwise(F.lit(RED))


def strategy_code(text: Column) -> Column:
    """Form choice to stored code."""
    return F.when(text.contains("CAPITAL"), F.lit(CAPITAL_ONLY)).otherwise(F.lit(HYBRID))


def strategy_choice(code: Column) -> Column:
    """Stored code to form choice, the reverse of strategy_code."""
    return F.when(code.contains(HYBRID), F.lit(CHOICES[0])).otherwise(F.lit(CHOICES[1]))


def clean_ticker(text: Column) -> Column:
    return F.upper(text)


def epic_or_ticker(epic: Column, ticker: Column) -> Column:
    """Blank epics default to the ticker; both upper-cased."""
    return F.upper(F.coalesce(F.nullif(epic, F.lit("")), ticker))


def batch_count(rows: Column, size: int = 100) -> Column:
    return F.ceil(rows / F.lit(size)).cast("long")


def count_text(value: Column) -> Column:
    """Integer text for display, blank for no data."""
    return F.coalesce(value.cast("long").cast("string"), F.lit(""))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)
