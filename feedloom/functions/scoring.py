"""Score arithmetic as columns. Every function takes the evaluation time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS_PER_MONTH = 30.44
DECAY, GRAVITY, GRAVITY_DAYS = 0.0007, 0.0005, 14.0
MATERIAL = 0.25
# Label and ceiling, searched in this order.
BANDS = (
    ("EPOCH", 1.000), ("TRANSFORMATIVE", 0.999), ("EXCEPTIONAL", 0.994), ("VERY_STRONG", 0.984), ("CLEARLY_POSITIVE", 0.939),
    ("STRONG", 0.969), ("SLIGHTLY_POSITIVE", 0.799), ("WEAK_POSITIVE", 0.599), ("POSITIVE", 0.899), ("NEUTRAL", 0.0),
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def seconds_between(ts: Column | str, as_of: Column) -> Column:
    """Seconds from ``ts`` to ``as_of``, not below zero; null for a null time."""
    gap = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(_c(ts).cast("timestamp"))
    return F.when(gap < 0, F.lit(0.0)).otherwise(gap / 1e6)


def age_hours(ts: Column | str, as_of: Column) -> Column:
    return seconds_between(ts, as_of) / 3600


def age_days(ts: Column | str, as_of: Column) -> Column:
    return seconds_between(ts, as_of) / 86400


def decay_weight(ts: Column | str, as_of: Column, rate: float = DECAY, grace_months: float = 1.0) -> Column:
    """1 within the grace period, then exponential decay by the hour."""
    over = age_hours(ts, as_of) - DAYS_PER_MONTH * 24 * grace_months
    return F.when(over <= 0, F.lit(1.0)).otherwise(F.exp(-rate * over))


def time_decay(score: Column | str, ts: Column | str, as_of: Column, **options) -> Column:
    return F.bround(_c(score) * decay_weight(ts, as_of, **options), 6)


def material(score: Column | str, least: float = MATERIAL) -> Column:
    return F.abs(_c(score)) >= least


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` kept between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def asymptotic_multiply(base: Column | str, factor: Column | str, knee: float = 0.85) -> Column:
    """``base * factor``; beyond the knee it only closes in on one."""
    b, m = _c(base).cast("double"), _c(factor).cast("double")
    size = F.abs(b)
    closer = F.least(F.lit(1.0), 1 - (1 - size) * (2 - clamp(m, 0.5, 2.0)))
    return F.when(size <= knee, clamp(b * m, -1.0, 1.0)).otherwise(F.signum(b) * F.greatest(size, closer))


def gravity(score: Column | str, newest: Column | str, as_of: Column, rate: float = GRAVITY, days: float = GRAVITY_DAYS) -> Column:
    """Pull towards zero once nothing new has come for ``days``."""
    s, over = _c(score), age_hours(newest, as_of) - 24 * days
    return F.when(_c(newest).isNull() | (s == 0) | (over <= 0), s).otherwise(F.bround(s * F.exp(-rate * over), 6))


def growth_to_multiplier(growth: Column | str) -> Column:
    g = clamp(_c(growth).cast("double"), 0.0, 1.0)
    return F.when(g <= 0.4, F.lit(1.0)).otherwise(F.bround(1 + (g - 0.4) / 0.6 * 0.05, 3))


def relevant(flag: Column | str) -> Column:
    """Text flag as boolean; unknown counts as relevant."""
    return F.coalesce(F.lower(F.trim(_c(flag).cast("string"))).isin("true", "1", "yes"), F.lit(True))


def band_ceiling(rationale: Column | str) -> Column:
    """Ceiling of the first band named in the text; null if none is."""
    text, out = F.upper(_c(rationale)), F.lit(None).cast("double")
    for label, ceiling in reversed(BANDS):
        out = F.when(text.contains(label), F.lit(ceiling)).otherwise(out)
    return out


def final_article_score(score: Column | str, bonus: Column | str, rationale: Column | str, flag: Column | str) -> Column:
    """Score with its bonus, under the ceiling of its band, from -1."""
    s, b, top = _c(score).cast("double"), clamp(F.coalesce(_c(bonus).cast("double"), F.lit(0.0)), 0.0, 0.03), band_ceiling(rationale)
    raised = F.least(F.lit(0.999), s + b)
    raised = F.when(top.isNotNull() & (raised > 0), F.least(raised, top)).otherwise(raised)
    return F.when(~relevant(flag), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.when(s < 1, raised).otherwise(F.lit(1.0))))


def score_label(score: Column | str) -> Column:
    s = _c(score)
    return (
        F.when(s >= 0.75, "STRONG BUY").when(s >= 0.60, "BUY").when(s >= 0.40, "NEUTRAL").when(s >= 0.25, "WEAK SELL").when(s.isNotNull(), "SELL")
    )


def insider_modifier(value: Column | str) -> Column:
    return clamp(_c(value).cast("double") / 1e6 * 0.01, 0.01, 0.03)


def score_boost(multiplier: Column | str) -> Column:
    """Percent that a multiplier adds."""
    return (_c(multiplier) - 1) * 100


def score_base(final: Column | str, macro: Column | str, ai: Column | str) -> Column:
    """The score before both multipliers; as it is where one is zero."""
    f, product = _c(final).cast("double"), F.coalesce(_c(macro).cast("double"), F.lit(1.0)) * F.coalesce(_c(ai).cast("double"), F.lit(1.0))
    return F.when(product == 0, f).otherwise(F.round(f / F.nullif(product, F.lit(0.0)), 6))


def score_decomposition(df: DataFrame, final: str = "final_score", macro: str = "macro_multiplier", ai: str = "ai_multiplier") -> DataFrame:
    """Add ``base_score`` and the percent that each multiplier adds."""
    return df.withColumns({"base_score": score_base(final, macro, ai), "macro_boost": score_boost(macro), "ai_boost": score_boost(ai)})
