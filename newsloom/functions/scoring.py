"""Score, decision and move-score columns. All rounding is half-to-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
TIER_RELEVANCE = {"S": 100, "A": 90, "B": 75, "C": 55, "D": 35}
TIER_RANK = {"S": 5, "A": 4, "B": 3, "C": 2, "D": 1}
DECISION_RANK = {"archive_only": 0, "daily_digest": 1, "watchlist_batch": 2, "immediate_alert": 3}
DEFAULT_THRESHOLDS = {"immediate": 80, "watchlist": 55, "digest": 30}
MODIFIER_LIMIT = 10
HIGH_QUALITY_SCORE = 75


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def whole(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def ranked(c: Column, ranks: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for value, rank in ranks.items():
        out = F.when(c == value, F.lit(rank)).otherwise(out)
    return out


def confidence(source_count: Column, hq_count: Column, status: Column) -> Column:
    n, hq = F.greatest(F.lit(0), source_count), F.greatest(F.lit(0), hq_count)
    lifted = F.least(F.lit(100), F.least(F.lit(80), F.lit(40) + n * 10) + F.least(F.lit(15), hq * 5))
    floors = (F.when(hq >= 2, 85).otherwise(0), F.when(status.isin("confirmed", "official"), 95).otherwise(0))
    return F.greatest(lifted, *floors).cast("int")


def score_event(*, top_source_score: Column, source_count: Column, tier: Column, hq_source_count: Column,
                status: Column, move_score: Column, is_duplicate: Column | None = None,
                is_stale: Column | None = None) -> Column:
    """Struct with every component of an event score; ``move_score`` may be null."""
    duplicate = F.lit(False) if is_duplicate is None else is_duplicate
    stale = F.lit(False) if is_stale is None else is_stale
    source = clamp(top_source_score).cast("int")
    conf = confidence(source_count, hq_source_count, F.coalesce(status, F.lit("")))
    relevance = ranked(F.upper(F.trim(F.coalesce(tier, F.lit("")))), TIER_RELEVANCE, TIER_RELEVANCE["D"])
    has_move = move_score.isNotNull()
    move = clamp(F.coalesce(move_score, F.lit(0))).cast("int")
    # every step is a product, so that no branch repeats the whole expression before it
    plain = source * F.lit(0.25) + relevance * F.lit(0.35) + conf * F.lit(0.25)
    base = (plain + F.when(has_move, move * F.lit(0.15)).otherwise(0.0)) / F.when(has_move, 1.0).otherwise(0.85)
    after_duplicate = base * F.when(duplicate, 0.70).otherwise(1.0)
    after_stale = after_duplicate * F.when(stale, 0.70).otherwise(1.0)
    noise = (F.when(source <= 40, F.lit(0.85)).when(source >= 55, F.lit(1.0))
             .otherwise(F.lit(0.85) + ((source - 40) / F.lit(15)) * F.lit(0.15)))
    final = after_stale * noise
    urgency = F.when(has_move, relevance * F.lit(0.45) + move * F.lit(0.35) + conf * F.lit(0.20)).otherwise(
        relevance * F.lit(0.65) + conf * F.lit(0.35))
    return F.struct(
        source.alias("source_score"),
        move.alias("impact_score"),
        relevance.cast("int").alias("relevance_score"),
        F.when(duplicate, F.lit(20)).otherwise(F.lit(100)).alias("novelty_score"),
        whole(urgency).alias("urgency_score"),
        move.alias("market_move_score"),
        conf.alias("confidence_score"),
        whole(base - after_duplicate).alias("duplicate_penalty"),
        whole(after_stale - final).alias("noise_penalty"),
        whole(after_duplicate - after_stale).alias("stale_penalty"),
        clamp(whole(final)).cast("int").alias("final_score"),
    )


def decide(final_score: Column, immediate: Column | int | None = None, watchlist: Column | int | None = None,
           digest: Column | int | None = None) -> Column:
    def level(value: Column | int | None, name: str) -> Column:
        if value is None:
            return F.lit(DEFAULT_THRESHOLDS[name])
        return value if isinstance(value, Column) else F.lit(value)

    return (F.when(final_score >= level(immediate, "immediate"), F.lit("immediate_alert"))
            .when(final_score >= level(watchlist, "watchlist"), F.lit("watchlist_batch"))
            .when(final_score >= level(digest, "digest"), F.lit("daily_digest"))
            .otherwise(F.lit("archive_only")))


def decision_reason(decision: Column) -> Column:
    return (F.when(decision == "immediate_alert", F.lit("score_above_immediate_threshold"))
            .when(decision == "watchlist_batch", F.lit("score_above_watchlist_threshold"))
            .when(decision == "daily_digest", F.lit("score_above_digest_threshold"))
            .otherwise(F.lit("score_below_digest_threshold")))


def move_score(price_change_pct: Column, volume_change_pct: Column, z_score: Column) -> Column:
    base = F.least(F.lit(70), whole(F.abs(price_change_pct) * 14))
    bonus = (F.when(volume_change_pct >= 50, F.lit(35)).otherwise(F.lit(0))
             + F.when(z_score >= 2, F.lit(20)).otherwise(F.lit(0)))
    return F.when(price_change_pct.isNotNull(), F.least(F.lit(100), base + bonus)).cast("int")


def effective_source_score(manual: Column, auto: Column) -> Column:
    return F.coalesce(whole(manual * F.lit(0.7) + auto * F.lit(0.3)), manual.cast("int"))


def modifier_step(score: Column, used: Column, modifier: Column) -> tuple[Column, Column]:
    """Apply one model modifier within the shared +-10 budget; returns (score, used)."""
    room_up = F.lit(MODIFIER_LIMIT) - F.greatest(F.lit(0), used)
    room_down = F.lit(MODIFIER_LIMIT) + F.least(F.lit(0), used)
    capped = F.least(room_up, F.greatest(-room_down, F.coalesce(modifier, F.lit(0))))
    return clamp(score + capped).cast("int"), (used + capped).cast("int")
