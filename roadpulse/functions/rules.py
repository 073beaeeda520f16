"""Row-level rules as pure column expressions, shared by batch and streaming plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse.config import INCIDENT_LEVELS, LEVEL_LABELS, Scoring, Thresholds


def round_stable(value: Column, digits: int) -> Column:
    """Round after dropping the noise that the order of a distributed sum leaves in the last bits."""
    return F.round(F.round(value, 9), digits)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``value`` within the bounds. NULL stays NULL, which ``least`` and ``greatest`` alone would turn into a bound."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def normalize(value: Column, maximum: float) -> Column:
    """Share of ``maximum`` in [0, 1]; 0 when the maximum is not positive."""
    if maximum <= 0:
        return F.lit(0.0)
    return clamp(value / F.lit(float(maximum)))


def congestion_score(count: Column, speed: Column, stopped: Column, scoring: Scoring = Scoring()) -> Column:
    """C8, unrounded: weighted load, slowness and standstill."""
    load = F.lit(scoring.weight_count) * normalize(count, scoring.max_vehicle_count)
    slowness = F.lit(scoring.weight_speed) * (F.lit(1.0) - normalize(speed, scoring.max_speed_kmh))
    return clamp(load + slowness + F.lit(scoring.weight_stopped) * stopped)


def level_of(score: Column, thresholds: Thresholds = Thresholds()) -> Column:
    """Strict cuts, so a score equal to a threshold belongs to the level above it."""
    return level_between(score, F.lit(thresholds.low), F.lit(thresholds.moderate), F.lit(thresholds.high))


def level_between(score: Column, low: Column, moderate: Column, high: Column) -> Column:
    return (
        F.when(score < low, "LOW").when(score < moderate, "MODERATE").when(score < high, "HIGH").otherwise("SEVERE")
    )


def is_incident(level: Column) -> Column:
    """True for HIGH and SEVERE; False otherwise, also for NULL."""
    return F.coalesce(level.isin(*INCIDENT_LEVELS), F.lit(False))


def incident_flag(level: Column) -> Column:
    """1 for HIGH and SEVERE, else 0."""
    return is_incident(level).cast("int")


def severity_of(level: Column) -> Column:
    """C11: alert severity, NULL when the level raises no alert."""
    return F.when(level == "SEVERE", "CRITICAL").when(level == "HIGH", "WARNING")


def level_idx(level: Column) -> Column:
    """Class index for the three-class target; SEVERE counts as HIGH, anything unknown as LOW."""
    return F.when(level == "MODERATE", 1).when(level.isin(*INCIDENT_LEVELS), 2).otherwise(0)


def level_prob(idx: Column) -> Column:
    """Class index as a congestion probability of 0, 0.5 or 1."""
    return F.when(idx == 1, 0.5).when(idx == 2, 1.0).otherwise(0.0)


def level_rank(level: Column) -> Column:
    """Order LOW < MODERATE < HIGH < SEVERE; a missing level ranks lowest."""
    return F.when(level == "SEVERE", 3).when(level == "HIGH", 2).when(level == "MODERATE", 1).otherwise(0)


def level_label(idx: Column) -> Column:
    """label of a predicted class."""
    return F.coalesce(F.get(F.array(*[F.lit(label) for label in LEVEL_LABELS]), idx.cast("int")), F.lit("LOW"))


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def alert_title(severity: Column) -> Column:
    """C19."""
    return F.concat(severity, F.lit(" congestion"))


def alert_message(severity: Column, camera_id: Column, resolved: Column) -> Column:
    """Text of an open or a resolved alert."""
    opened = F.format_string("%s congestion detected at camera %s", severity, camera_id)
    return F.when(resolved, F.format_string("Congestion resolved for camera %s", camera_id)).otherwise(opened)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def plus_seconds(moment: Column, seconds: Column | int) -> Column:
    shift = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(F.unix_micros(moment) + shift.cast("long") * F.lit(1_000_000))


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
