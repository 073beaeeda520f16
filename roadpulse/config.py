"""Settings that define the semantics. Every default is a fixed value."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values.
VEHICLE_CLASSES = ("car", "bus", "truck", "motorcycle", "bicycle", "pedestrian")
LEVELS = ("LOW", "MODERATE", "HIGH", "SEVERE")
INCIDENT_LEVELS = ("HIGH", "SEVERE")
PUSH_ALERT_LEVELS = ("HIGH", "SEVERE", "CRITICAL", "EMERGENCY")
LEVEL_LABELS = ("LOW", "MEDIUM", "HIGH")
EVENT_TYPES = ("traffic_metrics_update", "heatmap_update", "new_alert", "admin_broadcast")
STOPPED_SPEED_KMH = 5.0
SEVERE_ROW_MINUTES = 5
SUMMARY_STEPS = 60
DOWNSAMPLE_STEPS = 12
PI = 3.14159265


@dataclass(frozen=True)
class Thresholds:
    low: float = 0.30
    moderate: float = 0.55
    high: float = 0.80

    def __post_init__(self) -> None:
        if not all(0.0 <= cut <= 1.0 for cut in (self.low, self.moderate, self.high)):
            raise ValueError("thresholds must lie in [0, 1]")
        if not self.low <= self.moderate <= self.high:
            raise ValueError("thresholds must satisfy low <= moderate <= high")


@dataclass(frozen=True)
class Scoring:
    weight_count: float = 0.4
    weight_speed: float = 0.4
    weight_stopped: float = 0.2
    max_vehicle_count: float = 50.0
    max_speed_kmh: float = 60.0
    thresholds: Thresholds = field(default_factory=Thresholds)


# Loop detectors count far more vehicles per interval than a camera window does.
SENSOR_SCORING = Scoring(max_vehicle_count=700.0, max_speed_kmh=110.0)


@dataclass(frozen=True)
class SpeedFallback:
    pixel_to_meter: float = 0.05
    ttl_seconds: int = 30


@dataclass(frozen=True)
class Retention:
    events_hours: int = 24
    metrics_days: int = 30


@dataclass(frozen=True)
class Episode:
    start_threshold: float = 0.55
    end_threshold: float = 0.30
    min_steps: int = 3
    step_seconds: int = 300


@dataclass(frozen=True)
class ForecastWindow:
    """Shape of the supervised samples: history steps in, horizon steps out."""

    t_in: int = 12
    t_out: int = 6
    step_seconds: int = 300
    hops: int = 2
    vehicle_count_max: float = 700.0
    speed_max_kmh: float = 110.0


WINDOW_SECONDS = 5
LATENESS_SECONDS = 1
# Ordered work on one key is cut into pieces of this length, so that no task holds a key's whole history.
SLICE_SECONDS = 86_400
