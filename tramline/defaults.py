"""Default thresholds, stated once (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass

LOCAL_ZONE = "America/Toronto"
NO_LEADER_GAP_M = 20_000.0


@dataclass(frozen=True)
class Defaults:
    resolution_s: int = 10
    max_orthogonal_m: float = 200.0
    max_speed_m_s: float = 35.0
    stop_tolerance_m: float = 1.0
    idle_speed_m_s: float = 0.5
    idle_minutes: float = 5.0
    crowd_pct: float = 100.0
    bunch_seconds: float = 120.0
    bunch_distance_m: float = 150.0
    tick_s: int = 30
    stale_s: float = 1200.0
    min_displacement_m: float = 500.0
    fetch_slack_hours: int = 6
    step_s: int = 60
    history_ticks: int = 20
    horizon_ticks: int = 30
    label_gap_m: float = 100.0
    edge_stops: int = 2
    persist_ticks: int = 2
    headway_ratio: float = 0.25
    freshness_s: float = 90.0
    train_share: float = 0.70
    val_share: float = 0.15


DEFAULTS = Defaults()
