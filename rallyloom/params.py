"""Every threshold of the engine in one place (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass

COURT_WIDTH_M = 9.0
COURT_LENGTH_M = 18.0
NET_Y_M = 9.0
FRONT_ZONE_DEPTH_M = 3.0

#: Labelled points of the court in metres, in canonical order, by layout. In the
#: layout ``reference`` attack lines lie 3 m from the baselines; the rules of the
#: game (``regulation``) have them 3 m from the net.
REFERENCE_POINTS = {
    "reference": (
        ("baseline_near_left", 0.0, 0.0), ("baseline_near_right", 9.0, 0.0), ("attackline_near_left", 0.0, 3.0), ("attackline_near_right", 9.0, 3.0),
        ("net_left", 0.0, 9.0), ("net_right", 9.0, 9.0), ("attackline_far_left", 0.0, 15.0), ("attackline_far_right", 9.0, 15.0),
        ("baseline_far_left", 0.0, 18.0), ("baseline_far_right", 9.0, 18.0),
    ),
    "regulation": (
        ("baseline_near_left", 0.0, 0.0), ("baseline_near_right", 9.0, 0.0), ("attackline_near_left", 0.0, 6.0), ("attackline_near_right", 9.0, 6.0),
        ("net_left", 0.0, 9.0), ("net_right", 9.0, 9.0), ("attackline_far_left", 0.0, 12.0), ("attackline_far_right", 9.0, 12.0),
        ("baseline_far_left", 0.0, 18.0), ("baseline_far_right", 9.0, 18.0),
    ),
}


@dataclass(frozen=True)
class EventParams:
    contact_radius: int = 5
    contact_min_excursion: float = 15.0
    crossing_x_margin: float = 1.0
    max_dead_gap: int = 90
    min_crossings: int = 2
    bounds_margin: float = 3.0
    stationary_min_frames: int = 150
    stationary_max_extent: float = 150.0


@dataclass(frozen=True)
class TrackParams:
    high_conf: float = 0.25
    low_conf: float = 0.1
    max_gap: int = 15
    soft_speed: float = 100.0
    hard_speed: float = 220.0
    confirm_window: int = 2
    confirm_radius: float = 60.0
    gate: float = 9.21
    sigma_min: float = 3.0
    sigma_max: float = 30.0
    jerk: float = 50.0
    init_pos_var: float = 4.0
    init_vel_var: float = 10000.0
    init_acc_var: float = 10000.0


@dataclass(frozen=True)
class PlayerParams:
    """Multi-object tracking. ``low_conf`` bounds the second matching stage from below."""

    high_conf: float = 0.4
    low_conf: float = 0.1
    match: float = 0.85
    second_match: float = 0.5
    unconfirmed_match: float = 0.7
    lost_buffer: int = 120
    min_consecutive: int = 2


@dataclass(frozen=True)
class CurationParams:
    positive_spacing: int = 3
    bucket: float = 40.0
    val_fraction: float = 0.15
    event_top_k: int = 12
    event_spacing: int = 10
    event_offsets: tuple[int, ...] = (1, 3, 5, 7)
    event_probe: int = 4


@dataclass(frozen=True)
class LabelParams:
    local_high_conf: float = 0.5
    trusted: tuple[str, ...] = ("high", "medium")
    min_side_px: float = 3.0
    polygon_points: int = 16
