"""Parameters of the trajectory operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Defaults of the canonical variant; every operator takes its thresholds from here or as arguments."""

    max_gap_sec: int = 1800
    drift_speed_kmh: float = 80.0
    drift_distance_m: float = 1000.0
    drift_angle_deg: float = 30.0
    lon_range: tuple[float, float] = (73.0, 135.0)
    lat_range: tuple[float, float] = (18.0, 53.0)
    utc_offset_sec: int = 28800
    parking_speed_kmh: float = 0.0
    parking_min_sec: int = 3600
    congestion_speed_kmh: float = 20.0
    congestion_min_sec: int = 240
    event_speed_kmh: float = 32.0
    event_min_sec: int = 180
    likely_parked_sec: int = 1800
    hex_size_m: float = 300.0
    kde_cell_m: float = 150.0
    kde_radius_m: float = 800.0
    hotspot_top_fraction: float = 0.03
    persistence_min: int = 7
    component_min_cells: int = 3
    alpha_z: float = 1.96
    road_tolerance_m: float = 30.0
    snap_tolerance_m: float = 500.0
    alternative_ratio: float = 1.2
    alternative_attempts: int = 5
    random_seed: int = 42
    detour_ratio: float = 1.5
    earth_radius_m: float = 6371008.8

    def __post_init__(self) -> None:
        positive = ("max_gap_sec", "hex_size_m", "kde_cell_m", "kde_radius_m", "snap_tolerance_m", "detour_ratio", "earth_radius_m")
        for name in positive:
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be positive")
        if not 0 < self.hotspot_top_fraction < 1:
            raise ValueError("hotspot_top_fraction must lie between 0 and 1")
        if self.alternative_ratio < 1:
            raise ValueError("alternative_ratio must be at least 1")


DEFAULT = Settings()


@dataclass(frozen=True)
class StageResult:
    """What a stage has done: SUCCESS, SKIPPED or FAILED."""

    stage: str
    status: str
    metrics: dict
    elapsed_sec: float
    error: str | None = None
