"""Settings of the point-cloud operators; units are in the names."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

UNKNOWN, GROUND, OBSTACLE = 0, 1, 2
VALID, NOISE = 0, 1
ANTICLOCKWISE, CLOCKWISE, COLINEAR = 0, 1, 2
#: Smallest step above one of a 32-bit float; keeps the elevation step below the ground threshold.
FLOAT_EPSILON = 2.0**-23


@dataclass(frozen=True)
class SegmenterConfig:
    elevation_up_deg: float = 2.0
    elevation_down_deg: float = -24.8
    image_width: int = 2048
    image_height: int = 64
    assume_unorganized_cloud: bool = False
    grid_radial_spacing_m: float = 2.0
    grid_slice_resolution_deg: float = 1.0
    ground_height_threshold_m: float = 0.2
    road_maximum_slope_m_per_m: float = 0.2
    min_distance_m: float = 2.0
    max_distance_m: float = 100.0
    sensor_height_m: float = 1.73
    kernel_threshold_distance_m: float = 1.0
    amplification_factor: float = 5.0
    z_min_m: float = -3.0
    z_max_m: float = 4.0
    gap_m: float = 0.5
    ransac_iterations: int = 60

    @property
    def rings(self) -> int:
        return int(self.max_distance_m / self.grid_radial_spacing_m)

    @property
    def slices(self) -> int:
        return round(360.0 / self.grid_slice_resolution_deg)

    @property
    def slice_rad(self) -> float:
        return math.radians(self.grid_slice_resolution_deg)

    @property
    def elevation_step(self) -> float:
        """Most that the ground may rise from one ring to the next."""
        rise = self.grid_radial_spacing_m * math.tan(self.road_maximum_slope_m_per_m)
        return min(rise, self.ground_height_threshold_m - FLOAT_EPSILON)

    @property
    def first_elevation(self) -> float:
        return -self.sensor_height_m + self.ground_height_threshold_m

    @property
    def least_normal_z(self) -> float:
        return math.cos(math.tan(self.road_maximum_slope_m_per_m))


@dataclass(frozen=True)
class ClustererConfig:
    voxel_range_m: float = 0.4
    voxel_azimuth_deg: float = 1.0
    voxel_elevation_deg: float = 1.5
    min_cluster_size: int = 3
    full_circle: bool = False


@dataclass(frozen=True)
class NoiseConfig:
    radius_multiplier_m_per_m: float = 0.02
    min_radius_m: float = 0.1
    min_neighbours: int = 4


@dataclass(frozen=True)
class VehicleClass:
    name: str
    length: tuple[float, float]
    width: tuple[float, float]
    height: tuple[float, float]

    @property
    def area(self) -> tuple[float, float]:
        return self.length[0] * self.width[0], self.length[1] * self.width[1]

    @property
    def volume(self) -> tuple[float, float]:
        return self.area[0] * self.height[0], self.area[1] * self.height[1]


#: Fixed table: adjusted lengths, widths and heights in metres.
VEHICLES = [
    VehicleClass("compact", (3.5, 5.4), (1.1, 2.4), (0.9, 2.0)),
    VehicleClass("sedan", (3.8, 5.8), (1.1, 2.4), (0.9, 2.0)),
    VehicleClass("suv", (3.8, 6.0), (1.2, 2.6), (1.2, 2.3)),
    VehicleClass("truck", (4.4, 6.6), (1.4, 2.7), (1.3, 2.5)),
    VehicleClass("minivan", (4.1, 6.0), (1.2, 2.6), (1.2, 2.3)),
]


@dataclass(frozen=True)
class VehicleConfig:
    min_points: int = 150
    height_m: tuple[float, float] = (0.9, 2.5)
    volume_m3: tuple[float, float] = (3.465, 44.55)
    min_fill: float = 0.4


def from_dict(kind: type, values: dict):
    """A settings object; unknown or missing-typed names raise."""
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return kind(**values)


def from_text(kind: type, text: str, strict: bool = False):
    """Settings from ``name: value`` lines (the flat subset of YAML that parameter files use); comments and nesting heads are skipped.

    Settings that the text lacks have their defaults, or raise if ``strict``.
    """
    values = {}
    for line in text.splitlines():
        name, found, value = line.split("#")[0].strip().partition(":")
        if found and value.strip() and name in {f.name for f in fields(kind)}:
            raw = value.strip().strip("\"'")
            values[name] = {"true": True, "false": False}.get(raw.lower(), raw)
            if isinstance(values[name], str):
                values[name] = float(raw) if any(c in raw for c in ".eE") else int(raw)
    if strict and (missing := {f.name for f in fields(kind)} - set(values)):
        raise ValueError(f"missing settings: {sorted(missing)}")
    return from_dict(kind, values)
