"""Every threshold and constant of the engine, in frozen parameter objects."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TripParams:
    """Trip-side parameters. Money is in cents, speed in miles per hour, time in minutes."""

    # Results must use exactly these.
    stop_buffer_minutes: int = 10
    incentive_light_usd: int = 1
    incentive_medium_usd: int = 2
    incentive_heavy_usd: int = 4
    long_horizon_hours: int = 48
    runner_ups: int = 3

    # Our own modelling choices.
    light_flow_percent: int = 80
    medium_flow_percent: int = 50
    incident_threshold: int = 3
    min_mph: int = 5
    max_mph: int = 40
    earth_radius_miles: float = 3958.7613
    gas_cents_per_gallon: int = 350
    miles_per_gallon: int = 25
    parking_cents: int = 0
    fare_cents: int = 200
    credit_light_cents: int = 50
    credit_medium_cents: int = 100
    credit_heavy_cents: int = 200


@dataclass(frozen=True)
class GridParams:
    """Layout of the box join: square cells that double per level, time buckets that widen per rung."""

    base_degrees: float = 0.05
    levels: int = 6
    cells_per_axis: int = 4
    time_rungs_minutes: tuple[int, ...] = (120, 1440, 46080)


@dataclass(frozen=True)
class SumGridParams:
    """Layout of the box sums: cells of one size, runs of 1, 2, 4 ... cells, and the buckets of running totals."""

    cell_degrees: float = 0.025
    heights: int = 4
    bucket_minutes: int = 60


@dataclass(frozen=True)
class NearGridParams:
    """Layout of the nearest-place join: the finest cells, and how often they double; the widest ones hold half the globe."""

    cell_degrees: float = 0.01
    levels: int = 16


@dataclass(frozen=True)
class FallbackParams:
    """Deterministic stand-in level for a series without history."""

    base: int
    variation: int


# Base level and bounded variation, upper bound excluded.
HOURLY_FALLBACK = FallbackParams(base=50, variation=20)
DAILY_FALLBACK = FallbackParams(base=10_000, variation=2_000)


@dataclass(frozen=True)
class ModeFactor:
    grams_per_mile: float
    passengers: float


@dataclass(frozen=True)
class EmissionParams:
    # Emission factors and the standard commute.
    bus: ModeFactor = field(default_factory=lambda: ModeFactor(2680.0, 30.0))
    car: ModeFactor = field(default_factory=lambda: ModeFactor(404.0, 1.5))
    commute_miles_per_day: float = 20.0
    commute_days_per_year: int = 250
    saved_grams_per_passenger_mile: float = 180.0
    grams_per_pound: float = 453.592


# Cost and impact index of a bus rider where driving a car is 100 %.
BUS_COST_INDEX = {
    "initial cost": 0,
    "depreciation": 0,
    "fuel cost": 10,
    "insurance": 0,
    "maintenance cost": 10,
    "repair cost": 10,
    "parking cost": 0,
    "overall cost": 20,
    "convenience": 70,
    "environmental impact": 30,
}

TRIP = TripParams()
GRID = GridParams()
SUM_GRID = SumGridParams()
NEAR_GRID = NearGridParams()
EMISSION = EmissionParams()
