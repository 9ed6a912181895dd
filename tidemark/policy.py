"""Every threshold of the analytics, as frozen values that operators take as arguments."""

from __future__ import annotations

from dataclasses import dataclass, field

SIGNALS = ("cognitive", "cyclomatic", "logical_lines", "max_nesting", "parameter_count")
VERDICT_ROLES = ("primary", "test", "example", "benchmark")
RATINGS = ("healthy", "watch", "high")


@dataclass(frozen=True)
class HealthPolicy:
    """Watch and high limits of each signal."""

    limits: dict = field(default_factory=lambda: {
        "cognitive": (15, 25), "cyclomatic": (11, 21), "logical_lines": (50, 100), "max_nesting": (4, 7),
        "parameter_count": (6, 9)})
    file_lines: tuple[int, int] = (400, 800)
    container_statements: tuple[int, int] = (300, 600)


@dataclass(frozen=True)
class HistoryPolicy:
    window_days: int = 90
    bulk_files: int = 25
    file_shared: int = 3
    file_permille: int = 100
    package_shared: int = 2
    finding_shared: int = 3
    finding_percent: int = 20
    hotspot_touches: int = 5
    concentration_total: int = 10
    concentration_percent: int = 90
    amplification_cap: int = 1000
    amplification_commits: int = 10
    amplification_median: int = 3


@dataclass(frozen=True)
class LeakagePolicy:
    distance: int = 2
    shared: int = 5
    bar: int = 400
    bar_step: int = 50
    bar_floor: int = 200
    walk: int = 4096


@dataclass(frozen=True)
class GraphPolicy:
    stable_references: int = 2
    closure_min: int = 20
    closure_max: int = 4096
    reach_total: int = 20
    package_total: int = 3
    package_reached: int = 2
    reach_candidates: int = 64
    reach_degree: int = 8
    core_files: int = 5
    core_percent: int = 2


@dataclass(frozen=True)
class VerdictPolicy:
    worn_permille: int = 10
    fights_permille: int = 50
    small_units: int = 200
    small_highs: int = 10
    fights_highs: int = 100
    lost_highs: int = 1000
    worn_cycles: int = 1
    fights_cycles: int = 3


@dataclass(frozen=True)
class ProblemPolicy:
    god_highs: int = 3
    god_debt: int = 6
    god_fan_out: int = 10
    hub_degree: int = 8
    hub_factor: int = 4


TIERS = ("empty", "clean", "solid", "worn", "fights_back", "lost")
