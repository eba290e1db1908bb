"""Thresholds of the detectors."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DetectorParams:
    failed_login_threshold: int = 5
    high_frequency_threshold: int = 50
    # window name -> (seconds, failed logins, requests)
    windows: dict = field(default_factory=lambda: {"1min": (60, 5, 100), "5min": (300, 10, 250), "15min": (900, 20, 500), "1hour": (3600, 50, 1000)})
    burst_period_window: int = 60
    burst_period_requests: int = 30
    scan_window: int = 300
    unique_paths_threshold: int = 10
    vuln_min_requests: int = 20
    vuln_ratio: float = 0.6
    dos_windows: dict = field(default_factory=lambda: {"30sec": 30, "1min": 60, "2min": 120, "5min": 300})
    dos_burst_threshold: int = 100
    ua_rotation_threshold: int = 5
    size_min_entries: int = 10
    tiny_bytes: int = 10
    tiny_ratio: float = 0.7
    tiny_count: int = 20
    huge_bytes: int = 10_000
    huge_ratio: float = 0.1
    huge_count: int = 5
    session_min_entries: int = 5
    session_min_gaps: int = 10
    session_max_gap: int = 60
    geo_change_threshold: int = 3
    geo_window: int = 3600
    travel_seconds: int = 1800
    country_requests_per_hour: float = 200.0
    country_failed_per_hour: float = 20.0
    # Multipliers of countries.
    country_multipliers: dict = field(default_factory=lambda: {"CN": 1.3, "RU": 1.4, "KP": 1.5, "IR": 1.4, "PK": 1.2, "BD": 1.2, "VN": 1.2, "IN": 1.1})


DEFAULT = DetectorParams()
