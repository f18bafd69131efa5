"""Engine settings.

One frozen dataclass carries every knob. Defaults are the published settings of the
analysis; `fixture_config()` adapts only the calendar to the supplied event table.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

# ---- fixed values (feature order, weights, tiers) -------------------------------------
FEATURES: tuple[str, ...] = (
    "hour_entropy_7d",
    "dow_entropy_30d",
    "after_hours_ratio",
    "session_duration_min",
    "data_volume_mb",
    "export_volume_mb",
    "new_host_flag",
    "new_device_flag",
    "url_bigram_rarity",
    "file_bigram_rarity",
)

WEIGHTS: tuple[float, ...] = (1.0, 0.7, 1.0, 0.6, 1.2, 1.6, 1.3, 1.3, 1.1, 1.1)

# (low inclusive, high exclusive, label); the last label also takes whatever matches none
TIERS: tuple[tuple[float, float, str], ...] = (
    (0.0, 40.0, "Low"),
    (40.0, 65.0, "Medium"),
    (65.0, 85.0, "High"),
    (85.0, 101.0, "Critical"),
)

ACTION_LABELS: tuple[tuple[str, str], ...] = (
    ("log_only", "Logged"),
    ("stepup_flagged", "Step-up flagged"),
    ("stepup_required_passed", "Step-up required (passed)"),
    ("quarantined_after_failed_stepup", "Quarantined (step-up failed)"),
    ("auto_quarantined", "Auto-quarantined"),
)

# why a session or an approval was refused, as audit entries name it
CAUSES: dict[str, str] = {
    "failed": "stepup_auth_failed",
    "critical": "critical_score",
    "approval": "missing_or_self_approval",
}
# ---- end of fixed values --------------------------------------------------------------


@dataclass(frozen=True)
class EngineConfig:
    # calendar
    start_day: dt.date = dt.date(2026, 1, 5)
    train_days: int = 50
    warmup_days: int = 14
    hour_window_days: int = 7
    dow_window_days: int = 30
    business_open: int = 8
    business_close: int = 18

    # features and explanation
    features: tuple[str, ...] = FEATURES
    weights: tuple[float, ...] = WEIGHTS
    top_features: int = 4
    std_floor_fraction: float = 0.15
    z_cap: float = 15.0
    rarity_scope: str = "all"  # "all": bigram counts over every session; "train": train days only

    # models
    seed: int = 42
    n_trees: int = 200
    tree_rows: int = 256
    ridge: float = 1e-3
    forest_k: float = 2.5
    peer_k: float = 2.5
    forest_weight: float = 0.5
    peer_weight: float = 0.5
    allow_partial: bool = False  # score sessions of unseen roles by the forest alone

    # decisions
    tiers: tuple[tuple[float, float, str], ...] = TIERS
    stepup_pass_rate: float = 0.97
    lease_ttl_seconds: int = 300
    audit_shards: int = 4

    # execution: a group with more rows than this is cut into time slices before any
    # ordered window runs over it (see operators/timeline.py)
    hot_group_rows: int = 2_000_000
    slice_seconds: int = 300

    @property
    def split_day(self) -> dt.date:
        return self.start_day + dt.timedelta(days=self.train_days)

    def with_(self, **changes) -> "EngineConfig":
        return replace(self, **changes)


def fixture_config() -> EngineConfig:
    """Calendar of the supplied `events` table: 30 days from 2024-01-01, split after 17."""
    return EngineConfig(start_day=dt.date(2024, 1, 1), train_days=17, warmup_days=7)
