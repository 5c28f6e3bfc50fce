"""Parameters of the engine."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    """All thresholds, by operator. Distances in pips are price differences divided by ``pip``."""

    # The defaults below.

    # bars
    child_width: str = "1 minute"
    parent_width: str = "15 minutes"
    early_split: int = 7
    eps: float = 1e-10
    absorption_body: float = 0.3
    pip: float = 0.1
    # sessions, in hours of the day, and kill zones, in minutes of the day
    asian_end: int = 8
    london_end: int = 16
    overlap: tuple[int, int] = (13, 16)
    kill_zones: tuple[tuple[int, int, int], ...] = ((480, 540, 1), (780, 840, 2), (930, 990, 3))
    atr_window: int = 14
    spike_window: int = 20
    spike_sigma: float = 2.0
    spike_cap: int = 50
    rank_window: int = 100
    # market structure
    swing: int = 5
    liq_tolerance_pips: float = 0.5
    liq_touches: int = 3
    liq_window: int = 100
    gap_pips: float = 0.5
    block_age: int = 500
    equilibrium: float = 0.05
    chunk_bars: int = 8192
    # derived scores
    whale_volume: int = 13
    whale_reversals: int = 4
    whale_absorption: int = 3
    trap_ob_pips: float = 10.0
    trap_absorption: float = 0.4
    dna_window: int = 200
    dna_least: int = 10
    dna_body: float = 0.3
    dna_ratio: float = 0.35
    dna_accel: float = -0.1
    dna_trap: int = 60
    dna_dead_volume: int = 8
    dna_dead_energy: float = 2.0
    dna_ob_pips: float = 15.0
    dna_volume: int = 5
    divergence_lag: int = 5
    streak_cap: int = 20
    climax_window: int = 20
    climax_sigma: float = 2.0
    range_window: int = 20
    continuation_window: int = 200
    regime_short: int = 50
    regime_long: int = 200
    regime_band: float = 0.10
    # labels, evaluation, signals
    tp_pips: float = 150.0
    sl_pips: float = 100.0
    horizon: int = 96
    confidence: float = 60.0
    tiers: tuple[tuple[int, float, float], ...] = ((1, 60.0, 70.0), (2, 70.0, 80.0), (3, 80.0, 101.0))
    bars_per_year: int = 96 * 252
    cooldown: int = 2
    daily_losses: int = 3
    correlation: float = 0.95
    # time splits (the end day counts whole) and walk-forward folds
    train: tuple[str, str] = ("2013-01-01", "2022-12-31")
    val: tuple[str, str] = ("2023-01-01", "2023-12-31")
    test: tuple[str, str] = ("2024-01-01", "2025-12-31")
    fold_years: int = 2
    fold_months: int = 3
    fold_least_train: int = 100
    fold_least_val: int = 10
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, prefix: str = "TIDEMARK_") -> EngineConfig:
        """Defaults, with plain numbers and strings overridden by environment variables."""
        made = cls()
        found = {f.name: type(getattr(made, f.name))(os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ and isinstance(getattr(made, f.name), (int, float, str))}
        return replace(made, **found)


#: The test tables' prices run from 0 to 490, so one pip is one price unit there.
EVENTS = EngineConfig(child_width="10 minutes", parent_width="1 hour", early_split=2, pip=1.0, liq_tolerance_pips=5.0, dna_accel=-10.0, dna_dead_energy=60.0, whale_volume=3, whale_reversals=2, dna_volume=2, dna_dead_volume=2, whale_absorption=1, trap_ob_pips=25.0, dna_ob_pips=25.0)
