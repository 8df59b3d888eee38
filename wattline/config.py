"""Run settings. Every number here is a documented default of the research workflow."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SignalConfig:
    volatility_window: int = 24
    equilibrium_window: int = 72
    position_scale_k: float = 2.0
    imbalance_scale: float = 8.0
    new_signal: bool = True
    volatility_scaling: bool = True
    regime_switching: bool = True
    forecast_weight: float = 0.45
    mean_reversion_weight: float = 0.30
    fundamental_weight: float = 0.25
    regime_quantile: float = 0.7
    position_limit: float = 1.0
    long_edge: float = 0.5
    short_edge: float = -0.5


@dataclass(frozen=True)
class BacktestConfig:
    signal: SignalConfig = SignalConfig()
    transaction_cost_bps: float = 5.0
    annualization: int = 24
    long_threshold: float = 0.1
    short_threshold: float = -0.1
    notional: float = 10000.0
    horizon: int = 1
    hold_tolerance: float = 0.002
    execution_delay: bool = True
    max_position_change: float = 0.35
    spread_bps: float = 3.0
    spread_fixed: float = 0.0
    slippage_volatility: float = 0.08
    slippage_turnover: float = 0.02
    delay_penalty: float = 0.03


@dataclass(frozen=True)
class ForecastConfig:
    train_days: int = 90
    test_days: int = 7
    correlation_threshold: float = 0.95
    near_constant_std: float = 1e-10
    validation_fraction: float = 0.2
    bootstrap_iterations: int = 250
    seed: int = 42


@dataclass(frozen=True)
class Chunking:
    """How a series is cut along time so that one long series is many tasks.

    ``rows`` is the length of a chunk on the hourly grid. Each task sees one chunk plus the
    few rows around it that its row frames reach into. With its halo a chunk stays below the 4,096
    rows that Spark's window operator keeps in memory before it turns to its spillable buffer.
    """

    rows: int = 3840


DEFAULT_CHUNKING = Chunking()
