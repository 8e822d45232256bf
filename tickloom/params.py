"""Thresholds of the library as frozen parameter objects."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


# Defaults that results depend on.
@dataclass(frozen=True)
class FeatureParams:
    return_lags: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 60)
    mean_windows: tuple[int, ...] = (5, 10, 20, 60, 120)
    vol_windows: tuple[int, ...] = (5, 20, 60)
    rsi_period: int = 14
    cci_period: int = 20
    stochastic_period: int = 14
    extreme_return: float = 0.40
    price_limit_cutover: date = date(2015, 6, 15)
    price_limit_before: float = 0.15
    price_limit_after: float = 0.30
    price_limit_slack: float = 0.005


@dataclass(frozen=True)
class CriteriaParams:
    top_turnover_rank: int = 15
    high_conviction_net_buy: float = 100_000_000_000.0
    rsi_watch_low: float = 30.0
    rsi_watch_high: float = 35.0
    rsi_overbought: float = 70.0
    tailwind: float = 0.01
    headwind: float = -0.01
    near_high_distance: float = 0.03
    leader_top_n: int = 3
    leader_min_co_movers: int = 2
    leader_min_return: float = 0.0


@dataclass(frozen=True)
class SignalParams:
    return_weight: float = 0.65
    up_prob_weight: float = 0.35
    uncertainty_penalty: float = 0.25
    buy_above_pct: float = 2.0
    sell_at_or_below_pct: float = -2.0


@dataclass(frozen=True)
class PortfolioParams:
    top_k: int = 20
    portfolio_value: float = 1_000_000_000.0
    max_participation: float = 0.10
    fee_bps: float = 10.0
    slippage_bps: float = 5.0
    dynamic_slippage_bps: float = 10.0
    min_up_probability: float = 0.50
    turnover_limit: float = 0.5
    min_value_traded: float = 3_000_000_000.0
    min_external_coverage: float = 0.0
    min_investor_coverage: float = 0.5
    max_per_market_type: int = 12
    scenario_multipliers: tuple[tuple[str, float], ...] = (
        ("conservative", 1.5),
        ("neutral", 1.0),
        ("aggressive", 0.75),
    )


@dataclass(frozen=True)
class FoldParams:
    min_train: int = 252 * 3
    test: int = 252
    step: int = 126
    purge: int = 1
    embargo: int = 0
    lookback: int = 0
    quantiles: tuple[float, float, float] = (0.1, 0.5, 0.9)
    seed: int = 42
    min_folds: int = 3


@dataclass(frozen=True)
class TuningParams:
    return_weights: tuple[float, ...] = (0.3, 0.45, 0.6, 0.65)
    prob_weights: tuple[float, ...] = (0.20, 0.35, 0.50)
    penalties: tuple[float, ...] = (0.15, 0.25, 0.35)
    default: tuple[float, float, float] = (0.65, 0.35, 0.25)
    rank_ic_weight: float = 0.10
    downside_weight: float = 0.25
    overfit_gap: float = 0.15
    default_tolerance: float = 0.02
    train_ratio: float = 0.7
    top_share: float = 0.1


@dataclass(frozen=True)
class ScreenerParams:
    mean_windows: tuple[int, ...] = (5, 20, 60)
    short_high: int = 20
    long_high: int = 252
    near_high: float = 0.98
    min_history: int = 252
    volume_spike: float = 1.5
    top_value_count: int = 20
    top_n: int = 3
    first_buy_ratio: float = 0.6


@dataclass(frozen=True)
class GateParams:
    min_samples: int = 250
    min_bucket_samples: int = 30
    min_rank_ic: float = 0.0
    min_spread: float = 0.0


@dataclass(frozen=True)
class Params:
    feature: FeatureParams = field(default_factory=FeatureParams)
    criteria: CriteriaParams = field(default_factory=CriteriaParams)
    signal: SignalParams = field(default_factory=SignalParams)
    portfolio: PortfolioParams = field(default_factory=PortfolioParams)
    folds: FoldParams = field(default_factory=FoldParams)
    tuning: TuningParams = field(default_factory=TuningParams)
    screener: ScreenerParams = field(default_factory=ScreenerParams)
    gate: GateParams = field(default_factory=GateParams)
