"""Settings: one small object for each operator that takes any, and a study that holds them together."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass

# The factor names, in their order of output.
TECHNICAL = (
    "sma_crossover",
    "ema_crossover",
    "trend_filter",
    "breakout",
    "rsi",
    "cci",
    "macd",
    "obv",
    "bollinger",
    "ts_momentum",
    "variable_week_high",
    "price_action",
)
FUNDAMENTAL = (
    "book_to_market",
    "earnings_yield",
    "roa",
    "roe",
    "gross_profitability",
    "asset_growth",
    "investment_to_assets",
    "net_issuance",
    "accruals",
    "cash_flow_yield",
    "earnings_surprise",
)

# The defaults below are fixed values: results have to agree with them.


@dataclass(frozen=True)
class Lookbacks:
    """Spans of the technical factors, in rows of their own granularity."""

    averages: tuple[int, int] = (20, 50)
    trend: int = 200
    exponential: tuple[int, int] = (21, 63)
    convergence: tuple[int, int, int] = (12, 26, 9)
    strength: int = 14
    channel: int = 20
    volume_balance: int = 20
    bands: tuple[int, float] = (20, 2.0)
    breakout_weeks: int = 26
    high_weeks: tuple[int, ...] = (13, 26, 52)
    momentum_months: tuple[int, int] = (12, 1)
    action_weeks: int = 8


@dataclass(frozen=True)
class Eligible:
    """What a symbol needs on a date: price, mean dollar volume, and sessions with a close so far."""

    price: float = 5.0
    dollar_volume: float = 20e6
    sessions: int = 260


@dataclass(frozen=True)
class Selection:
    """How many names are held: all, half from ``half_at`` of the macro score down, none from ``none_at`` down."""

    names: int = 5
    half_at: float = -0.5
    none_at: float | None = -1.0
    positive_only: bool = True


@dataclass(frozen=True)
class Fitting:
    """Walk-forward windows, and how factor weights are fitted in them.

    ``scheme``: ``ic`` or ``equal`` over all factors, ``grouped_ic`` or ``grouped_equal`` with a fixed share for the
    fundamental group, inside which ``given`` weights come first.
    """

    train_months: int = 60
    test_months: int = 12
    step_months: int = 6
    least_dates: int = 26
    least_symbols: int = 20
    scheme: str = "ic"
    fundamental_share: float = 0.25
    given: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Setup:
    """A whole study."""

    factors: tuple[str, ...] = TECHNICAL + FUNDAMENTAL
    signal: str = "daily"
    rebalance: str = "weekly"
    needs_trend: bool = True
    capital: float = 100_000.0
    lookbacks: Lookbacks = Lookbacks()
    eligible: Eligible = Eligible()
    selection: Selection = Selection()
    fitting: Fitting = Fitting()

    def chosen(self, of: tuple[str, ...]) -> list[str]:
        """The names in ``of`` that are switched on. Others, such as a filter column, are never scored."""
        return [name for name in of if name in self.factors]


def flat(settings: object, prefix: str = "") -> dict[str, object]:
    """Every single setting under its dotted path: the parameters of a row for hashing and comparing in Spark."""
    out: dict[str, object] = {}
    for f in fields(settings):
        value = getattr(settings, f.name)
        out |= flat(value, f"{prefix}{f.name}.") if is_dataclass(value) else {prefix + f.name: value}
    return out
