"""Parameters of the library, with the defaults of a one-second grid."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Microseconds of each unit of a duration.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def micros(duration: str) -> int:
    """Microseconds of a duration such as 500ms, 1s, 10min or 1h."""
    m = re.fullmatch(r"(\d+)\s*([a-z]+)", duration.strip().lower())
    if not m or m.group(2) not in UNITS:
        raise ValueError(f"not a duration: {duration!r}")
    return int(m.group(1)) * UNITS[m.group(2)]


@dataclass(frozen=True)
class Cost:
    fee_bps: float
    slippage_bps: float
    spread_multiplier: float


# Cost scenarios of a round trip.
SCENARIOS = {"zero": Cost(0, 0, 0), "low": Cost(1, 0.5, 0.5), "medium": Cost(2, 1, 1.0), "high": Cost(5, 2, 1.0)}


@dataclass(frozen=True)
class Config:
    """Grid, levels, windows, horizons and sessions.

    Row-offset operations run inside a session; ranks, splits, quantiles and
    backtests run per `asset`. Windows hold `block_rows` rows of a session and what
    they look back and ahead.
    """

    frequency: str = "1s"
    levels: int = 5
    imbalance_levels: tuple[int, ...] = (1, 3, 5)
    trade_windows: tuple[str, ...] = ("1s", "5s", "10s")
    volatility_windows: tuple[str, ...] = ("10s", "30s", "60s")
    return_lags: tuple[str, ...] = ("1s", "5s", "10s", "30s")
    horizons: tuple[str, ...] = ("1s", "5s", "10s", "30s")
    lookback: int = 300
    min_periods: int = 10
    block_rows: int = 16_384
    session: tuple[str, ...] = ("symbol", "date")
    asset: tuple[str, ...] = ("symbol",)
    scenarios: dict[str, Cost] = field(default_factory=lambda: dict(SCENARIOS))

    def steps(self, duration: str) -> int:
        """Grid rows that a duration spans, 1 at least."""
        return max(1, micros(duration) // micros(self.frequency))
