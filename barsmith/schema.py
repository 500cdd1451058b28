"""Declared schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

BARS = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume bigint"
CANDLES = BARS + ", oi bigint"
TRADES = "symbol string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, bars_held bigint, return_pct double, exit_reason string, trend_regime string, volatility_regime string"
EQUITY = "symbol string, trade_id bigint, entry_time timestamp_ntz, exit_time timestamp_ntz, starting_equity double, position_size double, return_pct double, pnl double, ending_equity double, drawdown double"
INSTRUMENTS = "instrument_token bigint, exchange_token bigint, tradingsymbol string, name string, last_price double, expiry string, strike double, tick_size double, lot_size bigint, instrument_type string, segment string, exchange string"


def require_columns(df: DataFrame, names: Iterable[str], who: str = "operator") -> None:
    """ValueError that names the operator and the columns it misses."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{who}: missing columns {missing}")
