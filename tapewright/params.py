"""Fixed values of the research protocol, used as parameter defaults."""

from __future__ import annotations

import datetime as dt

# Symbol lists.
UNIVERSE = (
    "TSLA NVDA AAPL MSFT GOOGL SPY QQQ SPCX INTC MU SKHY COHR BE AMZN "
    "META AMD NFLX AVGO COIN PLTR MSTR ARM IWM SMCI CRWD ORCL LLY XOM"
).split()
EVENT_SYMBOLS = ["TSLA", "NVDA", "GOOGL"]
ETFS = ["SPY", "QQQ", "IWM"]
SYMBOL_HOLDOUT = ["ARM", "AVGO", "MU", "NVDA", "SKHY", "SMCI", "SPY"]

# Feature table.
TIME_CUTOFF = dt.date(2026, 5, 21)
WINDOW = 20
MIN_OBS = 15
MIN_HISTORY_DAYS = 60
TRADING_DAYS_PER_YEAR = 252

# Cluster events, capture, stopping rule.
MIN_NOTIONAL = 250_000
MIN_PRINTS = 2
CUTOFF_HOUR = 15
CAPTURE_THRESHOLD = 95.0
SAMPLE_PER_SYMBOL = 3
EXPERIMENT_START = dt.date(2026, 8, 12)
HARD_STOP = dt.date(2026, 9, 23)
TARGET_EVENTS = 150
TARGET_DAYS = 20
NOTIONAL_BUCKETS = [
    ("250k-500k", 500_000),
    ("500k-1M", 1_000_000),
    ("1M-2M", 2_000_000),
    ("2M-5M", 5_000_000),
    ("5M+", None),
]

# Flow analysis.
BLOCK_VOLUME = 50
FLOW_TOP_K = 10
BUY_PRESSURE = 0.65
SELL_PRESSURE = 0.35

# Screener.
SCREEN_MIN_OI = 100
SCREEN_DTE = (7, 21)
SCREEN_ABS_DELTA = (0.25, 0.40)
SCREEN_MAX_SPREAD_PCT = 10.0
SCREEN_SPREAD_TOLERANCE = 1e-9
SCREEN_TOP_K = 5

# Watch list and universe building.
WATCH_POLLING = 12
WATCH_PUSH = 40
NEAREST_STRIKES = 20
MAX_DTE = 45
SPAN_DAYS = 28

# Event study.
HORIZON_MINUTES = 60
CONTROLS_PER_EVENT = 20
GO_EXCESS = 0.0015
GO_T = 2.5
KILL_EXCESS = 0.0010
KILL_T = 2.0

# Collector clock.
SILENCE_MINUTES = 20
FLUSH_SECONDS = 60
REPICK_MINUTES = 45
