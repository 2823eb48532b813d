"""Screening all tickers of a chain in one plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright import params as P
from tapewright.operators.chain import screen_options


def normalize_tickers(tickers: Iterable[str]) -> list[str]:
    return [t if "." in t else f"US.{t.upper()}" for t in tickers]


def screen_tickers(
    chain: DataFrame, tickers: Sequence[str] | None = None, k: int = P.SCREEN_TOP_K, ties: Sequence[str] = ("code",)
) -> DataFrame:
    """Top calls and puts of each ticker; the chain is partitioned by ``symbol``."""
    if tickers is not None:
        wanted = [t.removeprefix("US.") for t in normalize_tickers(tickers)]
        chain = chain.filter(F.col("symbol").isin(wanted))
    return screen_options(chain, ["symbol", "option_type"], k, ties)
