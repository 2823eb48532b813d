"""Contract codes: ``US.<SYMBOL><yymmdd><C|P><strike * 1000>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the contract code format.
CONTRACT_PATTERN = r"^US\.([A-Z]+)(\d{6})([CP])(\d+)$"


def _part(code: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(code, CONTRACT_PATTERN, group), F.lit(""))


def contract_symbol(code: Column) -> Column:
    return _part(code, 1)


def contract_expiry(code: Column) -> Column:
    return F.to_date(F.try_to_timestamp(_part(code, 2), F.lit("yyMMdd")))


def contract_right(code: Column) -> Column:
    return F.when(_part(code, 3) == "C", "CALL").when(_part(code, 3) == "P", "PUT")


def contract_strike(code: Column) -> Column:
    return _part(code, 4).cast("decimal(18,0)").cast("double") / 1000


def strike_text(strike: Column) -> Column:
    """Up to six significant digits, no trailing zeros: 250.0 -> 250, 2.5 -> 2.5."""
    rounded = (
        F.when(strike >= 100_000, F.round(strike, 0))
        .when(strike >= 10_000, F.round(strike, 1))
        .when(strike >= 1_000, F.round(strike, 2))
        .otherwise(F.round(strike, 3))
    )
    return F.regexp_replace(rounded.cast("decimal(18,3)").cast("string"), r"\.?0+$", "")


def contract_label(code: Column) -> Column:
    """``SYM C250 260821``; null when the code is not a contract code."""
    return F.concat(
        _part(code, 1), F.lit(" "), _part(code, 3), strike_text(contract_strike(code)), F.lit(" "), _part(code, 2)
    )


def code_to_file(code: Column) -> Column:
    return F.replace(code, F.lit("."), F.lit("_"))


def file_to_code(name: Column) -> Column:
    return F.replace(name, F.lit("US_"), F.lit("US."))


def normalize_ticker(ticker: Column) -> Column:
    return F.when(F.instr(ticker, ".") > 0, ticker).otherwise(F.concat(F.lit("US."), F.upper(ticker)))
