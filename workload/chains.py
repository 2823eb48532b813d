"""Chain queries: screener, pickers, strikes, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewright.functions import clock, contract
from tapewright.operators import chain
from tapewright.plans import screening
from workload import adapters as A
from workload.registry import CHAIN, TAPE, query

SCORED = f"""WITH {CHAIN}, scored AS (
  SELECT *, 100 * (ask - bid) / ((ask + bid) / 2) AS spread_pct,
         oi + volume - (100 * (ask - bid) / ((ask + bid) / 2)) * 100 AS liquidity_score
  FROM chain
  WHERE option_type IN ('CALL', 'PUT') AND premium > 0 AND iv > 0 AND oi >= 100 AND bid > 0 AND ask > 0
    AND dte BETWEEN 7 AND 21 AND abs(delta) BETWEEN 0.25 AND 0.40
    AND 100 * (ask - bid) / ((ask + bid) / 2) <= 10 + 1e-9)"""
SCREEN_COLS = "option_type:s screen_rank:i code:s spread_pct:f liquidity_score:f"
TIES = ["code", "option_premium"]


@query(
    SCREEN_COLS,
    f"""{SCORED}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY option_type
  ORDER BY liquidity_score DESC, code, premium) AS screen_rank FROM scored) WHERE screen_rank <= 5""",
)
def screen_options(spark, sf_dir):
    return chain.screen_options(A.lineitem_chain(spark, sf_dir), ties=TIES)


@query(
    "symbol:i " + SCREEN_COLS,
    f"""{SCORED}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, option_type
  ORDER BY liquidity_score DESC, code, premium) AS screen_rank FROM scored) WHERE screen_rank <= 5""",
)
def screen_tickers(spark, sf_dir):
    return screening.screen_tickers(A.lineitem_chain(spark, sf_dir), ties=TIES)


LIQUID = f"""WITH {CHAIN}, live AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, code, premium) AS volume_rank
  FROM chain WHERE premium > 0 AND volume > 0 AND dte > 1)"""


@query("symbol:i volume_rank:i code:s volume:f", f"{LIQUID} SELECT * FROM live WHERE volume_rank <= 12")
def liquid_contracts(spark, sf_dir):
    return chain.liquid_contracts(A.lineitem_chain(spark, sf_dir), ties=TIES)


@query(
    "code:s",
    f"""{LIQUID}
SELECT DISTINCT code FROM live WHERE volume_rank <= 40
  AND code NOT IN (SELECT code FROM live WHERE volume_rank <= 12)""",
)
def watch_additions(spark, sf_dir):
    rows = A.lineitem_chain(spark, sf_dir)
    fresh = chain.liquid_contracts(rows, n=40, ties=TIES)
    return chain.watch_additions(fresh, fresh.filter("volume_rank <= 12"))


NEAREST = f"""WITH {CHAIN},
spot AS (SELECT symbol, CAST(sum(CAST(premium AS DECIMAL(18,2))) AS DOUBLE) / sum(volume) AS spot
         FROM chain GROUP BY symbol),
near AS (SELECT c.*, s.spot, abs(strike - spot) AS distance, row_number() OVER (
    PARTITION BY c.symbol, expiry, option_type ORDER BY abs(strike - spot), code, premium) AS strike_rank
  FROM chain c JOIN spot s ON c.symbol = s.symbol)"""


def near_strikes(spark, sf_dir):
    rows = A.lineitem_chain(spark, sf_dir)
    mean = F.sum(A.hundredths(F.col("option_premium"))) / 100 / F.sum("volume")
    spot = rows.groupBy("symbol").agg(mean.alias("spot"))
    return chain.nearest_strikes(rows, spot, ties=TIES)


@query(
    "symbol:i expiry:i option_type:s strike_rank:i code:s distance:f",
    f"{NEAREST}\nSELECT * FROM near WHERE strike_rank <= 20",
)
def nearest_strikes(spark, sf_dir):
    return near_strikes(spark, sf_dir)


@query("code:s", f"{NEAREST}\nSELECT DISTINCT code FROM near WHERE strike_rank <= 20")
def contract_universe(spark, sf_dir):
    return chain.contract_universe(near_strikes(spark, sf_dir))


@query(
    "code:s part:i price:f",
    """SELECT code, l_partkey AS part, l_extendedprice AS price FROM (
  SELECT concat_ws('_', l_orderkey, l_linenumber) AS code, l_partkey, l_extendedprice,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn
  FROM lineitem) WHERE rn = 1""",
)
def distinct_contracts(spark, sf_dir):
    pages = A.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("code"), F.col("l_partkey").alias("part"),
        "l_suppkey", F.col("l_extendedprice").alias("price"), "l_shipdate",
    )
    return chain.distinct_contracts(pages, ["part", "l_suppkey", "price", "l_shipdate"])


@query(
    "trade_date:d symbol:i sample_rank:i code:i prints:i",
    f"""WITH {TAPE}, n AS (SELECT trade_date, symbol, code, count(*) AS prints FROM tape GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, symbol ORDER BY prints DESC, code DESC)
  AS sample_rank FROM n) WHERE sample_rank <= 3""",
)
def busiest_sample(spark, sf_dir):
    return chain.busiest_contracts(A.lineitem_tape(spark, sf_dir))


@query(
    "symbol:s contracts:i",
    f"""WITH {CHAIN}
SELECT CAST(symbol AS VARCHAR) AS symbol, count(*) AS contracts FROM chain GROUP BY symbol
UNION ALL SELECT 'TOTAL', count(*) FROM chain""",
)
def snapshot_totals(spark, sf_dir):
    rows = A.lineitem_chain(spark, sf_dir)
    return chain.snapshot_totals(rows.withColumn("symbol", F.col("symbol").cast("string")))


def part_codes(spark, sf_dir):
    """Contract codes from part columns; large sizes keep the part name, which is no contract code."""
    expiry = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyMMdd")
    strike = F.round(F.col("p_retailprice") * 1000).cast("bigint").cast("string")
    right = F.when(F.col("p_brand") < "Brand#2", "C").otherwise("P")
    code = F.concat(F.lit("US."), "p_type", expiry, right, strike)
    return A.table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") > 45, F.col("p_name")).otherwise(code).alias("code")
    )


@query(
    "p_partkey:i file_name:s back:s symbol:s expiry:d right:s strike:f label:s",
    """WITH p AS (
  SELECT p_partkey, p_type, p_name, p_size > 45 AS odd, p_retailprice, DATE '2024-01-01' + p_size AS expiry,
         CASE WHEN p_brand < 'Brand#2' THEN 'C' ELSE 'P' END AS cp FROM part),
c AS (SELECT *, CASE WHEN odd THEN p_name ELSE concat('US.', p_type, strftime(expiry, '%y%m%d'), cp,
                     CAST(round(p_retailprice * 1000) AS BIGINT)) END AS code FROM p)
SELECT p_partkey, replace(code, '.', '_') AS file_name, code AS back,
       CASE WHEN NOT odd THEN p_type END AS symbol, CASE WHEN NOT odd THEN expiry END AS expiry,
       CASE WHEN odd THEN NULL WHEN cp = 'C' THEN 'CALL' ELSE 'PUT' END AS right,
       CASE WHEN NOT odd THEN p_retailprice END AS strike,
       CASE WHEN NOT odd THEN concat(p_type, ' ', cp, format('{:g}', p_retailprice), ' ', strftime(expiry, '%y%m%d')) END
         AS label
FROM c""",
)
def contract_parse(spark, sf_dir):
    code = F.col("code")
    return part_codes(spark, sf_dir).select(
        "p_partkey", contract.code_to_file(code).alias("file_name"),
        contract.file_to_code(contract.code_to_file(code)).alias("back"),
        contract.contract_symbol(code).alias("symbol"), contract.contract_expiry(code).alias("expiry"),
        contract.contract_right(code).alias("right"), contract.contract_strike(code).alias("strike"),
        contract.contract_label(code).alias("label"),
    )


@query(
    "ticker:s n:i",
    """SELECT CASE WHEN contains(p_name, 'e') THEN concat(p_type, '.', p_brand) ELSE concat('US.', upper(p_name)) END
  AS ticker, count(*) AS n FROM part GROUP BY 1""",
)
def normalized_tickers(spark, sf_dir):
    dotted = F.concat_ws(".", "p_type", "p_brand")
    raw = F.when(F.contains("p_name", F.lit("e")), dotted).otherwise(F.col("p_name"))
    parts = A.table(spark, sf_dir, "part").select(contract.normalize_ticker(raw).alias("ticker"))
    return parts.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query(
    "day:d start:d stop:d",
    """SELECT day, day + o AS start, least(day + o + 28, day + 45) AS stop
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), (SELECT unnest([0, 29]) AS o)""",
)
def date_spans(spark, sf_dir):
    days = A.snapshots(spark, sf_dir).select("day").distinct()
    spans = clock.date_spans(F.col("day"), F.date_add("day", 45))
    return days.select("day", F.inline(spans))
