"""The derived market tables as DuckDB common table expressions."""

from __future__ import annotations



def _mean(c: str, frame: str, scale: int = 1) -> str:
    """Window mean as one division of an integer sum: AVG may round twice."""
    rows = f"OVER (s ROWS BETWEEN {frame})"
    amount = c if scale == 1 else f"CAST({c} * {scale} AS BIGINT)"
    return (
        f"CAST(sum({amount}) {rows} AS DOUBLE) / NULLIF(CAST(count({c}) {rows} AS DOUBLE)"
        f" * {scale}, 0)"
    )


CTES = {
    "trades": """
        SELECT upper(p.p_brand) AS symbol, CAST(l.l_shipdate AS DATE) AS date,
               CAST(l.l_extendedprice AS DECIMAL(12,2)) AS px,
               CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) % 5000 + 100000
                   AS cents,
               CAST(l.l_quantity AS BIGINT) AS qty, l.l_returnflag AS rf,
               row(l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey, l.l_extendedprice,
                   l.l_quantity) AS k
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "daily": """
        SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
               arg_max(px, k) AS close,
               arg_min(cents, k) AS open_c, max(cents) AS high_c, min(cents) AS low_c,
               arg_max(cents, k) AS close_c,
               CAST(sum(qty) AS BIGINT) AS volume, CAST(sum(px) AS DECIMAL(18,2)) AS value,
               CAST(count(*) AS INTEGER) AS trades,
               CAST(sum(CASE WHEN rf <> 'R' THEN qty ELSE 0 END) AS BIGINT) AS delivery_volume
        FROM trades GROUP BY symbol, date""",
    "shares": """
        SELECT *, 'EQ' AS series,
               CAST(round(CAST(value AS DOUBLE) / NULLIF(volume, 0), 2) AS DECIMAL(12,2)) AS vwap,
               CAST(round(CAST(delivery_volume * 100 AS DOUBLE) / NULLIF(volume, 0), 2)
                   AS DECIMAL(6,2)) AS delivery_pct
        FROM daily""",
    "bars": """
        SELECT symbol, date, series, open, high, low, close,
               lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close,
               volume, value, vwap, trades, delivery_volume, delivery_pct
        FROM shares""",
    "index_bars": """
        SELECT 'MARKET' AS index_name, date, arg_min(open, symbol) AS open, max(high) AS high,
               arg_max(close, symbol) AS close, min(low) AS low
        FROM daily WHERE dayofweek(date) <> 0 GROUP BY date""",
    "bans": """
        SELECT date AS trade_date, symbol FROM bars WHERE delivery_volume * 2 < volume""",
    "master": """
        SELECT symbol, company_name, lot_size, CAST(NULL AS VARCHAR) AS sector,
               CASE right(symbol, 1) WHEN '1' THEN NULL WHEN '2' THEN '' ELSE company_name END
                   AS industry,
               CASE WHEN right(symbol, 1) = '3' THEN NULL ELSE 'DERIVATIVES' END AS segment
        FROM (SELECT upper(p_brand) AS symbol, min(p_type) AS company_name,
                     CAST(min(p_size) AS INTEGER) AS lot_size
              FROM part GROUP BY 1)""",
    "adj0": """
        SELECT symbol, date, series, CAST(open_c * 0.01 AS DECIMAL(12,2)) AS open,
               CAST(high_c * 0.01 AS DECIMAL(12,2)) AS high,
               CAST(low_c * 0.01 AS DECIMAL(12,2)) AS low,
               CAST(close_c * 0.01 AS DECIMAL(12,2)) AS close,
               volume, value, vwap, trades, delivery_volume, delivery_pct
        FROM shares""",
    "adj": """
        SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM adj0""",
    "bars_q": """
        SELECT symbol, date, series, open * f AS open, high * f AS high, low * f AS low,
               close * f + bump AS close, prev_close, volume, value, vwap, trades,
               delivery_volume, delivery_pct
        FROM (SELECT *,
                     CASE WHEN symbol IN ('BRAND#1', 'BRAND#13') AND date < DATE '1998-01-01'
                          THEN 2 ELSE 1 END AS f,
                     CASE WHEN symbol = 'BRAND#7' AND day(date) = 13 THEN 200 ELSE 0 END AS bump
              FROM adj)""",
    # rolling columns of every bar
    "lagged": """
        SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS before_close FROM bars""",
    "ranged": """
        SELECT *, greatest(high - low, abs(high - before_close), abs(low - before_close)) AS tr
        FROM lagged""",
    "rolled": f"""
        SELECT *,
               max(high) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top20,
               min(low) OVER (s ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS bottom20,
               {_mean('volume', '50 PRECEDING AND 1 PRECEDING')} AS vol50,
               max(volume) OVER (s ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS volmax10,
               {_mean('volume', '20 PRECEDING AND 1 PRECEDING')} AS vol20,
               {_mean('delivery_volume', '50 PRECEDING AND 1 PRECEDING')} AS del50,
               max(delivery_volume) OVER (s ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS delmax10,
               {_mean('delivery_volume', '20 PRECEDING AND 1 PRECEDING')} AS del20,
               {_mean('tr', '13 PRECEDING AND CURRENT ROW', 100)} AS atr14,
               max(high) OVER (s ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS high252,
               {_mean('close', '19 PRECEDING AND CURRENT ROW', 100)} AS sma20,
               {_mean('close', '49 PRECEDING AND CURRENT ROW', 100)} AS sma50,
               {_mean('close', '199 PRECEDING AND CURRENT ROW', 100)} AS sma200,
               lag(close, 20) OVER s AS month_ago, lag(close, 251) OVER s AS year_ago,
               row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS newest
        FROM ranged WINDOW s AS (PARTITION BY symbol ORDER BY date)""",
    "benchmark_moves": """
        SELECT date, CAST(close - lag(close) OVER (ORDER BY date) AS DOUBLE)
                     / NULLIF(lag(close) OVER (ORDER BY date), 0) * 100 AS benchmark_pct
        FROM index_bars""",
    "metrics": """
        SELECT m.symbol, m.date, m.open, m.high, m.low, m.close, m.prev_close,
               CASE WHEN m.prev_close > 0
                    THEN round((m.close - m.prev_close) / m.prev_close * 100, 2) END AS change_pct,
               m.volume, m.value, m.delivery_volume, m.delivery_pct,
               CASE WHEN y.close > 0 THEN round((m.close - y.close) / y.close * 100, 2) END
                   AS ytd_pct,
               CASE WHEN m.year_ago > 0
                    THEN round((m.close - m.year_ago) / m.year_ago * 100, 2) END AS pct_1y,
               CASE WHEN m.month_ago > 0
                    THEN round((m.close - m.month_ago) / m.month_ago * 100, 2) END AS pct_1m,
               CASE WHEN m.high252 > 0
                    THEN round((m.close - m.high252) / m.high252 * 100, 2) END AS delta_52w_high,
               m.close > m.sma20 AS above_sma_20, m.close > m.sma50 AS above_sma_50,
               m.close > m.sma200 AS above_sma_200,
               CASE WHEN m.year_ago > 0
                    THEN round((m.close - m.year_ago) / m.year_ago * 100 - coalesce((
                        SELECT (CAST(n.close AS DOUBLE) - CAST(t.close AS DOUBLE))
                               / CAST(t.close AS DOUBLE) * 100
                        FROM ranked_index n, ranked_index t WHERE n.rn = 1 AND t.rn = 252), 0), 2)
               END AS rs_rank
        FROM rolled m LEFT JOIN (
            SELECT symbol, close FROM bars WHERE date = (
                SELECT min(date) FROM bars
                WHERE date >= date_trunc('year', (SELECT max(date) FROM bars)))
        ) y ON m.symbol = y.symbol
        WHERE m.newest = 1""",
    "ranked_index": """
        SELECT close, row_number() OVER (ORDER BY date DESC) AS rn FROM index_bars""",
    "banned_now": """
        SELECT DISTINCT symbol FROM bans
        WHERE trade_date = (SELECT max(trade_date) FROM bans)""",
}

# which expressions each one reads
NEEDS = {
    "trades": (),
    "daily": ("trades",),
    "shares": ("daily",),
    "bars": ("shares",),
    "index_bars": ("daily",),
    "bans": ("bars",),
    "master": (),
    "adj0": ("shares",),
    "adj": ("adj0",),
    "bars_q": ("adj",),
    "lagged": ("bars",),
    "ranged": ("lagged",),
    "rolled": ("ranged",),
    "benchmark_moves": ("index_bars",),
    "ranked_index": ("index_bars",),
    "metrics": ("rolled", "ranked_index"),
    "banned_now": ("bans",),
}


def with_tables(names: str, body: str, extra: str = "") -> str:
    """Prefix ``body`` with the expressions it needs, dependencies first.

    ``extra`` holds further expressions of the query itself.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in ordered]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)} {body}" if parts else body
