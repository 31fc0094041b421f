"""DuckDB equivalents of the registered queries."""

from __future__ import annotations

from .oracle_tables import with_tables

ORACLE: dict[str, str] = {}


def _add(name: str, tables: str, body: str, extra: str = "") -> None:
    ORACLE[name] = with_tables(tables, body, extra)


def _d(*columns: str) -> str:
    """Columns as doubles."""
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)


def _s(*columns: str) -> str:
    """Columns as text."""
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


# -- screens ---------------------------------------------------------------------------------


def _volume_hits(amount: str, mean: str, peak: str) -> str:
    return f"""
        SELECT symbol, date, close, (close - open) / NULLIF(open, 0) * 100 AS change_pct, volume,
               delivery_pct, round({amount} / NULLIF({mean}, 0), 2) AS volume_mult,
               'N/A' AS strength
        FROM rolled
        WHERE close > top20 AND {amount} > 2 * {mean} AND {amount} > {peak}
          AND close > open AND close > 20"""


def _range_hits(beyond: str, amount: str, mean: str) -> str:
    return f"""
        SELECT symbol, date, close,
               round((close - prev_close) / NULLIF(prev_close, 0) * 100, 2) AS change_pct, volume,
               delivery_pct, round({amount} / NULLIF({mean}, 0), 2) AS volume_mult,
               CASE WHEN NOT coalesce({beyond} > atr14, false) THEN 'Partial (Small Size)'
                    WHEN {amount} > 1.5 * {mean} THEN 'Full'
                    ELSE 'Partial (Low Volume)' END AS strength
        FROM rolled WHERE {beyond} > 0"""


_WEAK_HITS = """
        SELECT symbol, date, close, round(stock_pct, 2) AS change_pct,
               round(stock_pct - benchmark_pct, 2) AS relative_return,
               round(place * 100, 1) AS close_location,
               round(delivery_volume / NULLIF(del20, 0), 2) AS delivery_mult, delivery_pct
        FROM (SELECT *, CASE WHEN prev_close > 0
                             THEN (close - prev_close) / prev_close * 100 ELSE 0 END AS stock_pct,
                     CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS place
              FROM rolled) b
        LEFT JOIN benchmark_moves USING (date)
        WHERE stock_pct - coalesce(benchmark_pct, 0) <= -1.2 AND place <= 0.30
          AND delivery_volume >= 1.5 * del20 AND close > 20"""

_HITS = {
    "volume-breakout": _volume_hits("volume", "vol50", "volmax10"),
    "upward-breakout": _range_hits("(close - top20)", "volume", "vol20"),
    "downward-breakout": _range_hits("(bottom20 - close)", "volume", "vol20"),
    "volume-breakout-delivery": _volume_hits("delivery_volume", "del50", "delmax10"),
    "upward-breakout-delivery": _range_hits("(close - top20)", "delivery_volume", "del20"),
    "downward-breakout-delivery": _range_hits("(bottom20 - close)", "delivery_volume", "del20"),
    "relative-weakness": _WEAK_HITS,
}
_TITLES = {
    "volume-breakout": "Volume Breakout Pattern",
    "upward-breakout": "Upward Breakout (20D)",
    "downward-breakout": "Downward Breakdown (20D)",
    "volume-breakout-delivery": "Volume Breakout (Delivery)",
    "upward-breakout-delivery": "Upward Breakout (20D Delivery)",
    "downward-breakout-delivery": "Downward Breakdown (20D Delivery)",
    "relative-weakness": "Relative Weakness (vs Nifty)",
}


def _screen_columns(screen_id: str) -> str:
    if screen_id == "relative-weakness":
        numbers = ("close", "change_pct", "relative_return", "close_location", "delivery_mult",
                   "delivery_pct")
        return f"symbol, {_s('date')}, {_d(*numbers)}"
    numbers = ("close", "change_pct", "delivery_pct", "volume_mult")
    return f"symbol, {_s('date')}, {_d(*numbers)}, volume, strength"


def _screen_tables(screen_id: str) -> str:
    return "rolled benchmark_moves" if screen_id == "relative-weakness" else "rolled"


for _id, _hits in _HITS.items():
    _name = f"screen_{_id.replace('-', '_')}"
    _hit_table = f"hits AS ({_hits})"
    _columns = _screen_columns(_id)
    _add(_name, _screen_tables(_id), f"SELECT {_columns} FROM hits", _hit_table)
    _add(
        f"{_name}_as_of",
        _screen_tables(_id),
        f"SELECT {_columns} FROM hits WHERE date = (SELECT max(date) FROM hits)",
        _hit_table,
    )

_add(
    "screen_latest",
    "rolled benchmark_moves",
    f"""SELECT {_screen_columns('relative-weakness')} FROM hits
        WHERE date = (SELECT max(date) FROM bars)""",
    f"hits AS ({_WEAK_HITS})",
)
_UP_HITS = f"hits AS ({_HITS['upward-breakout']})"
_add(
    "screen_ban_marked",
    "rolled banned_now",
    f"""SELECT {_screen_columns('upward-breakout')},
               CASE WHEN symbol IN (SELECT symbol FROM banned_now) THEN 'true' ELSE 'false' END
                   AS in_ban
        FROM hits""",
    _UP_HITS,
)
_add(
    "screen_ban_excluded",
    "rolled banned_now",
    f"""SELECT {_screen_columns('upward-breakout')}, 'false' AS in_ban
        FROM hits WHERE symbol NOT IN (SELECT symbol FROM banned_now)""",
    _UP_HITS,
)
_add(
    "screen_counts",
    "rolled benchmark_moves",
    " UNION ALL ".join(
        f"SELECT '{i}' AS id, '{_TITLES[i]}' AS title, count(*) AS hits FROM ({h}) h{n}"
        for n, (i, h) in enumerate(_HITS.items())
    ),
)
_add(
    "screen_result_sort",
    "rolled",
    f"""SELECT {_screen_columns('upward-breakout-delivery')} FROM hits
        ORDER BY coalesce(hits.volume_mult, 0), hits.symbol, hits.date""",
    f"hits AS ({_HITS['upward-breakout-delivery']})",
)
_add(
    "screen_api_records",
    "rolled benchmark_moves banned_now",
    """SELECT symbol, CAST(close AS DOUBLE) AS close, change_pct AS changePct,
              relative_return AS relativeReturn, close_location AS closeLocation,
              delivery_mult AS deliveryMult, CAST(delivery_pct AS DOUBLE) AS deliveryPct,
              CAST(date AS VARCHAR) AS date,
              CASE WHEN symbol IN (SELECT symbol FROM banned_now) THEN 'true' ELSE 'false' END
                  AS inBan
       FROM hits""",
    f"hits AS ({_WEAK_HITS})",
)

# -- rolling columns -------------------------------------------------------------------------

_ROLLING = """
    SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(top20 AS DOUBLE) AS max_20_high,
           CAST(bottom20 AS DOUBLE) AS min_20_low, vol50 AS avg_50_vol, volmax10 AS max_10_vol,
           vol20 AS avg_20_vol, del50 AS avg_50_del_vol, delmax10 AS max_10_del_vol,
           del20 AS avg_20_del_vol, CAST(tr AS DOUBLE) AS tr, atr14 AS atr,
           CAST(high252 AS DOUBLE) AS high_52w, sma20 AS sma_20, sma50 AS sma_50,
           sma200 AS sma_200, CAST(month_ago AS DOUBLE) AS close_1m_ago,
           CAST(year_ago AS DOUBLE) AS close_1y_ago
    FROM rolled"""
_add("rolling_indicators", "rolled", _ROLLING)
_add("rolling_indicators_split", "rolled", _ROLLING)
_add("benchmark_return", "benchmark_moves", f"SELECT {_s('date')}, benchmark_pct FROM benchmark_moves")

# -- stock list ------------------------------------------------------------------------------

_METRICS = (
    "symbol, CAST(date AS VARCHAR) AS date, "
    + _d("open", "high", "low", "close", "prev_close", "change_pct")
    + ", volume, "
    + _d("value")
    + ", delivery_volume, "
    + _d("delivery_pct", "ytd_pct", "pct_1y", "pct_1m", "delta_52w_high", "rs_rank")
    + ", "
    + _s("above_sma_20", "above_sma_50", "above_sma_200")
)
_LISTED = """
    listed AS (SELECT m.*, s.company_name, CAST(s.lot_size AS BIGINT) AS lot_size,
                      m.symbol IN (SELECT symbol FROM banned_now) AS banned
               FROM metrics m JOIN master s ON m.symbol = s.symbol)"""
_PAGE = (
    f"SELECT {_METRICS}, company_name, lot_size, "
    "CASE WHEN banned THEN 'true' ELSE 'false' END AS in_ban"
)
_LIST_TABLES = "metrics master banned_now"

_add("stock_metrics", "metrics", f"SELECT {_METRICS} FROM metrics")
_add(
    "stock_list_page",
    _LIST_TABLES,
    f"""{_PAGE} FROM listed ORDER BY listed.pct_1y DESC NULLS LAST, listed.symbol
        LIMIT 7 OFFSET 7""",
    _LISTED,
)
_add(
    "stock_search",
    _LIST_TABLES,
    f"""{_PAGE} FROM listed WHERE symbol ILIKE '%and#2%' OR company_name ILIKE '%and#2%'
        ORDER BY listed.symbol LIMIT 50""",
    _LISTED,
)
_add(
    "stock_list_unbanned",
    _LIST_TABLES,
    f"""{_PAGE} FROM listed WHERE NOT banned
        ORDER BY listed.volume DESC NULLS LAST, listed.symbol LIMIT 20""",
    _LISTED,
)
_add(
    "stock_list_unbanned_strict",
    _LIST_TABLES,
    f"""{_PAGE} FROM (SELECT * FROM listed ORDER BY volume DESC NULLS LAST, symbol LIMIT 20)
        WHERE NOT banned""",
    _LISTED,
)
_CLOSES = """
    closes AS (SELECT symbol, string_agg(CAST(close AS VARCHAR), ',' ORDER BY date) AS prices
               FROM rolled WHERE newest <= 252 GROUP BY symbol)"""
_add(
    "stock_list",
    _LIST_TABLES,
    f"""{_PAGE}, sparkline FROM (
            SELECT l.*, c.prices AS sparkline FROM listed l LEFT JOIN closes c USING (symbol)
            ORDER BY l.rs_rank DESC NULLS LAST, l.symbol LIMIT 10)""",
    f"{_LISTED}, {_CLOSES}",
)
_add(
    "stock_page_totals",
    "master",
    """SELECT CAST(2 AS BIGINT) AS page, CAST(4 AS BIGINT) AS page_limit, total,
              CAST(ceil(total / 4.0) AS BIGINT) AS total_pages, CAST(5 AS BIGINT) AS first_row,
              least(CAST(8 AS BIGINT), total) AS last_row
       FROM (SELECT count(*) AS total FROM master
             WHERE symbol ILIKE '%brand#1%' OR company_name ILIKE '%brand#1%')""",
)
_add("sparkline", "rolled", "SELECT symbol, prices FROM closes", _CLOSES)
_add(
    "sparkline_trend",
    "rolled",
    """SELECT symbol, CASE WHEN count(*) < 2 THEN 'none'
                           WHEN arg_max(close, date) > arg_min(close, date) THEN 'positive'
                           WHEN arg_max(close, date) < arg_min(close, date) THEN 'negative'
                           ELSE 'neutral' END AS trend
       FROM rolled WHERE newest <= 252 GROUP BY symbol""",
)
_add(
    "sparkline_scaled",
    "rolled",
    """SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS position,
              (c - low) / CASE WHEN top = low THEN 1 ELSE top - low END AS height
       FROM (SELECT symbol, date, CAST(close AS DOUBLE) AS c,
                    min(CAST(close AS DOUBLE)) OVER (PARTITION BY symbol) AS low,
                    max(CAST(close AS DOUBLE)) OVER (PARTITION BY symbol) AS top
             FROM rolled WHERE newest <= 252)""",
)
_add(
    "stock_history",
    "bars master",
    f"""SELECT symbol, {_s('date')}, {_d('open', 'high', 'low', 'close', 'prev_close')}, volume,
               {_d('value')}, delivery_volume, {_d('delivery_pct')},
               round((close - prev_close) / NULLIF(prev_close, 0) * 100, 2) AS change_pct
        FROM bars WHERE symbol = 'BRAND#13' AND symbol IN (SELECT symbol FROM master)
        ORDER BY bars.date DESC LIMIT 30""",
)
_add(
    "stock_info",
    "master",
    """SELECT symbol, company_name, CAST(lot_size AS BIGINT) AS lot_size FROM master
       WHERE symbol = 'BRAND#13'""",
)

# -- bans ------------------------------------------------------------------------------------

_add(
    "ban_status",
    "bans banned_now",
    """SELECT CAST((SELECT max(trade_date) FROM bans) AS VARCHAR) AS trade_date, symbol,
              (SELECT count(*) FROM banned_now) AS banned_count
       FROM banned_now""",
)
_RECENT = """
    recent AS (SELECT * FROM bans, (SELECT max(trade_date) AS until FROM bans)
               WHERE trade_date > until - INTERVAL 30 DAY)"""
_add(
    "ban_frequency",
    "bans",
    "SELECT symbol, count(DISTINCT trade_date) AS days_in_ban FROM recent GROUP BY symbol",
    _RECENT,
)
_add(
    "ban_frequency_summary",
    "bans",
    """SELECT count(DISTINCT trade_date) AS days_with_bans,
              count(DISTINCT symbol) AS banned_symbols FROM recent""",
    _RECENT,
)
_add(
    "ban_sweep",
    "bans",
    """SELECT CAST(day AS VARCHAR) AS trade_date, count(symbol) AS banned_count
       FROM (SELECT CAST((SELECT max(trade_date) FROM bans) - to_days(CAST(i AS INTEGER)) AS DATE)
                 AS day
             FROM range(30) r(i))
       LEFT JOIN bans ON trade_date = day GROUP BY day""",
)
_add(
    "insert_ignore_bans",
    "bans",
    f"""SELECT {_s('trade_date')}, symbol,
               CASE WHEN trade_date < DATE '2000-01-01' THEN 'true' ELSE 'false' END AS kept
        FROM bans""",
)

# -- statistics and quality ------------------------------------------------------------------

_add(
    "market_stats",
    "bars master",
    """SELECT (SELECT count(*) FROM master) AS stock_count,
              count(*) FILTER (WHERE prev_close > 0 AND close > prev_close) AS positive_count,
              CAST(max(date) AS VARCHAR) AS last_updated
       FROM bars WHERE date = (SELECT max(date) FROM bars)""",
)
_add(
    "store_stats",
    "bars master",
    """SELECT (SELECT count(*) FROM master) AS stock_count, count(*) AS bar_count,
              CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date
       FROM bars""",
)


def _jumps(table: str) -> str:
    return f"""
        jumps AS (SELECT symbol, date, close, prev_close, lag(close) OVER (
                             PARTITION BY symbol ORDER BY date) AS prev_row_close
                  FROM {table})"""


_MOVE = "(close - prev_row_close) / NULLIF(prev_row_close, 0)"
_add(
    "detect_jumps_abs",
    "bars_q",
    f"SELECT DISTINCT symbol FROM jumps WHERE abs({_MOVE}) > 0.30",
    _jumps("bars_q"),
)
_add(
    "detect_jumps_drop",
    "bars",
    f"SELECT DISTINCT symbol FROM jumps WHERE {_MOVE} < -0.30",
    _jumps("bars"),
)
_add(
    "detect_jumps_prev_close",
    "bars_q",
    "SELECT DISTINCT symbol FROM jumps WHERE prev_close <> prev_row_close",
    _jumps("bars_q"),
)
_add(
    "jump_rows",
    "bars",
    f"""SELECT symbol, {_s('date')}, {_d('close', 'prev_row_close')} FROM jumps
        WHERE abs({_MOVE}) > 0.30""",
    _jumps("bars"),
)
_BAD = "(close < low OR close > high)"
_add("ohlc_violations", "bars_q", f"SELECT DISTINCT symbol FROM bars_q WHERE {_BAD}")
_add(
    "ohlc_violation_counts",
    "bars_q",
    f"SELECT symbol, count(*) AS bad_rows FROM bars_q WHERE {_BAD} GROUP BY symbol",
)
_CHECKS = {
    "null_close": "close IS NULL",
    "null_date": "date IS NULL",
    "date_before_floor": "date < DATE '1998-01-01'",
    "non_positive_close": "close <= 0",
    "negative_volume": "volume < 0",
    "close_outside_range": _BAD,
}
_add(
    "dq_summary",
    "bars_q",
    " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, count(*) AS bad_rows FROM bars_q WHERE {rule}"
        for name, rule in _CHECKS.items()
    ),
)
_add(
    "dq_delta_52w",
    "bars_q",
    """SELECT symbol, count(*) AS bad_rows
       FROM (SELECT symbol, close, max(high) OVER (PARTITION BY symbol ORDER BY date
                                ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS top
             FROM bars_q)
       WHERE round((close - top) / top * 100, 2) > 0 GROUP BY symbol""",
)

# -- repair ----------------------------------------------------------------------------------

_add(
    "repair_update",
    "bars_q adj",
    f"""SELECT symbol, {_s('date')}, {_d('open', 'high', 'low', 'close', 'prev_close')}, volume,
               delivery_volume
        FROM (SELECT q.symbol, q.date, a.open, a.high, a.low, a.close, q.prev_close, a.volume,
                     q.delivery_volume
              FROM bars_q q JOIN adj a ON q.symbol = a.symbol AND q.date = a.date
              WHERE q.symbol IN (SELECT symbol FROM flagged)
              UNION ALL
              SELECT symbol, date, open, high, low, close, prev_close, volume, delivery_volume
              FROM bars_q WHERE symbol NOT IN (SELECT symbol FROM flagged))""",
    f"{_jumps('bars_q')}, flagged AS (SELECT DISTINCT symbol FROM jumps WHERE abs({_MOVE}) > 0.30)",
)
_add(
    "repair_report",
    "bars_q adj",
    f"""SELECT q.symbol, count(*) AS rows_updated, 'true' AS fixed
        FROM bars_q q JOIN adj a ON q.symbol = a.symbol AND q.date = a.date
        WHERE q.symbol IN (SELECT symbol FROM bars_q WHERE {_BAD}) GROUP BY q.symbol""",
)
_add(
    "repair_verify",
    "bars_q adj",
    f"""SELECT q.symbol, count(*) AS rows_before,
               (SELECT count(*) FROM adj a WHERE a.symbol = q.symbol AND {_BAD}) AS rows_after
        FROM bars_q q WHERE {_BAD} GROUP BY q.symbol""",
)

# -- cleaning and feeds ----------------------------------------------------------------------

_BAR_PRICES = _d("open", "high", "low", "close")
_BAR_REST = f"volume, {_d('value', 'vwap')}, CAST(trades AS BIGINT) AS trades, delivery_volume"
_STORED_BARS = f"""
    SELECT symbol, {_s('date')}, series, {_BAR_PRICES},
           coalesce(CAST(prev_close AS DOUBLE), 0) AS prev_close, {_BAR_REST}, {_d('delivery_pct')}
    FROM bars"""
_add("clean_bars", "bars", _STORED_BARS)
_add("clean_bars_mixed_headers", "bars", _STORED_BARS)
_add("stream_upsert", "bars", _STORED_BARS)
_add("stream_upsert_mixed_headers", "bars", _STORED_BARS)
_add(
    "clean_bars_null",
    "bars",
    f"""SELECT symbol, {_s('date')}, {_d('prev_close')},
               NULLIF(delivery_volume, 0) AS delivery_volume FROM bars""",
)
_add(
    "clean_bars_range",
    "bars",
    f"""SELECT symbol, {_s('date')}, {_d('close')}, volume FROM bars
        WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""",
)
_UNDATED = "year(date) = 2000 AND day(date) % 4 = 2"
_add(
    "quarantine",
    "bars",
    f"SELECT symbol, count(*) AS bad_rows FROM bars WHERE {_UNDATED} GROUP BY symbol",
)
_add(
    "bad_cells",
    "bars",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS bad_cells FROM landed WHERE {rule}"
        for c, rule in {
            **{c: "false" for c in ("open", "high", "low", "close", "volume", "value", "vwap",
                                    "trades", "delivery_pct")},
            "prev_close": "prev_close IS NULL",
            "delivery_volume": "delivery_volume = 0",
        }.items()
    ),
    f"""landed AS (SELECT prev_close, delivery_volume FROM bars
                   UNION ALL SELECT prev_close, delivery_volume FROM bars WHERE {_UNDATED}
                   UNION ALL SELECT prev_close, delivery_volume FROM bars
                             WHERE day(date) = 8)""",
)
_INDEX = f"index_name, {_s('date')}, {_BAR_PRICES}"
_add("clean_index", "index_bars", f"SELECT {_INDEX} FROM index_bars")
_add("adjusted_index_feed", "index_bars", f"SELECT {_INDEX} FROM index_bars")
_add(
    "adjusted_feed",
    "adj",
    f"""SELECT symbol, {_s('date')}, {_BAR_PRICES}, volume FROM adj
        WHERE date >= DATE '1998-01-01'""",
)
_add(
    "lot_sizes_json",
    "",
    """SELECT CAST(user_id AS VARCHAR) AS symbol, arg_max(lot, event_id) AS lot_size
       FROM (SELECT user_id, event_id,
                    CAST(json_extract_string(props, '$.k') AS BIGINT) AS lot
             FROM events WHERE event_type = 'purchase')
       WHERE lot > 0 GROUP BY user_id""",
)
_add(
    "eligible_mixed_headers",
    "",
    """SELECT upper(p_brand) AS symbol, trim(max(p_name)) AS company_name
       FROM part WHERE upper(p_brand) <> 'BRAND#5' GROUP BY upper(p_brand)""",
)
_add(
    "master_rows",
    "",
    """SELECT symbol, company_name,
              CAST(coalesce(lot, 0) AS BIGINT) AS lot_size
       FROM (SELECT upper(p_brand) AS symbol, arg_max(p_name, p_partkey) AS company_name,
                    arg_max(p_size, p_partkey) FILTER (
                        WHERE p_type <> 'PROMO' AND upper(p_brand) <> 'BRAND#5' AND p_size > 0) AS lot
             FROM part GROUP BY 1)""",
)
_KIND = """CASE WHEN c_acctbal > 5000 THEN 'first' WHEN c_acctbal > 0 THEN 'second'
                WHEN c_acctbal > -500 THEN 'placeholder' ELSE 'error' END"""
_add(
    "asset_coverage",
    "",
    f"""SELECT {_KIND} AS asset_source, count(*) AS symbols,
               round(count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE) * 100, 1)
                   AS share_pct
        FROM customer GROUP BY 1""",
)
_add(
    "asset_summary",
    "",
    """SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS real_assets,
              round(count(*) FILTER (WHERE c_acctbal > 0) / CAST(count(*) AS DOUBLE) * 100, 1)
                  AS real_pct
       FROM customer""",
)

# -- keyed writes ----------------------------------------------------------------------------

_CORRECTED = "CASE WHEN date >= DATE '1999-01-01' THEN close + 2 ELSE close END"
_add(
    "upsert_bars",
    "bars",
    f"""SELECT symbol, {_s('date')}, series, {_d('open', 'high', 'low')},
               CAST({_CORRECTED} AS DOUBLE) AS close, {_d('prev_close')}, {_BAR_REST},
               {_d('delivery_pct')}
        FROM bars""",
)
_add(
    "upsert_index",
    "index_bars",
    f"""SELECT index_name, {_s('date')}, {_d('open', 'high', 'low')},
               CAST({_CORRECTED} AS DOUBLE) AS close
        FROM index_bars""",
)
_add(
    "upsert_master_partial",
    "master",
    """SELECT coalesce(o.symbol, n.symbol) AS symbol,
              CASE WHEN n.symbol IS NOT NULL THEN n.company_name ELSE o.company_name END
                  AS company_name,
              CAST(CASE WHEN n.symbol IS NOT NULL THEN n.lot_size ELSE o.lot_size END AS BIGINT)
                  AS lot_size,
              o.sector, o.industry, o.segment,
              CASE WHEN n.symbol IS NOT NULL THEN 'true' ELSE 'false' END AS stamped
       FROM (SELECT * FROM master WHERE symbol IN (
                 SELECT upper(p_brand) FROM part WHERE p_type = 'PROMO')) o
       FULL JOIN (SELECT upper(p_brand) AS symbol, max(p_name) AS company_name,
                         max(p_size) AS lot_size
                  FROM part WHERE upper(p_brand) <> 'BRAND#5' GROUP BY 1) n
       ON o.symbol = n.symbol""",
)
_GAP = "(industry IS NULL OR industry = '' OR segment IS NULL OR segment = '')"
_add("metadata_gap_list", "master", f"SELECT symbol FROM master WHERE {_GAP}")
_add(
    "metadata_update",
    "master",
    f"""SELECT m.symbol, company_name, CAST(lot_size AS BIGINT) AS lot_size, sector,
               CASE WHEN {_GAP} AND NOT (n.ind = '' AND n.seg = '') THEN n.ind ELSE industry END
                   AS industry,
               CASE WHEN {_GAP} AND NOT (n.ind = '' AND n.seg = '') THEN n.seg ELSE segment END
                   AS segment
        FROM master m JOIN (
            SELECT symbol, CASE WHEN symbol IN ('BRAND#11', 'BRAND#12') THEN '' ELSE kind END
                       AS ind,
                   CASE WHEN symbol = 'BRAND#12' THEN 'CASH' ELSE '' END AS seg
            FROM (SELECT upper(p_brand) AS symbol, max(p_type) AS kind FROM part GROUP BY 1)
        ) n ON m.symbol = n.symbol""",
)

# -- incremental collection ------------------------------------------------------------------

_LOADED = """
    loaded AS (SELECT * FROM bars
               WHERE (symbol < 'BRAND#2' OR date < DATE '2000-01-01') AND symbol <> 'BRAND#25'),
    ends AS (SELECT symbol, max(date) AS last_date FROM loaded GROUP BY symbol)"""
_add(
    "incremental_plan",
    "bars master",
    """SELECT m.symbol,
              CAST(coalesce(last_date + 1, DATE '1995-01-01') AS VARCHAR) AS from_date,
              CAST(today AS VARCHAR) AS to_date,
              CASE WHEN last_date + 1 > today THEN 'true' ELSE 'false' END AS skip
       FROM master m LEFT JOIN ends e ON m.symbol = e.symbol,
            (SELECT max(date) AS today FROM bars)""",
    _LOADED,
)
_FRESH = """SELECT b.* FROM bars b LEFT JOIN ends e ON b.symbol = e.symbol
            WHERE e.last_date IS NULL OR b.date > e.last_date"""
_add(
    "incremental_new_rows",
    "bars",
    f"SELECT symbol, {_s('date')}, {_d('close')} FROM ({_FRESH})",
    _LOADED,
)
_add(
    "incremental_append",
    "bars",
    f"""SELECT symbol, {_s('date')}, series, {_BAR_PRICES}, {_d('prev_close')}, {_BAR_REST},
               {_d('delivery_pct')}
        FROM (SELECT * FROM loaded UNION ALL {_FRESH})""",
    _LOADED,
)

# -- stores and jobs -------------------------------------------------------------------------

for _name in ("market_stats", "ban_status", "ban_frequency", "stock_metrics"):
    ORACLE[f"store_{_name}"] = ORACLE[_name]
_add(
    "store_screen_latest",
    "rolled banned_now",
    f"""SELECT {_screen_columns('upward-breakout')},
               CASE WHEN symbol IN (SELECT symbol FROM banned_now) THEN 'true' ELSE 'false' END
                   AS in_ban
        FROM hits WHERE date = (SELECT max(date) FROM bars)""",
    _UP_HITS,
)
_RANGE = "date BETWEEN DATE '1998-01-01' AND DATE '2000-01-01'"
_LISTED = "symbol <> 'BRAND#5'"
_NEW = f"{_LISTED} AND date > DATE '1999-01-01' AND date <= DATE '2000-01-01'"
_add("collect_all_bars", "bars", f"{_STORED_BARS} WHERE {_LISTED} AND {_RANGE}")
_add(
    "collect_all_master",
    "",
    f"""SELECT upper(p_brand) AS symbol, max(p_name) AS company_name, CAST(0 AS BIGINT) AS lot_size
        FROM part WHERE upper(p_brand) <> 'BRAND#5' GROUP BY 1""",
)
_EQUITY_COUNTS = {
    "equity_read": f"1 + CAST(day(date) = 8 AS INTEGER) + CAST({_UNDATED} AS INTEGER)",
    "equity_other_series": "CAST(day(date) = 8 AS INTEGER)",
    "equity_undated": f"CAST({_UNDATED} AS INTEGER)",
    "equity_out_of_range": f"CAST(NOT ({_RANGE}) AS INTEGER)",
    "equity_unlisted": f"CAST({_RANGE} AND NOT ({_LISTED}) AS INTEGER)",
    "equity_already_stored": f"CAST({_RANGE} AND {_LISTED} AND NOT ({_NEW}) AS INTEGER)",
    "daily_ohlcv": f"CAST({_NEW} AS INTEGER)",
}
_STOCK_COUNT = f"(SELECT count(*) FROM master WHERE {_LISTED})"
_LOADED_COUNT = f"(SELECT count(DISTINCT symbol) FROM bars WHERE {_NEW})"
_add(
    "collect_report",
    "bars index_bars bans master",
    " UNION ALL ".join(
        [
            f"SELECT '{step}' AS step, CAST(sum({value}) AS BIGINT) AS n_rows FROM bars"
            for step, value in _EQUITY_COUNTS.items()
        ]
        + [
            f"SELECT '{step}', {value}"
            for step, value in {
                "fno_stocks": _STOCK_COUNT,
                "with_lot_size": "0",
                "symbols_loaded": _LOADED_COUNT,
                "symbols_without_rows": f"{_STOCK_COUNT} - {_LOADED_COUNT}",
                "index_ohlcv": f"(SELECT count(*) FROM index_bars WHERE {_RANGE})",
                "fno_ban_period": "(SELECT count(*) FROM bans)",
            }.items()
        ]
    ),
)
_add(
    "refresh_index_counts",
    "index_bars",
    """SELECT count(*) FILTER (WHERE date < DATE '2000-01-01') AS rows_before,
              count(*) AS rows_after FROM index_bars""",
)
_add(
    "adjusted_feed_dirty",
    "adj",
    f"""SELECT symbol, {_s('date')}, {_d('open', 'high', 'low')},
               CASE WHEN day(date) = 9 THEN 1e30 ELSE CAST(close AS DOUBLE) END AS close, volume
        FROM adj WHERE date >= DATE '1998-01-01' AND day(date) <> 7""",
)
_add(
    "repair_update_dirty",
    "bars_q adj",
    f"""SELECT symbol, {_s('date')}, {_d('open', 'high', 'low', 'close')}, volume
        FROM (SELECT q.symbol, q.date, a.open, a.high, a.low, a.close, a.volume
              FROM bars_q q JOIN adj a ON q.symbol = a.symbol AND q.date = a.date
              WHERE q.symbol IN (SELECT symbol FROM flagged) AND day(q.date) NOT IN (7, 9)
              UNION ALL
              SELECT symbol, date, open, high, low, close, volume FROM bars_q
              WHERE symbol NOT IN (SELECT symbol FROM flagged) OR day(date) IN (7, 9))""",
    f"{_jumps('bars_q')}, flagged AS (SELECT DISTINCT symbol FROM jumps WHERE abs({_MOVE}) > 0.30)",
)

# -- display labels --------------------------------------------------------------------------

_add(
    "heat_levels",
    "bars",
    f"""SELECT symbol, {_s('date')},
               CASE WHEN x > 0 THEN 'positive' WHEN x < 0 THEN 'negative' ELSE 'neutral' END
                   AS heat_sign,
               CAST(CASE WHEN x IS NULL OR x = 0 THEN 0 WHEN abs(x) < 5 THEN 1
                         WHEN abs(x) < 15 THEN 2 WHEN abs(x) < 30 THEN 3
                         WHEN abs(x) < 50 THEN 4 ELSE 5 END AS BIGINT) AS heat_level
        FROM (SELECT symbol, date, CASE WHEN prev_close > 0
                     THEN round((close - prev_close) / prev_close * 100, 2) END AS x FROM bars)""",
)
_add(
    "rs_class",
    "metrics",
    """SELECT symbol, CASE WHEN rs_rank > 5 THEN 'strong' WHEN rs_rank < -5 THEN 'weak'
                           ELSE 'neutral' END AS rs_class FROM metrics""",
)


def _unit_text(x: str) -> str:
    return f"""CASE WHEN {x} >= 10000000 THEN printf('%.2f Cr', round({x} / 1e7, 2))
                    WHEN {x} >= 100000 THEN printf('%.2f L', round({x} / 1e5, 2))
                    WHEN {x} >= 1000 THEN printf('%.2f K', round({x} / 1e3, 2))
                    ELSE CAST({x} AS VARCHAR) END"""


_add(
    "volume_units",
    "bars",
    f"""SELECT symbol, {_s('date')}, {_unit_text('volume')} AS volume_text,
               {_unit_text('turnover')} AS turnover_text
        FROM (SELECT symbol, date, volume, CAST(floor(value) AS BIGINT) * 10 AS turnover
              FROM bars)""",
)
_add(
    "strength_classes",
    "rolled",
    f"""SELECT symbol, {_s('date')}, lower(split_part(strength, ' ', 1)) AS strength_class,
               CASE WHEN change_pct > 0 THEN 'positive' WHEN change_pct < 0 THEN 'negative'
                    ELSE 'neutral' END AS change_class
        FROM hits""",
    f"hits AS ({_HITS['downward-breakout']})",
)
