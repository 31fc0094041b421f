"""Questions about a store that read only the months they need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bans as ban_ops
from ..operators import lookups
from ..operators.rolling import reach
from ..sources.store import Store
from . import metrics, screens
from .screens import BENCHMARK


def market_stats(store: Store) -> DataFrame:
    """Stock count, stocks up on the latest date, and that date."""
    last = store.last_date("daily_ohlcv")
    return lookups.market_stats(store.table("fno_stocks"), store.table("daily_ohlcv", last, last))


def current_bans(store: Store) -> DataFrame:
    """Ban rows of the latest ban date."""
    last = store.last_date("fno_ban_period")
    return store.table("fno_ban_period", last, last)


def ban_status(store: Store) -> DataFrame:
    """Latest ban date with its banned symbols."""
    return ban_ops.ban_status(current_bans(store))


def ban_frequency(store: Store, days: int = 30) -> DataFrame:
    """Days in ban per symbol over the ``days`` up to the latest ban date."""
    last = store.last_date("fno_ban_period")
    first = None if last is None else last - ban_ops.before(days)
    until = F.current_date() if last is None else last
    return ban_ops.ban_frequency(store.table("fno_ban_period", first, last), until, days)


def screen_latest(
    store: Store,
    screen_id: str,
    *,
    exclude: bool = False,
    benchmark: str = BENCHMARK,
    ordered: bool = True,
) -> DataFrame:
    """A screen on the stored table's last date, with ban marks (K8).

    Only symbols that trade on that date are looked back upon, and only the months that hold
    the screen's look-back rows of each of them are read (A10).
    """
    last = store.last_date("daily_ohlcv")
    trading = store.table("daily_ohlcv", last, last).select("symbol")
    needed = reach(screens.get_screen(screen_id).indicators) + 1
    bars = store.recent("daily_ohlcv", needed, among=trading).join(trading, "symbol", "left_semi")
    return screens.run_screen(
        bars, current_bans(store), screen_id, index=store.table("index_ohlcv"),
        as_of="latest" if last is None else last, exclude=exclude, benchmark=benchmark,
        ordered=ordered,
    )


def ytd_anchor(store: Store) -> DataFrame:
    """Close of each symbol on the first trading date of the last date's year."""
    last = store.last_date("daily_ohlcv")
    start = None if last is None else last.replace(month=1, day=1)
    return metrics.ytd_anchor(store.table("daily_ohlcv", start, last), start)


def stock_metrics(store: Store, benchmark: str = BENCHMARK) -> DataFrame:
    """Latest bar and look-back metrics of every stored symbol (K9).

    Only the months that hold the newest year of rows of every symbol are read (A10).
    """
    return metrics.stock_metrics(
        store.recent("daily_ohlcv", metrics.YEAR_ROWS), store.table("index_ohlcv"), benchmark=benchmark,
        anchor=ytd_anchor(store),
    )
