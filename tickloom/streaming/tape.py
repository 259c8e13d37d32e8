"""Streams of trades and order events: bars by event time, rolling features, books.

Late rows: a row behind the watermark is dropped by the windowed bars (the query's progress counts them); the rolling
features take a micro-batch's rows in event order, and a row older than what its key has already emitted comes out
marked as late, without features. Keyed processors need the RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import is_buy, is_sell

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
_FEATURES = (
    "symbol string, ms long, trade_id long, trade_count_buy long, trade_count_sell long, cvd_buy double, cvd_sell double, "
    "mean_price_buy double, mean_price_sell double, mean_volume_buy double, mean_volume_sell double, trade_spread_signed double, late boolean"
)
_TOPS = "symbol string, seq long, best_bid double, best_ask double"


def bars(trades: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Bars of a stream with exchange_ts; quantiles are approximate (a stream keeps a sketch, not the prices)."""
    price, quantity = F.col("price"), F.col("quantity").cast("double")
    buy, sell = (F.coalesce(f(F.col("side")), F.lit(False)) for f in (is_buy, is_sell))
    at = F.struct("exchange_ts", "trade_id")
    grouped = trades.withWatermark("exchange_ts", late).groupBy("symbol", F.window("exchange_ts", width).alias("w"))
    out = grouped.agg(
        F.count("*").alias("trade_count"), F.count_if(buy).alias("trade_count_buy"), F.count_if(sell).alias("trade_count_sell"),
        F.sum(F.when(buy, quantity).otherwise(0.0)).alias("volume_buy"), F.sum(F.when(sell, quantity).otherwise(0.0)).alias("volume_sell"),
        F.sum(quantity).alias("volume_total"), F.sum(price * quantity).alias("notional_total"), F.max_by("price", at).alias("price_last"),
        F.min_by("price", at).alias("price_first"), F.min("price").alias("price_min"), F.max("price").alias("price_max"),
        F.avg("price").alias("price_mean"), F.stddev_samp("price").alias("price_std"), F.percentile_approx("price", [0.25, 0.75, 0.01, 0.99]).alias("q"),
    )
    q = [F.col("q")[i].alias(n) for i, n in enumerate(("price_q25", "price_q75", "q01", "q99"))]
    return out.select("symbol", F.col("w.start").alias("exchange_ts"), *[c for c in out.columns if c not in ("symbol", "w", "q")], *q)


def rolling_rows(ms: np.ndarray, price: np.ndarray, quantity: np.ndarray, buy: np.ndarray, sell: np.ndarray, back_ms: int) -> dict[str, np.ndarray]:
    """Rolling metrics of rows sorted by ms, by differences of prefix sums."""
    low, high = np.searchsorted(ms, ms - back_ms, "left"), np.searchsorted(ms, ms, "left")
    total = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[high] - c[low]
    out: dict[str, np.ndarray] = {}
    for name, side in (("buy", buy), ("sell", sell)):
        n, volume, paid = total(side.astype(np.int64)), total(np.where(side, quantity, 0.0)), total(np.where(side, price, 0.0))
        with np.errstate(invalid="ignore", divide="ignore"):
            out |= {f"trade_count_{name}": n, f"cvd_{name}": np.where(n > 0, volume, 0.0), f"mean_price_{name}": np.where(n > 0, paid / n, np.nan), f"mean_volume_{name}": np.where(n > 0, volume / n, np.nan)}
    out["trade_spread_signed"] = out["mean_price_buy"] - out["mean_price_sell"]
    return out


class Rolling(StatefulProcessor):
    """Keeps the last look-back of a symbol's trades, and gives each new trade its features."""

    back_ms = 300_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "ms long, price double, quantity double, side string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["ms", "trade_id"], kind="stable")
        old = pd.DataFrame([tuple(r) for r in self.held.get()], columns=["ms", "price", "quantity", "side"])
        tardy = new[new["ms"] < old["ms"].max()] if len(old) else new[:0]
        new = new.drop(tardy.index)
        if len(tardy):
            yield self._rows(key, tardy, {}, True)
        if not len(new):
            return
        names = ["ms", "price", "quantity", "side"]
        both = pd.concat([old, new[names]], ignore_index=True) if len(old) else new[names].reset_index(drop=True)
        side = both["side"].str.upper()
        made = rolling_rows(both["ms"].to_numpy(np.int64), both["price"].to_numpy(float), both["quantity"].to_numpy(float), (side == "BUY").to_numpy(), (side == "SELL").to_numpy(), self.back_ms)
        kept = both[both["ms"] >= both["ms"].max() - self.back_ms]
        self.held.put([tuple(r) for r in kept.itertuples(index=False, name=None)])
        yield self._rows(key, new, {k: v[len(old) :] for k, v in made.items()}, False)

    @staticmethod
    def _rows(key, rows: pd.DataFrame, made: dict[str, np.ndarray], late: bool) -> pd.DataFrame:
        out = pd.DataFrame({"symbol": key[0], "ms": rows["ms"].to_numpy(), "trade_id": rows["trade_id"].to_numpy()})
        for c in _FEATURES.split(", ")[3:-1]:
            name, kind = c.split()
            values = pd.Series(made.get(name, np.full(len(out), np.nan)))
            out[name] = values.astype("Int64") if kind == "long" else values.astype(object).where(values.notna(), None)
        return out.assign(late=late)

    def close(self) -> None:
        pass


def rolling(trades: DataFrame, back_ms: int = 300_000) -> DataFrame:
    """Rolling features of a stream with symbol, ms, trade_id, price, quantity, side."""
    processor = type("RollingOf", (Rolling,), {"back_ms": back_ms})()
    return trades.groupBy("symbol").transformWithStateInPandas(processor, _FEATURES, "Append", "None")


#: Living orders as they are held: side 0 is bid, 1 ask, anything else no side.
_ORDER = np.dtype([("uid", "<i8"), ("price", "<f8"), ("size", "<f8"), ("side", "i1")])


def last_lives(seq: np.ndarray, uid: np.ndarray, side: np.ndarray, price: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What some events leave of each order that they name, by uid: the order as it would be added by the first event
    after its last removal, whether it was removed among them, and whether it lives after them."""
    order = np.lexsort((seq, uid))
    uid, size = uid[order], size[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(len(uid), 1), bool), uid[1:] != uid[:-1])))
    end = np.append(start[1:], len(uid))
    removal = np.maximum.reduceat(np.where(size == 0, np.arange(len(uid)), -1), start) if len(uid) else start
    removed = removal >= start
    first = np.where(removed, removal + 1, start)
    lives = first < end
    added = order[np.minimum(first, end - 1)]
    made = np.empty(len(start), _ORDER)
    made["uid"], made["side"], made["price"], made["size"] = uid[start], side[added], price[added], size[end - 1]
    return made, removed, lives


def outlived(old: np.ndarray, made: np.ndarray, removed: np.ndarray, lives: np.ndarray) -> np.ndarray:
    """Orders (sorted by uid) after the events of ``last_lives``: one that wasn't removed keeps its side and price."""
    at = np.searchsorted(old["uid"], made["uid"])
    known = np.zeros(len(made), bool)
    inside = at < len(old)
    known[inside] = old["uid"][at[inside]] == made["uid"][inside]
    kept = known & ~removed
    made = made.copy()
    for c in ("side", "price"):
        made[c][kept] = old[c][at[kept]]
    rest = np.ones(len(old), bool)
    rest[at[known]] = False
    out = np.concatenate((old[rest], made[lives]))
    return out[np.argsort(out["uid"], kind="stable")]


class Book(StatefulProcessor):
    """Living orders in buckets by uid, and each bucket's best prices; after each batch the best prices of all.

    A batch's events are summed up for each order at once (orders don't depend on each other); only buckets that hold
    one of its orders are read and written. The number of buckets doubles with the book, so that one stays some
    ``fill`` orders.
    """

    fill, least = 64, 64

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.orders = handle.getMapState("orders", "bucket int", "rows binary")
        self.best = handle.getValueState("best", "orders long, prices binary")

    @staticmethod
    def _bucket(uid: np.ndarray, buckets: int) -> np.ndarray:
        mixed = uid.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - buckets.bit_length())).astype(np.int64)

    def _held(self, buckets: np.ndarray) -> np.ndarray:
        found = [self.orders.getValue((int(b),)) for b in buckets if self.orders.containsKey((int(b),))]
        rows = np.concatenate([np.zeros(0, _ORDER), *[np.frombuffer(bytes(f[0]), _ORDER) for f in found]])
        return rows[np.argsort(rows["uid"], kind="stable")]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kinds = {"seq": "int64", "uid": "int64", "side": "int8", "price": "float64", "size": "float64"}
        parts = [[r[c].astype(kind).to_numpy() for c, kind in kinds.items()] for r in rows]
        seq, *others = (np.concatenate(p) for p in zip(*parts, strict=True))
        del parts
        made, removed, lives = last_lives(seq, *others)
        n, prices = self.best.get() if self.best.exists() else (0, np.full((2, self.least), np.nan).tobytes())
        best = np.frombuffer(bytes(prices), np.float64).reshape(2, -1).copy()
        buckets = had = best.shape[1]
        while n + len(made) > 2 * self.fill * buckets:
            buckets *= 2
        touched = np.unique(self._bucket(made["uid"], had)) if buckets == had else np.arange(had)
        old = self._held(touched)
        left = outlived(old, made, removed, lives)
        if buckets != had:
            best, touched = np.full((2, buckets), np.nan), np.arange(buckets)
        home = self._bucket(left["uid"], buckets)
        order = np.argsort(home, kind="stable")
        left, home = left[order], home[order]
        ends = np.searchsorted(home, touched, side="right")
        for b, i, j in zip(touched.tolist(), np.searchsorted(home, touched).tolist(), ends.tolist(), strict=True):
            if j > i:
                self.orders.updateValue((b,), (left[i:j].tobytes(),))
            elif self.orders.containsKey((b,)):
                self.orders.removeKey((b,))
        best[:, touched] = np.nan
        for side, better in enumerate((np.fmax, np.fmin)):
            here = left["side"] == side
            better.at(best[side], home[here], left["price"][here])
        self.best.update((n + len(left) - len(old), best.tobytes()))
        bid, ask = (None if np.isnan(p) else float(p) for p in (np.fmax.reduce(best[0]), np.fmin.reduce(best[1])))
        yield pd.DataFrame({"symbol": [key[0]], "seq": [int(seq.max())], "best_bid": [bid], "best_ask": [ask]})

    def close(self) -> None:
        pass


def book(events: DataFrame) -> DataFrame:
    """Best bid and ask of each symbol after each micro-batch of order events."""
    side = F.when(F.col("side") == "bid", 0).when(F.col("side") == "ask", 1).otherwise(2).cast("byte").alias("side")
    rows = events.select("symbol", "seq", "uid", side, "price", "size")
    return rows.groupBy("symbol").transformWithStateInPandas(Book(), _TOPS, "Update", "None")
