"""The streamed book at size: its state is read and written by bucket, not by event."""

import random

import numpy as np
import pandas as pd
import pytest

from tickloom.streaming.tape import Book


class State:
    """A map or value state in memory that counts its calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def _call(self, value=None):
        self.calls += 1
        return value

    def containsKey(self, key):
        return self._call(key in self.rows)

    def getValue(self, key):
        return self._call(self.rows.get(key))

    def updateValue(self, key, value):
        self._call()
        self.rows[key] = value

    def removeKey(self, key):
        self._call()
        del self.rows[key]

    def keys(self):
        return iter(self._call(list(self.rows)))

    def exists(self):
        return self._call(() in self.rows)

    def get(self):
        return self._call(self.rows.get(()))

    def update(self, value):
        self._call()
        self.rows[()] = value


class Handle:
    def __init__(self):
        self.states = []

    def getMapState(self, *_):
        self.states.append(State())
        return self.states[-1]

    getValueState = getMapState

    def calls(self):
        return sum(s.calls for s in self.states)


def opened(least=64, fill=64):
    book, handle = type("BookOf", (Book,), {"least": least, "fill": fill})(), Handle()
    book.init(handle)
    return book, handle


def tops(book, batch):
    frame = pd.DataFrame(batch, columns=["seq", "uid", "side", "price", "size"])
    pieces = [frame[i : i + 37] for i in range(0, len(frame), 37)] if len(frame) < 1000 else [frame]
    (out,) = book.handleInputRows(("A",), iter(pieces), None)
    (row,) = out.itertuples(index=False)
    return row.seq, *(None if pd.isna(x) else x for x in (row.best_bid, row.best_ask))


def replayed(orders, batch):
    """The rule, event by event."""
    for _, uid, side, price, size in sorted(batch):
        if size == 0:
            orders.pop(uid, None)
        elif uid not in orders:
            orders[uid] = (side, price)
    bids, asks = ([p for s, p in orders.values() if s == k] for k in (0, 1))
    return max(batch)[0], max(bids, default=None), min(asks, default=None)


@pytest.mark.parametrize("seed", range(6))
def test_same_tops_as_event_by_event(seed):
    draw = random.Random(seed)
    book, handle = opened(least=2, fill=3)
    orders, seq = {}, 0
    for batch in range(40):
        span, removals = draw.choice([3, 30, 300]), draw.choice([0.1, 0.5, 0.95])
        events = []
        for _ in range(draw.randrange(1, 120)):
            seq += 1
            uid = draw.randrange(span) - 5
            events.append((seq, uid, draw.randrange(2), float(draw.randrange(40)), 0.0 if draw.random() < removals else float(draw.randrange(1, 9))))
        draw.shuffle(events)
        assert tops(book, events) == replayed(orders, events), batch
        n, prices = handle.states[1].rows[()]
        assert n == len(orders)
        buckets = len(np.frombuffer(prices)) // 2
        assert all(0 <= b < buckets for (b,) in handle.states[0].rows)
    assert buckets > 2


def test_an_emptied_book_has_no_best_and_no_rows():
    book, handle = opened()
    assert tops(book, [(1, 1, 0, 5.0, 1.0), (2, 2, 1, 7.0, 1.0)]) == (2, 5.0, 7.0)
    assert tops(book, [(3, 1, 0, 5.0, 0.0), (4, 2, 1, 7.0, 0.0)]) == (4, None, None)
    assert not handle.states[0].rows


def test_state_calls_follow_orders_not_events():
    draw = random.Random(7)
    book, handle = opened()
    events = [(i, draw.randrange(200), 0, float(draw.randrange(90)), float(draw.randrange(5))) for i in range(50_000)]
    assert tops(book, events) == replayed({}, events)
    assert handle.calls() < 1000


def test_a_large_book_is_read_in_part():
    book, handle = opened()
    tops(book, [(i, i, i % 2, float(i % 1000), 1.0) for i in range(100_000)])
    before = handle.calls()
    assert tops(book, [(200_000, 4, 0, 0.0, 0.0), (200_001, 999_998, 0, 5000.0, 1.0)]) == (200_001, 5000.0, 1.0)
    assert handle.calls() - before < 20
