from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from lapidary.llm import sale_assembly as sa

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, day string, due string"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, key string"
EPOCH = datetime(1970, 1, 1)


def _cents(x):
    return math.floor(100 * x + 0.5) if x is not None and math.isfinite(x) else 0


def _day(t):
    return (t - EPOCH).days


def _want(sales, lines, batches=10):
    """The contract, row by row."""
    lines = [r for r in dict.fromkeys(lines) if r[0] is not None]
    events = defaultdict(lambda: defaultdict(lambda: [0, 0, False]))  # by sale and day: lines, cents, held
    line_days = defaultdict(list)
    for r in lines:
        h = zlib.crc32((f"{r[0]}:{r[1]}" if r[1] is not None else f"{r[0]}").encode())
        d = 19723 + h % 152 if r[8] is None else _day(r[8]) + h % 15
        e = events[r[0]][d]
        e[0] += 1
        e[1] += _cents(r[5])
        line_days[r[0]].append((d, _cents(r[5])))
    totals = {}
    for r in sales:
        if r[0] is not None:
            d = 19723 if r[5] is None else _day(r[5])
            events[r[0]][d][2] = True
            totals[r[0]] = min(totals.get(r[0], (d, _cents(r[3]))), (d, _cents(r[3])))
    batch_of = lambda d: max(0, min(batches - 1, (d - 19723) * batches // 160))

    def due(s):
        k, own = zlib.crc32(str(s).encode()) % 5, line_days[s]
        if k == 0:
            return totals[s][1] if s in totals else 0
        return sum(c for d, c in own if k != 1 or d < max(x for x, _ in own))

    out, open_, largest = [], {}, -(10**9)
    for k in range(batches):
        days = sorted((d, s) for s, by in events.items() for d in by if batch_of(d) == k)
        for d, s in days:
            n, c, held = events[s][d]
            a = open_.setdefault(s, [d, d, 0, 0, False])
            a[1], a[2], a[3], a[4] = d, a[2] + n, a[3] + c, a[4] or held
            if a[4] and a[2] and a[3] == due(s):
                out.append((s, *a[:4], due(s), "complete", k))
                del open_[s]
        for s, a in list(open_.items()):
            if a[0] + 10 <= largest or k == batches - 1:
                status = "headless" if not a[4] else "orphan" if not a[2] else "short" if a[3] < due(s) else "over"
                out.append((s, *a[:4], due(s) if a[4] else None, status, k))
                del open_[s]
        largest = max([largest, *(d for d, _ in days)])
    return sorted(out, key=str)


def _random_shop(seed, n, hot=0, days=150):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    when = lambda: start + timedelta(days=rng.randrange(days), seconds=rng.randrange(86_400))
    sales, lines = [], []
    for s in range(n):
        own = []
        for i in range(rng.choice([0, 1, 1, 2, 3, 8]) if s != 7 else hot):
            amount = rng.choice([None, 0.0, 1.005, 19.99, rng.randrange(10_000) / 100])
            at = when() if rng.random() < 0.95 else None
            own.append((s if rng.random() < 0.98 else None, i if rng.random() < 0.97 else None, i, 1, 1, amount, 0.0, "kept", at, "k"))
        lines += own + own[: rng.choice([0, 0, 0, 1])]
        if rng.random() < 0.9:
            total = rng.choice([None, sum((r[5] or 0 for r in own), 0.0), 5.0, float("nan")])
            sales.append((s, 1, "done", total, when(), when() if rng.random() < 0.97 else None, 1, "x", "y"))
    sales += [(None, 1, "open", 3.0, None, when(), 1, "x", "y"), sales[0], (*sales[1][:3], 77.0, *sales[1][4:])]
    return sales, lines


@pytest.mark.parametrize(("seed", "n", "hot", "per_key", "batches"), [(1, 300, 400, sa.SALES_PER_KEY, 10), (2, 60, 5, 1, 4), (3, 200, 3, 20, 3)])
def test_closings_against_the_contract(spark, seed, n, hot, per_key, batches):
    """Many sales a key, one, and some; the hot sale has rows on nearly every day."""
    sales, lines = _random_shop(seed, n, hot)
    before = spark.conf.get(sa.EMPTY_BATCHES)
    found = sa.assemble(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES), sales_per_key=per_key, batches=batches)
    assert sorted(map(tuple, found.collect()), key=str) == _want(sales, lines, batches)
    assert spark.conf.get(sa.EMPTY_BATCHES) == before
    assert {r.status for r in found.collect()} >= {"complete", "orphan", "short", "headless"} or n < 100


def test_batches_without_rows_and_far_days(spark):
    at = lambda *d: datetime(*d)
    line = lambda s, i, a, t: (s, i, 1, 1, 1, a, 0.0, "kept", t, "k")
    sales = [(s, 1, "done", 1.0, None, at(*d), 1, "x", "y") for s, d in ((1, (2024, 1, 2)), (2, (1969, 5, 5)), (3, (2024, 5, 30)), (4, (2031, 1, 1)), (5, (2024, 1, 3)))]
    lines = [line(1, 1, 1.0, at(2024, 1, 1)), line(4, 1, 2.0, at(2030, 1, 1)), line(5, 1, 0.5, at(2024, 5, 20)), line(9, 1, 0.5, at(1960, 1, 1))]
    found = sa.assemble(spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES))
    assert sorted(map(tuple, found.collect()), key=str) == _want(sales, lines)


def test_empty_tables(spark):
    found = sa.assemble(spark.createDataFrame([], SALES), spark.createDataFrame([], LINES), batches=2)
    assert found.collect() == []
    assert found.columns == ["sale_id", "first_day", "last_day", "n_lines", "cents", "due", "status", "closing_batch"]


def test_days_are_folded_as_row_by_row():
    """The vectorised steps of a batch against a fold over rows, with assemblies that are open before it."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        rows = np.zeros(int(rng.integers(1, 60)), sa.ROW)
        rows["sale_id"], rows["day"] = rng.integers(0, 6, len(rows)), rng.integers(10, 22, len(rows))
        rows["held"] = rng.random(len(rows)) < 0.3
        rows["n_lines"] = np.where(rows["held"], 0, rng.integers(1, 3, len(rows)))
        rows["cents"] = np.where(rows["held"], 0, rng.integers(-2, 9, len(rows)))
        rows["due"] = np.array([7, 0, 12, 5, 9, 3])[rows["sale_id"]]
        start = np.zeros(2, sa.OPEN)
        start["sale_id"], start["first_day"], start["last_day"], start["n_lines"], start["cents"] = [1, 9], 5, 7, 2, 4
        live, done = {int(r["sale_id"]): r.tolist() for r in start}, []
        for day, sale in sorted({(int(r["day"]), int(r["sale_id"])) for r in rows}):
            own = rows[(rows["day"] == day) & (rows["sale_id"] == sale)]
            _, first, _, n, cents, due, held = live.get(sale, (sale, day, day, 0, 0, 0, False))
            held = bool(held or own["held"].any())
            due = int(own["due"].max()) if own["held"].any() else due
            live[sale] = (sale, first, day, n + int(own["n_lines"].sum()), cents + int(own["cents"].sum()), due, held)
            if held and live[sale][3] and live[sale][4] == due:
                done.append(live.pop(sale))
        open_, complete = sa.assembled(start, rows)
        assert sorted(map(tuple, open_.tolist())) == sorted(map(tuple, live.values()))
        assert sorted(map(tuple, complete.tolist())) == sorted(done)
