"""Blocks at or near a time: against brute force, and without pairs of all times and blocks of a day."""

import random

import pytest

from pegtrail.operators import joins

SCHEMA = "hash string, kind string, height long, time long"


@pytest.fixture(scope="module")
def chain(spark):
    """Blocks on few days, many of one time, some of a time twice, times before, between, on and after them."""
    r = random.Random(4)
    blocks = [(f"h{r.randrange(10**6)}", "canonical" if r.random() < 0.9 else "stale", r.randrange(40), r.choice((0, 3, 4, 9)) * 86_400 + r.randrange(300)) for _ in range(400)]
    times = [r.choice((-1, 0, 1, 3, 4, 6, 9, 11)) * 86_400 + r.randrange(-200, 400) for _ in range(300)]
    return blocks, times, spark.createDataFrame(blocks, SCHEMA), spark.createDataFrame([(t,) for t in [*times, *times[:9], None]], "t long")


def joins_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_height_at_time(chain):
    blocks, times, block, asked = chain
    want = {}
    for t in times:
        here = [(-time, -height, h) for h, kind, height, time in blocks if kind == "canonical" and time <= t]
        want[t] = (-min(here)[1], min(here)[2]) if here else (None, None)
    found = joins.height_at_time(block, asked)
    got = found.collect()
    assert {r["t"]: (r["height"], r["hash"]) for r in got} == want | {None: (None, None)} and len(got) == len(want) + 1
    assert joins_of(found) == 1  # the day's end alone is joined on


def test_nearest_canonical(chain):
    blocks, times, block, asked = chain
    want = {t: min((abs(time - t), height) for _, kind, height, time in blocks if kind == "canonical") for t in times}
    found = joins.nearest_canonical(block, asked)
    got = found.collect()
    assert {r["t"]: (r["off"], r["height"]) for r in got} == want and len(got) == len(want)
    assert joins_of(found) == 1


def test_no_blocks(spark, chain):
    empty = chain[2].where("false")
    assert [tuple(r) for r in joins.height_at_time(empty, chain[3].where("t = 0 or t is null")).collect() if r["t"] is None] == [(None, None, None)]
    assert {(r["height"], r["off"]) for r in joins.nearest_canonical(empty, chain[3]).collect()} == {(None, None)}


def test_epochs(spark, chain):
    """Rows of equal times, on a start, before all, above the horizon and without a time; no row reads all epochs."""
    epochs = [(i * 2016, 50_000 * i * i) for i in range(12)] + [(30_000, 50_000)]
    rows = [(i, t) for i, t in enumerate([*chain[1], 50_000, 50_000, 200_000, -5, None])]
    df = spark.createDataFrame(rows, "i long, time long")
    found = joins.epoch_asof(df, spark.createDataFrame(epochs, "epoch long, start_time long"), 500_000)
    want = {(i, max(((s, e) for e, s in epochs if s <= t), default=(0, None))[1] if t is not None and t <= 500_000 else None) for i, t in rows}
    assert {(r["i"], r["epoch"]) for r in found.collect()} == want and found.columns == ["i", "time", "epoch"]
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
