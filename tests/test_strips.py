"""Strips of blocks nearest in time: against brute force, with the numbers and parents of their rows, and without a shuffle of what they give."""

import random

from pegtrail.operators import spine


def test_strips(spark):
    r = random.Random(5)
    times = [r.randrange(40) * 300_000 for _ in range(60)]
    rows = sorted((t, f"u{r.randrange(10**6)}-{i}") for i, t in enumerate(times))
    names = [h for _, h in rows]
    parent = {h: r.choice([*names, "none"]) for h in names}
    block = spark.createDataFrame([(h, parent[h], "unknown", t, r.choice(("weak", None))) for t, h in rows] + [("x", "y", "unknown", 5, "excluded")], "hash string, prev_hash string, kind string, time long, orphan_class string")
    anchors = spark.createDataFrame([(h,) for h in [*names[:5], *names[20:30], *names[-5:], names[0], "x"]], "anchor_id string")
    k, want = 9, set()
    for p in {0, 1, 2, 3, 4, *range(20, 30), *range(55, 60)}:
        newer, older = min(59 - p, k), min(p, k)
        below = min(older, k - min(newer, 5))
        strip = names[p - below : p + min(newer, k - below) + 1]
        want |= {(names[p], i + 1, h, strip.index(parent[h]) + 1 if parent[h] in strip else None) for i, h in enumerate(strip)}
    found = spine.placed_strips(block, anchors, ["weak", "pending"], k)
    got = [(r["anchor_id"], r["id"], r["hash"], r["prev_id"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
    # rows of strips come out of the last join, so that what is exploded is buckets of anchors and not places
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in next(line for line in plan.splitlines() if "Generate explode" in line)
