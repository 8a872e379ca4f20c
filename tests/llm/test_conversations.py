import glob
import hashlib
import os
import random
import zlib

import duckdb
import pytest

from pegtrail.llm import conversation_repair

SPACE = " \t\n\v\f\r"
SCHEMA = "edit string, conv_id long, place string, turn long, role string, text string, same int, first long"


def frame(spark, rows):
    return spark.createDataFrame([("x", c, "y", t, r, x, 1, 2) for c, t, r, x in rows], SCHEMA)


def cheapest(turns):
    """The least of the cheapest audits, by a walk over the grammar's states. turns: (initial, must go, truncated)."""

    def inserted(best):
        out = dict(best)
        for s, (c, a) in best.items():
            to, way = ("u" if s == "a" else "a"), (c + 5, a + "I")
            out[to] = min(out.get(to, way), way)
        return out

    best = inserted({"": (0, "")})
    for initial, gone, cut in turns:
        ways = [(s, c + 2, a + "D") for s, (c, a) in best.items()]
        for s, (c, a) in best.items():
            if not gone:
                want = "a" if s == "a" else "u"
                ways.append(("u" if s == "a" else "a", c + (initial != want) + 5 * cut, a + ("K" if initial == want else "R")))
                ways += [("s", c + 5 * cut, a + "K")] * (s == "" and initial == "s")
        best = {}
        for s, c, a in ways:
            best[s] = min(best.get(s, (c, a)), (c, a))
        best = inserted(best)
    return min(v for s, v in best.items() if s in ("", "u"))


def plain(rows):
    """{conv_id: result} of (conv_id, turn, role, text) rows."""
    text_of = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            harm = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
            role, text = text_of(role), text_of(text)
            if harm:
                row = (turn, "user" if harm == 4 else role, "" if harm == 1 else text.translate({ord(x): None for x in ".!?"}) if harm == 2 else text)
                kept += [row] * (2 if harm == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(kept, faults)])
        repaired, at, expected = [], 0, "user"
        for edit in audit:
            role, text = ("", "") if edit == "I" else kept[at][1:]
            at += edit != "I"
            if edit != "D":
                repaired.append(f"{role if edit == 'K' else expected}:{text}")
                if not (edit == "K" and role[:1] == "s"):
                    expected = "assistant" if expected == "user" else "user"
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_whole_table_equals_plain_form(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    assert result(conversation_repair.audits(table)) == plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_sql_equals_query(spark, small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = con.execute(conversation_repair.ORACLE).df()
    got = result(conversation_repair.audits(spark.read.parquet(f"{small}/conversations.parquet")))
    assert {r[0]: tuple(r[1:]) for r in found.itertuples(index=False)} == got


def test_hard_rows(spark):
    rng = random.Random(7)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.choice([1, 2, 3, 9, 20])):
            text = rng.choice(["", " \n", "Yes.", "Yes.", "no", "What?\n", "ümlaut!", None, "same.", f"own {rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 5]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    rows += rows[:30]  # repeated rows
    assert result(conversation_repair.audits(frame(spark, rows))) == plain(rows)


def test_long_conversation_and_long_text(spark):
    rng = random.Random(11)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"turn {t}.", f"turn {t}", "again."])) for t in range(400)]
    rows += [(2, 0, "user", "long " * 400_000 + "."), (2, 1, "assistant", "." * 1_000_000 + " " * 1_000_000)]
    assert result(conversation_repair.audits(frame(spark, rows))) == plain(rows)


def test_edit_rows_rebuild_the_conversation(spark, small):
    damaged = conversation_repair.damage(spark.read.parquet(f"{small}/conversations.parquet"))
    edits = conversation_repair.repair(damaged).orderBy("conv_id", "place").collect()
    assert sorted((r["conv_id"], r["turn"], r["was"], r["text"]) for r in edits if r["edit"] != "I") == sorted(map(tuple, damaged.select("conv_id", "turn", "role", "text").collect()))
    by = {}
    for r in edits:
        if r["edit"] != "D":
            by.setdefault(r["conv_id"], []).append(r["role"][0])
    for roles in by.values():
        rest = "".join(roles).removeprefix("s")
        assert rest and rest == "ua" * (len(rest) // 2)


@pytest.mark.parametrize("rows", [[], [(7, 3, "user", "Only.")], [(None, None, None, None)]])
def test_tables_of_one_row_or_none(spark, rows):
    assert result(conversation_repair.audits(frame(spark, rows))) == plain(rows)


def test_segments_equal_one_table():
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 17, 40, 70):
        for _ in range(40):
            turns = [(rng.choice("suaua") if rng.random() < 0.9 else "", rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
            assert conversation_repair.audit_of(turns) == cheapest(turns)[1]
