"""Repair of the structure of conversations: the cheapest edits that give roles `(s?(ua)+)?`, an audit of them, and the rows repaired.

A turn's first fault counts: blank (nothing outside x20, x09-x0D), duplicate (role and text stood earlier in the
conversation), truncated (its last such character is none of `.!?`). Edits: Keep costs 0, Rerole to user or assistant 1,
Delete 2 (a must for blank and duplicate turns), Insert of an empty user or assistant turn 5; a truncated turn that isn't
deleted costs 5 more. Of the cheapest audits (the edits' initials in order) the least in ASCII order is taken.

Method: Wagner-Fischer alignment of the turns with the grammar's string of each feasible length. The cost of the best
alignment so far bounds the lengths that are feasible and the diagonals of each table (Ukkonen); alignments of equal cost
are compared by their audits. A conversation of more than SEGMENT turns is cut: each segment is aligned with the
alternating strings that lead from each state of the grammar to each other, and the segments' costs are added up from the
last one on, so that work grows with the number of turns and the result is that of one table.

Memory: a conversation is one hash over all of its texts in order, so one task streams it, in sorted order. It holds a byte
and two numbers of its segment for a turn; texts beyond SPOOLED bytes wait in a temporary file of the task.

Defined cases: nulls in role and text are one space (a blank text, a role with neither initial); null conversation ids are
one conversation; null turns come first; turns of equal number are ordered by role, then by text (bytes); an empty table
gives no rows; only the four columns are read, so others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pegtrail.llm.batches import picked, shared_dir, small_batches

SPACE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns that one table aligns.
SEGMENT = 16
#: Bytes of a conversation's texts that a task holds in memory.
SPOOLED = 8 << 20
#: Edit rows of an output batch, and its bytes of text.
ROWS, BYTES = 2000, 4 << 20
#: States of the grammar: nothing yet, a system turn alone, user next, assistant next.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60


def _off(k: int) -> int:
    """What k more target places than turns cost at least."""
    return INSERT * k if k >= 0 else -DELETE * k


def _table(turns, target: str, most: int, last: bool):
    """(cost, audit) of the cheapest alignment with `target`, of those the least; None if it costs more than `most`.

    turns: (initial, must be deleted, truncated). Costs are of the rest of both, so that the audit is read from the front.
    Only diagonals that a path of at most `most` can touch are filled. Before the last segment a turn ends the audit.
    """
    n, m = len(turns), len(target)
    cost = {(n, m): 0}
    get = cost.get
    for i in range(n, -1, -1):
        initial, gone, cut = turns[i] if i < n else ("", True, False)
        extra = TRUNCATED if cut else 0
        for j in range(m, -1, -1):
            if (i == n and j == m) or _off(j - i) + _off((m - n) - (j - i)) > most:
                continue
            best = get((i + 1, j), FAR) + DELETE if i < n else FAR
            if j < m:
                want = target[j]
                if want != "s" and (i < n or last):
                    best = min(best, get((i, j + 1), FAR) + INSERT)
                if not gone and (want == initial or want != "s"):
                    best = min(best, get((i + 1, j + 1), FAR) + extra + (KEEP if want == initial else REROLE))
            if best <= most:
                cost[i, j] = best
    total = get((0, 0), FAR)
    if total > most:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (n, m):  # D < I < K < R
        here = cost[i, j]
        if i < n and get((i + 1, j), FAR) + DELETE == here:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and (i < n or last) and get((i, j + 1), FAR) + INSERT == here:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i][0] == target[j] else "R")
            i, j = i + 1, j + 1
    return total, "".join(audit)


def _targets(state: int, n: int):
    """(target, state after it) from a state, of lengths nearest to n first."""
    first, other = ("a", "u") if state == ASSISTANT else ("u", "a")
    for length in sorted(range(3 * n + 3), key=lambda x: (abs(x - n), x)):
        for head in ("", "s") if state == NOTHING else ("",):
            body = length - len(head)
            if body < 0:
                continue
            text = head + ((first + other) * (body // 2 + 1))[:body]
            if body:
                yield text, (USER if text[-1] == "a" else ASSISTANT)
            else:
                yield text, (SYSTEM if head else state)


@functools.lru_cache(maxsize=1 << 15)
def align(turns: tuple, state: int, last: bool) -> dict:
    """{state after: (cost, audit)} of the cheapest alignment that leads there; of the last segment only states that may end."""
    best: dict = {}
    for target, to in _targets(state, len(turns)):
        if last and to not in (NOTHING, USER):
            continue
        most = best[to][0] if to in best else DELETE * len(turns) + INSERT * len(target)
        if _off(len(target) - len(turns)) <= most and (found := _table(turns, target, most, last)) and (to not in best or found < best[to]):
            best[to] = found
    return best


def audit_of(turns) -> str:
    """The audit of a whole conversation."""
    cut = [tuple(turns[i : i + SEGMENT]) for i in range(0, len(turns), SEGMENT)]
    rest = [{NOTHING: 0, USER: 0}]  # the cost from each state before the segments that follow
    for k in range(len(cut) - 1, 0, -1):
        after = rest[-1]
        rest.append({s: min(ways) for s in range(4) if (ways := [c + after[t] for t, (c, _) in align(cut[k], s, k == len(cut) - 1).items() if t in after])})
    state, audit = NOTHING, []
    for k, part in enumerate(cut):
        after = rest[len(cut) - 1 - k]
        _, text, state = min((c + after[t], text, t) for t, (c, text) in align(part, state, k == len(cut) - 1).items() if t in after)
        audit.append(text)
    return "".join(audit)


def _turn_of(code: int) -> tuple:
    return ("", "s", "u", "a")[code & 3], bool(code & 4), bool(code & 8)


def _stream(batches):
    """Rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


FIELDS = "place long, edit string, fault string, turn long, was string, role string, text string"
_ARROW = pa.schema([("place", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _edited(rows):
    """Edit rows of one conversation's rows (turn, role, text, first turn of equal rows or None and whether there is one)."""
    with tempfile.SpooledTemporaryFile(max_size=SPOOLED) as texts:
        codes, faults, before = bytearray(), bytearray(), None
        for turn, role, text, repeated, first in rows:
            bare = text.strip(SPACE)
            fault = 1 if not bare else 2 if repeated and (turn != first or before == (turn, role, text)) else 3 if bare[-1] not in ".!?" else 0
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) | 4 * (fault in (1, 2)) | 8 * (fault == 3))
            faults.append(fault)
            pickle.dump((turn, role, text), texts)
            before = (turn, role, text)
        texts.seek(0)
        at, expected = 0, "user"
        for place, edit in enumerate(audit_of([_turn_of(c) for c in codes])):
            if edit == "I":
                yield place, edit, None, None, None, expected, ""
            else:
                turn, role, text = pickle.load(texts)
                fault = (None, "blank", "duplicate", "truncated")[faults[at]]
                at += 1
                yield place, edit, fault, turn, role, None if edit == "D" else expected if edit == "R" else role, text
                if edit == "D" or edit == "K" and role[:1] == "s":
                    continue
            expected = "assistant" if expected == "user" else "user"


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id and FIELDS: a row for each edit, those of a conversation on end and in order in one partition.

    `was` and `turn` are the turn's own (null for an insert), `role` is the repaired one (null for a deletion): the repaired
    conversation is the rows whose edit isn't D.
    """
    small_batches(conversations.sparkSession)
    shared_dir(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    same = F.unhex(F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")), F.lit("\0"), "role", F.lit("\0"), "text"), 256))
    keyed = rows.withColumn("same", same)
    firsts = keyed.groupBy("same").agg(F.count("*").alias("n"), F.count("turn").alias("numbered"), F.min("turn").alias("least")).where("n > 1").select("same", F.lit(True).alias("repeated"), F.when(F.col("n") == F.col("numbered"), F.col("least")).alias("first")).checkpoint()
    known = picked(keyed, firsts, ["same"], "left").select("conv_id", "turn", "role", "text", F.coalesce("repeated", F.lit(False)).alias("repeated"), "first")
    placed = known.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([pa.field("conv_id", to_arrow_type(kind)), *_ARROW])
        held, size = [], 0
        for conv, group in itertools.groupby(_stream(batches), lambda r: r[0]):
            for row in _edited(r[1:] for r in group):
                held.append((conv, *row))
                size += len(row[-1])
                if len(held) >= ROWS or size >= BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return placed.mapInArrow(run, f"conv_id {kind.simpleString()}, {FIELDS}")


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COSTS = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def _summed(rows) -> tuple:
    faults, illegal, cost, audit, digest = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, [], hashlib.sha256()
    low = high = before = None
    distinct, written = 0, False
    for _, edit, fault, turn, was, role, text in rows:
        audit.append(edit)
        cost += _COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
        if fault:
            faults[fault] += 1
        if edit != "I":
            if before is not None and before + was[:1] not in ("su", "ua", "au"):
                illegal += 1
            before = was[:1]
            if turn is not None and turn != high:
                low, high, distinct = turn if low is None else low, turn, distinct + 1
        if edit != "D":
            digest.update((("\n" if written else "") + f"{role}:{text}").encode())
            written = True
    gaps = 0 if low is None else high - low + 1 - distinct
    return gaps, *faults.values(), illegal, cost, "".join(audit), digest.hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """conv_id and COUNTS of each conversation of repair()'s rows, whose partitions and order it relies on."""
    kind = edits.schema["conv_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        numbers = [pa.int64()] * 6 + [pa.string()] * 2
        names = ["conv_id", *(f.split()[0] for f in COUNTS.split(", "))]
        groups = ((conv, *_summed(r[1:] for r in group)) for conv, group in itertools.groupby(_stream(batches), lambda r: r[0]))
        while held := list(itertools.islice(groups, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), [to_arrow_type(kind), *numbers], strict=True)], names=names)

    return edits.mapInArrow(run, f"conv_id {kind.simpleString()}, {COUNTS}")


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32(`conv_id:turn`) % 20: 0 dropped, 1 text emptied, 2 without `.!?`, 3 twice, 4 of the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("harm")).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def audits(conversations: DataFrame) -> DataFrame:
    """COUNTS of every conv_id after damage(); of one that has lost all rows, zeros, an empty audit and the hash of an empty text."""
    found = digests(repair(damage(conversations)))
    names = [f.split() for f in COUNTS.split(", ")]
    every = conversations.select(F.col("conv_id").alias("original")).distinct()
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    joined = every.join(found, every["original"].eqNullSafe(found["conv_id"]), "left")
    return joined.select(F.col("original").alias("conv_id"), *(F.coalesce(name, F.lit(empty.get(name, 0)).cast(kind)).alias(name) for name, kind in names))


#: audits() of the table conversations. The states n, s, u, a are those of the grammar; a step takes a turn, with at most one
#: insert before it, and keeps for each state the cheapest audit, of those the least. crc32 is worked out byte by byte.
ORACLE = r"""
with recursive crc as (select list(c order by i) as t from (select i, list_reduce(list_prepend(i, range(0, 8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from (select unnest(range(0, 256)) as i))),
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, encode(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')) as k from conversations),
harmed as (select n.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(k)), lambda i: ('0x' || substr(hex(k), cast(2 * i + 1 as bigint), 2))::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as harm from named n, crc),
d as (
  select conv_id, turn, case when harm = 4 then 'user' else role end as role, case harm when 1 then '' when 2 then translate(text, '.!?', '') else text end as text from harmed where harm <> 0
  union all select conv_id, turn, role, text from harmed where harm = 3),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
f as (select *, substr(role, 1, 1) as x, case when not regexp_matches(text, '[^ \t\n\x0b\f\r]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
  when not regexp_matches(text, '[.!?][ \t\n\x0b\f\r]*$') then 'truncated' end as fault from p),
c as (select distinct conv_id from d),
step(st, edits, cost, goes) as (values ('n', 'D', 2, 'n'), ('s', 'D', 2, 's'), ('u', 'D', 2, 'u'), ('a', 'D', 2, 'a'), ('n', 'ID', 7, 'a'), ('s', 'ID', 7, 'a'), ('u', 'ID', 7, 'a'), ('a', 'ID', 7, 'u'),
  ('n', 'T', 0, 'a'), ('s', 'T', 0, 'a'), ('u', 'T', 0, 'a'), ('a', 'T', 0, 'u'), ('n', 'IT', 5, 'u'), ('s', 'IT', 5, 'u'), ('u', 'IT', 5, 'u'), ('a', 'IT', 5, 'a'), ('n', 'K', 0, 's')),
w as (
  select conv_id, 0::bigint as i, 'n' as st, 0::bigint as cost, '' as audit from c
  union all
  select conv_id, i, st, cost, audit from (
    select *, row_number() over (partition by conv_id, st order by cost, audit) as best from (
      select w.conv_id, f.i, s.goes as st,
        w.cost + s.cost + case when s.edits in ('D', 'ID') then 0 else (case when f.fault = 'truncated' then 5 else 0 end) + case when s.edits in ('T', 'IT') and f.x <> g.want then 1 else 0 end end as cost,
        w.audit || case when s.edits in ('T', 'IT') then replace(s.edits, 'T', case when f.x = g.want then 'K' else 'R' end) else s.edits end as audit
      from w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1 join step s on s.st = w.st,
        lateral (select case when (w.st = 'a') <> (s.edits = 'IT') then 'a' else 'u' end as want) g
      where case when s.edits = 'D' or s.edits = 'ID' then true when coalesce(f.fault, '') in ('blank', 'duplicate') then false when s.edits = 'K' then f.x = 's' else true end)) where best = 1),
z as (select conv_id, arg_min(audit, (cost, audit)) as audit, min(cost) as cost from (
    select w.conv_id, w.cost + case when st = 'a' then 5 else 0 end as cost, w.audit || case when st = 'a' then 'I' else '' end as audit, st
    from w join (select conv_id, max(i) as n from p group by 1) e on e.conv_id is not distinct from w.conv_id and e.n = w.i where st <> 's') group by 1),
ops as (select conv_id, audit, unnest(range(1, length(audit) + 1)) as k from z),
o as (select *, substr(audit, k, 1) as op, k - length(replace(substr(audit, 1, k), 'I', '')) as ins from ops),
r as (select o.conv_id, o.k, o.op, f.role, f.text, f.x from o left join f on o.op <> 'I' and f.conv_id is not distinct from o.conv_id and f.i = o.k - o.ins where o.op <> 'D'),
q as (select *, row_number() over (partition by conv_id order by k) - case when first_value(op = 'K' and x = 's') over (partition by conv_id order by k) then 1 else 0 end as place from r),
t as (select conv_id, sha256(string_agg(case when op = 'K' then role || ':' || text when place % 2 = 1 then 'user:' || coalesce(text, '') else 'assistant:' || coalesce(text, '') end, chr(10) order by k)) as sha from q group by 1),
m as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
  count(*) filter (i > 1 and before || x not in ('su', 'ua', 'au')) as illegal from (select *, lag(x) over (partition by conv_id order by i) as before from f) group by 1)
select v.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(z.cost, 0) as cost, coalesce(z.audit, '') as audit, coalesce(t.sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) v left join m on m.conv_id is not distinct from v.conv_id left join z on z.conv_id is not distinct from v.conv_id left join t on t.conv_id is not distinct from v.conv_id
"""
