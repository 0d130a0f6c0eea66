"""Repair of conversation structure: faults of rows, and the cheapest edits by a run-length DP."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import stage

DELETE, RETYPE, INSERT, TRUNCATED = 2, 1, 5, 5
USER, ASSISTANT = "user", "assistant"
_INK = r"[^\x20\x09-\x0D]"
# States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a; where an initial leads.
_STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_FORCED = {0: 2, 1: 2, 2: 3, 3: 2}
_INITIALS = "sua?"
# Symbols of rows: twice the place of the initial, one more if truncated; a row that must go.
GONE = 2 * len(_INITIALS)
_INF = 1 << 60
# Blocks of up to 2 ** so many equal rows keep their unrolled edits.
_KEPT_POWER = 12

_CONV = "struct<known:boolean,id:bigint>"
RUNS = (
    f"conv {_CONV}, pos bigint, symbols array<int>, lengths array<bigint>, first string, last string, illegal bigint, "
    "blank bigint, duplicate bigint, truncated bigint, first_turn bigint, last_turn bigint, turns bigint"
)
PLANS = (
    f"conv {_CONV}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "parts array<struct<pos:bigint,state:int,audit:string>>"
)
EDITS = f"conv {_CONV}, pos bigint, place bigint, edit string, role string, text string"


# --- the DP -----------------------------------------------------------------------------------


def _times(a: tuple, b: tuple) -> tuple:
    """The min-plus product of two matrices."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _apply(a: tuple, v: tuple) -> tuple:
    return tuple(min(row[k] + v[k] for k in range(4)) for row in a)


# Cheapest inserts between two states: one or two of them; more would come back to a state.
_INSERTS = tuple(
    tuple(0 if i == j else INSERT if _FORCED[i] == j else 2 * INSERT if _FORCED[_FORCED[i]] == j else _INF for j in range(4))
    for i in range(4)
)
END = _apply(_INSERTS, (0, _INF, _INF, 0))


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row in a state, with their cost and the state after, in the order of their initials."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        initial, extra = _INITIALS[symbol >> 1], TRUNCATED * (symbol & 1)
        if state in _STEPS.get(initial, ()):
            found.append(("K", extra, _STEPS[initial][state]))
        found.append(("R", RETYPE + extra, _FORCED[state]))
    return found


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple:
    """The min-plus transition of ``2 ** k`` rows of a symbol, inserts before each included."""
    if k:
        return _times(power(symbol, k - 1), power(symbol, k - 1))
    row = [[_INF] * 4 for _ in range(4)]
    for s in range(4):
        for _, cost, after in _choices(symbol, s):
            row[s][after] = min(row[s][after], cost)
    return _times(_INSERTS, tuple(map(tuple, row)))


def advance(symbol: int, length: int, rest: tuple) -> tuple:
    """Costs to finish before a run, from the costs to finish after it."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            rest = _apply(power(symbol, k), rest)
    return rest


def _inserts(state: int, costs: tuple, total: int, stop: str) -> tuple[str, int, int] | None:
    """An insert if it is part of a cheapest way and sorts before ``stop``."""
    after = _FORCED[state]
    return ("I", INSERT, after) if stop > "I" and INSERT + costs[after] == total else None


def _row(symbol: int, state: int, rest: tuple) -> tuple[str, int]:
    """The ASCII-least cheapest edits up to and with one row, and the state after."""
    here, audit = _apply(power(symbol, 0), rest), ""
    while True:
        edit, _, after = next((c for c in _choices(symbol, state) if c[1] + rest[c[2]] == here[state]), ("~", 0, 0))
        insert = _inserts(state, here, here[state], edit)
        if insert is None:
            return audit + edit, after
        audit, state = audit + "I", insert[2]


def _block(symbol: int, k: int, state: int, rest: tuple) -> tuple[str, int]:
    least = min(rest)  # only differences decide, so equal ones share an entry
    rest = tuple(min(x - least, _INF) for x in rest)
    return (_kept_block if k <= _KEPT_POWER else _halves)(symbol, k, state, rest)


def _halves(symbol: int, k: int, state: int, rest: tuple) -> tuple[str, int]:
    if k == 0:
        return _row(symbol, state, rest)
    head, state = _block(symbol, k - 1, state, _apply(power(symbol, k - 1), rest))
    tail, state = _block(symbol, k - 1, state, rest)
    return head + tail, state


_kept_block = lru_cache(maxsize=4096)(_halves)


def unroll(symbol: int, length: int, state: int, rest: tuple) -> tuple[str, int]:
    """The edits of a run and the state after it, from the costs to finish after the run."""
    ends = []
    for k in range(length.bit_length()):
        if length >> k & 1:
            ends.append((k, rest))
            rest = _apply(power(symbol, k), rest)
    parts = []
    for k, end in reversed(ends):
        audit, state = _block(symbol, k, state, end)
        parts.append(audit)
    return "".join(parts), state


def cheapest_edits(runs: list[tuple[int, int]]) -> tuple[int, list[str], list[int]]:
    """Least cost, and per run its edits and the state before it; the last edits end the pattern."""
    ends, rest = [], END
    for symbol, length in reversed(runs):
        ends.append(rest)
        rest = advance(symbol, length, rest)
    audits, states, state = [], [], 0
    for (symbol, length), end in zip(runs, reversed(ends), strict=True):
        states.append(state)
        audit, state = unroll(symbol, length, state, end)
        audits.append(audit)
    if audits and END[state]:
        audits[-1] += "I" * (END[state] // INSERT)
    return rest[0], audits, states


# --- rows -------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """The table with every kind of fault, by the checksum of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    ).where("kind <> 0")
    kind = F.col("kind")
    return slim.select(
        "conv_id", "turn", F.when(kind == 4, USER).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _key(c: str, name: str) -> Column:
    """A column as a struct without null: nulls come first and are equal."""
    return F.struct(F.col(c).isNotNull().alias("known"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("id")).alias(name)


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n``, their place ``pos`` in the order of the table, and faults.

    Order: conversation, turn (nulls first), role, text. Equal rows are one row, so they are counted
    before they meet; then ranges of the whole order are dealt out, so a conversation of any size
    spreads over tasks. ``pos`` grows with the order and by one within a task's rows. ``kind`` is
    ``blank``, ``truncated`` or empty; ``first`` tells that role and text were not seen earlier.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    counted = rows.select(_key("conv_id", "conv"), _key("turn", "turn"), role.alias("role"), text.alias("text")).groupBy(
        "conv", "turn", "role", "text"
    ).agg(F.count("*").alias("n"))
    counted = stage(
        counted.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), "counted"
    )
    first = counted.groupBy("conv", "digest").agg(F.min("turn").alias("turn")).withColumn("first", F.lit(True))
    end = F.regexp_extract("text", rf"({_INK})[\x20\x09-\x0D]*\z", 1)
    marked = counted.join(first, ["conv", "turn", "digest"], "left").select(
        "conv", "turn", "role", "text", "n", F.coalesce("first", F.lit(False)).alias("first"),
        F.when(end == "", "blank").when(end.isin(".", "!", "?"), "").otherwise("truncated").alias("kind"),
    )
    marked = stage(marked, "marked")  # ranges are drawn from it, then it is read again
    order = ["conv", "turn", "role", "text"]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.withColumn("pos", F.monotonically_increasing_id()), "ordered")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal symbols and counts of each stretch of neighbouring rows of one conversation."""
    held: dict | None = None
    done: list[dict] = []

    def add(symbol: int, n: int) -> None:
        if held["symbols"] and held["symbols"][-1] == symbol:
            held["lengths"][-1] += n
        elif n:
            held["symbols"].append(symbol)
            held["lengths"].append(n)

    for batch in batches:
        for r in batch.to_pylist():
            initial, turn = r["initial"], r["turn"]["id"] if r["turn"]["known"] else None
            if held is None or held["conv"] != r["conv"] or r["pos"] != at + 1:
                if held is not None:
                    done.append(held)
                held = {
                    "conv": r["conv"], "pos": r["pos"], "symbols": [], "lengths": [], "first": initial, "last": None, "illegal": 0,
                    "blank": 0, "duplicate": 0, "truncated": 0, "first_turn": turn, "last_turn": None, "turns": 0,
                }
            at = r["pos"]
            if held["last"] is not None:
                held["illegal"] += held["last"] + initial not in ("su", "ua", "au")
            held["illegal"] += r["n"] - 1
            held["last"] = initial
            held["turns"] += turn is not None and turn != held["last_turn"]
            held["first_turn"] = turn if held["first_turn"] is None else held["first_turn"]
            held["last_turn"] = turn
            if r["kind"] == "blank":
                held["blank"] += r["n"]
                add(GONE, r["n"])
            else:
                held["truncated"] += r["first"] and r["kind"] == "truncated"
                held["duplicate"] += r["n"] - r["first"]
                place = _INITIALS.find(initial) if initial else -1
                add(2 * (place if 0 <= place < 3 else 3) + (r["kind"] == "truncated"), int(r["first"]))
                add(GONE, r["n"] - r["first"])
        if done:
            yield pa.RecordBatch.from_pylist(done, _RUNS_TYPE)
            done.clear()
    if held is not None:
        yield pa.RecordBatch.from_pylist([held], _RUNS_TYPE)


_CONV_TYPE = pa.struct([("known", pa.bool_()), ("id", pa.int64())])
_LONGS = ("illegal", "blank", "duplicate", "truncated", "first_turn", "last_turn", "turns")
_RUNS_TYPE = pa.schema(
    [("conv", _CONV_TYPE), ("pos", pa.int64()), ("symbols", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int64()))]
    + [("first", pa.string()), ("last", pa.string())] + [(k, pa.int64()) for k in _LONGS]
)
_PART = pa.struct([("pos", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])
_PLANS_TYPE = pa.schema(
    [("conv", _CONV_TYPE)] + [(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("parts", pa.list_(_PART))]
)


def plan(stretches: list[dict]) -> dict:
    """Counts, cost and edits of a conversation from its stretches in order."""
    found = {k: sum(s[k] for s in stretches) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    known = [s for s in stretches if s["last_turn"] is not None]
    for a, b in zip(stretches, stretches[1:], strict=False):
        found["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
        found["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    turns = found.pop("turns")
    found["gaps"] = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns if known else 0
    runs = [run for s in stretches for run in zip(s["symbols"], s["lengths"], strict=True)]
    found["cost"], audits, states = cheapest_edits(runs)
    parts, at = [], 0
    for s in stretches:
        upto = at + len(s["symbols"])
        parts.append({"pos": s["pos"], "state": states[at], "audit": "".join(audits[at:upto])})
        at = upto
    return {"conv": stretches[0]["conv"], **found, "parts": parts}


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if held and held[0]["conv"] != r["conv"]:
                done.append(plan(held))
                held = []
            held.append(r)
        if done:
            yield pa.RecordBatch.from_pylist(done, _PLANS_TYPE)
    if held:
        yield pa.RecordBatch.from_pylist([plan(held)], _PLANS_TYPE)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their edits, in a partition where each stretch follows its audit."""
    schema = pa.schema([("conv", _CONV_TYPE), ("pos", pa.int64()), ("place", pa.int64())] + [(k, pa.string()) for k in ("edit", "role", "text")])
    audit, last, at, state, done = "", 0, 0, 0, []

    def put(row: dict, place: int, edit: str) -> None:
        nonlocal state
        role, text = row["role"], row["text"]
        if edit == "K":
            state = _STEPS[role[0]][state]
        elif edit != "D":
            state = _FORCED[state]
            role, text = USER if state == 2 else ASSISTANT, "" if edit == "I" else text
        done.append({"conv": row["conv"], "pos": row["pos"], "place": place, "edit": edit, "role": role, "text": text})

    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                audit, at, state = row["audit"], 0, row["state"]
                last = len(audit.rstrip("I"))
                continue
            left, place = row["n"], 0
            while left or last <= at < len(audit):  # inserts behind the last row belong to it
                put(row, place, audit[at])
                left -= audit[at] != "I"
                at, place = at + 1, place + 1
                size += len(row["text"])
                if len(done) >= 10_000 or size >= 1 << 22:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done.clear()
                    size = 0
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def structure(ordered: DataFrame) -> DataFrame:
    """Per conversation its counts, the least cost, and the edits of each stretch of ``ordered`` rows.

    Rows of a conversation become runs where they lie; the runs of one conversation then meet in a
    task, without texts, as its edits are one value anyway.
    """
    narrow = ordered.select("conv", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "n", "first", "kind")
    dealt = narrow.mapInArrow(_runs, RUNS).repartition("conv").sortWithinPartitions("conv", "pos")
    return dealt.mapInArrow(_plans, PLANS)


def edits(ordered: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per edit in the order ``pos, place``: ``D`` with the row that goes, ``K``, ``R`` and ``I``
    with the role and text of the repaired row."""
    audits = plans.select("conv", F.inline("parts")).select(
        "conv", "pos", F.lit(0).cast("long").alias("n"), F.lit("").alias("role"), F.lit("").alias("text"), "state", "audit"
    )
    rows = ordered.select("conv", "pos", "n", "role", "text", F.lit(None).cast("int").alias("state"), F.lit(None).cast("string").alias("audit"))
    task = F.shiftright("pos", 33)  # the task that ordered the row
    dealt = audits.union(rows).repartition(task).sortWithinPartitions("pos", F.col("audit").isNull())
    return dealt.mapInArrow(_edits, EDITS)


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and cheapest edits per conversation (``PLANS``), and every edit as a row (``EDITS``).

    Roles must read ``(s?(ua)+)?`` by their initials. Keeping a row costs nothing, giving it the role
    the place asks for 1, deleting it 2 (forced for rows without ink and for rows whose role and text
    were seen earlier), an insert 5, and a kept row whose last visible character ends no sentence 5
    more. Among cheapest ways the one whose initials are least in ASCII is taken.

    Rows are ordered by turn (nulls first), role and text; null roles and texts are one space; rows without
    ``conv_id`` are one conversation; repeated rows count each; an empty table gives empty
    results; other columns are ignored. Texts are read whole; a text of any length is one row.
    """
    ordered = ordered_rows(rows)
    plans = stage(structure(ordered), "plans")
    return plans, edits(ordered, plans)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation of a partition sorted by conversation and place; no text is held."""
    schema = pa.schema([("conv", _CONV_TYPE), ("repaired_sha256", pa.string())])
    conv, digest, between = None, None, ""
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if digest is None or r["conv"] != conv:
                if digest is not None:
                    done.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                conv, digest, between = r["conv"], hashlib.sha256(), ""
            digest.update(f"{between}{r['role']}:{r['text']}".encode())
            between = "\n"
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Counts, cost, edits and digest of the repaired rows of every conversation of the damaged table.

    Every ``conv_id`` of ``conversations`` gives a row, one without id included; a conversation without
    rows after the damage has zeros, no edits and the digest of nothing. The digest is sequential, so
    the repaired rows of one conversation pass through one task, one at a time.
    """
    plans, rows = repair_conversations(damage(conversations))
    left = rows.where("edit <> 'D'").select("conv", "pos", "place", "role", "text").repartition("conv")
    hashes = left.sortWithinPartitions("conv", "pos", "place").mapInArrow(_hashes, f"conv {_CONV}, repaired_sha256 string")
    every = conversations.select(_key("conv_id", "conv")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    audit = F.array_join(F.transform("parts", lambda p: p["audit"]), "")
    return (
        every.join(plans, "conv", "left").join(hashes, "conv", "left")
        .select(
            F.when(F.col("conv.known"), F.col("conv.id")).alias("conv_id"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
            F.coalesce(audit, F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )


def _oracle() -> str:
    """The same by a forward DP over rows: a state is cost, edits and repaired text in one string."""

    def add(s: str, cost: str, edit: str, line: str) -> str:
        head = f"split_part({s}, chr(1), 1)"
        return (
            f"printf('%09d', substr({s}, 1, 9)::int + {cost}) || substr({head}, 10) || '{edit}' || chr(1) "
            f"|| substr({s}, length({head}) + 2) || {line}"
        )

    def insert(s: str, role: str) -> str:
        return add(s, str(INSERT), "I", f"chr(10) || '{role}:'")

    def keep(s: str, initial: str) -> str:
        return f"case when not gone and substr(role, 1, 1) = '{initial}' then {add(s, f'{TRUNCATED} * cut', 'K', 'line')} end"

    def retype(s: str, role: str) -> str:
        line = f"chr(10) || '{role}:' || text"
        return f"case when not gone then {add(s, f'{RETYPE} + {TRUNCATED} * cut', 'R', line)} end"

    gone = [add(f"s{k}", str(DELETE), "D", "''") for k in range(4)]
    to_user = [x for s in ("s0", "s1", "s3") for x in (keep(s, "u"), retype(s, USER))]
    row = (
        f"{gone[0]} as n0, least({gone[1]}, {keep('s0', 's')}) as n1, least({', '.join([gone[2], *to_user])}) as n2, "
        f"least({gone[3]}, {keep('s2', 'a')}, {retype('s2', ASSISTANT)}) as n3"
    )
    user = ", ".join(insert(s, USER) for s in ("n0", "n1", "n3"))
    start = insert("('000000000' || chr(1))", USER)
    bytes_ = "list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i::int, 1)))"
    spread = f"list_prepend(4294967295::bigint, flatten(list_transform({bytes_}, lambda b: [b::bigint, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"xor(list_reduce({spread}, lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    ink = r"'([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z'"
    return rf"""
with recursive src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
kinds as (select *, {crc} % 20 as kind from src),
damaged as (select conv_id, turn, case when kind = 4 then '{USER}' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, unnest(case when kind = 3 then [0, 1] when kind = 0 then []::int[] else [0] end) as u(copy)),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    regexp_extract(text, {ink}, 1) as ink from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
    lag(substr(role, 1, 1)) over (partition by conv_id order by i) || substr(role, 1, 1) as pair from placed),
faults as (select *, ink = '' as blank, ink <> '' and again as duplicate,
    ink <> '' and not again and ink not in ('.', '!', '?') as truncated from seen),
rows_ as (select conv_id, i, role, text, blank or duplicate as gone, truncated::int as cut, chr(10) || role || ':' || text as line from faults),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank,
    count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(i) as n from faults group by conv_id),
walk as (
  select conv_id, 0::bigint as i, '000000000' || chr(1) as s0, null::varchar as s1, {start} as s2, {insert(f"({start})", ASSISTANT)} as s3
  from (select distinct conv_id from damaged)
  union all
  select conv_id, i, n0, n1, m2, least(n3, {insert("m2", ASSISTANT)}) from (
    select *, least(n2, {user}) as m2 from (
      select w.conv_id, r.i, {row} from walk w join rows_ r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1))),
ended as (select w.conv_id, least(s0, s3) as s, c.* exclude (conv_id) from walk w
  join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(substr(s, 1, 9)::bigint, 0) as cost,
  coalesce(substr(split_part(s, chr(1), 1), 10), '') as audit,
  sha256(coalesce(substr(s, length(split_part(s, chr(1), 1)) + 3), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join ended e on e.conv_id is not distinct from a.conv_id
"""


ORACLE = _oracle()
