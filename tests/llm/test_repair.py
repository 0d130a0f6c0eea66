"""Edits against a search over all of them, the table against the statement's rules, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from logloom.llm import repair as R

SYMBOLS = list(range(R.GONE + 1))


def search(symbols):
    """Least (cost, edits) by trying every edit of every row with up to two inserts between."""
    best = {0: (0, "")}

    def inserted(found):
        for _ in range(2):
            for s, (cost, audit) in list(found.items()):
                t = {0: 2, 1: 2, 2: 3, 3: 2}[s]
                found[t] = min(found.get(t, (9**9, "")), (cost + 5, audit + "I"))
        return found

    for x in symbols:
        now = {}
        for s, (cost, audit) in inserted(best).items():
            ways = [("D", 2, s)]
            if x != R.GONE:
                initial, cut = "sua?"[x // 2], 5 * (x % 2)
                t = {"0s": 1, "0u": 2, "1u": 2, "3u": 2, "2a": 3}.get(f"{s}{initial}")
                ways += [("K", cut, t)] if t else []
                ways += [("R", 1 + cut, 3 if s == 2 else 2)]
            for edit, more, t in ways:
                now[t] = min(now.get(t, (9**9, "")), (cost + more, audit + edit))
        best = now
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def runs(symbols):
    return [(k, len(list(g))) for k, g in itertools.groupby(symbols)]


def test_all_short_and_many_long_sequences():
    rng = random.Random(3)
    cases = [list(c) for n in range(4) for c in itertools.product(SYMBOLS, repeat=n)]
    for _ in range(400):
        part = rng.sample(SYMBOLS, rng.randint(1, 4))
        cases.append([s for _ in range(rng.randint(1, 12)) for s in [rng.choice(part)] * rng.choice([1, 1, 2, 3, 17, 40])])
    for symbols in cases:
        cost, audits, _ = R.cheapest_edits(runs(symbols))
        assert (cost, "".join(audits)) == search(symbols), symbols


def test_long_runs():
    for symbol in SYMBOLS:
        cost, audits, _ = R.cheapest_edits([(symbol, 100_001)])
        assert len("".join(audits).replace("I", "")) == 100_001
        assert (cost, "".join(audits)) == search([symbol] * 100_001)


def plain(rows):
    """The contract, row by row."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = []
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in found:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] = n.get(fault, 0) + 1
            place = "sua".find(role[:1]) if role else -1
            symbols.append(R.GONE if fault in ("blank", "duplicate") else 2 * (place if place >= 0 else 3) + (fault == "truncated"))
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit = search(symbols)
        lines, left, state = [], iter(found), 0
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (0, "", "")
            if edit == "D":
                continue
            state = 1 if edit == "K" and role[0] == "s" else 3 if state == 2 else 2
            lines.append(f"{role if edit == 'K' else 'user' if state == 2 else 'assistant'}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_rows(spark, partitions):
    rng = random.Random(8)
    roles = ["system", "user", "assistant", "tool", "", None, "s", "ua", "über"]
    texts = ["", None, " \n", "Yes.", "no", "What?", "a b!  ", "ü.", "x\x0b", "Stop.\x85", "two\nlines.", "q" * 90_000]
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in rng.sample([None, *range(12)], rng.randint(1, 9)):
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((conv, turn, rng.choice(roles[: rng.choice([3, 9])]), rng.choice(texts)))
    rows += [(99, k, "user", f"text {k % 300}." if k % 2 else "ok") for k in range(900)] + [(98, None, "assistant", "again.")] * 300
    rows += [(97, k, rng.choice(["user", "assistant"]), "same.") for k in range(500)] + rows[:9]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, n int, kind string, pos int")
    got = sorted(map(tuple, R.repair_digests(frame.repartition(partitions)).collect()), key=str)
    assert got == plain(rows)
    assert R.repair_digests(frame.limit(0)).collect() == []
    none = spark.createDataFrame([(0, k, "user", "a") for k in range(200) if zlib.crc32(f"0:{k}".encode()) % 20 == 0], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in R.repair_digests(none).collect()] == [(0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repaired_rows_have_legal_roles(spark):
    frame = R.damage(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    plans, edits = R.repair_conversations(frame)
    found = {}
    for r in sorted(edits.collect(), key=lambda r: (r.pos, r.place)):
        if r.edit != "D":
            found[r.conv.id] = found.get(r.conv.id, "") + r.role[0]
    assert all(re.fullmatch("s?(ua)+", x) for x in found.values())
    assert sum(len(p.audit) for r in plans.collect() for p in r.parts) == edits.count()
