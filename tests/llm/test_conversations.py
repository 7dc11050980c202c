"""Repair against a shortest-path search over rows and states, and awkward conversations."""
import hashlib
import heapq
import random
import re
import zlib

import pytest

from evcat.llm import conversations as C
from evcat.llm.queries import QUERIES, damaged

STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())


def brute(rows):
    """Counts, cost, audit and hash of one conversation: rows (turn, role, text) after damage."""
    rows = sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=order)
    seen, faults = set(), []
    for _, role, text in rows:
        last = [c for c in text if BLANK.match(c)]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    todo, best = [(0, "", 0, 0, ())], None
    done = set()
    while todo:
        cost, audit, at, state, made = heapq.heappop(todo)
        if at == len(rows) and state in (0, 3):
            best = (cost, audit, made)
            break
        if (at, state) in done:
            continue
        done.add((at, state))
        for role, after in STEP[state].items():
            if role in "ua":
                name = {"u": "user", "a": "assistant"}[role]
                heapq.heappush(todo, (cost + 5, audit + "I", at, after, made + ((name, ""),)))
                if at < len(rows) and faults[at] in ("", "truncated"):
                    more = 5 if faults[at] else 0
                    heapq.heappush(todo, (cost + 1 + more, audit + "R", at + 1, after, made + ((name, rows[at][2]),)))
            if at < len(rows) and faults[at] in ("", "truncated") and rows[at][1][:1] == role:
                heapq.heappush(todo, (cost + (5 if faults[at] else 0), audit + "K", at + 1, after, made + (rows[at][1:],)))
        if at < len(rows):
            heapq.heappush(todo, (cost + 2, audit + "D", at + 1, state, made))
    cost, audit, made = best
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest), list(made)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "z", 1) for c, t, r, x in rows], "conv_id bigint, turn bigint, role string, text string, digest string, conv int")


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def compare(spark, rows):
    given = table(spark, rows)
    reports = C.written(C.repair_reports(given), "reports")
    got = {r["conv"]: tuple(r)[1:] for r in reports.collect()}
    digests = {r["conv"]: r["repaired_sha256"] for r in C.repaired_digests(given, reports).collect()}
    made = {}
    for r in C.repaired_turns(given, reports).orderBy("conv", "place").collect():
        made.setdefault(r["conv"], []).append((r["role"], r["text"]))
    assert got.keys() == digests.keys() == by_conversation(rows).keys()
    for conv, own in by_conversation(rows).items():
        want, turns = brute(own)
        assert (*got[conv], digests[conv]) == want, (conv, own)
        assert made.get(conv, []) == turns


def random_rows(rng, conversations, longest):
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "s"])
            text = rng.choice(["yes.", "no!", "well", "hm?  ", " \t", "", "a.b", f"t{turn}.", f"own {conv} {turn}!", f"own {conv} {turn}"])
            rows += [(conv, rng.choice([turn, turn, turn * 3, None]) if rng.random() < 0.2 else turn, role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def test_random_conversations(spark):
    compare(spark, random_rows(random.Random(1), 120, 12))


def test_long_conversation_over_many_slices(spark):
    rng = random.Random(2)
    rows = random_rows(rng, 3, 10) + [(7, t, r, x) for _, t, r, x in random_rows(rng, 1, 400)]
    compare(spark, [(7 if c == 0 else c, t, r, x) for c, t, r, x in rows])


def test_awkward_rows(spark):
    rows = [
        (None, 1, "user", "hi."), (None, 2, None, None), (1, None, "user", None), (1, None, None, "x."), (2, 5, "system", "only."), (3, 1, "assistant", "a."),
        (4, -3, "user", "x" * 300_000 + "."), (4, 2**40, "assistant", "ok."), (5, 1, "user", "q.\n"), (5, 1, "user", "q.\n"), (5, 2, "assistant", "r. "), (6, 1, "user", " "),
    ]
    compare(spark, rows)


def test_empty_table(spark):
    given = table(spark, [])
    reports = C.repair_reports(given)
    assert reports.count() == 0
    assert C.repaired_digests(given, C.written(reports, "reports")).count() == 0


def test_equal_rows_by_the_thousand(spark):
    rows = [(1, 1, "user", "same.")] * 5_000 + [(1, t, "user", "same.") for t in range(2, 300)] + [(1, 500, "assistant", "end.")]
    given = table(spark, rows)
    r = C.repair_reports(given).first()
    assert r["duplicate"] == 5_000 - 1 + 298 and r["cost"] == 2 * r["duplicate"] and r["audit"] == "K" + "D" * r["duplicate"] + "K"


@pytest.mark.parametrize("cells", [1, 2, 5, 8, 13])
def test_any_split_gives_the_same_cell(cells):
    rng = random.Random(cells)
    rows = [C.row_cell(rng.choice("sua"), rng.random() < 0.3) for _ in range(cells)]
    whole = C.span_cell(rows)
    for split in range(1, cells):
        assert C.joined(C.span_cell(rows[:split]), C.span_cell(rows[split:])) == whole


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    faulty = damage(rows)
    assert sorted(map(tuple, damaged(table(spark, rows)).collect())) == sorted(faulty)
    want = by_conversation(faulty)
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_repair"](spark, sf).collect()}
    assert got.keys() == {r[0] for r in rows}
    for conv, row in got.items():
        assert row == (brute(want[conv])[0] if conv in want else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
