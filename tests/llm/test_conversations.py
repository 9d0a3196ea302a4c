"""Conversation repair against an exhaustive search, and its run-length steps against single rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparsight.llm import conversations as C

INK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if v is None else str(v) for v in (conv, turn)]
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(":".join(spaced).encode()) % 20
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [] if case == 0 else [(conv, turn, role, text)] * (2 if case == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        ink = INK.findall(text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Dijkstra over (rows done, initials so far), paths in the order of (cost, audit)."""
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        for full in ("user", "assistant"):
            if full[0] in follows:
                heapq.heappush(heap, (cost + 3, audit + "I", i, full[0], [*lines, full + ":"]))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, lines))
            if marks[i] not in ("blank", "duplicate"):
                late = 3 * (marks[i] == "truncated")
                if role[:1] and role[0] in follows:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, role[0], [*lines, f"{role}:{text}"]))
                for full in ("user", "assistant"):
                    if full[0] in follows:
                        heapq.heappush(heap, (cost + late + 3, audit + "R", i + 1, full[0], [*lines, f"{full}:{text}"]))


def brute(rows, damaged=True):
    held = {}
    for r in damage(rows) if damaged else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        held.setdefault(r[0], []).append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        found = sorted(held.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        marks, turns = faults(found), [r[1] for r in found if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(not a[2] or not b[2] or a[2][0] + b[2][0] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        cost, audit, lines = cheapest(found, marks)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def collected(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def random_rows(seed, convs=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "open", "", " \t\n", None, "What?", "a. ", "é漢", "x:y.", "long " * 50]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in [*range(convs), None]:
        turn = rng.randrange(-3, 3)
        for _ in range(rng.randrange(1, 14)):
            turn += rng.choice([1, 1, 1, 0, 2])
            rows.append((conv, None if rng.random() < 0.05 else turn, rng.choices(roles, [8, 8, 2, 1, 1, 1, 1])[0], rng.choice(texts)))
    return rows + rows[5:9]


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("block_rows", [3, C.BLOCK_ROWS])
def test_random_conversations(spark, block_rows):
    rows = random_rows(3)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("d")).withColumn("at", F.lit(1)).withColumn("kind", F.lit("k"))
    assert collected(C.repair_damaged(frame, block_rows)) == brute(rows)


def test_one_conversation_over_many_blocks(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "user", "assistant"]), rng.choice([f"text {t}.", "again.", "open"])) for t in range(600)]
    rows += [(1, 600, "user", "the same over and over.")] * 300 + [(0, 1, "user", "Hello."), (2, 5, "assistant", "Bye.")]
    expected = brute(rows)
    assert collected(C.repair_damaged(spark.createDataFrame(rows, SCHEMA), 16)) == expected
    assert collected(C.repair(spark.createDataFrame(rows, SCHEMA), 64)) == brute(rows, damaged=False)


def test_nothing_left_and_nothing_at_all(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    got = collected(C.repair_damaged(spark.createDataFrame([(conv, 1, "user", "x")], SCHEMA)))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert C.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_powers_equal_single_rows():
    rng = random.Random(1)
    for _ in range(300):
        symbols = [rng.randrange(C.GONE + 1) for _ in range(rng.randrange(1, 5))]
        counts = [rng.choice([1, 2, 3, 7, 30]) for _ in symbols]
        singles = [s for s, n in zip(symbols, counts) for _ in range(n)]
        ahead = C.ENDS
        for s in reversed(singles):
            ahead = C.applied(C.power(s, 0), ahead)
        runs = C.ENDS
        for s, n in zip(reversed(symbols), reversed(counts)):
            assert C.applied(C.run_matrix(s, n), runs) == C.run_before(s, n, runs)
            runs = C.run_before(s, n, runs)
        assert runs == ahead
        state = rng.randrange(4)
        assert C.unrolled(symbols, counts, C.ENDS, state) == C.unrolled(singles, [1] * len(singles), C.ENDS, state)


def test_a_long_run_needs_few_steps():
    C._unrolled_power.cache_clear()
    audit, state = C.unrolled([2], [1_000_000], C.ENDS, C.START)
    # A million user rows in turn: every other one becomes the assistant's.
    assert audit == "KR" * 500_000 and state == C.ASSISTANT
    assert C._unrolled_power.cache_info().misses < 500
