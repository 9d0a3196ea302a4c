"""Conversation structure repair: cheapest edits that give each conversation a lawful order of roles.

What counts of a row is its symbol: the initial of its role and whether it must go (blank, or a
duplicate) or is truncated.  Equal consecutive symbols are one run.  One row of a symbol is a min-plus
matrix over four states (nothing yet, after system, after user, after assistant); a run of n rows is a
product of cached binary powers of it, so costs of a run take log n steps.  The audit is unrolled from
the costs of what is left: halves of a power that meet the same relative costs in the same state give
the same letters and are kept.

Plan.  Rows that are equal in conversation, turn, role and text are counted together before anything
moves, and only role, turn and the text's MD5 take part in the search.  These narrow rows are dealt to
range partitions by (conversation, turn, role, MD5), written, and taken in blocks of ``BLOCK_ROWS``, so a
conversation of any length is spread over tasks.  Conversations inside a block are done there; of those
at the edges a block gives one matrix, the matrices of a conversation are multiplied from its end, and
its pieces are unrolled once their first states are known.  Texts move once, to be hashed in order: the
hash of a conversation is one SHA-256, so its texts stream through one task, which holds a piece's audit
and one batch.

Defined results: rows stand by turn (nulls first), then role, then the MD5 of the text; nulls of role and
text are one space, as are nulls in the damage key; a null conversation is one conversation.  Equal rows
are duplicates of the first.  A role counts by its first character; an empty role has none and makes its
neighbourhood illegal.  A conversation without rows has zeros, an empty audit and the hash of nothing; an
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.operators.skew import split_join
from sparsight.storage import materialize

#: Costs of the edits.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Narrow rows of a block: a task holds one at a time.
BLOCK_ROWS = 65_536
#: The role initials that have classes of their own; others can only be renamed or deleted.
INITIALS = "sua"
LEGAL_PAIRS = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: A symbol is 2 * class + truncated; this one has to be deleted.
GONE = 2 * (len(INITIALS) + 1)
FAR = 1 << 60
#: What it costs to end in each state, and the inserted rows that do it.
ENDS = (0, 2 * INSERT, INSERT, 0)
END_LETTERS = ("", "II", "I", "")
#: The state after the next user or assistant row in each state.
NEXT = (USER, USER, ASSISTANT, USER)
LINE_ROLE = {USER: "user", ASSISTANT: "assistant"}
KEY = ["conv_id", "turn", "role", "digest"]


# -- min-plus algebra of runs ----------------------------------------------------------------------


def kept_state(state: int, symbol: int) -> int | None:
    """The state after a row of this symbol is kept; None where the order of roles forbids it."""
    initial = INITIALS[symbol // 2] if symbol // 2 < len(INITIALS) else ""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return None


def choices(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """What can be done with a row: letter, cost and the state after it, in the order of letters."""
    found = [("D", DELETE, state)]
    if symbol != GONE:
        late = TRUNCATED * (symbol % 2)
        if (after := kept_state(state, symbol)) is not None:
            found.append(("K", late, after))
        found.append(("R", RENAME + late, NEXT[state]))
    return found


def product(a, b):
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def applied(a, v):
    return tuple(min(r[0] + v[0], r[1] + v[1], r[2] + v[2], r[3] + v[3]) for r in a)


@lru_cache(maxsize=4096)
def power(symbol: int, k: int):
    """The matrix of 2^k rows of a symbol, rows to insert before each of them included."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    inserts = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        inserts[state][state] = 0
        once = NEXT[state]
        inserts[state][once] = min(inserts[state][once], INSERT)
        twice = NEXT[once]
        inserts[state][twice] = min(inserts[state][twice], 2 * INSERT)
    row = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in choices(state, symbol):
            row[state][after] = min(row[state][after], cost)
    return product(inserts, row)


def powers_of(n: int) -> list[int]:
    return [k for k in range(n.bit_length()) if n >> k & 1]


def run_before(symbol: int, n: int, ahead):
    """Costs from each state before ``n`` rows of a symbol, given the costs after them."""
    for k in powers_of(n):
        ahead = applied(power(symbol, k), ahead)
    return ahead


@lru_cache(maxsize=4096)
def run_matrix(symbol: int, n: int):
    found = None
    for k in powers_of(n):
        found = power(symbol, k) if found is None else product(found, power(symbol, k))
    return found


def relative(v):
    least = min(v)
    return tuple(x - least for x in v)


@lru_cache(maxsize=2048)
def _unrolled_power(symbol: int, k: int, ahead, state: int) -> tuple[str, int]:
    """ASCII-least letters of the cheapest edits of 2^k rows and the state after them."""
    if k:
        middle = relative(applied(power(symbol, k - 1), ahead))
        first, state = unrolled_power(symbol, k - 1, middle, state)
        second, state = unrolled_power(symbol, k - 1, ahead, state)
        return first + second, state
    here = applied(power(symbol, 0), ahead)
    letters = ""
    while True:
        found = dict((letter, (cost, after)) for letter, cost, after in choices(state, symbol))
        cost, after = found["D"]
        if cost + ahead[after] == here[state]:
            return letters + "D", after
        if INSERT + here[NEXT[state]] == here[state]:
            letters, state = letters + "I", NEXT[state]
            continue
        for letter in ("K", "R"):
            if letter in found and found[letter][0] + ahead[found[letter][1]] == here[state]:
                return letters + letter, found[letter][1]
        raise AssertionError("no edit has the cost of the cheapest")


def unrolled_power(symbol: int, k: int, ahead, state: int) -> tuple[str, int]:
    # Long powers are put together from cached ones, so that the cache holds short strings only.
    if k > 10:
        return _unrolled_power.__wrapped__(symbol, k, ahead, state)
    return _unrolled_power(symbol, k, ahead, state)


def unrolled(symbols, counts, ahead, state: int, letters: bool = True) -> tuple[str, int]:
    """The audit of runs from a state, given the costs after the last of them, and the last state."""
    steps = [(s, k) for s, n in zip(symbols, counts) for k in reversed(powers_of(n))]
    after = []
    for s, k in reversed(steps):
        after.append(ahead)
        ahead = relative(applied(power(s, k), ahead))
    parts = []
    for (s, k), costs in zip(steps, reversed(after)):
        part, state = unrolled_power(s, k, relative(costs), state)
        if letters:
            parts.append(part)
    return "".join(parts), state


# -- narrow rows -----------------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the crc32 of ``conv_id:turn`` decides."""
    spaced = lambda c: F.coalesce(c, F.lit(" "))
    key = F.concat(spaced(F.col("conv_id").cast("string")), F.lit(":"), spaced(F.col("turn").cast("string")))
    case = F.crc32(key.cast("binary")) % 20
    text = spaced(F.col("text"))
    made = rows.select(
        "conv_id", "turn", F.when(case == 4, F.lit("user")).otherwise(spaced(F.col("role"))).alias("role"),
        F.when(case == 1, F.lit("")).when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        case.alias("case"),
    )
    copies = F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return made.filter("case <> 0").select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def narrow_rows(rows: DataFrame) -> DataFrame:
    """Equal rows counted together: KEY, n, initial, blank, truncated, and whether they hold the first of their text."""
    last = F.right(F.rtrim("text", F.lit(common.SPACES)), F.lit(1))
    marked = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        (F.btrim("text", F.lit(common.SPACES)) == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
    )
    counted = marked.groupBy(*KEY, "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
    counted = materialize(counted.withColumn("initial", F.substring("role", 1, 1)), "turns")
    # Of a text that stands in several turns the least turn (nulls first) holds the first; most texts stand in one.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    same = ["conv_text", "conv_known", "role", "digest"]
    keyed = counted.withColumns({"conv_text": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "conv_known": F.col("conv_id").isNotNull()})
    repeated = keyed.groupBy(*same).agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("turns")).filter("turns > 1")
    repeated = materialize(repeated.select(*same, "least"), "repeated-turns")
    sent = common.sent_if_small(repeated, 96 + F.octet_length("conv_text") + F.octet_length("role"))
    joined = split_join(keyed, repeated, same, "left") if sent is repeated else keyed.join(sent, same, "left")
    first = F.coalesce(F.col("least") == place, F.lit(True))
    return joined.select(*KEY, "n", "initial", "blank", "truncated", first.alias("first"))


# -- blocks and pieces -----------------------------------------------------------------------------

_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_SPAN = ["turns", "least_turn", "most_turn", "first_turn", "last_turn"]


def _piece_schema(key_types: dict[str, str]) -> str:
    return (
        f"at bigint, edge boolean, conv_id {key_types['conv_id']}, turn {key_types['turn']}, role string, digest binary, "
        + ", ".join(f"{c} bigint" for c in _COUNTS + _SPAN)
        + ", first_initial string, last_initial string, symbols binary, counts array<bigint>, matrix array<bigint>, cost bigint, audit string"
    )


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value of an Arrow column differs from the one before; nulls are equal."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.r_[True, codes[1:] != codes[:-1]]


def block_pieces(table: pa.Table) -> list[dict]:
    """The pieces of conversations in one block; those inside it are finished."""
    table = table.sort_by("at").combine_chunks()
    column = {c: table[c].combine_chunks() if table[c].num_chunks else table[c] for c in table.column_names}
    column = {c: v.chunk(0) if isinstance(v, pa.ChunkedArray) else v for c, v in column.items()}
    number = lambda c, t: column[c].to_numpy(zero_copy_only=False).astype(t)
    n, blank, truncated, first = number("n", np.int64), number("blank", bool), number("truncated", bool), number("first", bool)
    initials = column["initial"].to_pylist()
    starts = np.flatnonzero(_changes(column["conv_id"]))
    stops = np.r_[starts[1:], len(n)]
    group = np.repeat(np.arange(len(starts)), stops - starts)

    # The first row of a count, then the others, which are its duplicates.
    classes = np.array([INITIALS.find(i) if i else -1 for i in initials])
    classes[classes < 0] = len(INITIALS)
    lives = first & ~blank
    symbols = np.column_stack([np.where(lives, 2 * classes + truncated, GONE), np.full(len(n), GONE)]).ravel()
    counts = np.column_stack([np.where(lives, 1, n), np.where(lives, n - 1, 0)]).ravel()
    owner = np.repeat(group, 2)[counts > 0]
    symbols, counts = symbols[counts > 0], counts[counts > 0]
    run = np.flatnonzero(np.r_[True, (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])])
    run_symbols, run_counts, run_owner = symbols[run], np.add.reduceat(counts, run), owner[run]
    run_edges = np.searchsorted(run_owner, np.arange(len(starts) + 1))

    illegal = n - 1
    pairs = np.array([a + b not in LEGAL_PAIRS or not a or not b for a, b in zip(initials, initials[1:])], bool)
    illegal[1:] += pairs & (group[1:] == group[:-1])
    total = lambda v: np.bincount(group, weights=v, minlength=len(starts)).astype(np.int64).tolist()
    sums = dict(zip(_COUNTS, (total(n * blank), total(np.where(blank, 0, np.where(first, n - 1, n))), total(lives & truncated), total(illegal))))
    turns = column["turn"].to_pylist()
    found = []
    for g, (start, stop) in enumerate(zip(starts.tolist(), stops.tolist())):
        held = [t for t in turns[start:stop] if t is not None]
        at = slice(run_edges[g], run_edges[g + 1])
        piece = {
            "at": column["at"][start].as_py(), "edge": g in (0, len(starts) - 1), **{c: column[c][start].as_py() for c in KEY},
            **{c: v[g] for c, v in sums.items()}, "turns": len(set(held)), "least_turn": held[0] if held else None,
            "most_turn": held[-1] if held else None, "first_turn": turns[start], "last_turn": turns[stop - 1],
            "first_initial": initials[start], "last_initial": initials[stop - 1],
        }
        s, c = run_symbols[at].tolist(), run_counts[at].tolist()
        if piece["edge"]:
            matrix = None
            for symbol, count in zip(s, c):
                here = run_matrix(symbol, count)
                matrix = here if matrix is None else product(matrix, here)
            piece |= {"symbols": bytes(s), "counts": c, "matrix": [x for row in matrix for x in row]}
        else:
            ahead = ENDS
            for symbol, count in zip(reversed(s), reversed(c)):
                ahead = run_before(symbol, count, ahead)
            audit, state = unrolled(s, c, ENDS, START)
            piece |= {"cost": ahead[START], "audit": audit + END_LETTERS[state]}
        found.append(piece)
    return found


def joined_pieces(pieces: list[dict]) -> tuple[dict, list[tuple]]:
    """Counts and cost of one conversation from its pieces in order, and the costs after each piece."""
    whole = {c: sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for a, b in zip(pieces, pieces[1:]):
        pair = a["last_initial"] + b["first_initial"]
        whole["illegal"] += pair not in LEGAL_PAIRS or not a["last_initial"] or not b["first_initial"]
        whole["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    least = [p["least_turn"] for p in pieces if p["least_turn"] is not None]
    most = [p["most_turn"] for p in pieces if p["most_turn"] is not None]
    whole |= {"least_turn": min(least, default=None), "most_turn": max(most, default=None)}
    ahead, after = ENDS, []
    for p in reversed(pieces):
        after.append(ahead)
        m = p["matrix"]
        ahead = applied((m[0:4], m[4:8], m[8:12], m[12:16]), ahead)
    return whole | {"cost": ahead[START]}, after[::-1]


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def finished_pieces(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Audits by piece (KEY of its first row, start, audit) and sums by conversation, from narrow rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    dealt = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(dealt, "turn-order")
    types = {f.name: f.dataType.simpleString() for f in placed.schema}
    spark = rows.sparkSession
    names = _piece_schema(types)
    piece_schema = spark.createDataFrame([], names).schema
    arrow = to_arrow_schema(piece_schema)
    part = F.shiftright("at", 33)
    block = F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / block_rows)
    blocks = placed.withColumns({"part": part, "block": block}).groupBy("part", "block")
    pieces = materialize(blocks.applyInArrow(lambda t: _table(block_pieces(t), arrow), names), "turn-pieces")
    edges = pieces.filter("edge")

    # Costs after each piece at an edge, from the matrices of its conversation.
    sums = ["blank", "duplicate", "truncated", "illegal", "turns", "least_turn", "most_turn", "cost"]
    whole_names = f"at bigint, conv_id {types['conv_id']}, " + ", ".join(f"{c} bigint" for c in sums) + ", ahead array<bigint>"
    whole_arrow = to_arrow_schema(spark.createDataFrame([], whole_names).schema)

    def combine(t: pa.Table) -> pa.Table:
        held = t.sort_by("at").to_pylist()
        whole, after = joined_pieces(held)
        rows = [{"at": p["at"], "conv_id": p["conv_id"], "ahead": list(relative(v))} for p, v in zip(held, after)]
        rows.append({"conv_id": held[0]["conv_id"], **whole})
        return _table(rows, whole_arrow)

    narrow = edges.select("at", "conv_id", *_COUNTS, *_SPAN, "first_initial", "last_initial", "matrix")
    combined = materialize(narrow.groupBy("conv_id").applyInArrow(combine, whole_names), "turn-costs")
    runs = edges.select("at", *KEY, "symbols", "counts").join(combined.filter("at is not null").select("at", "ahead"), "at")
    runs = materialize(runs, "turn-runs")

    # The state each piece ends in from every state, then the one it starts in.
    def ends(stream):
        for batch in stream:
            made = [
                [unrolled(r["symbols"], r["counts"], tuple(r["ahead"]), s, letters=False)[1] for s in range(4)]
                for r in batch.select(["symbols", "counts", "ahead"]).to_pylist()
            ]
            columns = [batch.column("at"), batch.column("conv_id"), pa.array(made, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "conv_id", "ends"])

    def follow(t: pa.Table) -> pa.Table:
        state, rows = START, []
        held = t.sort_by("at").to_pylist()
        for i, p in enumerate(held):
            rows.append({"at": p["at"], "start": state, "is_last": i == len(held) - 1})
            state = p["ends"][state]
        return _table(rows, pa.schema([("at", pa.int64()), ("start", pa.int32()), ("is_last", pa.bool_())]))

    mapped = runs.mapInArrow(ends, f"at bigint, conv_id {types['conv_id']}, ends array<int>")
    starts = mapped.groupBy("conv_id").applyInArrow(follow, "at bigint, start int, is_last boolean")
    audit_names = f"conv_id {types['conv_id']}, turn {types['turn']}, role string, digest binary, start int, audit string"
    audit_arrow = to_arrow_schema(spark.createDataFrame([], audit_names).schema)

    def letters(stream):
        for batch in stream:
            rows = []
            for r in batch.to_pylist():
                audit, state = unrolled(r["symbols"], r["counts"], tuple(r["ahead"]), r["start"])
                rows.append({**{c: r[c] for c in [*KEY, "start"]}, "audit": audit + (END_LETTERS[state] if r["is_last"] else "")})
            yield from _table(rows, audit_arrow).to_batches()

    at_edges = runs.join(starts, "at").mapInArrow(letters, audit_names)
    inside = pieces.filter("not edge")
    audits = inside.select(*KEY, F.lit(START).alias("start"), "audit").unionByName(at_edges)
    wholes = inside.select("conv_id", *sums).unionByName(combined.filter("at is null").select("conv_id", *sums))
    return audits, wholes


# -- texts -----------------------------------------------------------------------------------------

_RESULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Conversation:
    """What is known of the conversation whose rows are streaming by."""

    def __init__(self, conv_id):
        self.conv_id, self.sums = conv_id, [0] * len(_RESULTS)
        self.hash, self.empty, self.audits = hashlib.sha256(), True, []
        self.letters, self.at, self.state = "", 0, START

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{role}:{text}".encode() if self.empty else f"\n{role}:{text}".encode())
        self.empty = False

    def insert_rows(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self.line(LINE_ROLE[self.state], "")

    def begin_piece(self, start: int, audit: str) -> None:
        if self.at != len(self.letters):
            raise AssertionError("a piece of a conversation has fewer rows than edits")
        self.audits.append(audit)
        self.letters, self.at, self.state = audit, 0, start

    def row(self, role: str, text: str) -> None:
        self.insert_rows()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "K":
            self.state = kept_state(self.state, 2 * max(INITIALS.find(role[:1]), 0))
            self.line(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self.line(LINE_ROLE[self.state], text)

    def result(self) -> tuple:
        self.insert_rows()
        self.begin_piece(START, "")
        return (self.conv_id, *self.sums, "".join(self.audits), self.hash.hexdigest())


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Audit, cost and repaired text's hash of every conversation of ``rows`` (conv_id, turn, role, text).

    ``rows`` may be the output of :func:`damaged` or any table of conversations; nulls of role and text
    count as one space.
    """
    spaced = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    audits, wholes = finished_pieces(narrow_rows(spaced), block_rows)
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0))
    heads = wholes.select("conv_id", F.lit(0).alias("kind"), F.array(gaps, *[F.col(c) for c in _RESULTS[1:]]).alias("sums"))
    marks = audits.withColumn("kind", F.lit(1))
    texts = spaced.withColumns({"kind": F.lit(2), "digest": F.unhex(F.md5(F.col("text").cast("binary")))})
    stream = heads.unionByName(marks, True).unionByName(texts, True)
    order = [F.col("conv_id"), F.col("kind") > 0, F.col("turn"), F.col("role"), F.col("digest"), F.col("kind")]
    dealt = stream.repartition("conv_id").sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "kind", "sums", "start", "audit", "role", "text")
    conv = dealt.schema["conv_id"].dataType.simpleString()
    names = f"conv_id {conv}, " + ", ".join(f"{c} bigint" for c in _RESULTS) + ", audit string, repaired_sha256 string"

    def hashed(batches):
        now, done = None, []
        for batch in batches:
            ids, kinds, sums, starts, letters, roles, texts = (batch.column(i) for i in range(7))
            conv_type = ids.type
            ids, kinds, roles, texts = ids.to_pylist(), kinds.to_pylist(), roles.to_pylist(), texts.to_pylist()
            for i, (conv_id, kind) in enumerate(zip(ids, kinds)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                if kind == 2:
                    now.row(roles[i], texts[i])
                elif kind == 1:
                    now.begin_piece(starts[i].as_py(), letters[i].as_py())
                else:
                    now.sums = sums[i].as_py()
            if len(done) >= 4096:
                yield _results(done, conv_type)
                done = []
        if now is not None:
            yield _results([*done, now.result()], conv_type)

    return dealt.mapInArrow(hashed, names)


def _results(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, *[pa.int64()] * len(_RESULTS), pa.string(), pa.string()]
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_RESULTS, "audit", "repaired_sha256"])


def repair_damaged(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`repair` of the damaged rows, with a row for each conversation of ``rows``, those without rows included."""
    repaired = repair(damaged(rows), block_rows)
    every = rows.select(F.col("conv_id").alias("every_id")).distinct()
    joined = every.join(repaired, F.col("every_id").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        F.col("every_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _RESULTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def op13_run_length_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair_damaged(common.table(spark, sf, "conversations"))


_SPACED = r"[^\x20\x09-\x0D]"
OP13_SQL = rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda a, i:
         CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], list_transform(
             string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: unicode(c)::BIGINT)),
             lambda a, b: xor(a >> 8, t.crc[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS c
  FROM conversations, t),
m AS (
  SELECT conv_id, turn, CASE c WHEN 4 THEN 'user' ELSE role END AS role,
         CASE c WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM d, range(2) AS k(i) WHERE c <> 0 AND (i = 0 OR c = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM m),
w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
         NOT regexp_matches(text, '{_SPACED}') AS blank, left(role, 1) AS initial,
         coalesce(right(regexp_extract(text, '(?s)^.*{_SPACED}'), 1), '') NOT IN ('.', '!', '?') AS open
  FROM o),
r AS (SELECT *, blank OR seen > 1 AS gone, NOT blank AND seen = 1 AND open AS cut,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM w),
s AS (
  SELECT conv_id, max(i) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND seen > 1) AS duplicate,
         count(*) FILTER (cut) AS truncated,
         count(*) FILTER (i > 1 AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM r GROUP BY conv_id),
ins(state, mid, paid, letters, lines) AS (VALUES
  (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, {INSERT}, 'I', ['user:']), (1, 2, {INSERT}, 'I', ['user:']), (3, 2, {INSERT}, 'I', ['user:']), (2, 3, {INSERT}, 'I', ['assistant:']),
  (0, 3, {2 * INSERT}, 'II', ['user:', 'assistant:']), (1, 3, {2 * INSERT}, 'II', ['user:', 'assistant:'])),
act(letter) AS (VALUES ('D'), ('K'), ('R')),
step AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM s
  UNION ALL
  SELECT conv_id, i, state, cost, audit, lines FROM (
    SELECT x.*, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS place FROM (
      SELECT step.conv_id, r.i,
             CASE act.letter WHEN 'D' THEN mid WHEN 'R' THEN CASE mid WHEN 2 THEN 3 ELSE 2 END
                  ELSE CASE r.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS state,
             step.cost + paid + CASE act.letter WHEN 'D' THEN {DELETE} WHEN 'R' THEN {RENAME} ELSE 0 END
               + CASE WHEN act.letter <> 'D' AND r.cut THEN {TRUNCATED} ELSE 0 END AS cost,
             step.audit || ins.letters || act.letter AS audit,
             list_concat(step.lines, ins.lines, CASE act.letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
               ELSE [CASE mid WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text] END) AS lines
      FROM step JOIN r ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.i = step.i + 1
      JOIN ins ON ins.state = step.state, act
      WHERE act.letter = 'D' OR NOT r.gone AND (act.letter = 'R'
        OR r.initial = 's' AND mid = 0 OR r.initial = 'u' AND mid <> 2 OR r.initial = 'a' AND mid = 2)) AS x)
  WHERE place = 1),
fin(state, paid, letters, lines) AS (VALUES (0, 0, '', []::VARCHAR[]), (1, {2 * INSERT}, 'II', ['user:', 'assistant:']),
  (2, {INSERT}, 'I', ['assistant:']), (3, 0, '', [])),
best AS (
  SELECT step.conv_id, step.cost + fin.paid AS cost, step.audit || fin.letters AS audit, list_concat(step.lines, fin.lines) AS lines,
         row_number() OVER (PARTITION BY step.conv_id ORDER BY step.cost + fin.paid, step.audit || fin.letters) AS place
  FROM step JOIN s ON s.conv_id IS NOT DISTINCT FROM step.conv_id AND s.n = step.i JOIN fin ON fin.state = step.state)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM best WHERE place = 1) AS b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""
