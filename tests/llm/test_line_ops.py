"""Line dedup and line-first cleaning against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.llm import line_dedup as L
from sparsight.llm import quality_rules as Q

STRIP = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_dedup(rows):
    keys = lambda t: [lower(x.strip(STRIP)) for x in (t or "").split("\n")]
    holders = {}
    for i, t in set(rows):
        for k in set(keys(t)):
            if len(k) >= 40:
                holders.setdefault(k, []).append(i)
    keeper = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= 5}
    out = []
    for i, t in rows:
        kept = [x for x, k in zip((t or "").split("\n"), keys(t)) if k not in keeper or keeper[k] == i]
        n = len(keys(t))
        out.append((i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def digest(df):
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return Counter(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", sha).collect())


def test_dedup_equals_brute_force(awkward, awkward_docs):
    got = L.dedup_lines(awkward_docs, report=True)
    assert digest(got) == brute_dedup(awkward)
    assert L.dedup_lines(awkward_docs).columns == awkward_docs.columns


def test_dedup_of_a_very_common_line(spark):
    line = "this very common line stands in every single document here"
    rows = [(i, f"own {i}\n{line}\n{line}  \nend {i}") for i in range(400)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), report=True)
    assert digest(got) == brute_dedup(rows)


@pytest.mark.parametrize("hot", [L.HOT_DOCS, 20])
def test_more_shared_lines_than_may_be_sent(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "SEND_BYTES", 0)
    monkeypatch.setattr(L, "HOT_DOCS", hot)
    shared = [f"line {j} stands in a good many of the documents of this test" for j in range(9)]
    rows = [(i, "\n".join([f"own {i}", *[s for j, s in enumerate(shared) if i % (j + 1) == 0], f"end {i}"])) for i in range(90)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), report=True)
    assert digest(got) == brute_dedup(rows)


def test_first_lines_are_streamed_from_sorted_runs(spark):
    rows = [(i, i % 7, 3, j, j % 4, 0) for i in range(50) for j in range(9)]
    lines = spark.createDataFrame(rows, "doc_id bigint, text_key bigint, n_lines int, pos int, h1 bigint, h2 bigint")
    firsts = L.first_lines(lines)
    plan = firsts._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" in plan and "Window [" in plan and "rangepartitioning" in plan
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, firsts.collect())) == sorted({(h1, h2, i) for i, _, _, _, h1, h2 in rows})


def test_kept_runs_are_the_rest(spark):
    frame = spark.createDataFrame([([0, 1, 4], 6), ([2], 3), ([0, 1], 2), ([1], 4)], "p array<int>, n int")
    got = [[tuple(x) for x in r[0]] for r in frame.select(L.kept_runs(L.runs_of_places(F.col("p")), F.col("n"))).collect()]
    assert got == [[(2, 2), (5, 1)], [(0, 2)], [], [(0, 1), (2, 2)]]


def test_dedup_of_nothing(no_docs):
    assert L.dedup_lines(no_docs, report=True).count() == 0


def test_bitmaps_are_runs(spark):
    places = spark.createDataFrame([([0, 1, 2, 5, 7, 8],), ([3],)], "p array<int>")
    runs = [[tuple(x) for x in r[0]] for r in places.select(L.runs_of_places(F.col("p"))).collect()]
    assert runs == [[(0, 3), (5, 1), (7, 2)], [(3, 1)]]


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n_words = len(words)
    return (
        n_words, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n_words < 50 or 100 * len(covered) > 50 * n_words,
    )


def test_base_measures(awkward, awkward_docs):
    got = Counter(tuple(r) for r in Q.judge(awkward_docs, "j").select("doc_id", *[f"j.{c}" for c in Q.BASE[:-1]]).collect())
    assert got == Counter((i, *brute_base(t)) for i, t in awkward)


def test_lines_fail_by_rule(spark):
    lines = {
        "A usual sentence, with words and an end.": False,
        "": False,
        "word### word$$$ other*** more&&& end.%%%": True,
        "LOUD!! WORDS!! AND!! MORE!!": True,
        "home | news | sport | about | contact": True,
        "Read more": True,
        "Back to top": True,
        "All rights reserved.": True,
        "Licensed under the Apache License, Version 2.0.": True,
        "one two three": False,
        " ".join(["word"] * 30): True,
        "Is that so? It is!": False,
    }
    rows = spark.createDataFrame([(k,) for k in lines], "line string").select("line", Q.line_fails(F.col("line"))).collect()
    assert dict(map(tuple, rows)) == lines


def test_cleaning(spark, awkward_docs, no_docs):
    good = "Here is a sentence of a story, told at some length. " * 3
    body = "\n".join(f"{good}It has part {i} of {i * 7} in it, as number {i + 100} says." for i in range(5))
    rows = [(1, body + "\nRead more"), (2, "\n".join(["a | b | c | d | e"] * 40) + "\n" + body[:300]), (3, None)]
    kept = Q.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [tuple(r) for r in kept] == [(1, body)] or Q.judge(spark.createDataFrame(rows[:1], "doc_id bigint, text string")).first().judged.base_failed
    assert Q.clean(awkward_docs).columns == awkward_docs.columns
    assert Q.clean(no_docs).count() == 0


def test_large_bitmap_tables_are_joined_alike(awkward, awkward_docs, monkeypatch):
    from sparsight.llm import common

    monkeypatch.setattr(common, "SEND_BYTES", -1)
    assert digest(L.dedup_lines(awkward_docs, report=True)) == brute_dedup(awkward)
