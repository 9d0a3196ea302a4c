import math
import random

import pytest

from sparsight.plans import evaluate as V


def run_frame(spark, lists, config="c"):
    rows = [(config, q, p, i + 1) for q, pids in lists.items() for i, p in enumerate(pids)]
    return spark.createDataFrame(rows, "config string, qid string, pid string, rank int")


def qrel_frame(spark, qrels):
    rows = [(q, p, r) for q, grades in qrels.items() for p, r in grades.items()]
    return spark.createDataFrame(rows, "qid string, pid string, rel int")


def measures(spark, lists, qrels, **options):
    table = V.evaluate(run_frame(spark, lists), qrel_frame(spark, qrels), **options)
    return {r.measure: r.value for r in table.collect()}


def test_perfect_run(spark):
    got = measures(spark, {"q": ["a", "b", "c"]}, {"q": {"a": 3, "b": 2, "c": 1, "d": 0}})
    for name in ("map", "gm_map", "ndcg", "Rprec", "recip_rank", "bpref", "set_F", "11pt_avg", "success_1"):
        assert got[name] == pytest.approx(1.0), name
    # Its smoothing keeps the inferred measure just below one.
    assert got["infAP"] == pytest.approx(1.0, abs=1e-5)
    assert got["P_5"] == pytest.approx(0.6) and got["relative_P_5"] == pytest.approx(1.0)
    assert got["utility"] == 3.0


# Relevant b (grade 2), d and z (not returned); x and y judged non-relevant; u in the pool only.
RUN = {"q": ["x", "b", "n", "d", "y", "u"]}
QRELS = {"q": {"b": 2, "d": 1, "z": 1, "x": 0, "y": 0, "u": -1}}


def test_by_hand(spark):
    got = measures(spark, RUN, QRELS)
    assert [got[f"num_{n}"] for n in ("q", "ret", "rel", "rel_ret", "nonrel_judged_ret")] == [1, 6, 3, 2, 2]
    assert got["map"] == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert got["recip_rank"] == 0.5
    assert got["P_5"] == pytest.approx(2 / 5) and got["P_10"] == pytest.approx(2 / 10)
    assert got["recall_5"] == pytest.approx(2 / 3) and got["success_1"] == 0 and got["success_5"] == 1
    assert got["map_cut_5"] == got["map"]
    dcg = 2 / math.log2(3) + 1 / math.log2(5)
    ideal = 2 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert got["ndcg"] == pytest.approx(dcg / ideal)
    assert got["Rprec"] == pytest.approx(1 / 3)
    # int(0.2·3+0.9) = 1 and int(1.4·3+0.9) = 5
    assert got["Rprec_mult_0.20"] == 0 and got["Rprec_mult_1.40"] == pytest.approx(2 / 5)
    # int(0.8·3+0.9) = 3 relevant hits are never reached.  0.7·3+0.9 is just below 3 in doubles.
    assert got["iprec_at_recall_0.00"] == 0.5 and got["iprec_at_recall_0.70"] == 0.5
    assert got["iprec_at_recall_0.80"] == 0.0 and got["iprec_at_recall_1.00"] == 0.0
    # Both relevant hits have one judged non-relevant above; min(1, 3) / min(2, 3).
    assert got["bpref"] == pytest.approx(2 * (1 - 1 / 2) / 3)
    assert got["set_P"] == pytest.approx(2 / 6) and got["set_recall"] == pytest.approx(2 / 3)
    assert got["set_F"] == pytest.approx(4 / 9) and got["set_map"] == pytest.approx(2 / 9)
    assert got["set_relative_P"] == pytest.approx(2 / 3)
    assert got["utility"] == 2 - 4
    e = 1e-5
    at2 = 1 / 2 + (1 / 2) * (1 / 1) * ((0 + e) / (1 + 2 * e))
    at4 = 1 / 4 + (3 / 4) * (2 / 3) * ((1 + e) / (2 + 2 * e))
    assert got["infAP"] == pytest.approx((at2 + at4) / 3)


def test_queries_must_be_in_both(spark):
    lists = {"q": ["a"], "unjudged": ["a"]}
    qrels = {"q": {"a": 1}, "silent": {"a": 1}}
    assert measures(spark, lists, qrels)["num_q"] == 1
    whole = measures(spark, lists, qrels, complete=True)
    assert whole["num_q"] == 2 and whole["map"] == 0.5 and whole["num_rel"] == 2


def test_a_judged_query_without_relevant_passages_scores_zero(spark):
    got = measures(spark, {"q": ["a"], "r": ["a"]}, {"q": {"a": 0}, "r": {"a": 1}})
    assert got["num_q"] == 2 and got["map"] == 0.5 and got["ndcg"] == 0.5
    assert got["gm_map"] == pytest.approx(math.sqrt(1e-5))


def test_buckets_and_chunks_do_not_show(spark, monkeypatch):
    rng = random.Random(1)
    pids = [str(i) for i in range(60)]
    lists = {"hot": rng.sample(pids, 50), "small": rng.sample(pids, 5)}
    qrels = {q: {p: rng.choice([-1, 0, 0, 1, 2]) for p in rng.sample(pids, 40)} for q in lists}
    plain = measures(spark, lists, qrels, depth=50)
    judged = sorted(V.judge_run(run_frame(spark, lists), qrel_frame(spark, qrels)).collect(), key=str)
    monkeypatch.setattr(V, "BUCKET", 4)
    monkeypatch.setattr(V, "IDEAL_CHUNK", 3)
    assert measures(spark, lists, qrels) == pytest.approx(plain)
    assert sorted(V.judge_run(run_frame(spark, lists), qrel_frame(spark, qrels)).collect(), key=str) == judged


def test_judge_run_counts_unjudged_hits_too(spark):
    rows = V.judge_run(run_frame(spark, RUN), qrel_frame(spark, QRELS)).orderBy("rank").collect()
    assert [r.rel for r in rows] == [0, 2, None, 1, 0, -1]
    assert [r.rel_so_far for r in rows] == [0, 1, 1, 2, 2, 2]


def test_chosen_measures_equal_the_full_set(spark):
    run, qrels = run_frame(spark, RUN), qrel_frame(spark, QRELS)
    whole = {r.measure: r.value for r in V.evaluate(run, qrels).collect()}
    some = {r.measure: r.value for r in V.evaluate(run, qrels, ("gm_map", "P_", "num_q")).collect()}
    assert set(some) == {"gm_map", "num_q", *[f"P_{k}" for k in V.CUTOFFS]}
    assert all(whole[m] == v for m, v in some.items())


def test_rank_run_and_compare(spark):
    lists = spark.createDataFrame([("a", "q", ["x", "y"])], "config string, qid string, pids array<string>")
    assert sorted(map(tuple, V.rank_run(lists).collect())) == [("a", "q", "x", 1), ("a", "q", "y", 2)]
    metrics = spark.createDataFrame([("a", "map", 0.1), ("b", "map", 0.2)], "config string, measure string, value double")
    assert V.compare_configs(metrics, ["a", "b"]).first().asDict() == {"measure": "map", "a": 0.1, "b": 0.2}
