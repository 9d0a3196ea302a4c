"""Ranking measures over judged runs.

A run is ``config, qid, pid, rank`` (rank from 1), judgments are ``qid, pid, rel``.
Only judged hits are joined and numbered; how far a hit is from the top is already in
its rank, so unjudged hits are needed as counts alone.  Running counts are taken in
rank buckets first, so not even a query with an extreme share of the hits is one group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cut-offs and levels of the standard measure set.
CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
SUCCESS_CUTOFFS = (1, 5, 10)
R_MULTIPLES = (0.2, 0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0)
RECALL_LEVELS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)

# Floor inside geometric means, smoothing of the inferred measure,
# and the rounding term that turns a share of R into a rank.
GEOMETRIC_FLOOR = 1e-5
INFERRED_SMOOTHING = 1e-5
SHARE_ROUNDING = 0.9

# Measures that are added up, and those reported as a geometric mean too.
SUMMED = ("num_ret", "num_rel", "num_rel_ret", "num_nonrel_judged_ret")
GEOMETRIC = {"map": "gm_map", "bpref": "gm_bpref"}

# Ranks per running-count bucket, and ideal ranks summed in one row.
BUCKET = 1024
IDEAL_CHUNK = 4096


def rank_run(lists: DataFrame) -> DataFrame:
    """``config, qid, pids`` (best first) as one row per hit with its rank."""
    return lists.select("config", "qid", F.posexplode("pids").alias("rank", "pid")).select(
        "config", "qid", "pid", (F.col("rank") + 1).alias("rank")
    )


def one_judgment(qrels: DataFrame) -> DataFrame:
    """``qid, pid, rel``: of several judgments of a pair the highest counts; null grades are none."""
    return qrels.filter("rel IS NOT NULL").groupBy("qid", "pid").agg(F.max("rel").alias("rel"))


def _judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels.select("qid", "pid", "rel"), ["qid", "pid"])


def _with_running_counts(
    hits: DataFrame, of_query: DataFrame | None = None, depth: int | None = None
) -> DataFrame:
    """Relevant, judged non-relevant and pooled unjudged hits up to and including each rank.

    The columns of ``of_query`` (one row per qid) are added too, before hits are counted, so that
    they are dealt by query once.  A run known to be at most one bucket deep is counted per query
    at once.  Otherwise counts inside a bucket get those of the buckets above it, and ``of_query``
    travels with these, so that hits are only ever joined by (config, qid, bucket).
    """
    key, bucket = ["config", "qid"], ["config", "qid", "_bucket"]
    names = {"_r": "rel_so_far", "_n": "nonrel_so_far", "_u": "unjudged_so_far"}
    kinds = {"_r": F.col("rel") >= 1, "_n": F.col("rel") == 0, "_u": F.col("rel") < 0}
    flags = hits.select("*", *[F.coalesce(f.cast("bigint"), F.lit(0)).alias(c) for c, f in kinds.items()])
    if depth is not None and depth <= BUCKET:
        above = Window.partitionBy(*key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        extra = [c for c in of_query.columns if c != "qid"] if of_query is not None else []
        flags = flags.join(of_query, "qid") if extra else flags
        return flags.select(*hits.columns, *extra, *[F.sum(c).over(above).alias(n) for c, n in names.items()])

    flags = flags.withColumn("_bucket", F.call_function("div", F.col("rank") - 1, F.lit(BUCKET)))
    totals = flags.groupBy(*bucket).agg(*[F.sum(c).alias(c) for c in names])
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *bucket, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_above") for c in names]
    )
    extra = []
    if of_query is not None:
        extra = [c for c in of_query.columns if c != "qid"]
        offsets = offsets.join(of_query, "qid")
    inside = Window.partitionBy(*bucket).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    numbered = flags.select(*hits.columns, "_bucket", *[F.sum(c).over(inside).alias(c) for c in names])
    return numbered.join(offsets, bucket).select(
        *hits.columns, *extra, *[(F.col(c) + F.col(f"{c}_above")).alias(n) for c, n in names.items()]
    )


def _measured_depth(run: DataFrame, depth: int | None) -> tuple[DataFrame, int | None]:
    """The run and its depth; where none is named, the lowest rank, of hits with a configuration and a rank.

    A run of one bucket is then joined and moved once, not again for the totals of its buckets.
    Repeated ranks make a query longer than its depth, so the hits of the longest query count too.
    """
    if depth is not None:
        return run, depth
    run = run.filter("config IS NOT NULL AND rank IS NOT NULL")
    lowest = run.agg(F.max("rank")).first()[0] or 0
    if lowest <= BUCKET:
        lowest = run.groupBy("config", "qid").count().agg(F.max("count")).first()[0] or 0
    return run, lowest


def judge_run(run: DataFrame, qrels: DataFrame, depth: int | None = None) -> DataFrame:
    """Every hit of a judged query with its judgment (null if unjudged) and ``rel_so_far``."""
    run, depth = _measured_depth(run, depth)
    qrels = one_judgment(qrels)
    kept = run.join(qrels.select("qid").distinct(), "qid", "left_semi")
    judged = kept.join(qrels.select("qid", "pid", "rel"), ["qid", "pid"], "left")
    return _with_running_counts(judged, depth=depth).select("config", "qid", "pid", "rank", "rel", "rel_so_far")


def _share(x: float) -> str:
    """int(x·R + 0.9) as SQL."""
    return f"cast(floor({x}D * num_rel + {SHARE_ROUNDING}D) AS bigint)"


def _safe(numerator: str, denominator: str) -> str:
    """A quotient that is 0 where there is nothing to divide by."""
    return f"CASE WHEN {denominator} > 0 THEN ({numerator}) / ({denominator}) ELSE 0D END"


def ideal_gains(qrels: DataFrame, cutoffs: Iterable[int]) -> DataFrame:
    """Ideal discounted gain per query, whole (``ideal``) and cut (``ideal_k``).

    Judgments are counted per grade; a grade fills a range of ideal ranks whose
    discounts are added in chunks, so no query's judgments are sorted in one task.
    """
    grades = qrels.filter("rel >= 1").groupBy("qid", "rel").agg(F.count("*").alias("n"))
    better = Window.partitionBy("qid").orderBy(F.col("rel").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = grades.withColumn("first", F.coalesce(F.sum("n").over(better), F.lit(0)) + 1)
    last = F.col("first") + F.col("n") - 1
    starts = F.sequence(F.col("first"), last, F.lit(IDEAL_CHUNK).cast("bigint"))
    chunks = ranges.select("qid", "rel", last.alias("last"), F.explode(starts).alias("start"))
    chunks = chunks.withColumn("stop", F.least("last", F.col("start") + IDEAL_CHUNK - 1))

    def gain(stop: Column) -> Column:
        ranks = F.sequence(F.col("start"), stop)
        discounts = F.aggregate(ranks, F.lit(0.0), lambda a, r: a + F.lit(1.0) / F.log2(r + 1.0))
        return F.col("rel") * discounts

    def cut(k: int) -> Column:
        return F.when(F.col("start") <= k, gain(F.least("stop", F.lit(k).cast("bigint"))))

    return chunks.groupBy("qid").agg(
        F.sum(gain(F.col("stop"))).alias("ideal"),
        *[F.coalesce(F.sum(cut(k)), F.lit(0.0)).alias(f"ideal_{k}") for k in cutoffs],
    )


def per_query(
    run: DataFrame, qrels: DataFrame, complete: bool = False, depth: int | None = None
) -> DataFrame:
    """All measures of each (config, qid) as columns.

    Queries count when they are in both tables.  With ``complete`` judged queries
    without hits count too, with zeros.
    """
    qrels = one_judgment(qrels)
    judgments = qrels.groupBy("qid").agg(
        F.sum((F.col("rel") >= 1).cast("bigint")).alias("num_rel"),
        F.sum((F.col("rel") == 0).cast("bigint")).alias("num_nonrel"),
    )
    returned = run.groupBy("config", "qid").agg(F.count("*").alias("num_ret"))
    if complete:
        every = judgments.select("qid").crossJoin(run.select("config").distinct())
        returned = every.join(returned, ["config", "qid"], "left").fillna(0, ["num_ret"])
    queries = returned.join(judgments, "qid").join(ideal_gains(qrels, CUTOFFS), "qid", "left")

    # What each judged hit adds, once the counts of its query are at hand.
    eps = f"{INFERRED_SMOOTHING}D"
    run, depth = _measured_depth(run, depth)
    hits = _with_running_counts(_judged(run, qrels), judgments, depth).selectExpr(
        "config", "qid", "rank", "rel", "num_rel",
        "rel >= 1 AS hit",
        "rel_so_far",
        "rel_so_far / rank AS precision",
        "rel / log2(rank + 1D) AS gain",
        """CASE WHEN rel < 1 THEN NULL WHEN nonrel_so_far > 0
            THEN 1 - least(nonrel_so_far, num_rel) / least(num_nonrel, num_rel) ELSE 1D END AS preferred""",
        f"""CASE WHEN rel < 1 THEN NULL WHEN rank = 1 THEN 1D ELSE 1D / rank + (rank - 1) / rank
            * ((rel_so_far - 1 + nonrel_so_far + unjudged_so_far) / (rank - 1))
            * ((rel_so_far - 1 + {eps}) / (rel_so_far - 1 + nonrel_so_far + 2 * {eps})) END AS inferred""",
    )
    sums = {
        "num_rel_ret": "count_if(hit)",
        "num_nonrel_judged_ret": "count_if(rel = 0)",
        "ap": "sum(precision) FILTER (WHERE hit)",
        "dcg": "sum(gain) FILTER (WHERE hit)",
        "first_rel": "min(rank) FILTER (WHERE hit)",
        "bpref_sum": "sum(preferred)",
        "inf_sum": "sum(inferred)",
    }
    for k in CUTOFFS:
        sums[f"ap_{k}"] = f"sum(precision) FILTER (WHERE hit AND rank <= {k})"
        sums[f"dcg_{k}"] = f"sum(gain) FILTER (WHERE hit AND rank <= {k})"
    for k in sorted({*CUTOFFS, *SUCCESS_CUTOFFS}):
        sums[f"rel_{k}"] = f"count_if(hit AND rank <= {k})"
    for i, x in enumerate(R_MULTIPLES):
        sums[f"rel_{i}x"] = f"count_if(hit AND rank <= {_share(x)})"
    for i, x in enumerate(RECALL_LEVELS):
        sums[f"iprec_{i}"] = f"max(precision) FILTER (WHERE hit AND rel_so_far >= {_share(x)})"
    summed = hits.groupBy("config", "qid").agg(*[F.expr(e).alias(name) for name, e in sums.items()])
    table = queries.join(summed, ["config", "qid"], "left")
    # A judged query without judged hits has no sums: they are zero.
    zeros = [c for c in table.columns if c not in ("config", "qid", "first_rel")]
    table = table.selectExpr("config", "qid", "first_rel", *[f"coalesce({c}, 0) AS {c}" for c in zeros])

    set_p, set_recall = _safe("num_rel_ret", "num_ret"), _safe("num_rel_ret", "num_rel")
    measures = {
        **{name: name for name in SUMMED},
        "map": _safe("ap", "num_rel"),
        "recip_rank": "coalesce(1D / first_rel, 0D)",
        "ndcg": _safe("dcg", "ideal"),
        "Rprec": _safe(f"rel_{R_MULTIPLES.index(1.0)}x", "num_rel"),
        "bpref": _safe("bpref_sum", "num_rel"),
        "infAP": _safe("inf_sum", "num_rel"),
        "utility": "num_rel_ret - (num_ret - num_rel_ret)",
        "set_P": set_p,
        "set_recall": set_recall,
        "set_F": _safe("2D * num_rel_ret", "num_ret + num_rel"),
        "set_map": f"({set_p}) * ({set_recall})",
        "set_relative_P": _safe("num_rel_ret", "least(num_ret, num_rel)"),
    }
    for k in CUTOFFS:
        measures[f"map_cut_{k}"] = _safe(f"ap_{k}", "num_rel")
        measures[f"P_{k}"] = f"rel_{k} / {k}"
        measures[f"recall_{k}"] = _safe(f"rel_{k}", "num_rel")
        measures[f"relative_P_{k}"] = _safe(f"rel_{k}", f"least({k}, num_rel)")
        measures[f"ndcg_cut_{k}"] = _safe(f"dcg_{k}", f"ideal_{k}")
    for k in SUCCESS_CUTOFFS:
        measures[f"success_{k}"] = f"if(rel_{k} > 0, 1D, 0D)"
    for i, x in enumerate(R_MULTIPLES):
        measures[f"Rprec_mult_{x:.2f}"] = _safe(f"rel_{i}x", _share(x))
    for i, x in enumerate(RECALL_LEVELS):
        measures[f"iprec_at_recall_{x:.2f}"] = f"iprec_{i}"
    levels = " + ".join(f"iprec_{i}" for i in range(len(RECALL_LEVELS)))
    measures["11pt_avg"] = f"({levels}) / {len(RECALL_LEVELS)}"
    return table.selectExpr("config", "qid", *[f"cast({e} AS double) AS `{n}`" for n, e in measures.items()])


def summarize(queries: DataFrame) -> DataFrame:
    """``config, measure, value`` from the per-query columns."""
    names = [c for c in queries.columns if c not in ("config", "qid")]
    totals = {"num_q": "cast(count(*) AS double)"}
    for name in names:
        totals[name] = f"{'sum' if name in SUMMED else 'avg'}(`{name}`)"
        if name in GEOMETRIC:
            totals[GEOMETRIC[name]] = f"exp(avg(ln(greatest(`{name}`, {GEOMETRIC_FLOOR}D))))"
    wide = queries.groupBy("config").agg(*[F.expr(e).alias(name) for name, e in totals.items()])
    return wide.unpivot("config", [f"`{name}`" for name in totals], "measure", "value")


def evaluate(
    run: DataFrame,
    qrels: DataFrame,
    measures: tuple[str, ...] = (),
    complete: bool = False,
    depth: int | None = None,
) -> DataFrame:
    """The measure set of every configuration: ``config, measure, value``.

    ``measures`` narrows it to names, or to families given as ``"P_"``; what is left
    out is not computed.  ``depth`` is the most hits a query has, where that is known.
    """
    queries = per_query(run, qrels, complete, depth)
    if not measures:
        return summarize(queries)

    def wanted(name: str) -> bool:
        return any(name.startswith(m) if m.endswith("_") else name == m for m in measures)

    names = [c for c in queries.columns if wanted(c) or wanted(GEOMETRIC.get(c, c))]
    narrow = summarize(queries.select("config", "qid", *[F.col(f"`{n}`") for n in names]))
    reported = [n for n in ("num_q", *names, *[GEOMETRIC[n] for n in names if n in GEOMETRIC]) if wanted(n)]
    return narrow.filter(F.col("measure").isin(reported))


def compare_configs(metrics: DataFrame, configs: list) -> DataFrame:
    """One row per measure with a column per configuration."""
    return metrics.groupBy("measure").pivot("config", configs).agg(F.first("value"))
