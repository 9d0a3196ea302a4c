import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsight import storage
from sparsight.functions import columns as C
from sparsight.functions import permutation
from sparsight.operators import addressing as R
from sparsight.sources import tables, text_files, vector_shards


def write_lines(base, name, lines):
    path = f"{base}/{name}"
    with open(path, "w", encoding="utf-8") as file:
        file.write("".join(line + "\n" for line in lines))
    return path


def test_row_index_follows_files_and_splits(spark, base):
    for i, part in enumerate(np.array_split(np.arange(50_000), 3)):
        spark.createDataFrame([(int(v),) for v in part], "v long").coalesce(1).write.parquet(f"{base}/t/part={i}")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "40000")
    try:
        rows = R.with_row_index(spark.read.parquet(f"{base}/t").select("v"))
        assert spark.read.parquet(f"{base}/t").rdd.getNumPartitions() > 3
        assert rows.filter("v <> row_idx").count() == 0
        assert rows.agg(F.countDistinct("row_idx")).first()[0] == 50_000
        write_lines(base, "x.txt", [f"{i}\tline {i}" for i in range(20_000)])
        lines = text_files.scan_passages_tsv(spark, f"{base}/x.txt")
        assert lines.filter("cast(pid AS long) <> row_idx").count() == 0
        assert lines.count() == 20_000
    finally:
        spark.conf.set(setting, before)


def test_row_index_compares_part_numbers(spark, base):
    for name, line in (("part-99999-x.txt", "a"), ("part-100000-x.txt", "b"), ("part-00007-x.txt", "z")):
        write_lines(base, name, [line])
    rows = R.with_row_index(spark.read.text(base)).orderBy("row_idx").collect()
    assert [r.value for r in rows] == ["z", "a", "b"]


def test_row_index_counts_rows_after_a_filter(spark, base):
    spark.range(100).write.parquet(f"{base}/t")
    rows = R.with_row_index(spark.read.parquet(f"{base}/t").filter("id % 3 = 0"))
    assert sorted(r.row_idx for r in rows.collect()) == list(range(34))


def test_ordered_index(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("v"))
    assert R.with_ordered_index(df, ["v"]).filter("v <> row_idx").count() == 0


def test_shard_round_trip(spark):
    df = spark.range(500).select("id", C.shard_of("id", 51).alias("s"), C.offset_of("id", 51).alias("o"))
    assert df.filter(C.row_of("s", "o", 51) != F.col("id")).count() == 0
    assert [tuple(r) for r in df.filter("id = 103").collect()] == [(103, 1, 2)]


def test_worker_slices_cover_every_row_once(spark):
    kept = [spark.range(1000).filter(C.in_worker_slice("id", 152, 8, w)).count() for w in range(8)]
    assert sum(kept) == 1000 and min(kept) > 0


def test_shuffled_batches_are_a_permutation(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_idx")
    one, two, other = (R.assign_batches(df, 64, True, seed).collect() for seed in (1, 1, 2))
    assert sorted(one) == sorted(two) != sorted(other)
    sizes = {}
    for r in one:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert sizes == {**{b: 64 for b in range(15)}, 15: 40}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 97, 1000, 99_991])
def test_permutation_is_a_bijection(spark, n):
    a, b = permutation.grid(n)
    assert n <= a * b <= n + permutation.SPARE
    df = spark.range(n, numPartitions=3)
    places = [r[0] for r in df.select(permutation.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(places) == list(range(n))
    if n >= 1000:
        # Neighbours part, and no number keeps its place more often than by chance.
        steps = np.abs(np.diff(places))
        assert np.mean(steps) == pytest.approx(n / 3, rel=0.1) and np.mean(np.array(places) == np.arange(n)) < 0.01
    assert places != [r[0] for r in df.select(permutation.permuted(F.col("id"), n, 6)).collect()] or n < 64


def test_shuffled_batches_move_no_row(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_idx")
    assert "Exchange" not in R.assign_batches(df, 64, True, 3)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        R.assign_batches(df.filter("row_idx > 3"), 64, True, 3)
    assert R.assign_batches(df.limit(0), 64, True, 3).count() == 0


def test_head_and_lookup_and_zip(spark):
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_idx long, pid string")
    vecs = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row_idx long, vec array<double>")
    assert [r.pid for r in R.head_batch(ids, 2).collect()] == ["a", "b"]
    assert sorted(r.pid for r in R.zip_ids_vectors(ids, vecs).collect()) == ["a", "b"]
    hits = spark.createDataFrame([(9, 2)], "qid long, place long")
    assert R.lookup_ids(hits, ids, "place", "pid").first().pid == "c"


def test_tsv_is_stripped_and_split_on_tabs_only(spark, base):
    path = write_lines(base, "p.tsv", ["0\tone  two ", "  1\t'quo\"ted' ", "2\tlast"])
    rows = text_files.scan_passages_tsv(spark, path).orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [(0, "0", "one  two"), (1, "1", "'quo\"ted'"), (2, "2", "last")]


@pytest.mark.parametrize("bad", ["only one", "a\tb\tc", ""])
def test_malformed_tsv_lines_are_errors(spark, base, bad):
    path = write_lines(base, "p.tsv", ["0\tfine", bad])
    with pytest.raises(Exception, match="expected 2 fields"):
        text_files.scan_passages_tsv(spark, path).collect()


def test_qrels_last_line_wins(spark, base):
    path = write_lines(base, "q.tsv", ["1 0 7 1", "1\t0\t8  0", " 1 0 7 3 "])
    rows = sorted(map(tuple, text_files.scan_qrels(spark, path, "dev").collect()))
    assert rows == [("dev", "1", "7", 3), ("dev", "1", "8", 0)]
    with pytest.raises(Exception, match="expected 4 fields"):
        text_files.scan_qrels(spark, write_lines(base, "bad.tsv", ["1 0 7"]), "dev").collect()


def test_run_and_qrel_files(spark, base):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, pid string, rank int")
    text_files.export_run_file(run, f"{base}/run")
    assert sorted(r.value for r in spark.read.text(f"{base}/run").collect()) == ["q 0 a 0 -1 0", "q 0 a 0 0 0"][1:] + ["q 0 b 0 -1 0"]
    qrels = spark.createDataFrame([("q", "a", 2)], "qid string, pid string, rel int")
    text_files.export_qrel_file(qrels, f"{base}/qrels")
    assert text_files.scan_qrels(spark, f"{base}/qrels", "dev").first().rel == 2


def test_passages_come_back_in_round_robin_shards(spark, base):
    rows = spark.range(10).select(F.col("id").alias("row_idx"), F.col("id").cast("string").alias("pid"),
                                  F.concat(F.lit("p"), "id").alias("passage"))
    tables.write_passages(rows, 4, base)
    assert sorted(tables.scan_passages(spark, base).collect()) == sorted(rows.collect())
    shards = spark.read.parquet(f"{base}/passages").groupBy("shard").count().collect()
    assert sorted((r["shard"], r["count"]) for r in shards) == [(0, 3), (1, 3), (2, 2), (3, 2)]


def test_a_shard_may_be_several_files(spark, base):
    rows = spark.range(100).select(F.col("id").alias("row_idx"), F.col("id").cast("string").alias("pid"), F.lit("p").alias("passage"))
    tables.write_passages(rows, 3, base, files_per_shard=4)
    assert sorted(tables.scan_passages(spark, base).collect()) == sorted(rows.collect())
    stored = spark.read.parquet(f"{base}/passages")
    assert stored.filter("row_idx % 3 <> shard").count() == 0
    assert stored.select("_metadata.file_path").distinct().count() == 12


def test_splits_are_pruned_and_checked(spark, base):
    rows = spark.createDataFrame([("train", 0, "1", "x"), ("dev", 0, "2", "y")], "split string, row_idx long, qid string, query string")
    tables.write_queries(rows, base)
    dev = tables.scan_queries(spark, base, "dev")
    assert [r.qid for r in dev.collect()] == ["2"]
    assert "PartitionFilters: [isnotnull(split" in dev._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        tables.scan_queries(spark, base, "test")


def test_vector_tables_are_float32(spark, base):
    rows = spark.createDataFrame([(i, str(i), [0.1 * i, 1.0]) for i in range(7)], "row_idx long, pid string, vec array<double>")
    tables.write_vectors(rows, 3, base, "e")
    back = tables.scan_vectors(spark, base, "e")
    assert dict(back.dtypes)["vec"] == "array<float>"
    assert np.allclose([r.vec[0] for r in back.orderBy("row_idx").collect()], [0.1 * i for i in range(7)])


@pytest.mark.parametrize("rows,shards", [(500, 3), (2, 5), (1, 1)])
def test_array_shards_round_trip(spark, base, monkeypatch, rows, shards):
    monkeypatch.setattr(vector_shards, "ROWS_PER_RANGE", 64)
    x = np.random.default_rng(0).random((rows, 6), dtype=np.float32)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "row_idx long, vec array<float>")
    vector_shards.export_vector_shards(df, shards, f"{base}/a").collect()
    # The layout: row i is row i div n of file i mod n.
    for i in range(min(rows, 7)):
        assert np.array_equal(np.load(f"{base}/a/{i % shards:08d}.npy")[i // shards], x[i])
    if rows >= shards:
        back = vector_shards.import_vector_shards(spark, f"{base}/a").orderBy("row_idx").collect()
        assert [r.row_idx for r in back] == list(range(rows))
        assert np.array_equal(np.array([r.vec for r in back], np.float32), x)


def test_import_accepts_arrays_saved_elsewhere(spark, base):
    x = np.arange(35, dtype=np.float32).reshape(7, 5)
    for s in range(2):
        np.save(f"{base}/{s:08d}.npy", x[s::2])
    back = vector_shards.import_vector_shards(spark, base).orderBy("row_idx").collect()
    assert np.array_equal(np.array([r.vec for r in back]), x)


def test_reports_are_appended(spark, base):
    one = spark.createDataFrame([("a", "map", 0.5)], "config string, measure string, value double")
    tables.write_metrics(one, base)
    tables.write_metrics(one.withColumn("config", F.lit("b")), base)
    assert sorted(r.config for r in tables.scan_metrics(spark, base).collect()) == ["a", "b"]


def test_models_are_found_through_their_newest_pointer(spark, base):
    assert tables.scan_model(spark, base, "m", "last") is None
    for epoch in (0, 1):
        snapshot = spark.createDataFrame([(epoch, 1.0)], "feature int, b_enc double")
        tables.write_model(snapshot, spark.createDataFrame([(epoch,)], "epoch int"), base, "m", "last", epoch)
    weights, state = tables.scan_model(spark, base, "m", "last")
    assert weights.first().feature == 1 and state.first().epoch == 1
    with pytest.raises(ValueError):
        tables.scan_model(spark, base, "m", "newest")


def test_shared_folder_comes_from_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        assert storage.shared_dir(spark) == named.rstrip("/")
    assert storage.fresh_path(spark, "x") != storage.fresh_path(spark, "x")
    assert storage.materialize(spark.range(5), "five").count() == 5


def test_a_model_saved_from_itself_again_and_again(spark, base):
    schema = "feature int, w double"
    tables.write_model(spark.createDataFrame([(0, 1.0)], schema), spark.createDataFrame([(3,)], "epoch int"), base, "m", "best", 3)
    for turn in range(2):  # the same epoch, from the stored snapshot
        stored = tables.scan_model(spark, base, "m", "best")[0]
        tables.write_model(stored.withColumn("w", F.col("w") * 2), spark.createDataFrame([(3,)], "epoch int"), base, "m", "best", 3)
    assert [tuple(r) for r in tables.scan_model(spark, base, "m", "best")[0].collect()] == [(0, 4.0)]
    broken = spark.range(1).selectExpr("0 AS feature", "raise_error('stop') AS w")
    with pytest.raises(Exception, match="stop"):
        tables.write_model(broken, spark.createDataFrame([(3,)], "epoch int"), base, "m", "best", 3)
    assert tables.scan_model(spark, base, "m", "best")[0].first().w == 4.0


@pytest.mark.parametrize("places", [[0, 1, 3], [0, 0, 1], [1, 2, 3]])
def test_export_refuses_numbers_with_gaps(spark, base, places):
    rows = spark.createDataFrame([(p, [1.0, 2.0]) for p in places], "row_idx long, vec array<double>")
    with pytest.raises(Exception, match="rows of shard|its header says"):
        vector_shards.export_vector_shards(rows, 1, f"{base}/shards").collect()


def test_large_passages_are_cut_into_files(spark, base, monkeypatch):
    rows = spark.createDataFrame([(i, str(i), "x" * 100) for i in range(60)], "row_idx long, pid string, passage string")
    monkeypatch.setattr(tables, "FILE_BYTES", 500, raising=False)
    tables.write_passages(rows, 3, base)
    files = spark.read.parquet(f"{base}/passages").select("shard", F.input_file_name().alias("file")).distinct()
    assert {r["count"] for r in files.groupBy("shard").count().collect()} == {4}
    got = sorted(tuple(r) for r in tables.scan_passages(spark, base).collect())
    assert got == sorted(tuple(r) for r in rows.collect())
