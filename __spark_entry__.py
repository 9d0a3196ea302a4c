"""Binds the operators to the driver's tables.

``queries()`` runs each operator over whole tables, ``oracle_sql()`` gives the same
result as SQL.  How the tables play their parts:

* vectors: every row of ``embeddings`` is both a query and a passage;
* texts: ``documents`` are passages, ``benchmark`` items are queries;
* postings: an order (or a customer) with the summed quantity of each of its parts;
* rankings: customers (or nations, for deep rankings) as queries, all the parts they ordered as
  passages; a line that was accepted is relevant, one that was returned is judged non-relevant.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import oracle_statements as oracles
from sparsight.functions import columns as C
from sparsight.functions import text as X
from sparsight.operators import addressing as R
from sparsight.operators import autoencoder as A
from sparsight.operators import dense as D
from sparsight.operators import dense_index as DX
from sparsight.operators import fit as T
from sparsight.operators import pairs as M
from sparsight.operators import sparse as P
from sparsight.plans import evaluate as V
from sparsight.plans import retrieval as B
from sparsight.sources import tables, text_files, vector_shards
from sparsight.storage import fresh_path, materialize

try:
    from sparsight.llm import queries as corpus
except ModuleNotFoundError as missing:  # the subpackage and its pipeline may be left out; other errors count
    if not (missing.name or "").startswith(("sparsight.llm", "corpus_pipeline")):
        raise
    corpus = None

# Parameters shared with the SQL side.
LATENT_SIZE, LATENT_K, SEED = oracles.LATENT_SIZE, oracles.LATENT_K, oracles.SEED
TOP_K, PAIR_K, BATCH = oracles.TOP_K, oracles.PAIR_K, oracles.BATCH
FEEDBACK = oracles.FEEDBACK


def r6(column: Column | str) -> Column:
    """Six digits, without a negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), 6) + F.lit(0.0)


def r9(column: str) -> Column:
    """Nine digits, for means: at six, a mean of P@200 may lie exactly between two values."""
    return F.round(column, 9) + F.lit(0.0)


def rows6(df: DataFrame, *keys: str) -> DataFrame:
    return A.vectors_as_rows(df, keys).select(*keys, "dim", r6("value").alias("value"))


# --- the parts the tables play ---------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias("vec"))


def width(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "embeddings").select(F.size("embedding")).first()[0]


def model(spark: SparkSession, sf: str) -> A.SparseModel:
    return A.SparseModel.of(*start_weights(spark, sf))


def start_weights(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return A.init_weights(A.feature_ids(spark, LATENT_SIZE), width(spark, sf), LATENT_SIZE, SEED)


def order_postings(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey")
    return lines.agg(F.sum("l_quantity").alias("weight")).select(
        F.col("l_orderkey").alias("pid"), F.col("l_partkey").alias("feature"), "weight"
    )


def customer_lines(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def asked_lines(spark: SparkSession, sf: str, by: str) -> DataFrame:
    """Lines with the query they belong to: a customer, or the nation of the customer."""
    lines = customer_lines(spark, sf)
    if by == "customer":
        return lines.withColumn("qid", F.col("o_custkey"))
    nations = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("qid"))
    return lines.join(nations, "o_custkey")


def customer_postings(spark: SparkSession, sf: str) -> DataFrame:
    lines = customer_lines(spark, sf).groupBy("o_custkey", "l_partkey")
    return lines.agg(F.sum("l_quantity").alias("weight")).select(
        F.col("o_custkey").alias("qid"), F.col("l_partkey").alias("feature"), "weight"
    )


def part_run(spark: SparkSession, sf: str, by: str = "customer") -> DataFrame:
    """Two rankings of all the parts of each query."""
    # Lines are dealt by query once, for the sums and for the ranks.
    lines = asked_lines(spark, sf, by).repartition("qid").groupBy("qid", F.col("l_partkey").alias("pid"))
    scored = lines.agg(
        F.round(F.sum("l_extendedprice"), 2).alias("spend"), F.sum("l_quantity").alias("quantity")
    )
    # Both ranks are taken before a row becomes two.
    of_query = Window.partitionBy("qid")
    ranks = [F.row_number().over(of_query.orderBy(F.col(c).desc(), "pid")).alias(f"{c}_rank") for c in ("spend", "quantity")]
    entries = [
        F.struct(F.lit(c).alias("config"), F.col(f"{c}_rank").alias("rank"), F.col(c).alias("score")) for c in ("spend", "quantity")
    ]
    ranked = scored.select("qid", "pid", "spend", "quantity", *ranks).select("qid", "pid", F.inline(F.array(*entries)))
    return ranked.select("config", "qid", "pid", "rank", "score")


def part_qrels(spark: SparkSession, sf: str, by: str = "customer") -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    rel = (
        F.when((flag == "A") & (F.col("l_quantity") >= 25), 2)
        .when(flag == "A", 1)
        .when(flag == "R", 0)
        .when((flag == "N") & (status == "F"), -1)
    )
    lines = asked_lines(spark, sf, by).withColumn("rel", rel).filter("rel IS NOT NULL")
    return lines.groupBy("qid", F.col("l_partkey").alias("pid")).agg(F.max("rel").alias("rel"))


def neighbors(spark: SparkSession, sf: str, k: int = TOP_K) -> DataFrame:
    return D.neighbor_join(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), "dev", k)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbors(spark, sf, PAIR_K)
    built = M.build_pairs(near, vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), PAIR_K)
    return built.withColumn("row_idx", F.col("qid"))


def terms(spark: SparkSession, sf: str) -> DataFrame:
    batched = R.assign_batches(pairs(spark, sf), BATCH)
    return M.pair_terms(M.reconstruct_pairs(batched, model(spark, sf), LATENT_K))


def scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", r6("score"))


def neighbor_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Exact neighbours as graded judgments: the nearest gets the highest grade."""
    near = neighbors(spark, sf)
    return near.select("qid", "pid", (F.lit(TOP_K + 1) - F.col("rank")).alias("rel"))


# --- scans and sinks -------------------------------------------------------


def q_scan_passages_tsv(spark, sf):
    path = fresh_path(spark, "passages-tsv")
    text_files.write_tsv(table(spark, sf, "part"), "p_partkey", "p_name", path)
    return text_files.scan_passages_tsv(spark, path)


def q_scan_queries_tsv(spark, sf):
    paths = {}
    for split, name, key, value in (
        ("train", "customer", "c_custkey", "c_name"),
        ("dev", "supplier", "s_suppkey", "s_name"),
        ("eval", "nation", "n_nationkey", "n_name"),
    ):
        paths[split] = fresh_path(spark, f"queries-{split}")
        text_files.write_tsv(table(spark, sf, name), key, value, paths[split])
    return text_files.scan_queries_tsv(spark, paths)


def q_scan_qrels(spark, sf):
    path = fresh_path(spark, "qrels")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("pid"), F.col("l_linenumber").alias("rel")
    )
    text_files.export_qrel_file(lines, path)
    return text_files.scan_qrels(spark, path, "train")


def passages(spark, sf):
    rows = R.with_row_index(table(spark, sf, "documents"))
    return rows.select("row_idx", F.col("doc_id").cast("string").alias("pid"), F.col("text").alias("passage"))


def split_queries(spark, sf):
    """Three splits of queries from three text tables."""
    parts = []
    for split, name, key, text in (
        ("train", "conversations", F.concat_ws("-", "conv_id", "turn"), "text"),
        ("dev", "benchmark", F.col("item_id").cast("string"), "text"),
        ("eval", "customer", F.col("c_custkey").cast("string"), "c_name"),
    ):
        rows = R.with_row_index(table(spark, sf, name))
        parts.append(rows.select(F.lit(split).alias("split"), "row_idx", key.alias("qid"), F.col(text).alias("query")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_scan_passages(spark, sf):
    base = fresh_path(spark, "corpus")
    tables.write_passages(passages(spark, sf), 4, base)
    return tables.scan_passages(spark, base)


def q_passage_count(spark, sf):
    return q_scan_passages(spark, sf).agg(F.count("*").alias("passages"))


def q_write_passages(spark, sf):
    base = fresh_path(spark, "corpus")
    tables.write_passages(passages(spark, sf), 4, base)
    return spark.read.parquet(f"{base}/passages").select(
        "row_idx", "pid", F.col("shard").cast("int").alias("shard"), F.length("passage").alias("n_chars")
    )


def q_scan_queries(spark, sf):
    base = fresh_path(spark, "corpus")
    tables.write_queries(split_queries(spark, sf), base)
    return tables.scan_queries(spark, base, "dev")


def q_write_queries(spark, sf):
    base = fresh_path(spark, "corpus")
    tables.write_queries(split_queries(spark, sf), base)
    rows = spark.read.parquet(f"{base}/queries")
    return rows.select(F.col("split").cast("string").alias("split"), "row_idx", "qid", "query")


def indexed_vectors(spark, sf):
    rows = R.with_row_index(table(spark, sf, "embeddings"))
    return rows.select("row_idx", F.col("vec_id").cast("string").alias("pid"), F.col("embedding").alias("vec"))


def q_scan_vectors(spark, sf):
    base = fresh_path(spark, "corpus")
    tables.write_vectors(indexed_vectors(spark, sf), 3, base, "given")
    return rows6(tables.scan_vectors(spark, base, "given"), "row_idx", "pid")


def q_scan_query_vectors(spark, sf):
    base = fresh_path(spark, "corpus")
    rows = indexed_vectors(spark, sf).select(F.lit("dev").alias("split"), "row_idx", F.col("pid").alias("qid"), "vec")
    tables.write_query_vectors(rows, 3, base, "given")
    return rows6(tables.scan_query_vectors(spark, base, "given", "dev"), "split", "row_idx", "qid")


def q_write_vectors(spark, sf):
    base = fresh_path(spark, "corpus")
    tables.write_vectors(indexed_vectors(spark, sf), 3, base, "given")
    rows = spark.read.parquet(f"{base}/passage_vectors/given")
    return rows.select("row_idx", "pid", F.col("shard").cast("int").alias("shard"), F.size("vec").alias("width"))


def q_import_vector_shards(spark, sf):
    folder = fresh_path(spark, "arrays")
    vector_shards.export_vector_shards(indexed_vectors(spark, sf), 3, folder).collect()
    return rows6(vector_shards.import_vector_shards(spark, folder), "row_idx")


def q_export_vector_shards(spark, sf):
    return vector_shards.export_vector_shards(indexed_vectors(spark, sf), 3, fresh_path(spark, "arrays"))


def q_scan_relevance(spark, sf):
    base = fresh_path(spark, "corpus")
    tables.write_qrels(part_qrels(spark, sf).withColumn("split", F.lit("dev")), base)
    return tables.scan_relevance(spark, base, "dev")


def q_scan_neighbors(spark, sf):
    base = fresh_path(spark, "corpus")
    tables.write_neighbors(neighbors(spark, sf), base, "given")
    return scored(tables.scan_neighbors(spark, base, "given", "dev"))


def q_write_qrels(spark, sf):
    base = fresh_path(spark, "corpus")
    qrels = part_qrels(spark, sf)
    tables.write_qrels(qrels.withColumn("split", F.lit("train")), base)
    rows = spark.read.parquet(f"{base}/qrels")
    return rows.select(F.col("split").cast("string").alias("split"), "qid", "pid", "rel")


def q_write_neighbors(spark, sf):
    base = fresh_path(spark, "corpus")
    tables.write_neighbors(neighbors(spark, sf), base, "given")
    rows = spark.read.parquet(f"{base}/neighbors/given")
    return rows.select(F.col("split").cast("string").alias("split"), "qid", "rank", "pid", r6("score").alias("score"))


def q_write_fit_history(spark, sf):
    base = fresh_path(spark, "models")
    losses = M.epoch_losses(terms(spark, sf)).select(F.lit(0).alias("epoch"), "mse", "kld")
    tables.write_fit_history(losses.unpivot("epoch", ["mse", "kld"], "name", "value"), base, "given")
    return tables.scan_fit_history(spark, base, "given").select("epoch", "name", r6("value").alias("value"))


def part_weights(spark, sf):
    """Start weights with one feature per part."""
    parts = table(spark, sf, "part")
    features = parts.select(F.col("p_partkey").alias("feature"))
    return A.init_weights(features, width(spark, sf), parts.count(), SEED)


def q_write_model(spark, sf):
    base = fresh_path(spark, "models")
    weights, bias = part_weights(spark, sf)
    snapshot = T.snapshot_of(weights, bias, width(spark, sf))
    state = T.state_table(spark, T.FitState(epoch=0, rate=0.001))
    tables.write_model(snapshot, state, base, "parts", "last", 0)
    saved, fitted = tables.scan_model(spark, base, "parts", "last")
    moments = [F.size(c) for c in ("m_enc", "m_dec", "v_enc", "v_dec")]
    zero = F.forall(F.concat("m_enc", "m_dec", "v_enc", "v_dec"), lambda x: x == 0)
    parts = F.posexplode(F.arrays_zip("w_enc", "w_dec")).alias("dim", "w")
    # The moments are looked at once a feature, before it becomes a row for each dimension.
    zero = (zero & (sum(moments) == 4 * F.size("w_enc"))).alias("zero")
    rows = saved.select("feature", r6("b_enc").alias("b_enc"), "w_enc", "w_dec", zero).select("feature", "b_enc", parts, "zero")
    said = fitted.select(F.col("epoch").alias("epoch"), F.col("step").alias("step"), r6("rate").alias("rate"))
    return rows.select(
        "feature", "b_enc", "dim", r6("w.w_enc").alias("w_enc"), r6("w.w_dec").alias("w_dec"), F.col("zero").alias("zero_moments")
    ).crossJoin(F.broadcast(said))


def q_scan_model(spark, sf):
    base = fresh_path(spark, "models")
    weights, bias = part_weights(spark, sf)
    snapshot = T.snapshot_of(weights, bias, width(spark, sf))
    tables.write_model(snapshot, T.state_table(spark, T.FitState(epoch=0)), base, "parts", "best", 0)
    loaded = T.model_of(tables.scan_model(spark, base, "parts", "best")[0])
    parts = F.posexplode(F.arrays_zip("w_enc", "w_dec")).alias("dim", "w")
    biases = F.array(*[F.lit(b) for b in loaded.b_dec])
    rows = loaded.weights.select("feature", F.lit(loaded.size).cast("bigint").alias("size"), r6("b_enc").alias("b_enc"), parts)
    return rows.select("feature", "size", "b_enc", "dim", r6("w.w_enc").alias("w_enc"), r6("w.w_dec").alias("w_dec"),
                       r6(F.get(biases, F.col("dim"))).alias("b_dec"))


def q_export_run_file(spark, sf):
    path = fresh_path(spark, "run")
    text_files.export_run_file(part_run(spark, sf).filter("config = 'spend'"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def q_export_qrel_file(spark, sf):
    path = fresh_path(spark, "qrels")
    text_files.export_qrel_file(part_qrels(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def q_write_metrics(spark, sf):
    base = fresh_path(spark, "reports")
    run, qrels = stored_run(spark, sf)
    for config in ("spend", "quantity"):
        tables.write_metrics(V.evaluate(run.filter(F.col("config") == config), qrels, ("num_", "recip_rank")), base)
    return tables.scan_metrics(spark, base).select("config", "measure", r9("value").alias("value"))


# --- addressing ------------------------------------------------------------


def indexed_orders(spark, sf):
    return R.with_row_index(table(spark, sf, "orders").select("o_orderkey", "o_custkey"))


def q_with_row_index(spark, sf):
    return indexed_orders(spark, sf).select("o_orderkey", "row_idx")


def q_shard_and_offset(spark, sf):
    return indexed_orders(spark, sf).select(
        "o_orderkey", C.shard_of("row_idx", 51).alias("shard"), C.offset_of("row_idx", 51).alias("off")
    )


def q_row_of(spark, sf):
    rows = q_shard_and_offset(spark, sf)
    return rows.select("o_orderkey", C.row_of("shard", "off", 51).alias("row_idx"))


def q_worker_slice(spark, sf):
    return indexed_orders(spark, sf).filter(C.in_worker_slice("row_idx", 152, 8, 2)).select("o_orderkey", "row_idx")


def q_lookup_ids(spark, sf):
    customers = R.with_row_index(table(spark, sf, "customer").select("c_custkey", "c_name"))
    hits = indexed_orders(spark, sf).select("o_orderkey", F.col("o_custkey").alias("position"))
    return R.lookup_ids(hits, customers, "position", "c_name")


def q_zip_ids_vectors(spark, sf):
    ids = passages(spark, sf).select("row_idx", "pid")
    zipped = R.zip_ids_vectors(ids, indexed_vectors(spark, sf).select("row_idx", "vec"))
    return rows6(zipped, "row_idx", "pid")


def q_assign_batches(spark, sf):
    return R.assign_batches(indexed_orders(spark, sf), 512).select("o_orderkey", "batch_id")


def q_assign_batches_shuffled(spark, sf):
    batched = R.assign_batches(indexed_orders(spark, sf), 512, shuffle=True, seed=SEED)
    return batched.select("o_orderkey", "batch_id")


def q_head_batch(spark, sf):
    rows = passages(spark, sf)
    return R.head_batch(rows, 8).select("row_idx", "pid", "passage")


def q_positive_only(spark, sf):
    balances = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("feature"), F.col("c_acctbal").alias("weight")
    )
    return P.positive_only(balances)


def q_prefix_neighbors(spark, sf):
    return scored(R.prefix_neighbors(neighbors(spark, sf), 3))


def q_to_feature_map(spark, sf):
    maps = P.to_feature_map(order_postings(spark, sf), "pid")
    return P.from_feature_map(maps.withColumn("n", F.size("features")), "pid").select("pid", "feature", "weight")


def q_parse_count(spark, sf):
    sizes = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"))
    return sizes.select(
        "p_partkey",
        C.parse_count("s").alias("plain"),
        C.parse_count(F.concat("s", F.lit("K"))).alias("thousands"),
        C.parse_count(F.concat("s", F.lit("m"))).alias("millions"),
    )


# --- text ------------------------------------------------------------------


def q_apply_instruction(spark, sf):
    names = F.explode(F.array(*[F.lit(n) for n in ("miniCPM", "bgeBase", "hashedWords")]))
    rows = table(spark, sf, "benchmark").select("item_id", "text", names.alias("embedding"))
    return rows.select("item_id", "embedding", X.apply_instruction("text", "embedding").alias("input"))


def q_embed_batches(spark, sf):
    encoded = X.embed_batches(table(spark, sf, "documents"), "text", X.HashedWords(64), ["doc_id"])
    return rows6(encoded, "doc_id")


def q_embed_queries(spark, sf):
    rows = table(spark, sf, "benchmark").select(
        "item_id", X.apply_instruction(F.col("text"), F.lit("miniCPM")).alias("text")
    )
    return rows6(X.embed_batches(rows, "text", X.HashedWords(64), ["item_id"], batch_size=8), "item_id")


def q_truncate_tokens(spark, sf):
    kept = X.truncate_tokens(X.tokens("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(kept).alias("n"), F.array_join(kept, " ").alias("kept"))


def token_vectors(spark, sf):
    """Vectors with one label are the tokens of one text."""
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("text_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"),
        (F.col("embedding")[0] > 0).cast("int").alias("mask"),
    )


def q_pool_first(spark, sf):
    return rows6(X.pool_first(token_vectors(spark, sf), "text_id"), "text_id")


def q_pool_masked_mean(spark, sf):
    return rows6(X.pool_masked_mean(token_vectors(spark, sf), "text_id"), "text_id")


def q_l2_normalize(spark, sf):
    lines = table(spark, sf, "lineitem")
    vec = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    unit = lines.select("l_orderkey", "l_linenumber", C.l2_normalize(vec).alias("vec"))
    return rows6(unit, "l_orderkey", "l_linenumber")


# --- autoencoder -----------------------------------------------------------


def q_init_weights(spark, sf):
    weights, _ = part_weights(spark, sf)
    entries = F.posexplode(F.arrays_zip("w_enc", "w_dec")).alias("dim", "w")
    return weights.select("feature", "b_enc", entries).select(
        "feature", r6("b_enc").alias("b_enc"), "dim", r6("w.w_enc").alias("w_enc"), r6("w.w_dec").alias("w_dec")
    )


def q_encode(spark, sf):
    rows = A.encode(vectors(spark, sf, "id"), model(spark, sf), ["id"])
    return rows.select("id", "feature", r6("activation").alias("activation"))


def q_center(spark, sf):
    return rows6(A.center(vectors(spark, sf, "id"), model(spark, sf)), "id")


def q_ksparse_features(spark, sf):
    codes = A.ksparse_features(vectors(spark, sf, "id"), model(spark, sf), LATENT_K, ["id"])
    return codes.select("id", "feature", r6("weight").alias("weight"))


def q_latent_postings(spark, sf):
    codes = A.latent_postings(vectors(spark, sf, "id"), model(spark, sf), LATENT_K, ["id"])
    return codes.select("id", "feature", r6("weight").alias("weight"))


def q_decode(spark, sf):
    rows, m = vectors(spark, sf, "id"), model(spark, sf)
    return rows6(A.decode(A.ksparse_features(rows, m, LATENT_K, ["id"]), m, rows, ["id"]), "id")


def q_reconstruct(spark, sf):
    return rows6(A.reconstruct(vectors(spark, sf, "id"), model(spark, sf), LATENT_K, ["id"]), "id")


def q_densify(spark, sf):
    codes = A.ksparse_features(vectors(spark, sf, "id"), model(spark, sf), LATENT_K, ["id"])
    maps = P.to_feature_map(codes, "id")
    return rows6(maps.select("id", C.densify("features", LATENT_SIZE).alias("vec")), "id")


# --- retrieval -------------------------------------------------------------


def q_dense_topk(spark, sf):
    return scored(D.dense_topk(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), TOP_K))


def q_dense_topk_sharded(spark, sf):
    return scored(D.dense_topk_sharded(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), TOP_K, 4, 3))


def q_dense_add(spark, sf):
    index = indexed_vectors(spark, sf)
    opposite = index.select(
        "row_idx", F.concat(F.lit("-"), "pid").alias("pid"), F.transform("vec", lambda x: -x).alias("vec")
    )
    return rows6(D.dense_add(index, opposite), "row_idx", "pid")


def stored_halves(spark, sf):
    """A stored index of the vectors with even ids, to which those with odd ids are added; its base and first version."""
    base, given = fresh_path(spark, "index"), materialize(table(spark, sf, "embeddings"), "embeddings")
    parts = [
        R.with_ordered_index(given.filter(F.col("vec_id") % 2 == i).select(F.col("vec_id").alias("pid"), F.col("embedding").alias("vec")), ["pid"])
        for i in range(2)
    ]
    versions = [DX.add(spark, base, "given", part) for part in parts]
    return base, versions[0]


def q_dense_index_search(spark, sf):
    base, _ = stored_halves(spark, sf)
    return scored(DX.search(spark, base, "given", vectors(spark, sf, "qid"), TOP_K))


def q_dense_index_snapshot(spark, sf):
    """The version before the second addition, searched after it."""
    base, first = stored_halves(spark, sf)
    return scored(DX.search(spark, base, "given", vectors(spark, sf, "qid"), TOP_K, version=first))


def q_neighbor_join(spark, sf):
    return scored(neighbors(spark, sf))


def q_hits_as_arrays(spark, sf):
    packed = D.hits_as_arrays(D.dense_topk(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), TOP_K))
    entries = F.posexplode(F.arrays_zip("pids", "scores")).alias("place", "hit")
    return packed.select("qid", entries).select("qid", "place", F.col("hit.pids").alias("pid"), r6("hit.scores").alias("score"))


def urgent_batch(spark, sf):
    """Newer postings of the urgent orders, with doubled weights."""
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    postings = order_postings(spark, sf).join(urgent, F.col("pid") == F.col("o_orderkey"), "left_semi")
    return postings.withColumn("weight", F.col("weight") * 2)


def q_sparse_index_upsert(spark, sf):
    return P.sparse_index_upsert(order_postings(spark, sf), urgent_batch(spark, sf)).select("pid", "feature", "weight")


def q_sparse_index_create(spark, sf):
    base = fresh_path(spark, "index")
    P.sparse_index_create(spark, base, "parts", urgent_batch(spark, sf))
    P.sparse_index_create(spark, base, "parts", order_postings(spark, sf), wipe=True)
    P.sparse_index_create(spark, base, "parts", urgent_batch(spark, sf), wipe=False)
    return P.sparse_index_open(spark, base, "parts").select("pid", "feature", "weight")


def q_sparse_index_search(spark, sf):
    """An index is stored and a batch added to it; the search reads the stored blocks where they are."""
    base = fresh_path(spark, "index")
    P.sparse_index_create(spark, base, "parts", order_postings(spark, sf))
    P.sparse_index_add(spark, base, "parts", urgent_batch(spark, sf))
    return P.sparse_index_search(spark, base, "parts", materialize(customer_postings(spark, sf), "asked"), TOP_K)


def q_sparse_index_compact(spark, sf):
    """The postings of an index of several segments once these have been merged."""
    base = fresh_path(spark, "index")
    P.sparse_index_create(spark, base, "parts", order_postings(spark, sf))
    P.sparse_index_add(spark, base, "parts", urgent_batch(spark, sf), merge=False)
    P.sparse_index_compact(spark, base, "parts", everything=True)
    return P.sparse_index_open(spark, base, "parts").select("pid", "feature", "weight")


def stored_postings(spark, sf):
    """Query postings and the index, each written once."""
    return materialize(customer_postings(spark, sf), "asked"), materialize(order_postings(spark, sf), "index")


def q_sparse_topk(spark, sf):
    return P.sparse_topk(*stored_postings(spark, sf), TOP_K)


def q_sparse_topk_batch(spark, sf):
    customers = R.with_row_index(table(spark, sf, "customer").select(F.col("c_custkey").alias("qid")))
    asked, index = stored_postings(spark, sf)
    return P.sparse_topk_batch(asked, customers, index, TOP_K)


def q_fetch_vectors(spark, sf):
    hits = D.dense_topk(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), 3).select("qid", "pid", "rank")
    return rows6(P.fetch_vectors(hits, vectors(spark, sf, "pid")), "qid", "pid", "rank")


# --- pairs, losses, fit ----------------------------------------------------


def q_build_pairs(spark, sf):
    rows = M.pairs_as_rows(pairs(spark, sf))
    return rows.select("qid", "rank", "pid", F.posexplode(F.arrays_zip("q_vec", "p_vec")).alias("dim", "v")).select(
        "qid", "rank", "pid", "dim", r6("v.q_vec").alias("q"), r6("v.p_vec").alias("p")
    )


def q_pair_scores(spark, sf):
    s = M.pair_scores(pairs(spark, sf))
    return s.select("qid", "rank", r6("m").alias("m"), r6("s").alias("s"), r6("z").alias("z"))


def q_loss_mse(spark, sf):
    return M.loss_mse(terms(spark, sf)).select("batch_id", r6("mse").alias("mse"))


def q_loss_kld(spark, sf):
    return M.loss_kld(terms(spark, sf)).select("batch_id", r6("kld").alias("kld"))


def q_epoch_losses(spark, sf):
    return M.epoch_losses(terms(spark, sf)).select(r6("mse").alias("mse"), r6("kld").alias("kld"))


def q_validate(spark, sf):
    batched = R.assign_batches(pairs(spark, sf), BATCH)
    losses = M.validate(batched, model(spark, sf), LATENT_K)
    return losses.select(r6("mse").alias("mse"), r6("kld").alias("kld"), r6(F.col("mse") + F.col("kld")).alias("total"))


def gradients(spark, sf):
    # Pairs are counted first.
    return T.fit_gradients(materialize(pairs(spark, sf), "pairs"), model(spark, sf), LATENT_K)


def q_fit_gradients(spark, sf):
    entries = F.posexplode(F.arrays_zip("d_dec", "d_enc")).alias("dim", "g")
    return gradients(spark, sf).select("feature", r6(F.col("d_bias")[0]).alias("d_bias"), entries).select(
        "feature", "d_bias", "dim", r6("g.d_dec").alias("d_dec"), r6("g.d_enc").alias("d_enc")
    )


def q_fit_adam_step(spark, sf):
    snapshot = T.snapshot_of(*start_weights(spark, sf), width(spark, sf))
    moved = T.fit_adam_step(snapshot, materialize(gradients(spark, sf), "gradients"), oracles.RATE, 1)
    vectors = ["w_dec", "w_enc", "m_dec", "m_enc", "v_dec", "v_enc"]
    entries = F.posexplode(F.arrays_zip(*vectors)).alias("dim", "w")
    biases = ["b_enc", "m_bias", "v_bias"]
    # Second moments are small: nine digits.
    digits = lambda c: r9(c) if c.split(".")[-1][0] == "v" else r6(c)
    return moved.select("feature", *[digits(b).alias(b) for b in biases], entries).select(
        "feature", *biases, "dim", *[digits(f"w.{c}").alias(c) for c in vectors]
    )


def q_fit(spark, sf):
    base = fresh_path(spark, "models")
    train = materialize(pairs(spark, sf), "pairs")
    history = T.fit(base, "given", train, train, *start_weights(spark, sf), LATENT_K,
                    epochs=2, batch_size=1024, rate=oracles.RATE, seed=SEED)
    return history.select("epoch", "name", r6("value").alias("value"))


# --- retrieval pipelines ---------------------------------------------------


def q_retrieve_reconstructed(spark, sf):
    hits = B.retrieve_reconstructed(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), model(spark, sf), LATENT_K, TOP_K)
    return scored(hits)


def q_retrieve_latent(spark, sf):
    return scored(B.retrieve_latent(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), model(spark, sf), LATENT_K, 100))


def q_retrieve_latent_wide(spark, sf):
    hits = B.retrieve_latent_wide(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), model(spark, sf), LATENT_K, 50)
    return scored(hits)


def feedback_tables(spark, sf):
    return B.FeedbackTables(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), model(spark, sf), LATENT_K)


def q_feedback_hits(spark, sf):
    t = feedback_tables(spark, sf)
    return scored(B.feedback_hits(t.q_hat, t.p_hat, FEEDBACK[0]))


def found_features(t):
    hits = B.feedback_hits(t.q_hat, t.p_hat, FEEDBACK[0])
    return B.feedback_features(hits, t.p_codes, FEEDBACK[1])


def q_feedback_features(spark, sf):
    rows = found_features(feedback_tables(spark, sf))
    return rows.select("qid", "pid", "rank", "feature", "place", r6("weight").alias("weight"))


def q_feedback_union(spark, sf):
    return B.feedback_union(found_features(feedback_tables(spark, sf)))


def q_expand_query(spark, sf):
    t = feedback_tables(spark, sf)
    expanded = B.expand_query(t.q_codes, B.feedback_union(found_features(t)), FEEDBACK[2])
    return expanded.select("qid", "feature", r6("weight").alias("weight"))


def q_retrieve_feedback(spark, sf):
    hits = B.retrieve_feedback(
        vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), model(spark, sf), LATENT_K, *FEEDBACK, TOP_K
    )
    return scored(hits)


def q_feedback_sweep(spark, sf):
    hits = B.feedback_sweep(vectors(spark, sf, "qid"), vectors(spark, sf, "pid"), model(spark, sf), LATENT_K, TOP_K)
    return scored(hits)


def evaluated(config: str, retrieve, depth: int):
    """A retrieval pipeline scored against the exact neighbours."""

    def query(spark, sf):
        run = materialize(retrieve(spark, sf), "run").withColumn("config", F.lit(config))
        metrics = V.evaluate(run, materialize(neighbor_qrels(spark, sf), "qrels"), depth=depth)
        return metrics.select("config", "measure", r9("value").alias("value"))

    return query


# --- measures --------------------------------------------------------------


def q_rank_run(spark, sf):
    packed = part_run(spark, sf).groupBy("config", "qid").agg(
        F.sort_array(F.collect_list(F.struct("rank", "pid"))).alias("hits")
    )
    return V.rank_run(packed.select("config", "qid", F.col("hits.pid").alias("pids")))


def q_judge_run(spark, sf):
    return V.judge_run(*stored_run(spark, sf))


def stored_run(spark, sf, by="customer"):
    """The run and its judgments, each written once, as a scorer reads them."""
    return materialize(part_run(spark, sf, by), "run"), materialize(part_qrels(spark, sf, by), "qrels")


def q_evaluate_deep(spark, sf):
    """All measures of rankings that go thousands of ranks deep: a query is a nation."""
    metrics = V.evaluate(*stored_run(spark, sf, "nation"))
    return metrics.select("config", "measure", r9("value").alias("value"))


def q_judge_run_deep(spark, sf):
    return V.judge_run(*stored_run(spark, sf, "nation"))


def measured(*names: str):
    def query(spark, sf):
        metrics = V.evaluate(*stored_run(spark, sf), names)
        return metrics.select("config", "measure", r9("value").alias("value"))

    return query


def q_compare_configs(spark, sf):
    metrics = V.evaluate(*stored_run(spark, sf), oracles.COMPARED)
    wide = V.compare_configs(metrics, ["spend", "quantity"])
    return wide.select("measure", r9("spend").alias("spend"), r9("quantity").alias("quantity"))


MEASURES = {name: measured(*families) for name, families in oracles.MEASURE_QUERIES.items()}


def entry(spark: SparkSession) -> DataFrame:
    """The ten nearest passages of every query vector."""
    return q_dense_topk(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator."""
    named = {n[2:]: f for n, f in globals().items() if n.startswith("q_") and callable(f)}
    return {
        **named,
        **MEASURES,
        "evaluate_reconstructed": evaluated("reconstructed", q_retrieve_reconstructed, TOP_K),
        "evaluate_latent": evaluated("latent", q_retrieve_latent, 100),
        "evaluate_feedback": evaluated("feedback", q_retrieve_feedback, TOP_K),
        **(corpus.QUERIES if corpus else {}),
    }


def oracle_sql() -> dict[str, str]:
    """The same results as SQL; queries without an entry are checked by rows only."""
    return {**oracles.statements(), **(corpus.SQL if corpus else {})}
