"""Lines repeated across documents, removed with DataFrame functions alone.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; keys
travel as two independent 64-bit hashes, never as text.  The hashed lines are dealt by range of
(hash, document) and sorted by (hash, document, position): equal hashes lie next to each other, and
even a hash that a third of all lines share is spread over many partitions.  A window streams over these
runs and keeps the first line of each hash and document; only these firsts are added up by hash, one row
per hash and partition before anything moves: the number of documents and the document whose lines
stay.  Lines of a shared hash elsewhere turn into one run-length bitmap per document, the runs of lines to
keep; texts meet the bitmaps only at the end.

Defined results: a null or empty text is one empty line; repeated rows (equal doc_id and text) count
as one document, rows with equal doc_id and different texts as one each, and lines stay in all rows
of the largest id; a null doc_id is smaller than any id; a document that loses all its lines keeps an
empty text; an empty table gives no rows; further columns are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.storage import materialize

MIN_CHARS, MIN_DOCS = 40, 5
#: A hash in more documents is sent to the lines even where there are too many shared hashes to send all.
HOT_DOCS = 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_count(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit(""))) + 1


def text_key(text: Column) -> Column:
    """Tells rows with equal doc_id apart, the same in every job."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, n_lines, pos, h1, h2 of every line whose key has at least ``min_chars`` code points."""
    text = F.col("text")
    exploded = docs.select(
        "doc_id", text_key(text).alias("text_key"), line_count(text).alias("n_lines"), F.posexplode(lines_of(text)).alias("pos", "line")
    )
    stripped = exploded.withColumn("line", F.btrim("line", F.lit(common.SPACES)))
    key = common.lower_ascii(F.col("line"))
    return stripped.filter(F.char_length("line") >= min_chars).select(
        "doc_id", "text_key", "n_lines", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")
    )


def runs_of_places(places: Column) -> Column:
    """Sorted places as runs (start, length)."""
    before = lambda p, i: (i == 0) | (F.get(places, i - 1) != p - 1)
    after = lambda p, i: (i == F.size(places) - 1) | (F.get(places, i + 1) != p + 1)
    return F.zip_with(
        F.filter(places, before), F.filter(places, after),
        lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")),
    )


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """The runs (start, length) between sorted runs that go."""
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["start"] + r["length"]))
    stops = F.concat(F.transform(dropped, lambda r: r["start"]), F.array(n_lines))
    runs = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def first_lines(lines: DataFrame) -> DataFrame:
    """h1, h2, doc_id of the first line of each hash and document, streamed from sorted range partitions."""
    order = ["h1", "h2", "doc_id", "text_key"]
    # Range partitions of these keys hold each (hash, document) whole, so the window needs no further shuffle.
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    turn = F.row_number().over(Window.partitionBy(*order).orderBy("pos"))
    return dealt.withColumn("turn", turn).filter("turn = 1").select("h1", "h2", "doc_id")


def lines_to_drop(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """The lines of shared hashes outside of the document that keeps them.

    More shared hashes than may be sent meet the lines by a shuffle, but for the hot ones, of which there are
    at most one per HOT_DOCS lines: these are sent, and their lines stay where they are.
    """
    key = ["h1", "h2"]
    known = shared.drop("docs")
    sent = common.sent_if_small(known, F.lit(48))
    if sent is not known:
        found = lines.join(sent, key)
    else:
        hot = F.broadcast(shared.filter(F.col("docs") > HOT_DOCS).drop("docs"))
        cold = shared.filter(F.col("docs") <= HOT_DOCS).drop("docs")
        found = lines.join(hot, key).unionByName(lines.join(hot, key, "left_anti").join(cold, key))
    return found.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_key, kept: the lines that stay, as runs (start, length); no row where all stay."""
    lines = materialize(hashed_lines(docs, min_chars), "lines")
    counted = first_lines(lines).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
    shared = materialize(counted.filter(F.col("docs") >= min_docs), "shared-lines")
    places = lines_to_drop(lines, shared).groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set("pos")).alias("places"), F.first("n_lines").alias("n_lines")
    )
    return places.select("doc_id", "text_key", kept_runs(runs_of_places(F.col("places")), F.col("n_lines")).alias("kept"))


def kept_text(text: Column, kept: Column) -> Column:
    places = F.flatten(F.transform(kept, lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    return common.let(lines_of(text), lambda lines: F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, report: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; with ``report``, also n_lines and n_dropped."""
    bitmaps = materialize(keep_bitmaps(docs, min_chars, min_docs), "keep-bitmaps")
    names = [common.fresh_name(docs.columns, n) for n in ("keep_doc", "keep_key", "kept")]
    bitmaps = common.sent_if_small(bitmaps, 48 + 16 * F.size("kept")).toDF(*names)
    same = docs["doc_id"].eqNullSafe(bitmaps[names[0]]) & (text_key(docs["text"]) == bitmaps[names[1]])
    joined = docs.join(bitmaps, same, "left")
    text, runs = docs["text"], F.col(names[2])
    kept = F.when(runs.isNull(), text).otherwise(kept_text(text, runs)).alias("text")
    columns = [kept if c == "text" else docs[c] for c in docs.columns]
    if not report:
        return joined.select(columns)
    n_lines = line_count(text)
    n_kept = F.aggregate(runs, F.lit(0), lambda n, r: n + r["length"])
    return joined.select(
        *columns, n_lines.cast("long").alias("n_lines"), F.coalesce(n_lines - n_kept, F.lit(0)).cast("long").alias("n_dropped")
    )


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    kept = dedup_lines(docs, report=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(common.text_bytes(F.col("text")), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             '{common.UPPER}', '{common.LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.*, s.key IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
