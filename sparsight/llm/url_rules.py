"""URL filtering: host and path rules met by hashed expressions.

A URL is taken apart into expressions: every suffix of its host at a label boundary, next to every
prefix of its path that a rule can end at.  Rules and expressions meet by an equi-join on the first
four bytes of their SHA-256; a match counts once the full digests agree.  Of the rules that fit, the
longest decides.  Different (host, path) pairs are expanded once, however many pages have them; only as
many labels, path segments and tails are expanded as the rules have, so a very long URL costs no more
than the rules can use.

A rule (host, path, verdict) fits its host and all subdomains, if the URL's path starts with the rule's.
A rule's path may end anywhere: what follows its last ``/`` is its tail, and URLs are cut at the tail
lengths that occur.

Defined results: a null URL, or one without ``://``, has an empty host and path; without a fitting rule the
rule is null and the verdict the default.  Rules with a null host or verdict count for nothing, a null path
fits every path; rule hosts are lower-cased (A-Z).  Rules of one length: the one with the longer host, then
the verdict that sorts last (block before allow).  Repeated pages and repeated rules change nothing; an
empty page table gives no rows, an empty rule table the default everywhere.  Columns of the pages that are
named like results must be renamed or left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsight.llm import common
from sparsight.operators.skew import split_join
from sparsight.storage import materialize

ALLOW, BLOCK = "allow", "block"
#: Hexadecimal digits of the hash prefix that is joined on: four bytes.
PREFIX_DIGITS = 8
RESULTS = ["host", "path", "rule", "verdict"]

#: The rules of the registered query: verdict, host, path.
RULES = [
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
]


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return common.lower_ascii(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def count_of(text: Column, mark: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))


def host_suffixes(host: Column, most_labels: int) -> Column:
    """The host's last 1, 2, … labels, as far as rules have labels."""
    labels = F.least(count_of(host, ".") + 1, F.lit(most_labels))
    return F.transform(F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", host, F.lit("."), -k))


def path_prefixes(path: Column, most_slashes: int, tails: Sequence[int]) -> Column:
    """The path up to each of its slashes, with as much of the next segment as a rule's tail is long."""
    slashes = F.least(count_of(path, "/"), F.lit(most_slashes))
    folders = F.transform(
        F.sequence(F.lit(0), slashes),
        lambda k: F.when(k > 0, F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))).otherwise(F.lit("")),
    )
    lengths = F.array(*[F.lit(t) for t in tails])

    def cuts(folder: Column) -> Column:
        start = F.char_length(folder)
        segment = F.call_function("substring_index", path.substr(start + 1, F.char_length(path)), F.lit("/"), F.lit(1))
        fitting = F.filter(lengths, lambda t: t <= F.char_length(segment))
        return F.transform(fitting, lambda t: path.substr(F.lit(1), start + t))

    return F.flatten(F.transform(folders, cuts))


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; neither a URL's host nor its path has a question mark."""
    return F.sha2(F.concat(host, F.lit("?"), path).cast("binary"), 256)


def prefix_of(full: Column) -> Column:
    return F.substring(full, 1, PREFIX_DIGITS)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """rule, length, host_length, verdict, labels, slashes, tail, full digest and its prefix, one row per rule."""
    host, path = common.lower_ascii(F.col("host")), F.coalesce("path", F.lit(""))
    usable = rules.filter(F.col("host").isNotNull() & F.col("verdict").isNotNull()).select(
        host.alias("host"), path.alias("path"), "verdict"
    )
    tail = F.substring_index("path", "/", -1)
    return usable.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.concat("host", "path").alias("rule"), (F.char_length("host") + F.char_length("path")).alias("length"),
        F.char_length("host").alias("host_length"), "verdict", (count_of(F.col("host"), ".") + 1).alias("labels"),
        count_of(F.col("path"), "/").alias("slashes"), F.char_length(tail).alias("tail"),
        digest(F.col("host"), F.col("path")).alias("full"),
    ).withColumn("prefix", prefix_of(F.col("full")))


def matches(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the different ``places`` (host, path) that a rule fits."""
    hashed = materialize(hashed_rules(rules), "url-rules")
    # The number of different tail lengths is bounded by the longest path of a rule.
    shape = hashed.agg(F.max("labels"), F.max("slashes"), F.sort_array(F.collect_set("tail"))).first()
    if shape[0] is None:
        return places.limit(0).select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    hosts = places.select("host", "path", F.explode(host_suffixes(F.col("host"), shape[0])).alias("suffix"))
    expressions = hosts.select(
        "host", "path", "suffix", F.explode(path_prefixes(F.col("path"), shape[1], shape[2])).alias("start")
    ).select("host", "path", digest(F.col("suffix"), F.col("start")).alias("found"))
    expressions = expressions.withColumn("prefix", prefix_of(F.col("found")))
    known = hashed.select("prefix", "full", "rule", "length", "host_length", "verdict")
    sent = common.sent_if_small(known, 160 + F.octet_length("rule") + F.octet_length("verdict"))
    if sent is known:  # more rules than may be sent: both sides move, an expression that many URLs have is split
        met = split_join(expressions, known, ["prefix"])
    else:
        met = expressions.join(sent, "prefix")
    best = F.max(F.struct("length", "host_length", "verdict", "rule"))
    fitting = met.filter(F.col("found") == F.col("full")).groupBy("host", "path").agg(best.alias("best"))
    return fitting.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, keep: Sequence[str], url: str = "url", default: str = ALLOW) -> DataFrame:
    """The ``keep`` columns of every page, then host, path, rule and verdict of its URL."""
    clash = [c for c in keep if c.lower() in RESULTS]
    if clash:
        raise ValueError(f"columns named like results: {', '.join(clash)}")
    placed = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    known = F.coalesce(F.col(url), F.lit(""))
    places = pages.select(host_of(known).alias("host"), path_of(known).alias("path")).distinct()
    found = materialize(matches(places, rules), "url-matches")
    placed = placed.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    bytes_ = 64 + F.octet_length("host") + F.octet_length("path") + F.octet_length("rule") + F.octet_length("verdict")
    sent = common.sent_if_small(found, bytes_)
    judged = split_join(placed, found, ["host", "path"], "left") if sent is found else placed.join(sent, ["host", "path"], "left")
    return judged.select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op12_url_expressions(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(common.table(spark, sf, "pages").select("page_id", "url"), rules, ["page_id"])


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP12_SQL = f"""
WITH r(verdict, host, path) AS (VALUES {_RULES}),
u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{common.UPPER}', '{common.LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT d.host, d.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM d JOIN r ON (d.host = r.host OR ends_with(d.host, '.' || r.host)) AND starts_with(d.path, r.path)
      GROUP BY d.host, d.path)
SELECT page_id, p.host, p.path, m.rule, coalesce(m.verdict, '{ALLOW}') AS verdict FROM p LEFT JOIN m USING (host, path)
"""
