"""The registered queries as SQL over the driver's views, and the parameters both sides share."""

from __future__ import annotations

import math
import re

from sparsight.functions import permutation
from sparsight.functions.text import INSTRUCTIONS, MAX_TOKENS
from sparsight.plans.evaluate import CUTOFFS, R_MULTIPLES, RECALL_LEVELS, SUCCESS_CUTOFFS
from sparsight.plans.retrieval import config_name, feedback_grid

LATENT_SIZE, LATENT_K, SEED = 128, 8, 7
TOP_K, PAIR_K, BATCH = 10, 4, 64
RATE = 0.001
# Hits, features and delta of the single feedback setting.
FEEDBACK = (4, 2, 0.16)

MEASURE_QUERIES = {
    "counts": ("num_",),
    "average_precision": ("map", "map_cut_", "gm_map"),
    "recip_rank": ("recip_rank",),
    "cutoff_measures": ("P_", "recall_", "success_", "relative_P_"),
    "ndcg": ("ndcg", "ndcg_cut_"),
    "r_precision": ("Rprec", "Rprec_mult_"),
    "interpolated_precision": ("iprec_at_recall_", "11pt_avg"),
    "bpref": ("bpref", "gm_bpref"),
    "set_measures": ("set_",),
    "inferred_and_utility": ("infAP", "utility"),
    "evaluate": (),
}
COMPARED = ("map", "recip_rank", "P_", "ndcg")


def _num(value: float) -> str:
    """A literal that is read as DOUBLE."""
    return f"{value!r}e0"


def _r6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0::DOUBLE"


def _r9(expression: str) -> str:
    return f"round({expression}, 9) + 0.0::DOUBLE"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- vectors and weights ---------------------------------------------------

def _uniform(label: str, bound: str) -> str:
    return f"(('0x' || substr(md5({label}), 1, 6))::BIGINT / 16777216.0e0 - 0.5e0) * (2.0e0 * {bound})"


def _vector(name: str, bound: str, row: str) -> str:
    label = f"'{SEED}:{name}:' || {row} || ':' || d"
    return f"list_transform(range(width), lambda d: {_uniform(label, bound)})"


def _weights(features: str, size: str) -> list[str]:
    label = f"'{SEED}:b_enc:' || f"
    return [
        f"""shape AS MATERIALIZED (SELECT width, pow(width, -0.5e0) AS enc, pow({size}, -0.5e0) AS dec
            FROM (SELECT max(len(embedding)) AS width FROM embeddings))""",
        f"""w AS MATERIALIZED (SELECT f::INT AS feature, {_vector('w_enc', 'enc', 'f')} AS w_enc,
            {_uniform(label, 'enc')} AS b_enc, {_vector('w_dec', 'dec', 'f')} AS w_dec FROM ({features}), shape)""",
        f"bd AS MATERIALIZED (SELECT {_vector('b_dec', 'dec', '0')} AS b_dec FROM shape)",
    ]


MODEL = _weights(f"SELECT unnest(range({LATENT_SIZE})) AS f", str(LATENT_SIZE))
PART_MODEL = _weights("SELECT p_partkey AS f FROM part", "(SELECT count(*) FROM part)")
VECTORS = "v AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"
DIMS = "dims AS MATERIALIZED (SELECT unnest(range(width))::INT AS dim FROM shape)"


def _centred(source: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT id, list_transform(list_zip(x, b_dec), lambda z: z[1] - z[2]) AS x
        FROM {source}, bd)"""


def _codes(source: str, name: str, k: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT id, feature, a AS weight FROM (
        SELECT id, feature, a, row_number() OVER (PARTITION BY id ORDER BY a DESC, feature) AS place
        FROM (SELECT id, feature, list_dot_product(x, w_enc) + b_enc AS a FROM {source}, w))
        WHERE place <= {k} AND a > 0)"""


def _decoded(ids: str, codes: str, name: str, keys: str = "id") -> str:
    on = " AND ".join(f"i.{k} = s.{k}" for k in keys.split(", "))
    kept = ", ".join(f"i.{k}" for k in keys.split(", "))
    return f"""{name}_sums AS MATERIALIZED (SELECT {keys}, dim, sum(weight * w_dec[dim + 1] ORDER BY feature) AS s
        FROM {codes} JOIN w USING (feature), dims GROUP BY {keys}, dim),
    {name} AS MATERIALIZED (SELECT {keys}, list(value ORDER BY dim) AS x FROM (
        SELECT {kept}, dims.dim, coalesce(s.s, 0.0e0) + b_dec[dims.dim + 1] AS value
        FROM (SELECT DISTINCT {keys} FROM {ids}) i CROSS JOIN dims CROSS JOIN bd
        LEFT JOIN {name}_sums s ON {on} AND s.dim = dims.dim) GROUP BY {keys})"""


def _search(queries: str, passages: str, name: str, k: int, keys: str = "id") -> str:
    """Hits of ``queries`` (keys, x); the key ``id`` becomes ``qid``."""
    kept = ", ".join("q.id AS qid" if key == "id" else f"q.{key}" for key in keys.split(", "))
    group = ", ".join("qid" if key == "id" else key for key in keys.split(", "))
    return f"""{name} AS MATERIALIZED (SELECT {group}, pid, score, rank::INT AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, pid) AS rank
        FROM (SELECT {kept}, p.id AS pid, list_dot_product(q.x, p.x) AS score FROM {queries} q, {passages} p))
        WHERE rank <= {k})"""


def _sparse(queries: str, index: str, name: str, k: int) -> str:
    return f"""{name} AS MATERIALIZED (SELECT qid, pid, score, rank::INT AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM (
            SELECT q.id AS qid, d.id AS pid, sum(q.weight * d.weight ORDER BY feature) AS score
            FROM {queries} q JOIN {index} d USING (feature) GROUP BY q.id, d.id)) WHERE rank <= {k})"""


def _rows(source: str, keys: str = "id") -> str:
    return f"""SELECT {keys}, (unnest(range(len(x))))::INT AS dim, {_r6('unnest(x)')} AS value FROM {source}"""


def _stored(source: str, name: str, keys: str = "id") -> str:
    """Vectors as they are at rest, in float32."""
    return f"{name} AS MATERIALIZED (SELECT {keys}, x::FLOAT[]::DOUBLE[] AS x FROM {source})"


HITS = f"SELECT qid, pid, {_r6('score')} AS score, rank FROM "
RECONSTRUCTED = [
    *MODEL, VECTORS, DIMS, _centred("v", "c"), _codes("c", "codes", LATENT_K), _decoded("v", "codes", "hat"),
]
# The codes of the reconstruction, from which expansion starts.
SEARCHED = [*RECONSTRUCTED, _stored("hat", "kept")]
SECOND_PASS = [*SEARCHED, _centred("kept", "c2"), _codes("c2", "codes2", LATENT_K)]
NEAREST = [VECTORS, _search("v", "v", "near", TOP_K)]


def _feedback(hits: int, features: int) -> list[str]:
    return [
        *SECOND_PASS,
        _search("kept", "kept", "first", hits),
        f"""best AS MATERIALIZED (SELECT * FROM (SELECT id AS pid, feature, weight,
            row_number() OVER (PARTITION BY id ORDER BY weight DESC, feature)::INT AS place FROM codes)
            WHERE place <= {features})""",
        "found AS MATERIALIZED (SELECT qid, pid, rank, feature, place, weight FROM first JOIN best USING (pid))",
    ]


EXPANDED = [
    *_feedback(FEEDBACK[0], FEEDBACK[1]),
    f"""expanded AS MATERIALIZED (SELECT id, feature, coalesce(weight, 0.0e0) + CASE WHEN u.qid IS NULL
        THEN 0.0e0 ELSE {_num(FEEDBACK[2])} END AS weight
        FROM (SELECT coalesce(c.id, u.qid) AS id, coalesce(c.feature, u.feature) AS feature, c.weight, u.qid
              FROM codes2 c FULL JOIN (SELECT DISTINCT qid, feature FROM found) u
              ON c.id = u.qid AND c.feature = u.feature) u)""",
]


def _grid_values() -> str:
    return ", ".join(f"('{config_name(*g)}', {g[0]}, {g[1]}, {_num(g[2])})" for g in feedback_grid())


SWEEP = [
    *_feedback(max(g[0] for g in feedback_grid()), max(g[1] for g in feedback_grid())),
    f"grid(config, hits, features, delta) AS (VALUES {_grid_values()})",
    """picked AS MATERIALIZED (SELECT DISTINCT config, qid AS id, feature, delta FROM found
        JOIN grid ON rank <= hits AND place <= features)""",
    """swept AS MATERIALIZED (SELECT config, id, feature, sum(weight) AS weight FROM (
        SELECT config, id, feature, weight FROM codes2, grid
        UNION ALL SELECT config, id, feature, delta FROM picked) GROUP BY ALL)""",
    "ids AS (SELECT config, id FROM v, grid)",
    _decoded("ids", "swept", "decoded", "config, id"),
    _stored("decoded", "asked", "config, id"),
    _search("asked", "kept", "final", TOP_K, "config, id"),
]


# --- pairs and losses ------------------------------------------------------

PAIRS = [
    *RECONSTRUCTED,
    _search("v", "v", "near", PAIR_K),
    f"""pairs AS MATERIALIZED (SELECT n.qid, n.rank, n.pid, n.qid // {BATCH} AS batch_id, q.x AS q, p.x AS p,
        qh.x AS q_hat, ph.x AS p_hat, len(q.x) AS dim FROM near n JOIN v q ON q.id = n.qid JOIN v p ON p.id = n.pid
        JOIN hat qh ON qh.id = n.qid JOIN hat ph ON ph.id = n.pid)""",
    """scores AS MATERIALIZED (SELECT *, exp(m) AS s, exp(m_hat) AS s_hat,
        sum(exp(m)) OVER (PARTITION BY qid) AS z, sum(exp(m_hat)) OVER (PARTITION BY qid) AS z_hat
        FROM (SELECT *, list_dot_product(q, p) / sqrt(dim) AS m, list_dot_product(q_hat, p_hat) / sqrt(dim) AS m_hat
              FROM pairs))""",
    """shares AS MATERIALIZED (SELECT *, s / (s + z) AS t, s_hat / (s_hat + z_hat) AS u FROM scores)""",
    """losses AS MATERIALIZED (SELECT k.batch_id, k.kld, q.mse + p.mse AS mse FROM
        (SELECT batch_id, sum(t * (ln(t) - ln(u))) AS kld FROM shares GROUP BY batch_id) k JOIN
        (SELECT batch_id, sum(list_distance(q_hat, q) ** 2) / sum(dim) AS mse FROM pairs WHERE rank = 1
         GROUP BY batch_id) q USING (batch_id) JOIN
        (SELECT batch_id, sum(list_distance(p_hat, p) ** 2) / sum(dim) AS mse FROM pairs GROUP BY batch_id) p
        USING (batch_id))""",
]

# Output gradients of one batch over all queries, then the rows of the active features.
GRADIENTS = [
    *PAIRS,
    """pull AS MATERIALIZED (SELECT *, (s_hat * sum(t / (s_hat + z_hat)) OVER (PARTITION BY qid)
        - t * (1.0e0 - u)) / sqrt(dim) AS g FROM shares)""",
    "sizes AS (SELECT count(DISTINCT qid) AS n_queries, count(*) AS n_passages FROM pairs)",
    """outputs AS MATERIALIZED (
        SELECT qid AS id, list(value ORDER BY d) AS gx FROM (
            SELECT qid, d, any_value(2.0e0 * (q_hat[d + 1] - q[d + 1])) / any_value(n_queries * dim)
                + sum(g * p_hat[d + 1]) AS value
            FROM pull, sizes, (SELECT dim AS d FROM dims) GROUP BY qid, d) GROUP BY qid
        UNION ALL
        SELECT pid, list_transform(range(dim), lambda d: 2.0e0 * (p_hat[d + 1] - p[d + 1]) / (n_passages * dim)
            + g * q_hat[d + 1]) FROM pull, sizes)""",
    """active AS MATERIALIZED (SELECT feature, weight, gx, x, list_dot_product(gx, w_dec) AS delta, w_enc
        FROM outputs JOIN codes USING (id) JOIN c USING (id) JOIN w USING (feature))""",
    """grads AS MATERIALIZED (
        SELECT feature, sum(delta) OVER (PARTITION BY feature, dim) AS d_bias, dim, d_dec, d_enc FROM (
            SELECT feature, dim, sum(weight * gx[dim + 1]) AS d_dec, sum(delta * x[dim + 1]) AS d_enc, sum(delta) AS delta
            FROM active, dims GROUP BY feature, dim)
        UNION ALL
        SELECT -1, 0.0e0, dim, o.s - coalesce(a.s, 0.0e0), 0.0e0 FROM
            (SELECT dim, sum(gx[dim + 1]) AS s FROM outputs, dims GROUP BY dim) o LEFT JOIN
            (SELECT dim, sum(delta * w_enc[dim + 1]) AS s FROM active, dims GROUP BY dim) a USING (dim))""",
]



def _first_step(value: str, gradient: str) -> str:
    """Adam's first step from zero moments, unsimplified."""
    mean = f"0.1e0 * coalesce({gradient}, 0) / (1 - 0.9e0)"
    square = f"0.001e0 * coalesce({gradient}, 0) * coalesce({gradient}, 0) / (1 - 0.999e0)"
    return f"{value} - {_num(RATE)} * ({mean}) / (sqrt({square}) + 1.0e-8)"


ADAM = [
    *GRADIENTS,
    """rows AS (SELECT feature, b_enc, w_dec, w_enc FROM w UNION ALL
        SELECT -1, 0.0e0, b_dec, list_transform(b_dec, lambda b: 0.0e0) FROM bd)""",
]

# The tables of one pass over all pairs as one batch, and those that every pass shares.
PASS_TABLES = (
    "w bd c codes hat_sums hat pairs scores shares losses pull sizes outputs active grads".split()
)
PASS_SHARED = [VECTORS, DIMS, _search("v", "v", "near", PAIR_K)]


def _pass(number: int) -> list[str]:
    """Losses and gradients at the weights of pass ``number``, its tables named after it."""
    parts = [
        p.replace(f"n.qid // {BATCH} AS batch_id", "0 AS batch_id")
        for p in GRADIENTS if p not in MODEL and p not in PASS_SHARED
    ]
    return [re.sub(rf"\b({'|'.join(PASS_TABLES)})\b", rf"\1_{number}", p) for p in parts]


def _stepped(number: int, start: float) -> list[str]:
    """Weights and moments after the Adam step that pass ``number`` leads to, counted from 0."""
    t = number + 1
    kinds = {"dec": ("w_dec[d.dim + 1]", "d_dec"), "enc": ("w_enc[d.dim + 1]", "d_enc"), "bias": ("b_enc", "d_bias")}
    moments, moved = [], []
    for kind, (value, gradient) in kinds.items():
        mean, square = (f"h.{m}_{kind}" if number else "0.0e0" for m in "mv")
        moments += [f"{value} AS old_{kind}",
                    f"0.9e0 * {mean} + (1.0e0 - 0.9e0) * coalesce({gradient}, 0) AS m_{kind}",
                    f"0.999e0 * {square} + (1.0e0 - 0.999e0) * coalesce({gradient}, 0) * coalesce({gradient}, 0) AS v_{kind}"]
        moved.append(f"old_{kind} - {_num(start)} * (m_{kind} / {_num(1 - 0.9**t)})"
                     f" / (sqrt(v_{kind} / {_num(1 - 0.999**t)}) + 1.0e-8) AS new_{kind}")
    before = f"LEFT JOIN step_{number - 1} h ON h.feature = r.feature AND h.dim = d.dim" if number else ""
    return [
        f"""rows_{number} AS MATERIALIZED (SELECT feature, b_enc, w_dec, w_enc FROM w_{number} UNION ALL
            SELECT -1, 0.0e0, b_dec, list_transform(b_dec, lambda b: 0.0e0) FROM bd_{number})""",
        f"""step_{number} AS MATERIALIZED (SELECT feature, dim, {', '.join(f'm_{k}, v_{k}' for k in kinds)}, {', '.join(moved)}
            FROM (SELECT r.feature, d.dim, {', '.join(moments)}
                FROM rows_{number} r CROSS JOIN dims d LEFT JOIN grads_{number} g ON g.feature = r.feature AND g.dim = d.dim
                {before}))""",
        f"""w_{number + 1} AS MATERIALIZED (SELECT feature, list(new_enc ORDER BY dim) AS w_enc, min(new_bias) AS b_enc,
            list(new_dec ORDER BY dim) AS w_dec FROM step_{number} WHERE feature >= 0 GROUP BY feature)""",
        f"bd_{number + 1} AS MATERIALIZED (SELECT list(new_dec ORDER BY dim) AS b_dec FROM step_{number} WHERE feature = -1)",
    ]


def _fit() -> str:
    """Two epochs of one batch each: the history."""
    first = [re.sub(r"\b(w|bd)\b", r"\1_0", p) for p in MODEL]
    last = [p for p in _pass(2) if not p.startswith(("pull_", "sizes ", "sizes_", "outputs_", "active_", "grads_"))]
    rates = [RATE * (1 + math.cos(math.pi * e / 2)) / 2 for e in range(3)]
    rows = [
        f"SELECT {epoch} AS epoch, '{name}' AS name, {value} AS value{source}"
        for epoch in range(2)
        for name, value, source in (
            ("tMSE", "mse", f" FROM losses_{epoch}"), ("tKLD", "kld", f" FROM losses_{epoch}"),
            ("vMSE", "mse", f" FROM losses_{epoch + 1}"), ("vKLD", "kld", f" FROM losses_{epoch + 1}"),
            ("lr", _num(rates[epoch + 1]), ""),
        )
    ]
    parts = [*first, *PASS_SHARED, *_pass(0), *_stepped(0, rates[0]), *_pass(1), *_stepped(1, rates[1]), *last]
    return _with(*parts) + f"SELECT epoch, name, {_r6('value')} AS value FROM ({' UNION ALL '.join(rows)})"


# --- postings and rankings -------------------------------------------------

ORDER_POSTINGS = "SELECT l_orderkey AS pid, l_partkey AS feature, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL"
CUSTOMER_POSTINGS = """SELECT o_custkey AS qid, l_partkey AS feature, sum(l_quantity) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""
PURCHASES = [
    f"asked AS MATERIALIZED (SELECT qid AS id, feature, weight FROM ({CUSTOMER_POSTINGS}))",
    f"idx AS MATERIALIZED (SELECT pid AS id, feature, weight FROM ({ORDER_POSTINGS}))",
    _sparse("asked", "idx", "hits", TOP_K),
]
URGENT = f"""SELECT pid, feature, weight * 2 AS weight FROM ({ORDER_POSTINGS})
    WHERE pid IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""

UPDATED = [
    f"asked AS MATERIALIZED (SELECT qid AS id, feature, weight FROM ({CUSTOMER_POSTINGS}))",
    f"""idx AS MATERIALIZED (SELECT pid AS id, feature, weight FROM ({ORDER_POSTINGS})
        WHERE pid NOT IN (SELECT pid FROM ({URGENT})) UNION ALL SELECT * FROM ({URGENT}))""",
    _sparse("asked", "idx", "hits", TOP_K),
]

LINES = {
    "customer": "(SELECT *, o_custkey AS qid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "nation": """(SELECT *, c_nationkey AS qid FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey)""",
}


def _run(by: str) -> str:
    return f"""run AS MATERIALIZED (SELECT config, qid, pid, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY config, qid ORDER BY score DESC, pid) AS rank FROM (
        SELECT 'spend' AS config, qid, l_partkey AS pid, round(sum(l_extendedprice), 2) AS score
        FROM {LINES[by]} GROUP BY ALL
        UNION ALL
        SELECT 'quantity', qid, l_partkey, sum(l_quantity) FROM {LINES[by]} GROUP BY ALL)))"""


def _qrels(by: str) -> str:
    return f"""qrels AS MATERIALIZED (SELECT qid, pid, max(rel)::INT AS rel FROM (
    SELECT qid, l_partkey AS pid, CASE WHEN l_returnflag = 'A' AND l_quantity >= 25 THEN 2
        WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 0
        WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN -1 END AS rel
    FROM {LINES[by]}) WHERE rel IS NOT NULL GROUP BY qid, pid)"""


RUN, QRELS = _run("customer"), _qrels("customer")
DEEP = [_run("nation"), _qrels("nation")]


def _measures() -> list[str]:
    """All measures of (config, qid) from ``run`` and ``qrels``, straight from their definitions."""
    safe = lambda top, bottom: f"CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) ELSE 0.0e0 END"
    share = lambda x: f"floor({_num(x)} * num_rel + 0.9e0)"
    columns = {
        "num_ret": "num_ret", "num_rel": "num_rel", "num_rel_ret": "rr", "num_nonrel_judged_ret": "nonrel_ret",
        "map": safe("ap", "num_rel"), "recip_rank": "coalesce(1.0e0 / first_rel, 0.0e0)",
        "ndcg": safe("dcg", "ideal"), "Rprec": safe("rel_1_0x", "num_rel"),
        "bpref": safe("bp", "num_rel"), "infAP": safe("inf", "num_rel"), "utility": "rr - (num_ret - rr)",
        "set_P": safe("rr * 1.0e0", "num_ret"), "set_recall": safe("rr * 1.0e0", "num_rel"),
        "set_F": "CASE WHEN rr > 0 THEN 2.0e0 * rr / (num_ret + num_rel) ELSE 0.0e0 END",
        "set_map": f"({safe('rr * 1.0e0', 'num_ret')}) * ({safe('rr * 1.0e0', 'num_rel')})",
        "set_relative_P": safe("rr * 1.0e0", "least(num_ret, num_rel)"),
    }
    sums = []
    for k in CUTOFFS:
        sums.append(f"coalesce(sum(prec) FILTER (r >= 1 AND rank <= {k}), 0) AS ap_{k}")
        sums.append(f"coalesce(sum(gain) FILTER (r >= 1 AND rank <= {k}), 0) AS dcg_{k}")
        columns[f"map_cut_{k}"] = safe(f"ap_{k}", "num_rel")
        columns[f"P_{k}"] = f"rel_{k} / {k}.0e0"
        columns[f"recall_{k}"] = safe(f"rel_{k} * 1.0e0", "num_rel")
        columns[f"relative_P_{k}"] = safe(f"rel_{k} * 1.0e0", f"least({k}, num_rel)")
        columns[f"ndcg_cut_{k}"] = safe(f"dcg_{k}", f"ideal_{k}")
    for k in sorted({*CUTOFFS, *SUCCESS_CUTOFFS}):
        sums.append(f"count(*) FILTER (r >= 1 AND rank <= {k}) AS rel_{k}")
    for k in SUCCESS_CUTOFFS:
        columns[f"success_{k}"] = f"CASE WHEN rel_{k} > 0 THEN 1.0e0 ELSE 0.0e0 END"
    for x in R_MULTIPLES:
        name = f"rel_{x}x".replace(".", "_")
        sums.append(f"count(*) FILTER (r >= 1 AND rank <= {share(x)}) * 1.0e0 AS {name}")
        columns[f"Rprec_mult_{x:.2f}"] = safe(name, share(x))
    for x in RECALL_LEVELS:
        name = f"ip_{x}".replace(".", "_")
        sums.append(f"coalesce(max(prec) FILTER (r >= 1 AND so_far >= {share(x)}), 0) AS {name}")
        columns[f"iprec_at_recall_{x:.2f}"] = name
    levels = " + ".join(f"ip_{x}".replace(".", "_") for x in RECALL_LEVELS)
    columns["11pt_avg"] = f"({levels}) / 11.0e0"
    ideals = ", ".join(f"coalesce(sum(rel / log2(i + 1)) FILTER (i <= {k}), 0) AS ideal_{k}" for k in CUTOFFS)
    values = ", ".join(f"('{n}', ({e})::DOUBLE)" for n, e in columns.items())
    return [
        """judged AS (SELECT qid, count(*) FILTER (rel >= 1) AS num_rel, count(*) FILTER (rel = 0) AS num_nonrel
            FROM qrels GROUP BY qid)""",
        f"""ideal AS (SELECT qid, sum(rel / log2(i + 1)) AS ideal, {ideals} FROM (SELECT qid, rel,
            row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i FROM qrels WHERE rel >= 1) GROUP BY qid)""",
        """marked AS (SELECT run.*, q.rel AS r, num_rel, num_nonrel,
            sum(CASE WHEN q.rel >= 1 THEN 1 ELSE 0 END) OVER h AS so_far,
            sum(CASE WHEN q.rel = 0 THEN 1 ELSE 0 END) OVER h AS nonrel,
            sum(CASE WHEN q.rel < 0 THEN 1 ELSE 0 END) OVER h AS unjudged
            FROM run JOIN judged USING (qid) LEFT JOIN qrels q USING (qid, pid)
            WINDOW h AS (PARTITION BY config, run.qid ORDER BY rank ROWS UNBOUNDED PRECEDING))""",
        """terms AS (SELECT *, so_far * 1.0e0 / rank AS prec, r / log2(rank + 1) AS gain,
            CASE WHEN nonrel > 0 THEN 1 - least(nonrel, num_rel) * 1.0e0 / least(num_nonrel, num_rel) ELSE 1 END AS pref,
            CASE WHEN rank = 1 THEN 1 ELSE 1.0e0 / rank + ((rank - 1) * 1.0e0 / rank)
                * ((so_far - 1 + nonrel + unjudged) * 1.0e0 / (rank - 1))
                * ((so_far - 1 + 1.0e-5) / (so_far - 1 + nonrel + 2.0e-5)) END AS infer FROM marked)""",
        f"""sums AS (SELECT config, qid, any_value(num_rel) AS num_rel, count(*) AS num_ret,
            count(*) FILTER (r >= 1) AS rr, count(*) FILTER (r = 0) AS nonrel_ret,
            coalesce(sum(prec) FILTER (r >= 1), 0) AS ap, min(rank) FILTER (r >= 1) AS first_rel,
            coalesce(sum(gain) FILTER (r >= 1), 0) AS dcg, coalesce(sum(pref) FILTER (r >= 1), 0) AS bp,
            coalesce(sum(infer) FILTER (r >= 1), 0) AS inf, {', '.join(sums)} FROM terms GROUP BY config, qid)""",
        f"""per_query AS MATERIALIZED (SELECT config, qid, m.measure, m.value FROM (SELECT config, qid,
            unnest([{', '.join(f"{{'measure': '{n}', 'value': ({e})::DOUBLE}}" for n, e in columns.items())}]) AS m
            FROM sums LEFT JOIN ideal USING (qid)))""",
        """metrics AS MATERIALIZED (
            SELECT config, measure, CASE WHEN measure LIKE 'num\\_%' ESCAPE '\\' THEN sum(coalesce(value, 0))
                ELSE avg(coalesce(value, 0)) END AS value FROM per_query GROUP BY config, measure
            UNION ALL SELECT config, 'num_q', count(DISTINCT qid) FROM per_query GROUP BY config
            UNION ALL SELECT config, 'gm_' || measure, exp(avg(ln(greatest(coalesce(value, 0), 1.0e-5))))
                FROM per_query WHERE measure IN ('map', 'bpref') GROUP BY config, measure)""",
    ]


def _chosen(families: tuple[str, ...]) -> str:
    if not families:
        return "true"
    return " OR ".join(f"starts_with(measure, '{f}')" if f.endswith("_") else f"measure = '{f}'" for f in families)


JUDGED = [RUN, QRELS, *_measures()]


def _report(families: tuple[str, ...]) -> str:
    return _with(*JUDGED) + f"SELECT config, measure, {_r9('value')} AS value FROM metrics WHERE {_chosen(families)}"


def _evaluated(config: str, hits: str, parts: list[str]) -> str:
    near = [p for p in NEAREST if p not in parts]
    return _with(
        *parts, *near,
        f"run AS MATERIALIZED (SELECT '{config}' AS config, qid, pid, rank FROM {hits})",
        f"qrels AS MATERIALIZED (SELECT qid, pid, {TOP_K + 1} - rank AS rel FROM near)",
        *_measures(),
    ) + f"SELECT config, measure, {_r9('value')} AS value FROM metrics"


LATENT = [*MODEL, VECTORS, _codes("v", "idx", LATENT_K), _sparse("idx", "idx", "hits", 100)]
FEEDBACK_SEARCH = [*EXPANDED, _decoded("v", "expanded", "decoded"), _stored("decoded", "asked"),
    _search("asked", "kept", "hits", TOP_K)]
INDEXED_DOCUMENTS = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id::VARCHAR AS pid, text AS passage FROM documents"
INDEXED_VECTORS = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_idx, vec_id::VARCHAR AS pid, embedding::DOUBLE[] AS x FROM embeddings"
INDEXED_ORDERS = "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders"
TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def _hashed_words(source: str, key: str, text: str) -> str:
    return _with(
        f"t AS (SELECT {key}, unnest({TOKENS}) AS token FROM (SELECT {key}, {text} AS text FROM {source}))",
        f"""counts AS (SELECT {key}, ('0x' || substr(md5(token), 1, 6))::BIGINT % 64 AS dim, count(*) AS n
            FROM t GROUP BY ALL)""",
        f"norms AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM counts GROUP BY {key})",
    ) + f"""SELECT d.{key}, r.dim::INT AS dim, {_r6('coalesce(((c.n / norm)::FLOAT)::DOUBLE, 0)')} AS value
        FROM {source} d CROSS JOIN (SELECT unnest(range(64)) AS dim) r
        LEFT JOIN counts c ON c.{key} = d.{key} AND c.dim = r.dim LEFT JOIN norms m ON m.{key} = d.{key}"""


def _shuffled_batches(source: str, size: int) -> str:
    """Batches of (o_orderkey, row_idx) after the keyed permutation of row_idx, walked round by round."""
    added = _mixed_sql("y", f"{permutation.round_keys(SEED)}[i % {permutation.ROUNDS} + 1]")
    return f"""WITH RECURSIVE o AS MATERIALIZED ({source}),
        c AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS root FROM o),
        g AS (SELECT n, min(a) AS a FROM c, generate_series(root, root + 100000) AS s(a)
              WHERE a * ((n + a - 1) // a) - n <= {permutation.SPARE} GROUP BY n),
        k AS (SELECT n, a, (n + a - 1) // a AS b FROM g),
        w AS (SELECT row_idx, row_idx // b AS x, row_idx % b AS y, a AS mx, b AS my, 0 AS i FROM o, k
              UNION ALL SELECT row_idx, y, (x + {added}) % mx, my, mx, i + 1 FROM w, k
              WHERE i = 0 OR i % {permutation.ROUNDS} <> 0 OR x * b + y >= n)
        SELECT o_orderkey, (x * b + y) // {size} AS batch_id FROM w JOIN o USING (row_idx), k
        WHERE i > 0 AND i % {permutation.ROUNDS} = 0 AND x * b + y < n"""


def _mixed_sql(value: str, key: str) -> str:
    x = f"(({value} * {permutation.FIRST} + {key}) % {permutation.RANGE})"
    x = f"xor({x}, {x} >> {permutation.SHIFTS[0]})"
    x = f"(({x} * {permutation.SECOND} + {key}) % {permutation.RANGE})"
    return f"xor({x}, {x} >> {permutation.SHIFTS[1]})"


def statements() -> dict[str, str]:
    hit_rows = HITS + "hits"
    judged_rows = """SELECT config, run.qid, run.pid, rank, rel,
        sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY config, run.qid ORDER BY rank
            ROWS UNBOUNDED PRECEDING)::BIGINT AS rel_so_far
        FROM run LEFT JOIN qrels USING (qid, pid) WHERE run.qid IN (SELECT qid FROM qrels)"""
    split_rows = """SELECT 'train' AS split, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx,
            conv_id || '-' || turn AS qid, text AS query FROM conversations
        UNION ALL SELECT 'dev', row_number() OVER (ORDER BY item_id) - 1, item_id::VARCHAR, text FROM benchmark
        UNION ALL SELECT 'eval', row_number() OVER (ORDER BY c_custkey) - 1, c_custkey::VARCHAR, c_name FROM customer"""
    near_rows = _with(*NEAREST) + f"SELECT 'dev' AS split, qid, rank, pid, {_r6('score')} AS score FROM near"
    gradient_rows = f"""SELECT feature, {_r6('d_bias')} AS d_bias, dim, {_r6('d_dec')} AS d_dec,
        {_r6('d_enc')} AS d_enc FROM grads"""
    prefix = " ".join(
        f"WHEN '{name}' THEN '{text}'" for name, text in INSTRUCTIONS.items()
    )
    sql = {
        # scans and sinks
        "scan_passages_tsv": """SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx,
            p_partkey::VARCHAR AS pid, p_name AS passage FROM part""",
        "scan_queries_tsv": """SELECT 'train' AS split, row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx,
                c_custkey::VARCHAR AS qid, c_name AS query FROM customer
            UNION ALL SELECT 'dev', row_number() OVER (ORDER BY s_suppkey) - 1, s_suppkey::VARCHAR, s_name FROM supplier
            UNION ALL SELECT 'eval', row_number() OVER (ORDER BY n_nationkey) - 1, n_nationkey::VARCHAR, n_name FROM nation""",
        "scan_qrels": """SELECT 'train' AS split, l_suppkey::VARCHAR AS qid, l_partkey::VARCHAR AS pid,
            arg_max(l_linenumber, line) AS rel
            FROM (SELECT *, row_number() OVER () AS line FROM lineitem) GROUP BY l_suppkey, l_partkey""",
        "scan_passages": INDEXED_DOCUMENTS,
        "passage_count": "SELECT count(*) AS passages FROM documents",
        "write_passages": f"""SELECT row_idx, pid, (row_idx % 4)::INT AS shard, length(passage)::INT AS n_chars
            FROM ({INDEXED_DOCUMENTS})""",
        "scan_queries": f"SELECT * FROM ({split_rows}) WHERE split = 'dev'",
        "write_queries": f"SELECT split, row_idx, qid, query FROM ({split_rows})",
        "scan_vectors": _rows(f"({INDEXED_VECTORS})", "row_idx, pid"),
        "scan_query_vectors": f"SELECT 'dev' AS split, pid AS qid, * EXCLUDE (pid) FROM ({_rows(f'({INDEXED_VECTORS})', 'row_idx, pid')})",
        "write_vectors": f"""SELECT row_idx, pid, (row_idx % 3)::INT AS shard, len(x)::INT AS width FROM ({INDEXED_VECTORS})""",
        "import_vector_shards": _rows(f"({INDEXED_VECTORS})", "row_idx"),
        "export_vector_shards": """SELECT lpad((vec_row % 3)::VARCHAR, 8, '0') || '.npy' AS file, count(*) AS rows
            FROM (SELECT row_number() OVER () - 1 AS vec_row FROM embeddings) GROUP BY ALL""",
        "scan_relevance": _with(QRELS) + "SELECT 'dev' AS split, qid, pid, rel FROM qrels",
        "scan_neighbors": near_rows,
        "write_qrels": _with(QRELS) + "SELECT 'train' AS split, qid, pid, rel FROM qrels",
        "write_neighbors": near_rows,
        "write_fit_history": _with(*PAIRS) + f"""SELECT 0 AS epoch, 'mse' AS name, {_r6('avg(mse)')} AS value FROM losses
            UNION ALL SELECT 0, 'kld', {_r6('avg(kld)')} FROM losses""",
        "write_model": _with(*PART_MODEL, DIMS) + f"""SELECT feature, {_r6('b_enc')} AS b_enc, dim,
            {_r6('w_enc[dim + 1]')} AS w_enc, {_r6('w_dec[dim + 1]')} AS w_dec, true AS zero_moments,
            0::INT AS epoch, 0::INT AS step, {_r6('0.001e0')} AS rate
            FROM (SELECT feature, b_enc, w_enc, w_dec FROM w UNION ALL
                SELECT -1, 0.0e0, list_transform(b_dec, lambda b: 0.0e0), b_dec FROM bd), dims""",
        "scan_model": _with(*PART_MODEL, DIMS) + f"""SELECT feature, (SELECT count(*) FROM part) AS size,
            {_r6('b_enc')} AS b_enc, dim, {_r6('w_enc[dim + 1]')} AS w_enc, {_r6('w_dec[dim + 1]')} AS w_dec,
            {_r6('b_dec[dim + 1]')} AS b_dec FROM w, dims, bd""",
        "export_run_file": _with(RUN) + """SELECT qid || ' 0 ' || pid || ' 0 ' || (1 - rank) || ' 0' AS line
            FROM run WHERE config = 'spend'""",
        "export_qrel_file": _with(QRELS) + "SELECT qid || ' 0 ' || pid || ' ' || rel AS line FROM qrels",
        "write_metrics": _report(("num_", "recip_rank")),
        # addressing
        "with_row_index": f"SELECT o_orderkey, row_idx FROM ({INDEXED_ORDERS})",
        "shard_and_offset": f"SELECT o_orderkey, (row_idx % 51)::INT AS shard, row_idx // 51 AS off FROM ({INDEXED_ORDERS})",
        "row_of": f"SELECT o_orderkey, row_idx FROM ({INDEXED_ORDERS})",
        "worker_slice": f"SELECT o_orderkey, row_idx FROM ({INDEXED_ORDERS}) WHERE row_idx % 152 % 8 = 2",
        "lookup_ids": f"""SELECT o_orderkey, c_name FROM orders JOIN
            (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer) ON o_custkey = position""",
        "zip_ids_vectors": f"""SELECT v.row_idx, d.pid, dim, value FROM ({_rows(f'({INDEXED_VECTORS})', 'row_idx')}) v
            JOIN ({INDEXED_DOCUMENTS}) d USING (row_idx)""",
        "assign_batches": f"SELECT o_orderkey, row_idx // 512 AS batch_id FROM ({INDEXED_ORDERS})",
        "assign_batches_shuffled": _shuffled_batches(INDEXED_ORDERS, 512),
        "head_batch": f"SELECT * FROM ({INDEXED_DOCUMENTS}) ORDER BY row_idx LIMIT 8",
        "positive_only": """SELECT c_custkey AS id, c_nationkey AS feature, c_acctbal AS weight FROM customer
            WHERE c_acctbal > 0""",
        "prefix_neighbors": f"SELECT * FROM ({near_rows}) WHERE rank <= 3",
        "to_feature_map": ORDER_POSTINGS,
        "parse_count": """SELECT p_partkey, p_size::BIGINT AS plain, p_size::BIGINT * 1000 AS thousands,
            p_size::BIGINT * 1000000 AS millions FROM part""",
        # text
        "apply_instruction": f"""SELECT item_id, embedding, CASE embedding {prefix} ELSE '' END || text AS input
            FROM benchmark, (SELECT unnest(['miniCPM', 'bgeBase', 'hashedWords']) AS embedding)""",
        "embed_batches": _hashed_words("documents", "doc_id", "text"),
        "embed_queries": _hashed_words("benchmark", "item_id", f"'{INSTRUCTIONS['miniCPM']}' || text"),
        "truncate_tokens": f"""SELECT doc_id, len(kept)::INT AS n, array_to_string(kept, ' ') AS kept FROM
            (SELECT doc_id, ({TOKENS})[1:{MAX_TOKENS}] AS kept FROM documents)""",
        "pool_first": _rows("(SELECT label AS text_id, arg_min(embedding, vec_id)::DOUBLE[] AS x FROM embeddings GROUP BY label)", "text_id"),
        "pool_masked_mean": f"""SELECT text_id, dim, {_r6('sum(x * mask) / sum(mask)')} AS value FROM (
            SELECT label AS text_id, unnest(range(len(embedding)))::INT AS dim, unnest(embedding::DOUBLE[]) AS x,
            CASE WHEN embedding[1] > 0 THEN 1.0e0 ELSE 0.0e0 END AS mask FROM embeddings) GROUP BY text_id, dim""",
        "l2_normalize": _rows("""(SELECT l_orderkey, l_linenumber, list_transform(x, lambda e: e / greatest(norm, 1.0e-12)) AS x
            FROM (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM (SELECT l_orderkey, l_linenumber,
            [l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[] AS x FROM lineitem)))""", "l_orderkey, l_linenumber"),
        # autoencoder
        "init_weights": _with(*PART_MODEL) + f"""SELECT feature, {_r6('b_enc')} AS b_enc,
            unnest(range(len(w_enc)))::INT AS dim, {_r6('unnest(w_enc)')} AS w_enc, {_r6('unnest(w_dec)')} AS w_dec FROM w""",
        "encode": _with(*MODEL, VECTORS) + f"SELECT id, feature, {_r6('list_dot_product(x, w_enc) + b_enc')} AS activation FROM v, w",
        "center": _with(*MODEL, VECTORS, _centred("v", "c")) + _rows("c"),
        "ksparse_features": _with(*RECONSTRUCTED) + f"SELECT id, feature, {_r6('weight')} AS weight FROM codes",
        "latent_postings": _with(*MODEL, VECTORS, _codes("v", "idx", LATENT_K))
        + f"SELECT id, feature, {_r6('weight')} AS weight FROM idx",
        "decode": _with(*RECONSTRUCTED) + _rows("hat"),
        "reconstruct": _with(*RECONSTRUCTED) + _rows("hat"),
        "densify": _with(*RECONSTRUCTED) + f"""SELECT i.id, w.feature AS dim, {_r6('coalesce(c.weight, 0)')} AS value
            FROM (SELECT DISTINCT id FROM codes) i CROSS JOIN w LEFT JOIN codes c ON c.id = i.id AND c.feature = w.feature""",
        # search
        "dense_topk": _with(*NEAREST) + HITS + "near",
        "dense_topk_sharded": _with(*NEAREST) + HITS + "near",
        "dense_index_search": _with(*NEAREST) + f"""SELECT qid, row_idx, pid, {_r6('score')} AS score, rank FROM near JOIN
            (SELECT vec_id AS pid, row_number() OVER (ORDER BY vec_id % 2, vec_id) - 1 AS row_idx FROM embeddings) USING (pid)""",
        "dense_index_snapshot": _with(VECTORS, _search("v", "(SELECT * FROM v WHERE id % 2 = 0)", "near", TOP_K)) + f"""
            SELECT qid, pid // 2 AS row_idx, pid, {_r6('score')} AS score, rank FROM near""",
        "dense_add": f"""SELECT * FROM ({_rows(f'({INDEXED_VECTORS})', 'row_idx, pid')}) UNION ALL
            SELECT row_idx + (SELECT count(*) FROM embeddings), '-' || pid, dim, -value + 0.0::DOUBLE
            FROM ({_rows(f'({INDEXED_VECTORS})', 'row_idx, pid')})""",
        "neighbor_join": near_rows,
        "hits_as_arrays": _with(*NEAREST) + f"SELECT qid, rank - 1 AS place, pid, {_r6('score')} AS score FROM near",
        "sparse_index_upsert": f"""SELECT * FROM ({ORDER_POSTINGS}) WHERE pid NOT IN (SELECT pid FROM ({URGENT}))
            UNION ALL SELECT * FROM ({URGENT})""",
        "sparse_index_compact": f"""SELECT * FROM ({ORDER_POSTINGS}) WHERE pid NOT IN (SELECT pid FROM ({URGENT}))
            UNION ALL SELECT * FROM ({URGENT})""",
        "sparse_index_create": ORDER_POSTINGS,
        "sparse_index_search": _with(*UPDATED) + "SELECT qid, pid, score, rank FROM hits",
        "sparse_topk": _with(*PURCHASES) + "SELECT qid, pid, score, rank FROM hits",
        "sparse_topk_batch": _with(*PURCHASES) + """SELECT qid, pid, score, rank, row_idx FROM hits JOIN
            (SELECT c_custkey AS qid, row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx FROM customer) USING (qid)""",
        "fetch_vectors": _with(VECTORS, _search("v", "v", "hits", 3))
        + _rows("(SELECT qid, pid, rank, x FROM hits JOIN v ON pid = id)", "qid, pid, rank"),
        # pairs, losses, fit
        "build_pairs": _with(VECTORS, _search("v", "v", "near", PAIR_K)) + f"""SELECT qid, rank, pid,
            unnest(range(len(q.x)))::INT AS dim, {_r6('unnest(q.x)')} AS q, {_r6('unnest(p.x)')} AS p
            FROM near JOIN v q ON q.id = qid JOIN v p ON p.id = pid""",
        "pair_scores": _with(*PAIRS) + f"SELECT qid, rank, {_r6('m')} AS m, {_r6('s')} AS s, {_r6('z')} AS z FROM scores",
        "loss_mse": _with(*PAIRS) + f"SELECT batch_id, {_r6('mse')} AS mse FROM losses",
        "loss_kld": _with(*PAIRS) + f"SELECT batch_id, {_r6('kld')} AS kld FROM losses",
        "epoch_losses": _with(*PAIRS) + f"SELECT {_r6('avg(mse)')} AS mse, {_r6('avg(kld)')} AS kld FROM losses",
        "validate": _with(*PAIRS) + f"""SELECT {_r6('avg(mse)')} AS mse, {_r6('avg(kld)')} AS kld,
            {_r6('avg(mse) + avg(kld)')} AS total FROM losses""",
        "fit_gradients": _with(*GRADIENTS) + gradient_rows,
        "fit_adam_step": _with(*ADAM) + f"""SELECT feature, dim,
            {_r6(_first_step('b_enc', 'd_bias'))} AS b_enc, {_r6('0.1e0 * coalesce(d_bias, 0)')} AS m_bias,
            {_r9('0.001e0 * coalesce(d_bias, 0) * coalesce(d_bias, 0)')} AS v_bias,
            {_r6(_first_step('w_dec[dim + 1]', 'd_dec'))} AS w_dec, {_r6('0.1e0 * coalesce(d_dec, 0)')} AS m_dec,
            {_r9('0.001e0 * coalesce(d_dec, 0) * coalesce(d_dec, 0)')} AS v_dec,
            {_r6(_first_step('w_enc[dim + 1]', 'd_enc'))} AS w_enc, {_r6('0.1e0 * coalesce(d_enc, 0)')} AS m_enc,
            {_r9('0.001e0 * coalesce(d_enc, 0) * coalesce(d_enc, 0)')} AS v_enc
            FROM rows CROSS JOIN dims LEFT JOIN grads USING (feature, dim)""",
        "fit": _fit(),
        # pipelines
        "retrieve_reconstructed": _with(*SEARCHED, _search("kept", "kept", "hits", TOP_K)) + hit_rows,
        "retrieve_latent": _with(*LATENT) + hit_rows,
        "retrieve_latent_wide": _with(
            *MODEL, VECTORS, _codes("v", "idx", LATENT_K), _codes("v", "asked", 50), _sparse("asked", "idx", "hits", 50)
        ) + hit_rows,
        "feedback_hits": _with(*SEARCHED, _search("kept", "kept", "hits", FEEDBACK[0])) + hit_rows,
        "feedback_features": _with(*_feedback(*FEEDBACK[:2])) + f"""SELECT qid, pid, rank, feature, place,
            {_r6('weight')} AS weight FROM found""",
        "feedback_union": _with(*_feedback(*FEEDBACK[:2])) + "SELECT DISTINCT qid, feature FROM found",
        "expand_query": _with(*EXPANDED) + f"SELECT id AS qid, feature, {_r6('weight')} AS weight FROM expanded",
        "retrieve_feedback": _with(*FEEDBACK_SEARCH) + hit_rows,
        "feedback_sweep": _with(*SWEEP) + f"SELECT config, qid, pid, {_r6('score')} AS score, rank FROM final",
        # rankings
        "rank_run": _with(RUN) + "SELECT config, qid, pid, rank FROM run",
        "judge_run": _with(RUN, QRELS) + judged_rows,
        "judge_run_deep": _with(*DEEP) + judged_rows,
        "evaluate_deep": _with(*DEEP, *_measures())
            + f"SELECT config, measure, {_r9('value')} AS value FROM metrics",
        "compare_configs": _with(*JUDGED) + f"""SELECT measure, {_r9("max(value) FILTER (config = 'spend')")} AS spend,
            {_r9("max(value) FILTER (config = 'quantity')")} AS quantity FROM metrics
            WHERE {_chosen(COMPARED)} GROUP BY measure""",
        "evaluate_reconstructed": _evaluated(
            "reconstructed", "hits", [*SEARCHED, _search("kept", "kept", "hits", TOP_K)]
        ),
        "evaluate_latent": _evaluated("latent", "hits", LATENT),
        "evaluate_feedback": _evaluated("feedback", "hits", FEEDBACK_SEARCH),
    }
    for name, families in MEASURE_QUERIES.items():
        sql[name] = _report(families)
    return sql
