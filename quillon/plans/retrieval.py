"""Queries on supports, rankings, prefix scores, aggregates and corruption, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalar import rate
from quillon.functions.status import admissible_status
from quillon.operators import aggregate, arms, cells, classify, corrupt, corrupt_grid, prefix, rank, support
from quillon.sources import io, model

DIRECT = list(arms.DENSE)
TOP = 100


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "memory_id", "rank", F.round("score", 6).alias("score"))


# DuckDB: the model as common table expressions.
MODEL = """
WITH lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
mem AS (SELECT e.vec_id AS memory_id, d.lang AS ns, d.source AS group_id, CAST(e.embedding AS DOUBLE[]) AS emb, CAST(d.doc_id AS DOUBLE) AS released_order,
  CASE e.vec_id % 5 WHEN 0 THEN 'stale' WHEN 1 THEN 'superseded' WHEN 2 THEN 'unknown' ELSE 'current' END AS state, e.label, l.quality, l.toxic, d.text
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN lab l ON l.doc_id = e.vec_id),
q AS (SELECT memory_id AS query_id, ns AS q_ns, group_id AS q_group, emb AS q_emb, label AS q_label, text AS q_text, 's' || (label % 2) AS source,
  CASE WHEN (memory_id // 20) % 2 = 0 THEN 'current_state' ELSE 'history' END AS intent, CASE WHEN (memory_id // 20) % 3 = 0 THEN 'operation_trace' ELSE 'content_disclosure' END AS purpose
  FROM mem WHERE memory_id % 20 = 0),
pairs AS (SELECT q.query_id, q.source, q.q_group, q.q_ns, q.intent, q.purpose, m.memory_id, m.ns AS m_ns, m.state, m.released_order, m.toxic = 0 AS content_allowed, m.quality = 1 AS trace_allowed,
  CASE WHEN m.label <> q.q_label THEN false ELSE m.quality = 1 END AS relevant, m.ns = q.q_ns AS scope_ok, m.toxic = 0 AS policy_ok,
  CASE WHEN m.state = 'unknown' THEN NULL WHEN m.state = 'current' THEN true ELSE q.intent = 'history' END AS lifecycle_ok,
  list_inner_product(m.emb, q.q_emb) AS score FROM q JOIN mem m ON m.memory_id <> q.query_id)"""
POLICY = "(CASE WHEN purpose = 'content_disclosure' THEN content_allowed ELSE trace_allowed END) IS DISTINCT FROM false"
LIFE = "NOT (intent = 'current_state' AND state IN ('stale', 'superseded'))"
SUPPORT_SQL = {
    "global_dense": "true",
    "namespace_dense": "scope_ok",
    "query_agnostic_current_only": "scope_ok AND state NOT IN ('stale', 'superseded')",
    "namespace_policy_only": f"scope_ok AND {POLICY}",
    "namespace_lifecycle_only": f"scope_ok AND {LIFE}",
    "released_intent_lifecycle_upper_bound": f"scope_ok AND (intent <> 'current_state' OR ({POLICY} AND {LIFE}))",
    "released_governance_oracle_v2": f"scope_ok AND {POLICY} AND {LIFE}",
}
ARMS_SQL = ", ".join(f"('{a}')" for a in DIRECT)
HELD = "CASE arm " + " ".join(f"WHEN '{a}' THEN {c}" for a, c in SUPPORT_SQL.items()) + " END"

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _arms(spark: SparkSession, sf_dir: str, names: list[str], top: int) -> DataFrame:
    return arms.pooled_arms(model.queries(spark, sf_dir), model.candidates(spark, sf_dir), names, top)


def _frozen(spark: SparkSession, sf_dir: str, names: list[str], top: int) -> DataFrame:
    """setting_id, query_id, memory_id and rank of _arms as a written table: scorers read a ranking twice, for its labels and its prefixes."""
    return io.written(_arms(spark, sf_dir, names, top).select("setting_id", "query_id", "memory_id", "rank"), io.scratch(spark, "ranked"))


def _dense_query(arm: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ranked(_arms(spark, sf_dir, [arm], TOP))

    return run


for _arm, _where in SUPPORT_SQL.items():
    register(f"arm_{_arm}", f"{MODEL}, x AS (SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM pairs WHERE {_where}) SELECT query_id, memory_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM x WHERE rank <= {TOP}")(_dense_query(_arm))

BM25 = rf"""{MODEL},
tok AS (SELECT memory_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')) AS term FROM mem),
tf AS (SELECT memory_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT m.memory_id, coalesce(n, 0) AS dl FROM mem m LEFT JOIN (SELECT memory_id, count(*) AS n FROM tok GROUP BY ALL) USING (memory_id)),
sz AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM pairs JOIN dl USING (memory_id) GROUP BY ALL),
qt AS (SELECT q.query_id, tf.term FROM q JOIN tf ON tf.memory_id = q.query_id),
hits AS (SELECT qt.query_id, qt.term, tf.memory_id, tf.tf, dl.dl FROM qt JOIN tf USING (term) JOIN dl ON dl.memory_id = tf.memory_id WHERE tf.memory_id <> qt.query_id),
df AS (SELECT query_id, term, count(*) AS df FROM hits GROUP BY ALL),
sc AS (SELECT query_id, memory_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS s FROM hits JOIN df USING (query_id, term) JOIN sz USING (query_id) GROUP BY ALL),
bm AS (SELECT p.query_id, p.memory_id, p.score AS dense, coalesce(s, 0.0) AS s FROM pairs p LEFT JOIN sc USING (query_id, memory_id))"""


@register("arm_global_bm25", f"{BM25}, x AS (SELECT query_id, memory_id, round(s, 9) AS s FROM bm), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, memory_id) AS rank FROM x) SELECT query_id, memory_id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM y WHERE rank <= {TOP}")
def arm_global_bm25(spark, sf_dir):
    m = model.memories(spark, sf_dir, with_text=True).select("memory_id", "text")
    return _ranked(cells.ranked(cells.bm25_corpus(model.queries(spark, sf_dir).select("query_id"), m), m, TOP))


@register("arm_global_bm25_dense_rrf", f"""{BM25}, r AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, memory_id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, memory_id) AS r2 FROM bm),
s AS (SELECT query_id, memory_id, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS score FROM r), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s) SELECT query_id, memory_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM y WHERE rank <= {TOP}""")
def arm_global_rrf(spark, sf_dir):
    m, q = model.memories(spark, sf_dir, with_text=True), model.queries(spark, sf_dir)
    return _ranked(cells.fused(cells.bm25_corpus(q, m), cells.dense_corpus(q, m), m, TOP))


@register("arm_global_recency_dense", f"""{MODEL}, w AS (SELECT query_id, memory_id, score + 0.1 * coalesce((released_order - min(released_order) OVER o) / nullif(max(released_order) OVER o - min(released_order) OVER o, 0), 0) AS s FROM pairs WINDOW o AS (PARTITION BY query_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, memory_id) AS rank FROM w) SELECT query_id, memory_id, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM y WHERE rank <= {TOP}""")
def arm_global_recency_dense(spark, sf_dir):
    m = model.memories(spark, sf_dir)
    return _ranked(cells.ranked(cells.dense_corpus(model.queries(spark, sf_dir), m, 0.1), m, TOP))


@register("rank_blocked_dense", SQL["arm_global_dense"])
def rank_blocked_dense(spark, sf_dir):
    """Small blocks and chunks, so that rankings of several tasks meet."""
    q, m = model.queries(spark, sf_dir), model.memories(spark, sf_dir)
    every = F.lit("").alias("key")
    found = rank.blocked_dense(q.select(every, "query_id", F.lit(0).alias("fact"), "q_embedding"), m.select(every, "memory_id", F.lit(1).alias("fact"), "m_embedding"), TOP, block=16, chunk=128, slice_rows=200)
    return _ranked(rank.top_k(found, TOP))


def _router_sql(begins: str, place: str, score: str, least: str, top_l: int) -> str:
    """Clusters formed one memory after the other by a recursive fold; `begins`: the memory at hand begins one; `place`: which it joins; then the clusters that a query takes."""
    return f"""{MODEL.replace("WITH lab", "WITH RECURSIVE lab", 1)}, seq AS (SELECT ns, memory_id, emb, row_number() OVER (PARTITION BY ns ORDER BY released_order, memory_id) AS i FROM mem WHERE memory_id % 20 <> 0),
f AS (SELECT DISTINCT ns, 0::BIGINT AS i, NULL::BIGINT AS memory_id, 0::BIGINT AS cluster, []::DOUBLE[][] AS sums, []::BIGINT[] AS sizes FROM seq
UNION ALL SELECT ns, i, memory_id, CASE WHEN begins THEN len(sums) ELSE best - 1 END, CASE WHEN begins THEN list_append(sums, emb) ELSE list_transform(sums, lambda s, k: CASE WHEN k = best THEN list_transform(list_zip(s, emb), lambda z: z[1] + z[2]) ELSE s END) END, CASE WHEN begins THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda n, k: CASE WHEN k = best THEN n + 1 ELSE n END) END
  FROM (SELECT *, len(sums) = 0 OR {begins} AS begins FROM (SELECT *, {place} AS best FROM (SELECT s.ns, s.i, s.memory_id, s.emb, sums, sizes, list_transform(sums, lambda x: list_cosine_similarity(x, s.emb)) AS cos FROM f JOIN seq s ON s.ns = f.ns AND s.i = f.i + 1)))),
heads AS (SELECT ns, unnest(sums) AS total, unnest(sizes) AS members, unnest(range(len(sums))) AS cluster FROM (SELECT ns, arg_max(sums, i) AS sums, arg_max(sizes, i) AS sizes FROM f GROUP BY ns)),
own AS (SELECT query_id, cluster, {score} AS s FROM (SELECT q.query_id, cluster, members, list_cosine_similarity(total, q_emb) AS cos FROM q JOIN heads ON ns = q_ns) WHERE {least}),
chosen AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, cluster) <= {top_l}), width AS (SELECT query_id, count(*) AS w FROM chosen GROUP BY ALL),
kept AS (SELECT p.query_id, p.memory_id, score, f.cluster, w IS NULL AS fallback_used, coalesce(w, 1) AS route_width FROM pairs p JOIN f USING (memory_id) LEFT JOIN width USING (query_id) LEFT JOIN chosen c ON c.query_id = p.query_id AND c.cluster = f.cluster WHERE scope_ok AND (w IS NULL OR c.cluster IS NOT NULL)),
y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM kept)
SELECT query_id, memory_id, CAST(rank AS INT) AS rank, round(score, 6) AS score, CAST(cluster AS INT) AS cluster, fallback_used, CAST(route_width AS INT) AS route_width FROM y WHERE rank <= {TOP}"""


def _held_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The queries, and the memories that aren't queries, of which the routers' clusters are formed."""
    return model.queries(spark, sf_dir), model.memories(spark, sf_dir).where("memory_id % 20 <> 0")


@register("arm_threshold_router", _router_sql("list_max(cos) < 0.2", "list_position(cos, list_max(cos))", "cos", "cos >= 0.2", 3))
def arm_threshold_router(spark, sf_dir):
    q, m = _held_out(spark, sf_dir)
    return arms.pooled_threshold_router(q, m, theta=0.2, top_l=3, top_k=TOP).select("query_id", "memory_id", "rank", F.round("score", 6).alias("score"), "cluster", "fallback_used", "route_width")


_OLD = "list_transform(list_zip(sizes, cos), lambda z: 0.5 * ln(z[1] + 1) + z[2] / 0.1)"


@register("arm_cluster_router", _router_sql(f"(1 - list_max(cos)) / 0.4 > list_max({_OLD})", f"list_position({_OLD}, list_max({_OLD}))", "0.5 * ln(members + 1) + cos / 0.1", "true", 1))
def arm_cluster_router(spark, sf_dir):
    q, m = _held_out(spark, sf_dir)
    return arms.pooled_cluster_router(q, m, top_k=TOP).select("query_id", "memory_id", "rank", F.round("score", 6).alias("score"), "cluster", "fallback_used", "route_width")


STATS = f"""{MODEL}, arms(arm) AS (VALUES {ARMS_SQL}),
held AS (SELECT *, coalesce({HELD}, false) AS held FROM pairs, arms),
stats AS (SELECT arm AS setting_id, source, q_group AS group_id, query_id, CAST(sum(CASE WHEN held THEN 1 ELSE 0 END) AS BIGINT) AS candidates_scored FROM held GROUP BY ALL)"""


@register("route_stats", f"{STATS} SELECT *, CAST(candidates_scored > 0 AS INT) AS route_width FROM stats")
def route_stats(spark, sf_dir):
    return arms.pooled_stats(model.queries(spark, sf_dir), model.candidates(spark, sf_dir), DIRECT)


def _scores_sql(target: float, depth: str = f"rank <= {TOP}") -> str:
    rates = {
        "non_usable_known_rate": "sum(i AND usable IS FALSE) / nullif(sum(i AND usable IS NOT NULL), 0)", "non_usable_label_coverage": "sum(i AND usable IS NOT NULL) / nullif(sum(i), 0)",
        "non_usable_lower_bound": "sum(i AND usable IS FALSE) / nullif(sum(i), 0)", "non_usable_upper_bound": "sum(i AND usable IS DISTINCT FROM true) / nullif(sum(i), 0)",
        "admissibility_known_rate": "sum(i AND adm IS FALSE) / nullif(sum(i AND adm IS NOT NULL), 0)", "admissibility_label_coverage": "sum(i AND adm IS NOT NULL) / nullif(sum(i), 0)",
        "admissibility_lower_bound": "sum(i AND adm IS FALSE) / nullif(sum(i), 0)", "admissibility_upper_bound": "sum(i AND adm IS DISTINCT FROM true) / nullif(sum(i), 0)",
        "known_relevant_admissible_rate": "sum(i AND relevant IS TRUE AND adm IS TRUE) / nullif(sum(i), 0)", "known_relevant_inadmissible_rate": "sum(i AND relevant IS TRUE AND adm IS FALSE) / nullif(sum(i), 0)",
        "known_irrelevant_admissible_rate": "sum(i AND relevant IS FALSE AND adm IS TRUE) / nullif(sum(i), 0)", "known_irrelevant_inadmissible_rate": "sum(i AND relevant IS FALSE AND adm IS FALSE) / nullif(sum(i), 0)",
        "joint_label_coverage": "sum(i AND relevant IS NOT NULL AND adm IS NOT NULL) / nullif(sum(i), 0)", "wrong_scope_exposure_rate": "sum(i AND scope_ok IS FALSE) / nullif(sum(i), 0)",
        "policy_disallowed_exposure_rate": "sum(i AND policy_ok IS FALSE) / nullif(sum(i), 0)", "lifecycle_incompatible_exposure_rate": "sum(i AND lifecycle_ok IS FALSE) / nullif(sum(i), 0)", "unresolved_admissibility_rate": "sum(i AND adm IS NULL) / nullif(sum(i), 0)",
    }
    per = ", ".join(f"{v.replace('sum(', 'count_if(')} AS {k}" for k, v in rates.items())
    return f"""{STATS},
known AS (SELECT *, scope_ok AND policy_ok AND lifecycle_ok AS adm, relevant AND scope_ok AND policy_ok AND lifecycle_ok AS usable FROM held),
anchors AS (SELECT arm, query_id, count_if(usable) AS anchor_total FROM known GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY score DESC, memory_id) AS rank FROM known WHERE held),
cum AS (SELECT r.*, a.anchor_total, sum(CASE WHEN usable THEN 1 ELSE 0 END) OVER (PARTITION BY r.arm, r.query_id ORDER BY rank) AS cum FROM (SELECT * FROM ranked WHERE {depth}) r JOIN anchors a ON a.arm = r.arm AND a.query_id = r.query_id),
ins AS (SELECT *, coalesce(rank <= min(CASE WHEN cum / nullif(anchor_total, 0) >= {target} THEN rank END) OVER (PARTITION BY arm, query_id), false) AS i FROM cum),
per AS (SELECT arm, query_id, count_if(usable) AS got, count_if(i) AS n, {per} FROM ins GROUP BY ALL),
scores AS (SELECT s.*, CAST(s.candidates_scored > 0 AS INT) AS route_width, coalesce(a.anchor_total, 0) AS anchor_total, coalesce(p.got, 0) AS anchor_retrieved, coalesce(p.got, 0) / nullif(a.anchor_total, 0) AS evidence_recall,
  coalesce(p.got, 0) / nullif(a.anchor_total, 0) >= {target} AS feasible, CASE WHEN coalesce(p.got, 0) / nullif(a.anchor_total, 0) >= {target} THEN coalesce(p.n, 0) END AS matched_prefix_count, p.* EXCLUDE (arm, query_id, got, n)
  FROM stats s LEFT JOIN anchors a ON a.arm = s.setting_id AND a.query_id = s.query_id LEFT JOIN per p ON p.arm = s.setting_id AND p.query_id = s.query_id)"""


_ROUND = ", ".join(f"round({c}, 6) AS {c}" for c in ("evidence_recall", *aggregate.SCORES))
SCORE_COLUMNS = ["setting_id", "source", "group_id", "query_id", "candidates_scored", "route_width", "anchor_total", "anchor_retrieved", "feasible", "matched_prefix_count"]


def _scores(spark: SparkSession, sf_dir: str, target: float, names: list[str] = DIRECT, top: int = TOP) -> DataFrame:
    ranked = _frozen(spark, sf_dir, names, top)
    runs = arms.pooled_stats(model.queries(spark, sf_dir), model.candidates(spark, sf_dir), names)
    return prefix.score_route(model.assessed(spark, sf_dir, ranked), None, runs, target, model.anchors(spark, sf_dir), prefix.tasks(ranked))


@register("route_scores", f"{_scores_sql(0.5)} SELECT {', '.join(SCORE_COLUMNS)}, {_ROUND} FROM scores")
def route_scores(spark, sf_dir):
    return _scores(spark, sf_dir, 0.5).select(*SCORE_COLUMNS, *[F.round(c, 6).alias(c) for c in ("evidence_recall", *aggregate.SCORES)])


_AGG = ["recall_evaluable_rate", "mean_evidence_recall", "feasible_rate", "matched_recall_evaluable_rate", *aggregate.SCORES, "mean_route_width", "mean_matched_prefix_count", "mean_candidates_scored"]
_AGG_SQL = ["avg(CASE WHEN evidence_recall IS NULL THEN 0 ELSE 1 END)", "avg(evidence_recall)", "avg(CAST(feasible AS INT))", "avg(CASE WHEN matched_prefix_count IS NULL THEN 0 ELSE 1 END)", *[f"avg({c})" for c in aggregate.SCORES], "avg(route_width)", "avg(matched_prefix_count)", "avg(candidates_scored)"]


@register("aggregate_scores", f"{_scores_sql(0.5)} SELECT setting_id, count(*) AS query_count, {', '.join(f'round({e}, 6) AS {n}' for n, e in zip(_AGG, _AGG_SQL, strict=True))} FROM scores GROUP BY setting_id")
def aggregate_scores(spark, sf_dir):
    return aggregate.aggregate_scores(_scores(spark, sf_dir, 0.5), ["setting_id"]).select("setting_id", "query_count", *[F.round(c, 6).alias(c) for c in _AGG])


_PARTS = {
    "feasible_rate": "CAST(feasible AS INT)", "evidence_recall": "evidence_recall", "candidates_scored": "candidates_scored", "infeasibility_risk_component": "CAST(NOT feasible AS INT)",
    **{k: v for n in ("non_usable", "admissibility") for k, v in {
        f"penalized_{n}_upper_risk": f"CASE WHEN feasible IS NULL THEN NULL WHEN feasible AND {n}_upper_bound IS NOT NULL THEN {n}_upper_bound ELSE 1 END",
        f"penalized_{n}_known_risk": f"CASE WHEN feasible IS NULL THEN NULL WHEN feasible AND {n}_known_rate IS NOT NULL THEN {n}_known_rate ELSE 1 END",
        f"{n}_conditional_risk_component": f"CASE WHEN feasible IS NULL THEN NULL WHEN feasible THEN coalesce({n}_upper_bound, 1) ELSE 0 END",
        f"conditional_{n}_upper_risk": f"CASE WHEN feasible THEN coalesce({n}_upper_bound, 1) END"}.items()},
}
_SUMMARY = f"""{_scores_sql(0.2)}, by_source AS (SELECT setting_id, source, count(*) AS n, {', '.join(f'avg({e}) AS {k}' for k, e in _PARTS.items())} FROM scores GROUP BY ALL),
summary AS (SELECT setting_id, count(*) AS source_count, CAST(sum(n) AS BIGINT) AS query_count, {', '.join(f'avg({k}) AS {k}' for k in _PARTS)} FROM by_source GROUP BY ALL)"""


@register("setting_summary", f"{_SUMMARY} SELECT setting_id, source_count, query_count, {', '.join(f'round({k}, 6) AS {k}' for k in _PARTS)} FROM summary")
def setting_summary(spark, sf_dir):
    return aggregate.summarize_settings(_scores(spark, sf_dir, 0.2)).select("setting_id", "source_count", "query_count", *[F.round(c, 6).alias(c) for c in _PARTS])


@register("select_settings", f"{_SUMMARY}, k AS (SELECT *, split_part(setting_id, '_', 1) AS arm FROM summary), y AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY round(feasible_rate, 9) DESC, round(penalized_admissibility_upper_risk, 9), round(penalized_admissibility_known_risk, 9), round(evidence_recall, 9) DESC, candidates_scored, setting_id) AS k FROM k) SELECT arm, setting_id FROM y WHERE k = 1")
def select_settings(spark, sf_dir):
    s = aggregate.summarize_settings(_scores(spark, sf_dir, 0.2)).withColumn("arm", F.split("setting_id", "_")[0])
    s = s.withColumns({c: F.round(c, 9) for c in ("feasible_rate", "penalized_admissibility_upper_risk", "penalized_admissibility_known_risk", "evidence_recall")})
    return aggregate.select_settings(s, "arm").select("arm", "setting_id")


DEPTHS = [10, 20, 50, 100]
_PARETO = " UNION ALL ".join(f"SELECT * FROM ({_scores_sql(0.2, f'rank <= {d}')} SELECT setting_id || '@{d}' AS setting_id, avg(CAST(feasible AS INT)) AS f, avg(evidence_recall) AS r, avg(matched_prefix_count) AS m FROM scores WHERE setting_id IN ('global_dense', 'namespace_dense') GROUP BY ALL)" for d in DEPTHS)


@register("top_k_pareto", f"SELECT setting_id, round(f, 6) AS feasible_rate, round(r, 6) AS mean_evidence_recall, round(m, 6) AS mean_matched_prefix_count FROM ({_PARETO})")
def top_k_pareto(spark, sf_dir):
    names = ["global_dense", "namespace_dense"]
    deepest = _frozen(spark, sf_dir, names, max(DEPTHS))
    ranked = aggregate.depths(deepest, DEPTHS)
    runs = arms.pooled_stats(model.queries(spark, sf_dir), model.candidates(spark, sf_dir), names).withColumn("d", F.explode(F.array(*map(F.lit, DEPTHS)))).withColumn("setting_id", F.concat_ws("@", "setting_id", "d")).drop("d")
    scores = aggregate.aggregate_scores(prefix.score_route(ranked, model.assessments(spark, sf_dir, deepest), runs, 0.2, model.anchors(spark, sf_dir)), ["setting_id"])
    return scores.select("setting_id", *[F.round(c, 6).alias(c) for c in ("feasible_rate", "mean_evidence_recall", "mean_matched_prefix_count")])


@register("post_filters", f"""{MODEL}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM pairs), d(depth) AS (VALUES (20), (100), (500)),
m AS (SELECT depth, query_id, memory_id, row_number() OVER (PARTITION BY depth, query_id ORDER BY rank) AS rank FROM g, d WHERE rank <= depth AND scope_ok) SELECT depth, query_id, memory_id, CAST(rank AS INT) AS rank FROM m WHERE rank <= 20""")
def post_filters(spark, sf_dir):
    ranked = _arms(spark, sf_dir, ["global_dense"], 500).join(model.queries(spark, sf_dir).select("query_id", "namespace"), "query_id").join(model.candidates(spark, sf_dir).select("memory_id", "memory_namespace"), "memory_id")
    return arms.post_filters(ranked, [20, 100, 500], 20).select("depth", "query_id", "memory_id", "rank")


def uniform_sql(*parts: str) -> str:
    return f"(('0x' || substr(sha256(concat_ws(chr(0), {', '.join(parts)})), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


@register("random_partition", f"""{MODEL}, a AS (SELECT memory_id, row_number() OVER (ORDER BY memory_id) AS k FROM mem), b AS (SELECT ns, row_number() OVER (ORDER BY {uniform_sql("'7'", "'all'", "CAST(memory_id AS VARCHAR)")}, memory_id) AS k FROM mem)
SELECT memory_id, ns AS memory_namespace FROM a JOIN b USING (k)""")
def random_partition(spark, sf_dir):
    m = model.memories(spark, sf_dir).select("memory_id", "memory_namespace").withColumn("source", F.lit("all"))
    return support.random_partition(m, "7").select("memory_id", "memory_namespace")


@register("false_allow_support", f"{MODEL} SELECT query_id, count(*) AS supported, CAST(sum(CASE WHEN scope_ok THEN 1 ELSE 0 END) AS BIGINT) AS own FROM pairs WHERE scope_ok OR {uniform_sql(chr(39) + '3' + chr(39), chr(39) + 'false_allow' + chr(39), 'CAST(query_id AS VARCHAR)', 'CAST(memory_id AS VARCHAR)')} < 0.1 GROUP BY query_id")
def false_allow_support(spark, sf_dir):
    q, m = model.queries(spark, sf_dir), model.candidates(spark, sf_dir)
    outside = corrupt_grid.let_in(q, m, [0.1], ["3"], [F.col("query_id").cast("string")], [], "false_allow").select("query_id", "outside")
    own = arms.pooled_stats(q, m, ["namespace_dense"]).select("query_id", F.col("candidates_scored").alias("own"))
    return own.join(outside, "query_id", "left").select("query_id", (F.col("own") + F.coalesce("outside", F.lit(0))).alias("supported"), "own").where("supported > 0")


_CONTROL = f"""{MODEL}, known AS (SELECT *, scope_ok AND policy_ok AND lifecycle_ok AS full_ok, policy_ok AND lifecycle_ok AS residual_ok, coalesce(relevant AND scope_ok AND policy_ok AND lifecycle_ok, false) AS anchor FROM pairs),
tot AS (SELECT query_id, count_if(anchor) AS anchor_total FROM known GROUP BY ALL HAVING count_if(anchor) > 0),
r AS (SELECT k.*, anchor_total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM known k JOIN tot USING (query_id) WHERE scope_ok),
grid AS (SELECT t.target, c.cost FROM (VALUES (0.2::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) t(target), (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) c(cost)),
cum AS (SELECT *, sum(CAST(anchor AS INT)) OVER (PARTITION BY query_id, target, cost ORDER BY rank) AS cum FROM (SELECT * FROM r WHERE rank <= {TOP}) x, grid),
ins AS (SELECT *, coalesce(rank <= min(CASE WHEN cum / anchor_total >= target THEN rank END) OVER (PARTITION BY query_id, target, cost), false) AS i FROM cum),
per AS (SELECT query_id, target, cost, count_if(anchor) AS got, count_if(i AND full_ok IS DISTINCT FROM true) / nullif(count_if(i), 0) AS fu, count_if(i AND residual_ok IS DISTINCT FROM true) / nullif(count_if(i), 0) AS re, count_if(i AND full_ok IS FALSE) AS v FROM ins GROUP BY ALL),
e AS (SELECT *, coalesce(got, 0) / anchor_total AS recall, coalesce(got, 0) / anchor_total >= target AS ok FROM tot CROSS JOIN grid LEFT JOIN per USING (query_id, target, cost))
SELECT query_id, target, cost, round(recall, 6) AS evidence_recall, ok AS feasible, round(CASE WHEN ok THEN fu ELSE cost END, 6) AS penalized_full, round(CASE WHEN ok THEN re ELSE cost END, 6) AS penalized_residual, CASE WHEN ok THEN v END AS known_violations, CASE WHEN ok THEN v > 0 END AS any_known_violation FROM e"""


@register("support_control_scores", _CONTROL)
def support_control_scores(spark, sf_dir):
    ranked = _frozen(spark, sf_dir, ["namespace_dense"], TOP)
    known = prefix.labelled(model.assessments(spark, sf_dir, ranked))
    statuses = known.select("query_id", "memory_id", F.coalesce("usable", F.lit(False)).alias("anchor"), F.col("admissible").alias("full"), (F.col("policy_ok") & F.col("lifecycle_ok")).alias("residual"), (~F.col("scope_ok")).alias("wrong_scope"))
    runs = model.anchors(spark, sf_dir).where("anchor_total > 0").withColumn("setting_id", F.lit("namespace_dense"))
    grid = spark.createDataFrame([(t, c) for t in (0.2, 0.5, 0.8) for c in (0.5, 1.0)], "target double, cost double")
    out = prefix.score_matched_recall(ranked, statuses, runs, grid).select("query_id", "target", "cost", "evidence_recall", "feasible", "penalized_full", "penalized_residual", "known_violations", "any_known_violation")
    return out.withColumns(r6("evidence_recall", "penalized_full", "penalized_residual"))


RATES = [0.0, 0.1, 0.3]
_ID = {
    **{c: f"concat_ws(chr(0), seed, channel, source, CAST(memory_id AS VARCHAR), '{corrupt.tag(c)}')" for c in corrupt.RECORD_CHANNELS},
    **{c: f"concat_ws(chr(0), seed, channel, source, CAST(query_id AS VARCHAR), '{corrupt.tag(c)}')" for c in corrupt.QUERY_CHANNELS},
    **{c: f"concat_ws(chr(0), seed, channel, source, CAST(query_id AS VARCHAR), CAST(memory_id AS VARCHAR), '{corrupt.tag(c)}')" for c in corrupt.PAIR_CHANNELS},
}


def _corrupt_sql(rates: list[float], seeds: list[int]) -> str:
    """The pairs under every corruption: hit, the corrupted fields, and pol2, the decision for the query's purpose."""
    allowed = "CASE WHEN purpose = 'content_disclosure' THEN content_allowed ELSE trace_allowed END"
    return f"""{MODEL}, ch(channel) AS (VALUES {', '.join(f"('{c}')" for c in corrupt.CHANNELS)}), rt(rate) AS (VALUES {', '.join(f'({r}::DOUBLE)' for r in rates)}), sd(seed) AS (VALUES {', '.join(f"('{s}')" for s in seeds)}),
voc AS (SELECT list_sort(list_distinct(list(ns))) AS v FROM mem),
u AS (SELECT *, ('0x' || substr(sha256(CASE channel {' '.join(f"WHEN '{c}' THEN {e}" for c, e in _ID.items())} END), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u,
  list_filter(v, lambda x: x <> m_ns) AS others, CASE WHEN channel = 'namespace_swap' THEN {uniform_sql("seed", "channel", 'source', 'CAST(memory_id AS VARCHAR)', "'alternate'")} END AS ua, {allowed} AS pol FROM pairs, ch, sd, voc),
h AS (SELECT *, u < rate AS hit FROM u, rt),
c AS (SELECT channel, rate, seed, source, query_id, memory_id, hit, q_ns, scope_ok, score, relevant, policy_ok, lifecycle_ok,
  CASE WHEN hit AND channel = 'namespace_false_allow' THEN q_ns WHEN hit AND channel = 'namespace_false_deny' THEN '__denied__:' || m_ns WHEN hit AND channel = 'namespace_missing' THEN '__missing__' WHEN hit AND channel = 'namespace_swap' THEN others[CAST(least(floor(ua * len(others)), len(others) - 1) AS INT) + 1] ELSE m_ns END AS ns2,
  CASE WHEN hit AND channel = 'lifecycle_false_current' AND state IN ('stale', 'superseded') THEN 'current' WHEN hit AND channel = 'lifecycle_false_stale' AND state = 'current' THEN 'stale' WHEN hit AND channel = 'lifecycle_missing' THEN 'unknown' ELSE state END AS st2,
  CASE WHEN hit AND channel = 'query_intent_flip' THEN CASE WHEN intent = 'current_state' THEN 'history' ELSE 'current_state' END ELSE intent END AS in2,
  CASE WHEN hit AND channel = 'policy_false_allow' AND pol = false THEN true WHEN hit AND channel = 'policy_false_deny' AND pol THEN false WHEN hit AND channel = 'policy_missing' THEN NULL ELSE pol END AS pol2 FROM h)"""


_CORRUPT = f"""{_corrupt_sql(RATES, [1])},
curve AS (SELECT channel, rate, count_if(hit) AS hits, count_if(ns2 = q_ns AND pol2 IS DISTINCT FROM false AND NOT (in2 = 'current_state' AND st2 IN ('stale', 'superseded'))) AS admitted,
  count_if(ns2 = q_ns AND pol2 IS DISTINCT FROM false AND NOT (in2 = 'current_state' AND st2 IN ('stale', 'superseded')) AND NOT scope_ok) AS wrong_scope FROM c GROUP BY ALL)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrupt_grid.curve(model.queries(spark, sf_dir), model.candidates(spark, sf_dir), "released_governance_oracle_v2", list(corrupt.CHANNELS), RATES, [1]).drop("seed")


@register("corruption_curve", f"{_CORRUPT} SELECT channel, rate, hits, admitted, wrong_scope FROM curve")
def corruption_curve(spark, sf_dir):
    return _curve(spark, sf_dir)


@register("break_even", f"{_CORRUPT}, d AS (SELECT channel, rate, wrong_scope / nullif(admitted, 0) <= 0.1 + 1e-12 AS ok FROM curve), f AS (SELECT *, min(CASE WHEN NOT ok THEN rate END) OVER (PARTITION BY channel) AS fails FROM d) SELECT channel, max(CASE WHEN fails IS NULL OR rate < fails THEN rate END) AS last_dominating_rate, min(fails) AS first_non_dominating_rate FROM f GROUP BY channel")
def break_even(spark, sf_dir):
    curve = _curve(spark, sf_dir).withColumns({"value": rate(F.col("wrong_scope"), F.col("admitted")), "base": F.lit(0.1)})
    return corrupt.break_even(curve, ["channel"], "value", "base")


# The whole protocol of the metadata corruptions: 11 channels, 8 rates, 10 seeds, 4 arms at recall 0.8.
PROTOCOL_RATES = [0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5]
PROTOCOL_SEEDS = list(range(10))
PROTOCOL_ARMS = ["namespace_dense", "query_agnostic_current_only", "released_governance_oracle_v2"]
CURVE = ["feasible_rate", "evidence_recall", "penalized_admissibility_upper_risk", "penalized_admissibility_known_risk", "penalized_non_usable_upper_risk", "candidates_scored"]


def dominance(points: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """COR12: up to which rate namespace_dense is feasible as often as global_dense and at no higher risk, of each channel and seed."""

    def of(arm: str, c: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(c)))

    lacks = of("global_dense", "feasible_rate") - of("namespace_dense", "feasible_rate")
    more = of("namespace_dense", "penalized_admissibility_upper_risk") - of("global_dense", "penalized_admissibility_upper_risk")
    sides = points.groupBy("channel", "seed", "rate").agg(F.greatest(lacks, more).alias("excess")).withColumn("base", F.lit(0.0))
    return corrupt.break_even(sides, ["channel", "seed"], "excess", "base", tolerance)


def robustness(queries: DataFrame, memories: DataFrame, assess: Callable[[DataFrame], DataFrame], anchors: DataFrame, rates: list[float], seeds: list[int], target: float, top: int = TOP, **sizes: int) -> DataFrame:
    """COR11: channel, rate, seed, arm and the arm's summary under that corruption.

    global_dense reads no corrupted field, so it is scored once and stands beside every corruption.
    """
    channels = list(corrupt.CHANNELS)
    own = corrupt_grid.settings(queries, memories, assess, anchors, PROTOCOL_ARMS, channels, rates, seeds, k=top, target=target, **sizes)
    whole = ["global_dense"]
    ranked = io.written(arms.pooled_arms(queries, memories, whole, top), io.scratch(queries.sparkSession, "ranked"))  # read twice
    base = aggregate.summarize_settings(prefix.score_route(ranked, assess(ranked), arms.pooled_stats(queries, memories, whole), target, anchors))
    points = corrupt.grid(queries.sparkSession, channels, rates, seeds).drop("corruption_id")
    beside = points.crossJoin(base.select(F.col("setting_id").alias("arm"), *CURVE))  # one row by the stated grid
    return own.select("channel", "rate", "seed", "arm", *CURVE).unionByName(beside)


def _robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    def assess(ranked: DataFrame) -> DataFrame:
        return prefix.labelled(model.assessments(spark, sf_dir, ranked))

    return robustness(model.queries(spark, sf_dir), model.candidates(spark, sf_dir), assess, model.anchors(spark, sf_dir), PROTOCOL_RATES, PROTOCOL_SEEDS, 0.8)


_ARM_WHERE = {"namespace_dense": "true", "query_agnostic_current_only": "st2 NOT IN ('stale', 'superseded')", "released_governance_oracle_v2": "pol2 IS DISTINCT FROM false AND NOT (in2 = 'current_state' AND st2 IN ('stale', 'superseded'))"}
_POINT = "arm, channel, rate, seed"
_SETTINGS = f"""{_corrupt_sql(PROTOCOL_RATES, PROTOCOL_SEEDS)},
lbl AS (SELECT query_id, memory_id, score, scope_ok AND policy_ok AND lifecycle_ok AS adm, relevant AND scope_ok AND policy_ok AND lifecycle_ok AS usable FROM pairs),
anch AS (SELECT query_id, count_if(usable) AS t FROM lbl GROUP BY ALL),
here AS (SELECT * FROM c WHERE ns2 = q_ns),
held AS ({' UNION ALL '.join(f"SELECT '{a}' AS arm, channel, rate, seed, query_id, memory_id, score FROM here WHERE {w}" for a, w in _ARM_WHERE.items())} UNION ALL SELECT 'global_dense', '', 0::DOUBLE, '', query_id, memory_id, score FROM pairs),
num AS (SELECT *, row_number() OVER (PARTITION BY {_POINT}, query_id ORDER BY score DESC, memory_id) AS rank FROM held),
cand AS (SELECT {_POINT}, query_id, count(*) AS n FROM num GROUP BY ALL),
cum AS (SELECT num.*, adm, usable, t, sum(CASE WHEN usable THEN 1 ELSE 0 END) OVER (PARTITION BY {_POINT}, query_id ORDER BY rank) AS cum FROM num JOIN lbl USING (query_id, memory_id) JOIN anch USING (query_id) WHERE rank <= {TOP}),
ins AS (SELECT *, coalesce(rank <= min(CASE WHEN cum / nullif(t, 0) >= 0.8 THEN rank END) OVER (PARTITION BY {_POINT}, query_id), false) AS i FROM cum),
per AS (SELECT {_POINT}, query_id, max(cum) AS got, count_if(i) AS n, count_if(i AND adm) AS good, count_if(i AND adm IS FALSE) AS bad, count_if(i AND usable) AS fit FROM ins GROUP BY ALL),
points AS (SELECT arm, channel, rate, seed FROM (VALUES {', '.join(f"('{a}')" for a in _ARM_WHERE)}) a(arm), ch, rt, sd UNION ALL SELECT 'global_dense', '', 0::DOUBLE, ''),
scored AS (SELECT p.*, q.query_id, q.source, coalesce(cand.n, 0) AS candidates, t, coalesce(got, 0) / nullif(t, 0) AS recall, per.n, good, bad, fit FROM points p CROSS JOIN q JOIN anch USING (query_id) LEFT JOIN per USING ({_POINT}, query_id) LEFT JOIN cand USING ({_POINT}, query_id)),
parts AS (SELECT *, recall >= 0.8 AS ok FROM scored),
by_source AS (SELECT {_POINT}, source, avg(CAST(ok AS INT)) AS feasible_rate, avg(recall) AS evidence_recall, avg(CASE WHEN ok IS NULL THEN NULL WHEN ok THEN (n - good) / n ELSE 1 END) AS penalized_admissibility_upper_risk,
  avg(CASE WHEN ok IS NULL THEN NULL WHEN ok AND good + bad > 0 THEN bad / (good + bad) ELSE 1 END) AS penalized_admissibility_known_risk, avg(CASE WHEN ok IS NULL THEN NULL WHEN ok THEN (n - fit) / n ELSE 1 END) AS penalized_non_usable_upper_risk, avg(candidates) AS candidates_scored FROM parts GROUP BY ALL),
summary AS (SELECT {_POINT}, {', '.join(f'avg({c}) AS {c}' for c in CURVE)} FROM by_source GROUP BY ALL),
points_all AS (SELECT channel, rate, CAST(seed AS INT) AS seed, arm, {', '.join(CURVE)} FROM summary WHERE arm <> 'global_dense' UNION ALL SELECT ch.channel, rt.rate, CAST(sd.seed AS INT), arm, {', '.join(CURVE)} FROM ch, rt, sd, summary WHERE arm = 'global_dense')"""
_EVEN = f"""{_SETTINGS}, e AS (SELECT channel, seed, rate, greatest(max(CASE WHEN arm = 'global_dense' THEN feasible_rate END) - max(CASE WHEN arm = 'namespace_dense' THEN feasible_rate END),
  max(CASE WHEN arm = 'namespace_dense' THEN penalized_admissibility_upper_risk END) - max(CASE WHEN arm = 'global_dense' THEN penalized_admissibility_upper_risk END)) <= 1e-9 AS ok FROM points_all GROUP BY ALL),
f AS (SELECT *, min(CASE WHEN NOT ok THEN rate END) OVER (PARTITION BY channel, seed) AS fails FROM e)
SELECT channel, seed, max(CASE WHEN fails IS NULL OR rate < fails THEN rate END) AS last_dominating_rate, min(fails) AS first_non_dominating_rate FROM f GROUP BY channel, seed"""


@register("corruption_settings", f"{_SETTINGS} SELECT channel, rate, seed, arm, {', '.join(f'round(round({c}, 9), 6) AS {c}' for c in CURVE)} FROM points_all")
def corruption_settings(spark, sf_dir):
    return _robustness(spark, sf_dir).withColumns({c: F.round(F.round(c, 9), 6) for c in CURVE})


@register("corruption_break_even", _EVEN)
def corruption_break_even(spark, sf_dir):
    return dominance(_robustness(spark, sf_dir), 1e-9)


@register("natural_gates", f"""{MODEL}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM pairs), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM pairs WHERE scope_ok),
f AS (SELECT 'global' AS arm, * FROM g WHERE rank <= 20 UNION ALL SELECT 'namespace', * FROM n WHERE rank <= 20), k AS (SELECT *, scope_ok AND policy_ok AND lifecycle_ok AS adm, {uniform_sql("'v'", 'CAST(query_id AS VARCHAR)', 'CAST(memory_id AS VARCHAR)')} AS ver FROM f),
s AS (SELECT 'global_dense' AS setting_id, * FROM k WHERE arm = 'global' UNION ALL SELECT 'namespace_dense', * FROM k WHERE arm = 'namespace' UNION ALL SELECT 'namespace_policy_gate', * FROM k WHERE arm = 'namespace' AND policy_ok IS DISTINCT FROM false UNION ALL SELECT 'namespace_text_verifier', * FROM k WHERE arm = 'namespace' AND ver < 0.6 UNION ALL SELECT 'released_field_oracle', * FROM k WHERE arm = 'namespace' AND adm IS DISTINCT FROM false)
SELECT setting_id, count(*) AS kept, CAST(sum(rank) AS BIGINT) AS rank_sum, count_if(adm IS FALSE) AS violations, count_if(adm IS NULL) AS unresolved FROM s GROUP BY setting_id""")
def natural_gates(spark, sf_dir):
    from quillon.functions.scalar import uniform

    frozen = _frozen(spark, sf_dir, ["global_dense", "namespace_dense"], 20).select(F.when(F.col("setting_id") == "global_dense", "global").otherwise("namespace").alias("arm"), "query_id", "memory_id", "rank")
    frozen = model.assessed(spark, sf_dir, frozen).withColumns({"admissible": admissible_status(F.col("scope_ok"), F.col("policy_ok"), F.col("lifecycle_ok")), "verifier": uniform("v", F.col("query_id"), F.col("memory_id"))})
    gated = arms.natural_gates(frozen, 0.6)
    return gated.groupBy("setting_id").agg(F.count("*").alias("kept"), F.sum(F.col("rank").cast("bigint")).alias("rank_sum"), F.count_if(~F.col("admissible")).alias("violations"), F.count_if(F.col("admissible").isNull()).alias("unresolved"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen namespace rankings to rank 20 with labels and the verifier's predictions, which are keyed by place."""
    from quillon.functions.scalar import uniform
    from quillon.operators import paired

    frozen = _frozen(spark, sf_dir, ["namespace_dense"], 20).select("query_id", "memory_id", "rank")
    known = prefix.labelled(model.assessments(spark, sf_dir, frozen)).withColumn("anchor", F.coalesce("usable", F.lit(False)))
    cases = frozen.select(F.col("query_id").alias("case_id"), "rank", "memory_id")
    predictions = cases.select("case_id", F.col("rank").alias("position"), uniform("pv", F.col("case_id"), F.col("rank")).alias("p_violation"), uniform("pu", F.col("case_id"), F.col("rank")).alias("p_unknown"))
    scores = paired.verifier_scores(cases, predictions).withColumnRenamed("case_id", "query_id")
    return frozen.join(known, ["query_id", "memory_id"]).join(scores, ["query_id", "memory_id"])


_VERIFIED = f"""{MODEL}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM pairs WHERE scope_ok),
v AS (SELECT *, scope_ok AND policy_ok AND lifecycle_ok AS adm, {uniform_sql("'pv'", 'CAST(query_id AS VARCHAR)', 'CAST(rank AS VARCHAR)')} AS pv, {uniform_sql("'pu'", 'CAST(query_id AS VARCHAR)', 'CAST(rank AS VARCHAR)')} AS pu FROM n WHERE rank <= 20)"""


@register("inferred_gates", f"""{_VERIFIED}, s AS (SELECT 'namespace_dense' AS setting_id, * FROM v UNION ALL SELECT 'released_oracle', * FROM v WHERE adm IS DISTINCT FROM false UNION ALL SELECT 'text_inferred', * FROM v WHERE pv < 0.7 UNION ALL SELECT 'abstaining_verifier', * FROM v WHERE NOT (pv >= 0.7 AND pu <= 0.6))
SELECT setting_id, count(*) AS kept, CAST(sum(rank) AS BIGINT) AS rank_sum, count_if(adm IS FALSE) AS violations, count_if(adm IS NULL) AS unresolved FROM s GROUP BY setting_id""")
def inferred_gates(spark, sf_dir):
    gated = arms.inferred_gates(_verified(spark, sf_dir).withColumns({"v": F.lit(0.7), "u": F.lit(0.6)}))
    return gated.groupBy("setting_id").agg(F.count("*").alias("kept"), F.sum(F.col("rank").cast("bigint")).alias("rank_sum"), F.count_if(~F.col("admissible")).alias("violations"), F.count_if(F.col("admissible").isNull()).alias("unresolved"))


def calibrated(candidates: DataFrame, cases: DataFrame, calibration: Column, grid: DataFrame, cap: float, target: float) -> DataFrame:
    """NAT13: thresholds chosen on the calibration cases alone, and the inferred arms scored with them on the others alone.

    candidates: query_id, memory_id, rank, the labels, admissible, anchor, p_violation, p_unknown; cases: query_id, source, anchor_total >= 1.
    """
    required = candidates.where(calibration).select("p_violation", "p_unknown", "admissible", F.col("anchor").alias("required"))
    chosen = classify.select_threshold(classify.threshold_grid(required, grid), cap).select("v", "u")
    route = arms.inferred_gates(candidates.where(~calibration).crossJoin(F.broadcast(chosen)))  # one row
    names = F.explode(F.array(*map(F.lit, ("namespace_dense", "released_oracle", "text_inferred", "abstaining_verifier"))))
    own = cases.where(~calibration).withColumn("setting_id", names)
    scores = prefix.score_fixed_route(route.drop("v", "u"), own.select("setting_id", "query_id", "anchor_total"), target)
    return scores.join(own.select("setting_id", "query_id", "source"), ["setting_id", "query_id"]).crossJoin(F.broadcast(chosen))


@register("calibrated_gates")
def calibrated_gates(spark, sf_dir):
    cases = model.anchors(spark, sf_dir).where("anchor_total > 0").join(model.queries(spark, sf_dir).select("query_id", "source"), "query_id")
    grid = spark.createDataFrame([(v, u) for v in (0.5, 0.7, 0.9) for u in (0.2, 0.6, None)], "v double, u double")
    candidates = _verified(spark, sf_dir).join(cases.select("query_id"), "query_id", "left_semi")
    scores = calibrated(candidates, cases, classify.hash_split(F.col("query_id"), "cal", 0.5), grid, 0.5, 0.2)
    names = ["evidence_recall", "penalized_upper_risk", "route_width"]
    per = scores.groupBy("setting_id", "source").agg(*[F.avg(c).alias(c) for c in names])
    return aggregate.with_macro_row(per, ["setting_id", "source"], "source", "equal_source_macro", names).withColumns(r6(*names))


@register("fixed_route_scores", f"""{MODEL}, k AS (SELECT *, scope_ok AND policy_ok AND lifecycle_ok AS adm, coalesce(relevant AND scope_ok AND policy_ok AND lifecycle_ok, false) AS anchor FROM pairs), tot AS (SELECT query_id, count_if(anchor) AS anchor_total FROM k GROUP BY ALL HAVING count_if(anchor) > 0),
r AS (SELECT k.*, anchor_total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM k JOIN tot USING (query_id) WHERE scope_ok), c AS (SELECT *, sum(CAST(anchor AS INT)) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM r WHERE rank <= {TOP}),
i AS (SELECT *, coalesce(rank <= min(CASE WHEN cum / anchor_total >= 0.2 THEN rank END) OVER (PARTITION BY query_id), false) AS i FROM c),
p AS (SELECT query_id, count(*) AS width, count_if(anchor) AS hits, count_if(i) AS n, count_if(i AND adm IS FALSE) / nullif(count_if(i AND adm IS NOT NULL), 0) AS known, count_if(i AND adm IS DISTINCT FROM true) / nullif(count_if(i), 0) AS upper, count_if(scope_ok IS FALSE) / count(*) AS w, count_if(policy_ok IS FALSE) / count(*) AS p, count_if(lifecycle_ok IS FALSE) / count(*) AS l, count_if(adm IS NULL) / count(*) AS u FROM i GROUP BY query_id)
SELECT 'namespace_dense' AS setting_id, query_id, round(coalesce(hits, 0) / anchor_total, 6) AS evidence_recall, coalesce(hits, 0) / anchor_total >= 0.2 AS feasible, CASE WHEN coalesce(hits, 0) / anchor_total >= 0.2 THEN coalesce(n, 0) END AS matched_prefix_count, round(known, 6) AS known_violation_rate, round(upper, 6) AS upper_risk, round(coalesce(upper, 1), 6) AS penalized_upper_risk,
coalesce(width, 0) AS route_width, round(coalesce(w, 0), 6) AS wrong_scope_exposure_rate, round(coalesce(p, 0), 6) AS policy_disallowed_exposure_rate, round(coalesce(l, 0), 6) AS lifecycle_incompatible_exposure_rate, round(coalesce(u, 0), 6) AS unresolved_exposure_rate FROM tot LEFT JOIN p USING (query_id)""")
def fixed_route_scores(spark, sf_dir):
    ranked = _frozen(spark, sf_dir, ["namespace_dense"], TOP)
    route = prefix.labelled(model.assessed(spark, sf_dir, ranked)).withColumn("anchor", F.coalesce("usable", F.lit(False)))
    cases = model.anchors(spark, sf_dir).where("anchor_total > 0").withColumn("setting_id", F.lit("namespace_dense"))
    rates = ("evidence_recall", "known_violation_rate", "upper_risk", "penalized_upper_risk", "wrong_scope_exposure_rate", "policy_disallowed_exposure_rate", "lifecycle_incompatible_exposure_rate", "unresolved_exposure_rate")
    return prefix.score_fixed_route(route, cases, 0.2, prefix.tasks(ranked)).withColumns(r6(*rates))


