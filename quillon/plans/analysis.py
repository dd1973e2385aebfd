"""Queries on statistics, classification, agreement, paired designs, text, sources and quality, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar, status
from quillon.operators import aggregate, classify, corrupt, paired, quality, stats
from quillon.plans.retrieval import uniform_sql
from quillon.sources import io
from quillon.sources.model import labels, table

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Labelled documents: a score that hangs on the text's length, and deltas between two labels.
LAB = """WITH lab AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, d.text, l.quality, l.toxic, d.n_chars / (d.n_chars + 1000) AS score, CAST(l.quality - l.toxic AS DOUBLE) AS delta FROM documents d JOIN lab l USING (doc_id))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(labels(spark, sf_dir), "doc_id")
    return d.withColumns({"score": F.col("n_chars") / (F.col("n_chars") + 1000), "delta": (F.col("quality") - F.col("toxic")).cast("double")})


# --- statistics

N = 200  # where SQL repeats the draws
FULL = 10_000


def draw_sql(n: str, *parts: str) -> str:
    return f"CAST(least(floor({uniform_sql(*parts)} * {n}), {n} - 1) AS BIGINT)"


@register("cluster_macro_bootstrap", f"""{LAB}, u AS (SELECT source AS unit, avg(CAST(quality AS DOUBLE)) AS mean FROM d GROUP BY ALL), p AS (SELECT *, row_number() OVER (ORDER BY unit) - 1 AS k, count(*) OVER () AS n FROM u),
s AS (SELECT r.replicate, {draw_sql('n', "'11'", 'CAST(r.replicate AS VARCHAR)', 'CAST(k AS VARCHAR)')} AS pick FROM p, (SELECT unnest(range({N})) AS replicate) r),
v AS (SELECT replicate, avg(mean) AS v FROM s JOIN p ON p.k = s.pick GROUP BY ALL)
SELECT round((SELECT avg(mean) FROM u), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper, count(*) AS replicates FROM v""")
def cluster_macro_bootstrap(spark, sf_dir):
    return rounded(stats.cluster_macro_bootstrap(labelled(spark, sf_dir), "source", "quality", N, "11"), "estimate", "lower", "upper")


_PAIRED = f"""{LAB}, u AS (SELECT lang, source AS unit, sum(delta) AS s, count(*) AS c FROM d GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY unit) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM u),
dr AS (SELECT lang, r.replicate, {draw_sql('n', "'5'", 'lang', 'CAST(r.replicate AS VARCHAR)', 'CAST(k AS VARCHAR)')} AS pick FROM p, (SELECT unnest(range({N})) AS replicate) r),
g AS (SELECT dr.replicate, dr.lang, sum(p.s) AS s, sum(p.c) AS c FROM dr JOIN p ON p.lang = dr.lang AND p.k = dr.pick GROUP BY ALL)"""


@register("paired_bootstrap", f"""{_PAIRED}, v AS (SELECT replicate, avg(s / c) AS v FROM g GROUP BY ALL)
SELECT round((SELECT avg(x) FROM (SELECT sum(s) / sum(c) AS x FROM u GROUP BY lang)), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper, count(*) AS replicates FROM v""")
def paired_bootstrap(spark, sf_dir):
    return rounded(stats.paired_bootstrap(labelled(spark, sf_dir), ["lang"], "source", "delta", N, "5"), "estimate", "lower", "upper")


@register("case_weighted_delta", f"""{_PAIRED}, v AS (SELECT replicate, sum(s) / sum(c) AS v FROM g GROUP BY ALL), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM v)
SELECT round((SELECT sum(s) / sum(c) FROM u), 6) AS estimate, round(max(CASE WHEN k = round_even((n - 1) * 0.025, 0) THEN v END), 6) AS lower, round(max(CASE WHEN k = round_even((n - 1) * 0.975, 0) THEN v END), 6) AS upper, count(*) AS replicates FROM o""")
def case_weighted_delta(spark, sf_dir):
    return rounded(stats.paired_bootstrap(labelled(spark, sf_dir), ["lang"], "source", "delta", N, "5", weighting="cases", nearest=True), "estimate", "lower", "upper")


@register("scenario_bootstrap", f"""{LAB}, u AS (SELECT lang, source AS unit, avg(delta) AS mean FROM d GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY unit) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM u),
dr AS (SELECT lang, r.replicate, {draw_sql('n', "'9'", 'lang', 'CAST(r.replicate AS VARCHAR)', 'CAST(k AS VARCHAR)')} AS pick FROM p, (SELECT unnest(range({N})) AS replicate) r),
v AS (SELECT replicate, avg(m) AS v FROM (SELECT dr.replicate, dr.lang, avg(p.mean) AS m FROM dr JOIN p ON p.lang = dr.lang AND p.k = dr.pick GROUP BY ALL) GROUP BY ALL)
SELECT round((SELECT avg(m) FROM (SELECT avg(mean) AS m FROM u GROUP BY lang)), 6) AS estimate, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper, count(*) AS replicates FROM v""")
def scenario_bootstrap(spark, sf_dir):
    return rounded(stats.scenario_bootstrap(labelled(spark, sf_dir), "lang", "source", "delta", N, "9"), "estimate", "lower", "upper")


@register("cluster_macro_bootstrap_full")
def cluster_macro_bootstrap_full(spark, sf_dir):
    return rounded(stats.cluster_macro_bootstrap(labelled(spark, sf_dir), "source", "quality", FULL, "11"), "estimate", "lower", "upper")


@register("paired_bootstrap_full")
def paired_bootstrap_full(spark, sf_dir):
    return rounded(stats.paired_bootstrap(labelled(spark, sf_dir), ["lang"], "source", "delta", FULL, "5"), "estimate", "lower", "upper")


@register("case_weighted_delta_full")
def case_weighted_delta_full(spark, sf_dir):
    return rounded(stats.paired_bootstrap(labelled(spark, sf_dir), ["lang"], "source", "delta", FULL, "5", weighting="cases", nearest=True), "estimate", "lower", "upper")


@register("scenario_bootstrap_full")
def scenario_bootstrap_full(spark, sf_dir):
    return rounded(stats.scenario_bootstrap(labelled(spark, sf_dir), "lang", "source", "delta", FULL, "9"), "estimate", "lower", "upper")


_GAP = f"{LAB}, g AS (SELECT lang, source, avg(score) FILTER (WHERE quality = 1) - avg(score) FILTER (WHERE quality = 0) AS gap FROM d GROUP BY ALL)"


@register("scenario_selectivity", f"{_GAP} SELECT lang, source, round(gap, 6) AS gap FROM g WHERE gap IS NOT NULL")
def scenario_selectivity(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("cell", F.when(F.col("quality") == 1, "high").otherwise("low"))
    return rounded(stats.selectivity(rows, "lang", "source", "cell", "score", "high", "low"), "gap")


@register("agreement_bootstrap")
def agreement_bootstrap(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("n_chars") >= 1000).alias("b"))
    return stats.binary_agreement_bootstrap(rows, "a", "b", "doc_id", FULL, "3")


_MONTHS = """WITH m AS (SELECT month(o_orderdate) AS m, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS delta FROM orders GROUP BY ALL)"""


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.month("o_orderdate").cast("bigint").alias("m"), "o_orderstatus", "o_totalprice")
    return aggregate.paired_groups(rows, "o_orderstatus", "F", "O", ["m"], "o_totalprice")


@register("sign_flip_pvalue", f"""{_MONTHS}, u AS (SELECT delta AS d, row_number() OVER (ORDER BY delta) - 1 AS k FROM m WHERE delta <> 0), t AS (SELECT count(*) AS n, abs(avg(d)) AS o FROM u),
pat AS (SELECT unnest(range(CAST(2 ** n AS BIGINT))) AS x, o FROM t), s AS (SELECT x, o, sum(CASE WHEN (x >> k) & 1 = 1 THEN d ELSE -d END) / count(*) AS mean FROM pat, u GROUP BY ALL)
SELECT (SELECT n FROM t) AS units, round(avg(CASE WHEN abs(mean) >= o - 1e-15 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p FROM s""")
def sign_flip_pvalue(spark, sf_dir):
    return rounded(stats.sign_flip(monthly(spark, sf_dir), "delta"), "p")


@register("group_deltas", f"{_MONTHS}, t AS (SELECT *, (sum(delta) OVER () - delta) / nullif(count(*) OVER () - 1, 0) AS loo FROM m WHERE delta IS NOT NULL) SELECT count(*) AS groups, round(avg(delta), 4) AS mean_delta, count_if(delta > 0) AS positive, count_if(delta = 0) AS zero, count_if(delta < 0) AS negative, round(min(loo), 4) AS loo_min, round(max(loo), 4) AS loo_max FROM t")
def group_deltas(spark, sf_dir):
    return aggregate.sign_counts(monthly(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("mean_delta", "loo_min", "loo_max")})


@register("exposure_risk_difference", "SELECT round(avg(CASE WHEN value > 50 THEN CAST(event_type = 'purchase' AS INT) END) - avg(CASE WHEN NOT value > 50 THEN CAST(event_type = 'purchase' AS INT) END), 6) AS risk_difference FROM events")
def exposure_risk_difference(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("value") > 50).alias("exposed"), (F.col("event_type") == "purchase").cast("int").alias("used"))
    return rounded(stats.risk_difference(rows, "exposed", "used"), "risk_difference")


# --- classification


def toxic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.binary_rows(labelled(spark, sf_dir), F.col("toxic") == 0, F.col("score"), ["lang"])


@register("binary_metrics", f"""{LAB} SELECT lang, count(*) AS known_count, CAST(sum(toxic) AS BIGINT) AS positive_count, round(avg(toxic), 6) AS positive_rate, round(avg(CAST((score >= 0.5) = (toxic = 1) AS INT)), 6) AS accuracy,
round((avg(CASE WHEN toxic = 1 THEN CAST(score >= 0.5 AS INT) END) + avg(CASE WHEN toxic = 0 THEN CAST(score < 0.5 AS INT) END)) / 2, 6) AS balanced_accuracy, round(avg((score - toxic) * (score - toxic)), 6) AS brier FROM d GROUP BY lang""")
def binary_metrics(spark, sf_dir):
    return rounded(classify.binary_metrics(toxic_rows(spark, sf_dir), ["lang"]), "positive_rate", "accuracy", "balanced_accuracy", "brier")


@register("roc_auc", f"{LAB}, r AS (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS r FROM d), s AS (SELECT lang, sum(CASE WHEN toxic = 1 THEN r ELSE 0 END) AS r, sum(toxic) AS p, sum(1 - toxic) AS q FROM r GROUP BY lang) SELECT lang, round((r - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS roc_auc FROM s")
def roc_auc(spark, sf_dir):
    return rounded(classify.roc_auc(toxic_rows(spark, sf_dir), ["lang"]), "roc_auc")


@register("average_precision", f"{LAB}, g AS (SELECT lang, score, count(*) AS n, sum(toxic) AS p FROM d GROUP BY ALL), c AS (SELECT lang, sum(p) OVER w / sum(n) OVER w AS prec, p / nullif(sum(p) OVER (PARTITION BY lang), 0) AS gain FROM g WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT lang, round(sum(gain * prec), 6) AS pr_auc FROM c GROUP BY lang")
def average_precision(spark, sf_dir):
    return rounded(classify.average_precision(toxic_rows(spark, sf_dir), ["lang"]), "pr_auc")


@register("calibration_error", f"{LAB}, b AS (SELECT lang, (SELECT count(*) FROM range(1, 10) t(i) WHERE i / 10 <= score) AS bin, toxic, score FROM d), g AS (SELECT lang, bin, count(*) AS n, abs(avg(toxic) - avg(score)) AS gap FROM b GROUP BY ALL) SELECT lang, round(sum(n * gap) / sum(n), 6) AS ece FROM g GROUP BY lang")
def calibration_error(spark, sf_dir):
    return rounded(classify.calibration_error(toxic_rows(spark, sf_dir), ["lang"]), "ece")


_VER = f"""{LAB}, r AS (SELECT doc_id, {uniform_sql("'pv'", 'CAST(doc_id AS VARCHAR)')} AS p_violation, {uniform_sql("'pu'", 'CAST(doc_id AS VARCHAR)')} AS p_unknown, CASE WHEN quality = 0 AND toxic = 0 THEN NULL ELSE toxic = 0 END AS admissible, quality = 1 AND n_chars > 1000 AS required FROM d),
grid AS (SELECT v, u FROM (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) a(v), (VALUES (0.2::DOUBLE), (0.6::DOUBLE), (NULL)) b(u)),
x AS (SELECT v, u, admissible, required, p_unknown, v IS NOT NULL AND p_violation >= v AND (u IS NULL OR p_unknown <= u) AS dr FROM r, grid),
g AS (SELECT v, u, count(*) AS candidate_count, count_if(admissible IS NOT NULL) AS known_count, count_if(admissible IS FALSE) AS known_violation_count, count_if(dr) AS dropped_count, count_if(dr AND admissible IS NULL) AS dropped_unknown_gold,
  count_if(dr AND admissible IS FALSE) / nullif(count_if(dr AND admissible IS NOT NULL), 0) AS violation_precision, count_if(dr AND admissible IS FALSE) / nullif(count_if(admissible IS FALSE), 0) AS violation_recall,
  count_if(dr AND required) / nullif(count_if(required), 0) AS false_deny, count_if(u IS NULL OR p_unknown <= u) / count(*) AS abstention_coverage FROM x GROUP BY ALL)"""


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir)
    rows = d.select(scalar.uniform("pv", F.col("doc_id")).alias("p_violation"), scalar.uniform("pu", F.col("doc_id")).alias("p_unknown"), F.when(~((F.col("quality") == 0) & (F.col("toxic") == 0)), F.col("toxic") == 0).alias("admissible"), ((F.col("quality") == 1) & (F.col("n_chars") > 1000)).alias("required"))
    return classify.threshold_grid(rows, spark.createDataFrame([(v, u) for v in (0.5, 0.7, 0.9) for u in (0.2, 0.6, None)], "v double, u double"))


_DECISION = ("violation_precision", "violation_recall", "false_deny", "abstention_coverage")


@register("filter_decisions", f"{_VER} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _DECISION)}) FROM g")
def filter_decisions(spark, sf_dir):
    return rounded(_decisions(spark, sf_dir), *_DECISION)


@register("select_threshold", f"{_VER} SELECT v, u, round(violation_precision, 6) AS violation_precision, round(violation_recall, 6) AS violation_recall, round(false_deny, 6) AS false_deny, dropped_unknown_gold FROM g WHERE false_deny <= 0.4 ORDER BY g.violation_recall DESC, coalesce(g.violation_precision, -1) DESC, g.false_deny, v DESC, coalesce(u, 1) LIMIT 1")
def select_threshold(spark, sf_dir):
    return rounded(classify.select_threshold(_decisions(spark, sf_dir), 0.4), "violation_precision", "violation_recall", "false_deny")


_AGREE = f"{LAB}, t AS (SELECT lang, count(*) AS n, count_if(quality = 1 AND n_chars >= 1000) AS tt, count_if(quality = 1 AND n_chars < 1000) AS tf, count_if(quality = 0 AND n_chars >= 1000) AS ft, count_if(quality = 0 AND n_chars < 1000) AS ff FROM d GROUP BY lang), p AS (SELECT *, (tt + ff) / n AS e, (tt + tf) / n AS a, (tt + ft) / n AS b FROM t), c AS (SELECT *, a * b + (1 - a) * (1 - b) AS ch, 2 * ((a + b) / 2) * (1 - (a + b) / 2) AS ac FROM p)"


@register("binary_agreement", f"{_AGREE} SELECT lang, n, tt, tf, ft, ff, round(e, 6) AS exact, round(CASE WHEN ch = 1 THEN 1 ELSE (e - ch) / nullif(1 - ch, 0) END, 6) AS kappa, round(CASE WHEN ac = 1 THEN 1 ELSE (e - ac) / nullif(1 - ac, 0) END, 6) AS ac1 FROM c")
def binary_agreement(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("lang", (F.col("quality") == 1).alias("a"), (F.col("n_chars") >= 1000).alias("b"))
    return rounded(classify.binary_agreement(rows, "a", "b", ["lang"]), "exact", "kappa", "ac1")


@register("quality_agreement", f"""{LAB}, r AS (SELECT least(n_chars // 500, 10) AS a, CAST(floor({uniform_sql("'qa'", 'CAST(doc_id AS VARCHAR)')} * 11) AS BIGINT) AS b FROM d), m AS (SELECT count(*) AS n FROM r),
w AS (SELECT i, j, (i - j) * (i - j) AS w FROM range(11) x(i), range(11) y(j)), ex AS (SELECT sum(w * ca * cb) / ((SELECT n FROM m) * (SELECT n FROM m)) AS e FROM w JOIN (SELECT a, count(*) AS ca FROM r GROUP BY a) ON a = i JOIN (SELECT b, count(*) AS cb FROM r GROUP BY b) ON b = j)
SELECT count(*) AS n, round(avg(CAST(a = b AS INT)), 6) AS exact, round(avg(CAST(abs(a - b) <= 1 AS INT)), 6) AS within_one, round(avg(abs(a - b)), 6) AS mae, round(avg(a - b), 6) AS mean_difference, round(1 - avg((a - b) * (a - b)) / (SELECT e FROM ex), 6) AS quadratic_kappa FROM r""")
def quality_agreement(spark, sf_dir):
    rows = labelled(spark, sf_dir).select(F.least(F.floor(F.col("n_chars") / 500), F.lit(10)).alias("a"), F.floor(scalar.uniform("qa", F.col("doc_id")) * 11).alias("b"))
    return rounded(classify.quality_agreement(rows, "a", "b"), "exact", "within_one", "mae", "mean_difference", "quadratic_kappa")


# A document has one language, so the greedy choice is a rank by hash within it.
@register("unique_stratified_sample", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(chr(31), '17', lang, CAST(doc_id AS VARCHAR)))) AS k FROM documents) x WHERE k <= 10")
def unique_stratified_sample(spark, sf_dir):
    return classify.unique_stratified(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 10, "17")


@register("salted_sample", "WITH s AS (SELECT doc_id, lang FROM documents ORDER BY sha256('salt' || doc_id) LIMIT 50) SELECT * FROM s UNION SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def salted_sample(spark, sf_dir):
    return classify.salted_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50, "salt", F.col("lang") == "de")


@register("intent_metrics", f"""WITH u AS (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS gold, {', '.join(f"{uniform_sql(f"'i{k}'", 'CAST(doc_id AS VARCHAR)')} + 0.01::DOUBLE AS x{k}" for k in range(3))} FROM documents),
p AS (SELECT lang, gold, x0 / (x0 + x1 + x2) AS p0, x1 / (x0 + x1 + x2) AS p1, x2 / (x0 + x1 + x2) AS p2 FROM u),
r AS (SELECT lang, CAST(gold = CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INT) AS label, greatest(p0, p1, p2) AS score, (p0 - CAST(gold = 0 AS INT)) ** 2 + (p1 - CAST(gold = 1 AS INT)) ** 2 + p2 ** 2 AS brier FROM p),
m AS (SELECT lang, avg(label) AS accuracy, avg(brier) AS multiclass_brier FROM r GROUP BY lang), b AS (SELECT lang, (SELECT count(*) FROM range(1, 10) t(i) WHERE i / 10 <= score) AS bin, label, score FROM r),
g AS (SELECT lang, bin, count(*) AS n, abs(avg(label) - avg(score)) AS gap FROM b GROUP BY ALL), e AS (SELECT lang, sum(n * gap) / sum(n) AS ece FROM g GROUP BY lang)
SELECT lang, round(accuracy, 6) AS accuracy, round(multiclass_brier, 6) AS multiclass_brier, round(ece, 6) AS ece FROM m JOIN e USING (lang)""")
def intent_metrics(spark, sf_dir):
    names = ["current_state", "history", "unknown"]
    u = [scalar.uniform(f"i{k}", F.col("doc_id")) + 0.01 for k in range(3)]
    rows = table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 2 == 0, names[0]).otherwise(names[1]).alias("gold"), *[(x / (u[0] + u[1] + u[2])).alias(f"p{k}") for k, x in enumerate(u)])
    p = [F.col(f"p{k}") for k in range(3)]
    rows = rows.withColumns({"label": (scalar.argmax_label(names, *p) == F.col("gold")).cast("int"), "score": F.greatest(*p), "brier": classify.multiclass_brier(F.col("gold"), names, *p)})
    metrics = rows.groupBy("lang").agg(F.avg("label").alias("accuracy"), F.avg("brier").alias("multiclass_brier"))
    return rounded(metrics.join(classify.calibration_error(rows, ["lang"]), "lang"), "accuracy", "multiclass_brier", "ece")


# --- paired designs: three candidates make a pair, two pairs a scenario

_OBS = f"""WITH b AS (SELECT doc_id, doc_id // 3 AS pair, 'p' || (doc_id // 3) AS pair_id, 's' || (doc_id // 6 % 16) AS scenario_id, 'a' || (doc_id // 6 % 4) AS axis, 'c' || (doc_id % 3) AS candidate_key,
  CASE doc_id % 3 WHEN 0 THEN 'focal' WHEN 1 THEN 'stable_admissible' ELSE 'stable_inadmissible' END AS role, doc_id % 3 < 2 AS allow_gold, doc_id % 3 = 1 AS block_gold FROM documents),
c AS (SELECT b.*, condition, CASE WHEN condition = 'allow' THEN allow_gold ELSE block_gold END AS gold, {uniform_sql("'adm'", 'condition', 'CAST(doc_id AS VARCHAR)')} AS x, {uniform_sql("'inadm'", 'condition', 'CAST(doc_id AS VARCHAR)')} AS y, {uniform_sql("'unk'", 'condition', 'CAST(doc_id AS VARCHAR)')} AS z FROM b, (VALUES ('allow'), ('block')) t(condition)),
n AS (SELECT * EXCLUDE (x, y, z), x / (x + y + z) AS pa, y / (x + y + z) AS pi, z / (x + y + z) AS pu FROM c),
o AS (SELECT *, CASE WHEN pa >= pi AND pa >= pu THEN 'admissible' WHEN pi >= pu THEN 'inadmissible' ELSE 'unknown' END AS label, pa - pi AS lean, (pa - CAST(gold AS INT)) ** 2 + (pi - (1 - CAST(gold AS INT))) ** 2 + pu ** 2 AS brier FROM n),
obs AS (SELECT *, CAST(label = CASE WHEN gold THEN 'admissible' ELSE 'inadmissible' END AS INT) AS correct FROM o),
pc AS (SELECT pair_id, scenario_id, axis, candidate_key, role, sum(correct) AS r, count(*) AS j, sum(brier) AS brier, count_if(label = 'unknown') AS unk, sum(pu) AS pu, max(CASE WHEN condition = 'allow' THEN correct END) AS ac, max(CASE WHEN condition = 'block' THEN correct END) AS bc,
  (max(CASE WHEN condition = 'allow' THEN lean END) - max(CASE WHEN condition = 'block' THEN lean END)) / 2 AS margin, CAST(count(DISTINCT label) > 1 AS INT) AS flip FROM obs GROUP BY ALL),
ps AS (SELECT pair_id, scenario_id, axis, max(CASE WHEN role = 'focal' THEN CAST(r = 2 AS INT) END) AS strict, max(CASE WHEN role = 'focal' THEN CAST(margin > 0 AS INT) END) AS dir, max(CASE WHEN role = 'focal' THEN margin END) AS margin,
  sum(CASE WHEN role <> 'focal' THEN r END) AS sc, sum(CASE WHEN role <> 'focal' THEN j END) AS st, sum(CASE WHEN role <> 'focal' THEN flip END) AS sf, count_if(role <> 'focal') AS sn, sum(r) AS cc, sum(j) AS ct, sum(brier) AS brier, sum(unk) AS unk, sum(pu) AS pu FROM pc GROUP BY ALL)"""


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    third = F.floor(i / 3)
    rows = table(spark, sf_dir, "documents").select(
        i, F.concat(F.lit("p"), third).alias("pair_id"), F.concat(F.lit("s"), F.floor(i / 6) % 16).alias("scenario_id"), F.concat(F.lit("a"), F.floor(i / 6) % 4).alias("axis"), F.concat(F.lit("c"), i % 3).alias("candidate_key"),
        F.when(i % 3 == 0, "focal").when(i % 3 == 1, "stable_admissible").otherwise("stable_inadmissible").alias("role"), (i % 3 < 2).alias("allow_gold"), (i % 3 == 1).alias("block_gold"),
    )
    rows = paired.conditions(rows)
    x, y, z = (scalar.uniform(k, F.col("condition"), i) for k in ("adm", "inadm", "unk"))
    rows = rows.withColumns({"x": x, "y": y, "z": z})
    total = F.col("x") + F.col("y") + F.col("z")
    return paired.observations(rows.withColumns({"p_adm": F.col("x") / total, "p_inadm": F.col("y") / total, "p_unk": F.col("z") / total}).drop("x", "y", "z"))


KEYS = ["pair_id", "scenario_id", "axis"]


@register("pair_scores", f"{_OBS} SELECT pair_id, scenario_id, axis, strict AS strict_focal_pair_consistency, dir AS focal_direction_accuracy, round(margin, 6) AS focal_directional_margin, CAST(sc AS BIGINT) AS stable_correct, CAST(sf AS BIGINT) AS stable_flips, CAST(cc AS BIGINT) AS candidate_correct, round(brier, 6) AS brier_sum FROM ps")
def pair_scores(spark, sf_dir):
    return rounded(paired.pair_scores(_observations(spark, sf_dir), KEYS).select(*KEYS, "strict_focal_pair_consistency", "focal_direction_accuracy", "focal_directional_margin", "stable_correct", "stable_flips", "candidate_correct", "brier_sum"), "focal_directional_margin", "brier_sum")


@register("pair_metrics", f"""{_OBS} SELECT coalesce(axis, 'all') AS axis, count(*) AS pair_count, count(DISTINCT scenario_id) AS scenario_count, round(avg(strict), 6) AS strict_focal_pair_consistency, round(avg(dir), 6) AS focal_direction_accuracy, round(avg(margin), 6) AS mean_focal_directional_margin, round(sum(sc) / sum(st), 6) AS stable_control_accuracy,
round(sum(sf) / sum(sn), 6) AS stable_control_overflip_rate, round(sum(cc) / sum(ct), 6) AS candidate_accuracy, round(sum(brier) / sum(ct), 6) AS candidate_multiclass_brier, round(sum(unk) / sum(ct), 6) AS candidate_unknown_argmax_rate, round(sum(pu) / sum(ct), 6) AS candidate_mean_unknown_probability FROM ps GROUP BY GROUPING SETS ((), (axis))""")
def pair_metrics(spark, sf_dir):
    out = aggregate.grouping_sets(paired.pair_scores(_observations(spark, sf_dir), KEYS), [[], ["axis"]], paired.pair_metrics())
    return rounded(out, *[c for c in out.columns if c not in ("axis", "pair_count", "scenario_count")])


@register("error_taxonomy", f"{_OBS} SELECT coalesce(axis, 'all') AS axis, role, coalesce(condition, 'all') AS condition, count(*) AS n, round(avg(correct), 6) AS accuracy FROM obs GROUP BY GROUPING SETS ((role), (axis, role), (role, condition), (axis, role, condition))")
def error_taxonomy(spark, sf_dir):
    out = aggregate.grouping_sets(_observations(spark, sf_dir), [["role"], ["axis", "role"], ["role", "condition"], ["axis", "role", "condition"]], {"n": F.count("*"), "accuracy": F.avg("correct")})
    return rounded(out, "accuracy")


@register("stable_transitions", f"{_OBS}, w AS (SELECT role, max(CASE WHEN condition = 'allow' THEN label END) AS allow_label, max(CASE WHEN condition = 'block' THEN label END) AS block_label FROM obs WHERE role <> 'focal' GROUP BY pair_id, candidate_key, role), g AS (SELECT role, allow_label, block_label, count(*) AS n FROM w GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY role), 6) AS share FROM g")
def stable_transitions(spark, sf_dir):
    from pyspark.sql import Window

    wide = paired.stable_transitions(_observations(spark, sf_dir), ["pair_id"])
    per = wide.groupBy("role", "allow_label", "block_label").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("role")), 6))


_DIALOG = r"""WITH t AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS u, max(CASE WHEN role = 'assistant' THEN text END) AS a FROM conversations GROUP BY conv_id HAVING u IS NOT NULL AND a IS NOT NULL),
n AS (SELECT *, ' ' || trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')) || ' ' AS nu, ' ' || trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) || ' ' AS na FROM t)"""


def _dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text a conversation and role, the greatest: what the SQL of cell_metrics and token_jaccard reads."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.max("text"))
    return c.where("user IS NOT NULL AND assistant IS NOT NULL")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the assistant turn that follows it: conv_id, turn (the user's), user, assistant. A user turn without one has no pair."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    asked = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user"))
    return asked.join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant")), ["conv_id", "turn"])


def _exposure(d: DataFrame, unit: Column) -> DataFrame:
    units = d.select(unit.alias("unit_id"), F.concat(F.lit("s"), F.col("conv_id") % 16).alias("scenario_id"), F.concat(F.lit("a"), F.col("conv_id") % 4).alias("axis"), status.cell(F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 == 0).alias("cell"), F.array(F.lit("the"), F.lit("la")).alias("markers"))
    rows = d.select(unit.alias("unit_id"), F.explode(F.array(F.struct(F.lit("withheld").alias("exposure"), F.col("user").alias("answer")), F.struct(F.lit("exposed").alias("exposure"), F.col("assistant").alias("answer")))).alias("r"))
    responses = rows.select("unit_id", "r.exposure", "r.answer", F.when(F.length("r.answer") > 20, "answer").otherwise("refuse").alias("action"))
    return paired.exposure_scores(units, responses)


def _cells(scores: DataFrame) -> DataFrame:
    out = aggregate.grouping_sets(scores, [["cell"], ["axis", "cell"]], paired.cell_metrics())
    return rounded(out, *[c for c in out.columns if c.endswith(("_rate", "_effect"))])


_TURN = r"""WITH c AS (SELECT * FROM conversations WHERE text IS NOT NULL), t AS (SELECT q.conv_id, q.turn, q.text AS u, r.text AS a FROM c q JOIN c r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 AND r.role = 'assistant' WHERE q.role = 'user'),
n AS (SELECT *, ' ' || trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')) || ' ' AS nu, ' ' || trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')) || ' ' AS na FROM t),
s AS (SELECT conv_id || '|' || turn AS unit_id, 's' || (conv_id % 16) AS scenario_id, 'a' || (conv_id % 4) AS axis, CASE WHEN conv_id % 2 = 0 THEN 'relevant' ELSE 'irrelevant' END || '_' || CASE WHEN conv_id % 3 = 0 THEN 'admissible' ELSE 'inadmissible' END AS cell,
  CAST(contains(na, ' the ') OR contains(na, ' la ') AS INT) AS ed, CAST(contains(nu, ' the ') OR contains(nu, ' la ') AS INT) AS wd, CAST(length(a) <= 20 AS INT) AS er, CAST(length(u) <= 20 AS INT) AS wr FROM n)"""


@register("exposure_scores", f"{_TURN} SELECT unit_id, scenario_id, axis, cell, ed AS exposed_disclosure, er AS exposed_refusal, wd AS withheld_disclosure, wr AS withheld_refusal, ed - wd AS exposure_effect, er - wr AS refusal_effect FROM s")
def exposure_scores(spark, sf_dir):
    return _exposure(_turns(spark, sf_dir), F.concat_ws("|", "conv_id", "turn"))


_CELL = f"""{_DIALOG}, s AS (SELECT conv_id, 's' || (conv_id % 16) AS scenario_id, 'a' || (conv_id % 4) AS axis, CASE WHEN conv_id % 2 = 0 THEN 'relevant' ELSE 'irrelevant' END || '_' || CASE WHEN conv_id % 3 = 0 THEN 'admissible' ELSE 'inadmissible' END AS cell,
  CAST(contains(na, ' the ') OR contains(na, ' la ') AS INT) AS ed, CAST(contains(nu, ' the ') OR contains(nu, ' la ') AS INT) AS wd, CAST(length(a) <= 20 AS INT) AS er, CAST(length(u) <= 20 AS INT) AS wr FROM n)"""


@register("cell_metrics", f"{_CELL} SELECT cell, coalesce(axis, 'all') AS axis, count(*) AS unit_count, count(DISTINCT scenario_id) AS scenario_count, round(avg(ed), 6) AS exposed_disclosure_rate, round(avg(wd), 6) AS withheld_disclosure_rate, round(avg(ed - wd), 6) AS exposure_effect, round(avg(er), 6) AS exposed_refusal_rate, round(avg(wr), 6) AS withheld_refusal_rate, round(avg(er - wr), 6) AS refusal_effect FROM s GROUP BY GROUPING SETS ((cell), (axis, cell))")
def cell_metrics(spark, sf_dir):
    return _cells(_exposure(_dialog(spark, sf_dir), F.col("conv_id").cast("string")))


@register("cell_metrics_turns", f"{_TURN} SELECT cell, coalesce(axis, 'all') AS axis, count(*) AS unit_count, count(DISTINCT scenario_id) AS scenario_count, round(avg(ed), 6) AS exposed_disclosure_rate, round(avg(wd), 6) AS withheld_disclosure_rate, round(avg(ed - wd), 6) AS exposure_effect, round(avg(er), 6) AS exposed_refusal_rate, round(avg(wr), 6) AS withheld_refusal_rate, round(avg(er - wr), 6) AS refusal_effect FROM s GROUP BY GROUPING SETS ((cell), (axis, cell))")
def cell_metrics_turns(spark, sf_dir):
    """cell_metrics over every turn."""
    return _cells(exposure_scores(spark, sf_dir))


@register("exposure_cell_bootstrap")
def exposure_cell_bootstrap(spark, sf_dir):
    rows = exposure_scores(spark, sf_dir).where("cell = 'relevant_admissible'")
    return stats.scenario_bootstrap(rows, "axis", "scenario_id", "exposure_effect", FULL, "21")


@register("query_similarity")
def query_similarity(spark, sf_dir):
    d = _turns(spark, sf_dir).select("conv_id", "turn", F.col("user").alias("allow_query"), F.col("assistant").alias("block_query"))
    return paired.query_similarity(d).select("conv_id", "turn", "query_token_jaccard", "query_sequence_similarity")


@register("token_jaccard", r"""WITH t AS (SELECT conv_id, max(CASE WHEN role = 'user' THEN text END) AS u, max(CASE WHEN role = 'assistant' THEN text END) AS a FROM conversations GROUP BY conv_id HAVING u IS NOT NULL AND a IS NOT NULL),
x AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(u), '[a-z0-9]+')) AS u, list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')) AS a FROM t)
SELECT conv_id, round(CASE WHEN len(u) = 0 AND len(a) = 0 THEN 1 ELSE len(list_intersect(u, a)) / nullif(len(list_distinct(list_concat(u, a))), 0) END, 6) AS jaccard FROM x""")
def token_jaccard(spark, sf_dir):
    return _dialog(spark, sf_dir).select("conv_id", F.round(scalar.token_jaccard(F.col("user"), F.col("assistant")), 6).alias("jaccard"))


@register("token_jaccard_turns", r"""WITH c AS (SELECT * FROM conversations WHERE text IS NOT NULL), x AS (SELECT q.conv_id, q.turn, list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')) AS u, list_distinct(regexp_extract_all(lower(r.text), '[a-z0-9]+')) AS a FROM c q JOIN c r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 AND r.role = 'assistant' WHERE q.role = 'user')
SELECT conv_id, turn, round(CASE WHEN len(u) = 0 AND len(a) = 0 THEN 1 ELSE len(list_intersect(u, a)) / nullif(len(list_distinct(list_concat(u, a))), 0) END, 6) AS jaccard FROM x""")
def token_jaccard_turns(spark, sf_dir):
    """token_jaccard over every turn."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(scalar.token_jaccard(F.col("user"), F.col("assistant")), 6).alias("jaccard"))


@register("answer_metrics")
def answer_metrics(spark, sf_dir):
    d = _turns(spark, sf_dir).select("conv_id", "turn", F.col("assistant").alias("answer"), F.col("user").alias("expected_answer"), F.lit("answer").alias("action"))
    return paired.answer_metrics(d).drop("answer", "expected_answer", "action")


@register("request_dedup", """WITH r AS (SELECT sha256(text) AS prompt_sha256, text FROM conversations WHERE text IS NOT NULL) SELECT prompt_sha256, min(text) AS payload, count(*) AS assignments FROM r GROUP BY prompt_sha256""")
def request_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("text").alias("payload"), F.sha2("text", 256).alias("prompt_sha256"))
    return paired.requests(rows)


@register("reader_payloads", """WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
p AS (SELECT conv_id, '{"candidates":[' || string_agg('{"key":"' || printf('c%02d', k) || '","text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}', ',' ORDER BY printf('c%02d', k)) || '],"query":"q"}' AS payload FROM r GROUP BY conv_id)
SELECT conv_id, payload, sha256(payload) AS prompt_sha256 FROM p""")
def reader_payloads(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), "text", F.lit("q").alias("query_text"))
    return paired.payloads(rows, ["conv_id"], "query_text", "text")


@register("exposure_payloads", """WITH c AS (SELECT conv_id, printf('t%05d', turn) AS k, text FROM conversations WHERE text IS NOT NULL), u AS (SELECT conv_id, k, e FROM c, (VALUES ('withheld'), ('exposed')) x(e)),
p AS (SELECT u.conv_id || '|' || u.k AS unit_id, e AS exposure, '{"candidates":[' || coalesce(string_agg('{"candidate_key":"' || c.k || '","text":' || CAST(to_json(c.text) AS VARCHAR) || '}', ',' ORDER BY c.k) FILTER (WHERE e = 'exposed' OR c.k <> u.k), '') || '],"query":"q"}' AS payload FROM u JOIN c ON c.conv_id = u.conv_id GROUP BY u.conv_id, u.k, e)
SELECT unit_id, exposure, sha256(payload) AS prompt_sha256, length(payload) AS n_chars FROM p""")
def exposure_payloads(spark, sf_dir):
    """Every turn of a conversation as the candidate that is in or out."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.format_string("t%05d", "turn").alias("candidate_key"), "text")
    whole = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("candidate_key", "text"))).alias("candidates"))
    units = whole.select("conv_id", "candidates", F.explode("candidates.candidate_key").alias("candidate_key")).withColumn("query", F.lit("q"))
    return paired.request_payloads(units.withColumn("unit_id", F.concat_ws("|", "conv_id", "candidate_key"))).select("unit_id", "exposure", "prompt_sha256", F.length("payload").alias("n_chars"))


@register("ordered_requests", """WITH u AS (SELECT conv_id || '|' || e AS request_id FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES ('withheld'), ('exposed')) t(e)) SELECT request_id, sha256('5|m|' || request_id) AS order_key FROM u""")
def ordered_requests(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("unit_id")).distinct()
    return paired.ordered_requests(units, "5", "m").select("request_id", "order_key")


@register("paired_contrasts", f"""{LAB}, a AS (SELECT lang, source, 'm1' AS metric, avg(score) AS v FROM d GROUP BY ALL UNION ALL SELECT lang, source, 'm2', avg(quality) FROM d GROUP BY ALL) SELECT t.source, t.metric, t.lang AS treated, b.lang AS reference, round(t.v - b.v, 6) AS delta FROM a t JOIN a b ON b.source = t.source AND b.metric = t.metric AND ((t.lang = 'de' AND b.lang = 'en') OR (t.lang = 'fr' AND b.lang = 'en'))""")
def paired_contrasts(spark, sf_dir):
    rows = labelled(spark, sf_dir).groupBy("lang", "source").agg(F.avg("score").alias("m1"), F.avg("quality").alias("m2"))
    out = paired.contrasts(rows, "lang", ["source"], ["m1", "m2"], [("de", "en"), ("fr", "en")])
    return rounded(out.select("source", "metric", "treated", "reference", "delta"), "delta")


# --- aggregates, quantiles, text, quality


@register("macro_rows", f"{LAB}, p AS (SELECT source, lang, avg(score) AS score, avg(quality) AS quality FROM d GROUP BY ALL), a AS (SELECT * FROM p UNION ALL SELECT source, 'equal_stratum_macro', avg(score), avg(quality) FROM p GROUP BY source) SELECT source, lang, round(score, 6) AS score, round(quality, 6) AS quality FROM a")
def macro_rows(spark, sf_dir):
    per = labelled(spark, sf_dir).groupBy("source", "lang").agg(F.avg("score").alias("score"), F.avg("quality").alias("quality"))
    return rounded(aggregate.with_macro_row(per, ["source", "lang"], "lang", "equal_stratum_macro", ["score", "quality"]), "score", "quality")


@register("population_summary", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.5), 4) AS median, min(n_chars) AS low, max(n_chars) AS high, count(DISTINCT source) AS groups, round(count(n_chars) / count(*), 6) AS coverage FROM documents GROUP BY lang")
def population_summary(spark, sf_dir):
    return aggregate.population(table(spark, sf_dir, "documents"), ["lang"], "n_chars", "source").withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4), "coverage": F.round("coverage", 6)})


@register("quantile_conventions", "WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, round(quantile_cont(x, 0.95), 4) AS interpolated, round(max(CASE WHEN k = floor((n - 1) * 0.95::DOUBLE) THEN x END), 4) AS floored, round(max(CASE WHEN k = round_even((n - 1) * 0.95::DOUBLE, 0) THEN x END), 4) AS rounded FROM r GROUP BY l_returnflag")
def quantile_conventions(spark, sf_dir):
    return aggregate.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.95).withColumns({c: F.round(c, 4) for c in ("interpolated", "floored", "rounded")})


@register("usage_summary", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(value) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), l AS (SELECT event_type, max(CASE WHEN k = round_even((n - 1) * 50 / 100::DOUBLE, 0) THEN value END) AS value_p50, max(CASE WHEN k = round_even((n - 1) * 95 / 100::DOUBLE, 0) THEN value END) AS value_p95 FROM r GROUP BY ALL), c AS (SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, CAST(coalesce(sum(user_id % 7), 0) AS BIGINT) AS attempts, round(coalesce(sum(value), 0), 3) AS cost FROM events GROUP BY ALL) SELECT event_type, calls, attempts, cost, value_p50, value_p95 FROM c LEFT JOIN l USING (event_type)")
def usage_summary(spark, sf_dir):
    """AGG21, AGG28: calls, attempts and cost by type, and quantiles of what a call took."""
    calls = table(spark, sf_dir, "events").withColumn("tries", F.col("user_id") % 7)
    return aggregate.usage(calls, ["event_type"], {"attempts": "tries", "cost": "value"}, "value").withColumn("cost", F.round("cost", 3))


@register("seed_summary", "SELECT l_returnflag, l_linestatus, count(*) AS seeds, round(avg(q), 6) AS q_mean, round(coalesce(stddev_samp(q), 0), 6) AS q_std FROM (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY ALL")
def seed_summary(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_quantity").alias("q"))
    return rounded(aggregate.seed_summary(per, ["l_returnflag", "l_linestatus"], ["q"]), "q_mean", "q_std")


@register("duplicate_calls", "SELECT user_id, count(*) AS calls, count(DISTINCT sha256(event_type)) AS answers, count(DISTINCT event_type) > 1 AS differs, round(sum(value), 4) AS cost, round(sum(value) - max(value), 4) AS repeat_cost FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_calls(spark, sf_dir):
    return aggregate.duplicate_calls(table(spark, sf_dir, "events"), "user_id", "event_type", "value").withColumns({c: F.round(c, 4) for c in ("cost", "repeat_cost")})


@register("support_histogram", "WITH b AS (SELECT o_orderpriority, CAST(floor(o_totalprice / 50000) AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, bucket, n, CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY bucket) AS BIGINT) AS upto FROM b")
def support_histogram(spark, sf_dir):
    return aggregate.running_counts(table(spark, sf_dir, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 50000).alias("bucket")), ["o_orderpriority"], "bucket")


@register("continuation_gate", "WITH s AS (SELECT l_returnflag, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY ALL) SELECT bool_or(d > t) AS any_gain, bool_and(d > t) AS all_gain, bool_or(d > 0.05) AS any_level, bool_and(d > 0.05) AS all_level FROM s")
def continuation_gate(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return aggregate.gate(s, {"gain": F.col("d") > F.col("t"), "level": F.col("d") > 0.05})


@register("operating_curve", f"{LAB}, t AS (SELECT i / 20 AS threshold FROM range(21) x(i)), g AS (SELECT threshold, lang, avg(CAST(score >= threshold AS INT)) AS kept, count_if(score >= threshold AND toxic = 1) / nullif(count_if(score >= threshold), 0) AS risk FROM d, t GROUP BY ALL) SELECT round(threshold, 6) AS threshold, round(avg(kept), 6) AS kept, round(avg(risk), 6) AS risk FROM g GROUP BY threshold")
def operating_curve(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("threshold", F.col("i") / 20)
    kept = F.col("score") >= F.col("threshold")
    per = rows.groupBy("threshold", "lang").agg(F.avg(kept.cast("double")).alias("kept"), scalar.rate(F.count_if(kept & (F.col("toxic") == 1)), F.count_if(kept)).alias("risk"))
    return rounded(per.groupBy("threshold").agg(F.avg("kept").alias("kept"), F.avg("risk").alias("risk")), "threshold", "kept", "risk")


@register("text_tokens", r"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, sha256(array_to_string(t, ' ')) AS normalized FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+') AS t FROM documents)")
def text_tokens(spark, sf_dir):
    t = scalar.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("normalized"))


@register("text_functions", r'''SELECT doc_id, trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', ' ', 'g')) AS normalized, substr(sha256(doc_id || chr(0) || source), 1, 12) AS token, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS json_sha256, regexp_replace('x/' || source, '^[^/]*/', '') AS visible FROM documents''')
def text_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", scalar.normalize_disclosure(F.concat_ws(" / ", "source", "lang")).alias("normalized"), scalar.short_token("\0", 12, F.col("doc_id").cast("string"), F.col("source")).alias("token"), F.sha2(scalar.canonical_json(lang=F.col("lang"), doc_id=F.col("doc_id")), 256).alias("json_sha256"), status.visible_order(F.lit("memops"), F.concat(F.lit("x/"), "source")).alias("visible"))


@register("truncate_utf8")
def truncate_utf8(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalar.truncate_utf8(F.col("text"), 400).alias("head"))


@register("label_logic", "SELECT lang, count_if(p IS TRUE) AS yes, count_if(p IS FALSE) AS no, count_if(p IS NULL) AS unresolved FROM (SELECT d.lang, (d.lang = 'en') AND (l.toxic = 0) AND (CASE WHEN d.doc_id % 5 = 2 THEN NULL ELSE d.doc_id % 5 > 2 END) AS p FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)) GROUP BY lang")
def label_logic(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(labels(spark, sf_dir), "doc_id", "left")
    state = F.when(F.col("doc_id") % 5 == 2, F.lit(None).cast("boolean")).otherwise(F.col("doc_id") % 5 > 2)
    p = status.admissible_status(F.col("lang") == "en", F.col("toxic") == 0, state)
    return d.groupBy("lang").agg(F.count_if(p).alias("yes"), F.count_if(~p).alias("no"), F.count_if(p.isNull()).alias("unresolved"))


@register("corpus_status", "SELECT lang, s, count(*) AS n FROM (SELECT lang, CASE WHEN NOT (lang = 'en') THEN false WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 7 = 1 THEN NULL WHEN doc_id % 7 = 2 THEN false ELSE NOT (doc_id % 2 = 0 AND doc_id % 5 < 2) END AS s FROM documents) GROUP BY lang, s")
def corpus_status(spark, sf_dir):
    i = F.col("doc_id")
    s = status.corpus_status(F.col("lang") == "en", i % 7 == 0, i % 7 == 1, i % 7 == 2, i % 2 == 0, F.when(i % 5 < 2, "stale").otherwise("current"))
    return table(spark, sf_dir, "documents").select("lang", s.alias("s")).groupBy("lang", "s").agg(F.count("*").alias("n"))


@register("expectations", """SELECT 'duplicate orders' AS "check", count(*) AS violations FROM (SELECT o_orderkey FROM orders GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'lines without order', count(*) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) UNION ALL SELECT 'labels without document', count(*) FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))""")
def expectations(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "labels", "documents")}
    return quality.expectations({
        "duplicate orders": quality.duplicates(t["orders"], ["o_orderkey"]),
        "lines without order": quality.missing(t["lineitem"].select(F.col("l_orderkey").alias("k")), t["orders"].select(F.col("o_orderkey").alias("k")), ["k"]),
        "labels without document": quality.missing(t["labels"], t["documents"], ["doc_id"]),
    })


@register("value_drift", "WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem GROUP BY ALL), b AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) SELECT coalesce(a.k, b.k) AS k, round(a.v, 4) AS left_value, round(b.v, 4) AS right_value FROM a FULL JOIN b ON a.k = b.k WHERE NOT coalesce(abs(a.v - b.v) <= 0.01 * greatest(abs(a.v), abs(b.v), 1), a.v IS NULL AND b.v IS NULL)")
def value_drift(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")).alias("v"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return quality.drift(a, b, ["k"], "v", 0.01).withColumns({c: F.round(c, 4) for c in ("left_value", "right_value")})


@register("evidence_rows", "SELECT 'c1' AS claim_id, 'natural' AS family, CAST(NULL AS VARCHAR) AS population, source, CAST(NULL AS VARCHAR) AS contrast, 'mean_chars' AS metric, round(avg(n_chars), 4) AS estimate, CAST(NULL AS DOUBLE) AS ci95_lower, CAST(NULL AS DOUBLE) AS ci95_upper, count(*) AS n, CAST(NULL AS VARCHAR) AS notes FROM documents GROUP BY source")
def evidence_rows(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg("n_chars").alias("m"), F.count("*").alias("c"))
    return quality.evidence(per, claim_id="c1", family="natural", source=F.col("source"), metric="mean_chars", estimate=F.round("m", 4), n=F.col("c"))


@register("request_cost", "SELECT role, count(*) AS requests, CAST(sum(strlen(text)) AS BIGINT) AS bytes, round(sum((strlen(text) * 3.0 + 512 * 15.0) / 1e6), 6) AS cost_bound FROM conversations WHERE text IS NOT NULL GROUP BY role")
def request_cost(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("bytes", F.octet_length("text").cast("bigint"))
    return rounded(c.groupBy("role").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"), F.sum(quality.cost(F.col("bytes"), F.lit(512), 3.0, 15.0)).alias("cost_bound")), "cost_bound")


@register("sanitised_rows", "SELECT sha256('audit:' || doc_id) AS token, lang, n_chars FROM documents")
def sanitised_rows(spark, sf_dir):
    return quality.sanitised(table(spark, sf_dir, "documents"), "audit:", "doc_id", ["lang", "n_chars"])


@register("checkpoint_view", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def checkpoint_view(spark, sf_dir):
    return io.checkpoint_view(table(spark, sf_dir, "events"), "user_id", "event_id", "last").select("user_id", "event_id", "event_type")


@register("vector_stream")
def vector_stream(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return corrupt.vector_stream(rows, ["lang"], "doc_id", 1, "swap")
