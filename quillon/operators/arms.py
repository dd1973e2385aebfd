"""Route arms (ARM1-27) as compositions of supports and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.status import INTENT, LIFECYCLE
from quillon.operators import cluster, rank, support

# Supports of the dense arms, by arm; None is the global support.
DENSE = {
    "global_dense": None,
    "namespace_dense": lambda: support.in_namespace(),
    "query_agnostic_current_only": lambda: support.in_namespace() & support.current_only(),
    "namespace_policy_only": lambda: support.in_namespace() & support.policy_allows(),
    "namespace_lifecycle_only": lambda: support.in_namespace() & support.lifecycle_allows(),
    "released_intent_lifecycle_upper_bound": lambda: support.in_namespace() & support.released_v1(),
    "released_governance_oracle_v2": lambda: support.in_namespace() & support.governance_v2(),
}


def dense_arm(pairs: DataFrame, arm: str, top_k: int = 100) -> DataFrame:
    """ARM2, ARM5-10."""
    rows = pairs if DENSE[arm] is None else pairs.where(DENSE[arm]())
    return rank.top_k(rank.dense(rows), top_k).withColumn("setting_id", F.lit(arm))


def dense_arms(pairs: DataFrame, arms: list[str], top_k: int = 100) -> DataFrame:
    """Several dense arms in one pass: a pair's score is computed once and counts in every arm whose support holds it."""
    scored = rank.dense(pairs)
    held: list[Column] = [F.when(F.lit(True) if DENSE[a] is None else DENSE[a](), F.lit(a)) for a in arms]
    rows = scored.withColumn("setting_id", F.explode(F.array_compact(F.array(*held))))
    return rank.top_k(rows.drop("q_embedding", "m_embedding"), top_k, ["setting_id", "query_id"])


def route_stats(pairs: DataFrame, arms: list[str]) -> DataFrame:
    """candidates_scored and route_width of the direct arms, for every query."""
    held: list[Column] = [F.count_if(F.lit(True) if DENSE[a] is None else DENSE[a]()).alias(a) for a in arms]
    wide = pairs.groupBy("query_id", "source", "group_id").agg(*held)
    long = wide.select("query_id", "source", "group_id", F.explode(F.array(*[F.struct(F.lit(a).alias("setting_id"), F.col(a).alias("candidates_scored")) for a in arms])).alias("x"))
    return long.select("x.setting_id", "source", "group_id", "query_id", "x.candidates_scored", (F.col("x.candidates_scored") > 0).cast("int").alias("route_width"))


# A query's class, by which a memory's place in a support can be told ahead: its intent and purpose.
CLASSES = [(i, p) for i in INTENT for p in ("content_disclosure", "operation_trace")]


def query_class() -> Column:
    """The place in CLASSES; purposes other than content disclosure count as one."""
    intent = F.coalesce(*[F.when(F.col("intent") == x, F.lit(2 * k)) for k, x in enumerate(INTENT)], F.lit(2 * INTENT.index("unknown")))
    return intent + F.when(F.col("purpose") == "content_disclosure", 0).otherwise(1)


def with_support_bits(memories: DataFrame, names: list[str]) -> DataFrame:
    """memories with `fact`: bit class * len(names) + arm tells if the arm's support holds the memory for queries of the class in its namespace.

    The supports are asked once for each combination of the closed vocabularies, and memories look it up.
    """
    if len(CLASSES) * len(names) > 62:
        raise ValueError("too many arms for one pass")
    flags = (True, False, None)
    rows = [(state, content, trace, *asked, c) for state in LIFECYCLE for content in flags for trace in flags for c, asked in enumerate(CLASSES)]
    table = memories.sparkSession.createDataFrame(rows, "lifecycle_state string, content_allowed boolean, trace_allowed boolean, intent string, purpose string, class int").withColumns({"namespace": F.lit(""), "memory_namespace": F.lit("")})
    bits = sum((F.when(F.lit(True) if DENSE[a] is None else DENSE[a](), F.expr(f"shiftleft(1L, class * {len(names)} + {k})")).otherwise(0) for k, a in enumerate(names)), F.lit(0))
    known = table.groupBy(F.col("lifecycle_state").alias("s"), F.col("content_allowed").alias("c"), F.col("trace_allowed").alias("t")).agg(F.sum(bits).alias("fact"))  # 36 rows
    same = (F.col("lifecycle_state") == F.col("s")) & F.col("content_allowed").eqNullSafe(F.col("c")) & F.col("trace_allowed").eqNullSafe(F.col("t"))
    out = memories.join(F.broadcast(known), same, "left").drop("s", "c", "t")
    return out.withColumn("fact", F.coalesce("fact", F.raise_error(F.lit("unknown lifecycle state")).cast("bigint")))


def pooled_arms(queries: DataFrame, memories: DataFrame, names: list[str], top_k: int = 100) -> DataFrame:
    """ARM2, ARM5-10 where all queries share their candidates: setting_id, query_id, memory_id, rank, score, by blocks and without a row a pair.

    Arms other than the global one meet memories of their own namespace only, in one pass for all.
    """
    found = []
    for own in ([a for a in names if DENSE[a] is None], [a for a in names if DENSE[a] is not None]):
        if own:
            key = (lambda c: F.lit("")) if DENSE[own[0]] is None else F.col
            q = queries.select(key("namespace").alias("key"), "query_id", query_class().alias("fact"), "q_embedding")
            m = with_support_bits(memories, own).select(key("memory_namespace").alias("key"), "memory_id", "fact", "m_embedding")
            best = rank.blocked_dense(q, m, top_k, arms=len(own))
            named = F.array_compact(F.array(*[F.when(F.col("held").bitwiseAND(1 << k) != 0, F.lit(a)) for k, a in enumerate(own)]))
            found.append(rank.top_k(best.withColumn("setting_id", F.explode(named)).drop("held"), top_k, ["setting_id", "query_id"]))
    return reduce(DataFrame.unionByName, found)


def pooled_stats(queries: DataFrame, memories: DataFrame, names: list[str]) -> DataFrame:
    """route_stats where all queries share their candidates, from counts by kind of memory: no row a pair."""
    kinds = ["memory_namespace", "lifecycle_state", "content_allowed", "trace_allowed"]
    bits = with_support_bits(memories.select("memory_id", *kinds), names)
    counts = bits.groupBy("memory_namespace", "fact").agg(F.count("*").alias("n"))  # a row a kind
    asked = queries.select("query_id", "source", "group_id", "namespace", query_class().alias("class"))
    # The query itself as a memory; in no namespace arm if it lies in another namespace than it asks for.
    own = asked.join(bits.select(F.col("memory_id").alias("query_id"), F.col("memory_namespace").alias("own_namespace"), F.col("fact").alias("fact_there")), "query_id", "left")
    own = own.withColumn("own_fact", F.when(F.col("own_namespace") == F.col("namespace"), F.col("fact_there")))

    def holds(fact: str, k: int) -> Column:
        return F.coalesce(F.col(fact).bitwiseAND(F.expr(f"shiftleft(1L, cast(class * {len(names)} + {k} as int))")) != 0, F.lit(False))

    # What a class finds in each namespace; the query itself isn't a candidate.
    classes = asked.select("namespace", "class").distinct().join(counts, F.col("namespace") == F.col("memory_namespace"))
    in_namespace = classes.groupBy("namespace", "class").agg(*[F.sum(F.when(holds("fact", k), F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(names))])
    total = memories.agg(F.count("*").alias("total"))  # one row
    wide = own.join(in_namespace, ["namespace", "class"], "left").crossJoin(F.broadcast(total))
    scored = [F.col("total") - F.col("fact_there").isNotNull().cast("int") if DENSE[a] is None else F.coalesce(f"n{k}", F.lit(0)) - holds("own_fact", k).cast("int") for k, a in enumerate(names)]
    long = wide.select("query_id", "source", "group_id", F.explode(F.array(*[F.struct(F.lit(a).alias("setting_id"), c.cast("bigint").alias("candidates_scored")) for a, c in zip(names, scored, strict=True)])).alias("x"))
    return long.select("x.setting_id", "source", "group_id", "query_id", "x.candidates_scored", (F.col("x.candidates_scored") > 0).cast("int").alias("route_width"))


def corrupted_arms(rows: DataFrame, arms: list[str], top_k: int = 100) -> tuple[DataFrame, DataFrame]:
    """COR11: rankings and route statistics of dense arms under every corruption; setting_id is <arm>|<corruption_id>.

    rows: pairs under their corruptions, with the score, which no corruption touches. An arm with the global
    support reads none of what is corrupted; it is left to the caller to rank it once.
    """
    held: list[Column] = [F.when(DENSE[a](), F.lit(a)) for a in arms]
    keys = ["setting_id", "query_id"]
    named = rows.withColumn("arm", F.explode(F.array_compact(F.array(*held)))).withColumn("setting_id", F.concat_ws("|", "arm", "corruption_id"))
    ranked = rank.top_k(named.select(*keys, "memory_id", "score"), top_k, keys)
    wide = rows.groupBy("corruption_id", "query_id", "source", "group_id").agg(*[F.count_if(DENSE[a]()).alias(a) for a in arms])
    long = wide.select("corruption_id", "query_id", "source", "group_id", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("candidates_scored")) for a in arms])).alias("x"))
    runs = long.select(F.concat_ws("|", "x.arm", "corruption_id").alias("setting_id"), "source", "group_id", "query_id", "x.candidates_scored", (F.col("x.candidates_scored") > 0).cast("int").alias("route_width"))
    return ranked, runs


def global_bm25(queries: DataFrame, memories: DataFrame, pairs: DataFrame, top_k: int = 100) -> DataFrame:
    """ARM1."""
    return rank.top_k(rank.bm25(queries, memories, pairs), top_k)


def global_rrf(queries: DataFrame, memories: DataFrame, pairs: DataFrame, top_k: int = 100) -> DataFrame:
    """ARM3."""
    keys = pairs.select("query_id", "memory_id")
    return rank.top_k(rank.rrf(rank.bm25(queries, memories, keys), rank.dense(pairs)), top_k)


def global_recency_dense(pairs: DataFrame, gamma: float = 0.1, top_k: int = 100) -> DataFrame:
    """ARM4."""
    return rank.top_k(rank.recency(pairs, gamma), top_k)


def threshold_router(pairs: DataFrame, memories: DataFrame, *, theta: float = 0.8, top_l: int = 1, top_k: int = 100, **sizes: int) -> DataFrame:
    """ARM11. memories: those that clusters are formed of, none of them a query."""
    found = cluster.clusters(memories, cluster.threshold_rule(theta), **sizes)
    return rank.top_k(rank.dense(cluster.route(pairs.where(support.in_namespace()), found, top_l=top_l, theta=theta)), top_k)


def cluster_router(pairs: DataFrame, memories: DataFrame, *, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.5, tau: float = 0.1, tau_new: float = 0.4, top_l: int = 1, top_k: int = 100, **sizes: int) -> DataFrame:
    """ARM12. memories: those that clusters are formed of, none of them a query."""
    found = cluster.clusters(memories, cluster.size_aware_rule(alpha=alpha, beta=beta, gamma=gamma, tau=tau, tau_new=tau_new), **sizes)
    return rank.top_k(rank.dense(cluster.route(pairs.where(support.in_namespace()), found, top_l=top_l, beta=beta, gamma=gamma, tau=tau)), top_k)


def pooled_threshold_router(queries: DataFrame, memories: DataFrame, *, theta: float = 0.8, top_l: int = 1, top_k: int = 100, **sizes: int) -> DataFrame:
    """ARM11 where all queries share their candidates, memories that clusters are formed of and none of which is a query: no row a pair."""
    found = cluster.clusters(memories, cluster.threshold_rule(theta), **sizes)
    return cluster.routed(queries, memories, found, top_k, top_l=top_l, theta=theta)


def pooled_cluster_router(queries: DataFrame, memories: DataFrame, *, alpha: float = 1.0, beta: float = 1.0, gamma: float = 0.5, tau: float = 0.1, tau_new: float = 0.4, top_l: int = 1, top_k: int = 100, **sizes: int) -> DataFrame:
    """ARM12 likewise."""
    found = cluster.clusters(memories, cluster.size_aware_rule(alpha=alpha, beta=beta, gamma=gamma, tau=tau, tau_new=tau_new), **sizes)
    return cluster.routed(queries, memories, found, top_k, top_l=top_l, beta=beta, gamma=gamma, tau=tau)


def post_filters(ranked: DataFrame, depths: list[int], limit: int) -> DataFrame:
    """ARM25-27: one global ranking (with namespace and memory_namespace), the namespace mask over its first d ranks, then the cut."""
    return support.rerank(ranked.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).where((F.col("rank") <= F.col("depth")) & support.in_namespace()), ["depth", "query_id"], limit)


def natural_gates(frozen: DataFrame, threshold: float) -> DataFrame:
    """ARM13-17: delete-only gates over frozen rankings, the original rank kept. frozen: arm (global or namespace), policy_ok, admissible, verifier."""
    own = F.col("arm") == "namespace"
    gates = [F.when(~own, "global_dense"), F.when(own, "namespace_dense"), F.when(own & support.not_denied(F.col("policy_ok")), "namespace_policy_gate"), F.when(own & (F.col("verifier") < threshold), "namespace_text_verifier"), F.when(own & support.not_denied(F.col("admissible")), "released_field_oracle")]
    return frozen.withColumn("setting_id", F.explode(F.array_compact(F.array(*gates))))


def inferred_gates(frozen: DataFrame) -> DataFrame:
    """ARM18-21: the inferred arms over frozen namespace rankings, the original rank kept. frozen: admissible, p_violation, p_unknown, and the thresholds v and u."""
    kept = {"namespace_dense": F.lit(True), "released_oracle": support.not_denied(F.col("admissible")), **support.inferred(F.col("p_violation"), F.col("p_unknown"), F.col("v"), F.col("u"))}
    return frozen.withColumn("setting_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(a)) for a, c in kept.items()]))))
