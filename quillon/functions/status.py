"""Three-valued label expressions (PRJ1-14). NULL is unresolved; AND is Kleene's, which is Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies of labels.
RELEVANCE = ("required", "supportive", "not_useful", "unknown")
SCOPE = ("allowed", "disallowed", "unknown")
LIFECYCLE = ("current", "stale", "superseded", "unknown")
INTENT = ("current_state", "history", "unknown")
PAST = ("stale", "superseded")


def conjunction(*statuses: Column) -> Column:
    """PRJ1: False dominates, all True is True, else unknown."""
    return reduce(lambda a, b: a & b, statuses)


def lifecycle_compatible(state: Column, intent: Column) -> Column:
    """PRJ2: unknown on either side is NULL; current fits all; past states fit history only."""
    return F.when((state == "unknown") | (intent == "unknown"), F.lit(None).cast("boolean")).when(state == "current", F.lit(True)).otherwise(intent == "history")


def scope_status(scope: Column) -> Column:
    return F.when(scope == "unknown", F.lit(None).cast("boolean")).otherwise(scope == "allowed")


def admissible_status(scope_ok: Column, policy_ok: Column, lifecycle_ok: Column) -> Column:
    """PRJ3: independent of relevance."""
    return conjunction(scope_ok, policy_ok, lifecycle_ok)


def relevant_status(relevance: Column) -> Column:
    """PRJ4."""
    return F.when(relevance.isin("required", "supportive"), F.lit(True)).when(relevance == "not_useful", F.lit(False))


def usable_status(relevant: Column, admissible: Column) -> Column:
    """PRJ5."""
    return conjunction(relevant, admissible)


def allowed_for(purpose: Column, content_allowed: Column, trace_allowed: Column) -> Column:
    """PRJ6: the decision for a purpose."""
    return F.when(purpose == "content_disclosure", content_allowed).otherwise(trace_allowed)


def corpus_status(own_scope: Column | None, required: Column, uncertain: Column, distractor: Column, current_query: Column, state: Column) -> Column:
    """PRJ8: the order of the cases matters. own_scope None: the residual status, without the scope test."""
    full = F.when(required, F.lit(True)).when(uncertain, F.lit(None).cast("boolean")).when(distractor, F.lit(False)).otherwise(~(current_query & state.isin(*PAST)))
    return full if own_scope is None else F.when(~own_scope, F.lit(False)).otherwise(full)


def cell(relevant: Column, admissible: Column) -> Column:
    """PRJ9: the name of a cell of the 2 x 2 table."""
    return F.concat_ws("_", F.when(relevant, "relevant").otherwise("irrelevant"), F.when(admissible, "admissible").otherwise("inadmissible"))


def gold(condition: Column, allow: Column, block: Column) -> Column:
    """PRJ10."""
    return F.when(condition == "allow", allow).otherwise(block)


def drop_candidate(p_violation: Column, p_unknown: Column, v_threshold: Column, u_threshold: Column) -> Column:
    """PRJ11: no threshold keeps; below it keeps; else dropped unless too much is unknown."""
    return v_threshold.isNotNull() & F.coalesce(p_violation >= v_threshold, F.lit(False)) & F.coalesce(u_threshold.isNull() | (p_unknown <= u_threshold), F.lit(False))


def penalized(feasible: Column, value: Column, cost: float = 1.0) -> Column:
    """PRJ12: NULL if feasibility is; the value where there is one; else the cost."""
    return F.when(feasible.isNull(), F.lit(None).cast("double")).when(feasible & value.isNotNull(), value).otherwise(F.lit(cost))


def visible_order(source: Column, order: Column) -> Column:
    """PRJ13: what follows the first slash, except where orders are taken as they are."""
    return F.when(source == "rhelm", order).otherwise(F.regexp_replace(order, "^[^/]*/", ""))


def non_answer(action: Column) -> Column:
    """PRJ14."""
    return (action != "answer").cast("int")
