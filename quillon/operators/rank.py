"""Scoring and ranking (RNK1-8, RNK15). Ties break by memory_id; top-k cuts early in each task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import dot, finite, rate, tokens
from quillon.sources import io


def top_k(scored: DataFrame, k: int | None, keys: list[str] | None = None, score: str = "score") -> DataFrame:
    """RNK3: rank by (score desc, memory_id); a score that isn't finite raises."""
    keys = keys or ["query_id"]
    checked = F.when(finite(F.col(score)), F.col(score)).otherwise(F.raise_error(F.lit("scores must be finite")))
    ranked = scored.withColumn(score, checked).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "memory_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def dense(pairs: DataFrame, adjustment: Column | None = None) -> DataFrame:
    """RNK4: the inner product, with an additive adjustment."""
    score = dot(F.col("q_embedding"), F.col("m_embedding"))
    return pairs.withColumn("score", score if adjustment is None else score + adjustment)


def recency(pairs: DataFrame, gamma: float) -> DataFrame:
    """RNK8: dense plus gamma times the candidate's place between the oldest and the newest candidate."""
    w = Window.partitionBy("query_id")
    low, span = F.min("released_order").over(w), F.max("released_order").over(w) - F.min("released_order").over(w)
    return dense(pairs).withColumn("score", F.col("score") + gamma * F.coalesce(F.try_divide(F.col("released_order") - low, span), F.lit(0.0)))


def bm25(queries: DataFrame, candidates: DataFrame, pairs: DataFrame, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """RNK6: pairs (query_id, memory_id) with a BM25 score over each query's own candidates; no shared term gives 0.

    queries: query_id, text; candidates: memory_id, text. Documents are tokenised once. Document
    frequencies are counted per query over its candidates, as its support may differ from another's.
    """
    tf = candidates.select("memory_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("memory_id", "term").agg(F.count("*").alias("tf"))
    length = candidates.select("memory_id", F.size(tokens(F.col("text"))).alias("dl"))
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    support = pairs.select("query_id", "memory_id").join(length, "memory_id")
    sizes = support.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = terms.join(tf, "term").join(support, ["query_id", "memory_id"])
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = hits.join(df, ["query_id", "term"]).join(sizes, "query_id").groupBy("query_id", "memory_id").agg(F.sum(weight).alias("score"))
    return pairs.drop("score").join(scores, ["query_id", "memory_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def rrf(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """RNK7: 1 / (k + rank) summed over two full rankings of the same pairs."""
    a = top_k(first, None).select("query_id", "memory_id", F.col("rank").alias("r1"))
    c = top_k(second, None).select("query_id", "memory_id", F.col("rank").alias("r2"))
    return a.join(c, ["query_id", "memory_id"]).withColumn("score", 1 / (k + F.col("r1")) + 1 / (k + F.col("r2")))


# A cell meets at most BLOCK queries (or a block) with SLICE memories (or a slice); a key has up to CELLS of either before they grow to that.
BLOCK, SLICE, CELLS = 2048, 1 << 16, 16
FEW = 1 << 19  # rows of the cells' best that a task ranks
COPIES = 1 << 17  # rows that a task makes for the cells
LEAST = np.finfo(np.float64).min
NOISE = 1e-12  # a product's sum in another order differs by less, of a score of size 1


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    if lists.null_count or len(set(lists.value_lengths().to_numpy(zero_copy_only=False).tolist())) > 1:
        raise ValueError("vectors differ in dimension")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


class _Best:
    """The k best of some rows, with ties, of columns that come in chunks; what falls below a row's k-th score goes when much has gathered."""

    def __init__(self, rows: int, k: int):
        self.k, self.least, self.rows, self.columns, self.scores, self.most, self.count = k, np.full(rows, LEAST), [], [], [], 4 * k * rows, 0

    def add(self, scores: np.ndarray, at: int, columns: np.ndarray) -> None:
        own = scores if len(columns) == scores.shape[1] else scores[:, columns]
        if own.shape[1] > self.k and self.least[0] == LEAST:
            self._raise(slice(None), np.partition(own, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(own >= self.least[:, None])
        for x, v in ((self.rows, i), (self.columns, at + columns[j]), (self.scores, own[i, j])):
            x.append(v)
        self.count += len(i)
        if self.count > self.most:
            self.found()

    def _raise(self, rows: slice | np.ndarray, least: np.ndarray) -> None:
        self.least[rows] = np.maximum(self.least[rows], np.maximum(least - NOISE * np.maximum(1, np.abs(least)), LEAST))

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of what is left."""
        if not self.rows:
            return np.zeros(0, int), np.zeros(0, int)
        i, j, v = (np.concatenate(x) for x in (self.rows, self.columns, self.scores))
        order = np.lexsort((-v, i))
        first, n = np.searchsorted(i[order], np.arange(len(self.least))), np.bincount(i, minlength=len(self.least))
        full = np.flatnonzero(n >= self.k)
        self._raise(full, v[order][first[full] + self.k - 1])
        keep = v >= self.least[i]
        self.rows, self.columns, self.scores, self.count = [i[keep]], [j[keep]], [v[keep]], int(keep.sum())
        return self.rows[0], self.columns[0]


def _cell(k: int, arms: int, block: int, chunk: int, keyed: bool):
    """One block of queries with one slice of the memories of their key."""
    names = ["query_id", "memory_id", "score", "held", *(["key"] if keyed else [])]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.float64, np.int64)]
        if left.num_rows and right.num_rows:
            (q_ids, a), (m_ids, b) = ((t.column(f"{x}_id").to_numpy(), matrix(t.column(f"{x[0]}_embedding"))) for t, x in ((left, "query"), (right, "memory")))
            if a.shape[1] != b.shape[1]:
                raise ValueError("vectors differ in dimension")
            classes, facts = left.column("fact").to_numpy(), right.column("fact")
            facts = matrix(facts).astype(np.int64) if pa.types.is_list(facts.type) else facts.to_numpy()
            themselves = np.flatnonzero(np.isin(m_ids, q_ids))
            for c in np.unique(classes):
                of_class = np.flatnonzero(classes == c)
                inside = [facts[:, arm] == c if facts.ndim > 1 else (facts >> (int(c) * arms + arm)) & 1 == 1 for arm in range(arms)]
                for lo in range(0, len(of_class), block):
                    rows = of_class[lo : lo + block]
                    best = [_Best(len(rows), k) for _ in range(arms)]
                    for at in range(0, len(b), chunk):
                        scores = a[rows] @ b[at : at + chunk].T
                        if not np.isfinite(scores).all():
                            raise ValueError("scores must be finite")
                        same = themselves[slice(*np.searchsorted(themselves, (at, at + chunk)))]
                        i, j = np.nonzero(q_ids[rows][:, None] == m_ids[same])
                        scores[i, same[j] - at] = -np.inf
                        for kept, there in zip(best, inside, strict=True):
                            kept.add(scores, at, np.flatnonzero(there[at : at + chunk]))
                    parts = [(*kept.found(), arm) for arm, kept in enumerate(best)]
                    codes, bits = np.concatenate([i * len(b) + j for i, j, _ in parts]), np.concatenate([np.full(len(i), 1 << arm) for i, _, arm in parts])
                    if not len(codes):
                        continue
                    order = np.argsort(codes, kind="stable")
                    once, first = np.unique(codes[order], return_index=True)
                    i, j = rows[once // len(b)], once % len(b)
                    # Each by itself, so that equal vectors have equal scores wherever they stood.
                    exact = [np.einsum("ij,ij->i", a[i[x : x + 4096]], b[j[x : x + 4096]]) for x in range(0, len(i), 4096)]
                    for x, v in zip(out, (q_ids[i], m_ids[j], np.concatenate(exact), np.bitwise_or.reduceat(bits[order], first)), strict=True):
                        x.append(v)
        columns = [np.concatenate(x) for x in out]
        key = [pa.array([left.column("key")[0].as_py()] * len(columns[0]) if len(columns[0]) else [], pa.string())] if keyed else []
        return pa.Table.from_arrays([*(pa.array(x, t) for x, t in zip(columns, types, strict=False)), *key], names=names)

    return run


def _spread(rows: DataFrame, by: str, copies: float) -> DataFrame:
    """rows, of which so many copies are made next, in tasks that make COPIES each; few stay where they are."""
    return rows if copies <= COPIES else rows.repartition(-(-int(copies) // COPIES), by)


def blocked_dense(queries: DataFrame, memories: DataFrame, k: int, *, arms: int = 1, block: int = 1024, chunk: int = 4096, slice_rows: int = 1 << 14, keyed: bool = False) -> DataFrame:
    """RNK15: exact dense top-k of several arms by matrix products, without a row per pair: query_id, memory_id, score, held.

    queries: key, query_id, fact (the query's class, from 0), q_embedding; memories: key, memory_id, fact, m_embedding.
    A query meets the memories of its key but itself; bit class * arms + arm of a memory's fact tells if
    that arm's support holds it for that class, or, where fact is an array, its place `arm` has the class that
    the arm's support holds it for; bit `arm` of `held` if it is among the arm's k best there. With `keyed` rows
    tell their key, where a query stands under several.

    A key's queries are dealt into blocks and its memories into slices, and each block meets each slice in a cell
    of its own, which multiplies `block` queries with `chunk` memories at a time and passes on each arm's k best and their
    ties; those few meet in one ranking. Neither a hot key nor many queries gather in a cell. Rows move once for each
    cell, so blocks and slices, small on little input, grow with it to BLOCK and SLICE, and the number of cells stays low.
    The rows come dealt by query, over as many tasks as the cells and at most FEW of them to a task on average, so a ranking by query moves them no more,
    and its tasks grow in number, not in size.
    """
    per = [rows.groupBy("key").agg(F.count("*").alias(n)) for rows, n in ((queries, "n_q"), (memories, "n_m"))]

    def parts(n: str, least: int, most: int) -> Column:
        return F.ceil(F.col(n) / F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.col(n) / CELLS)))).cast("int")

    sizes = per[0].join(per[1], "key").select("key", "n_q", "n_m", parts("n_q", block, BLOCK).alias("blocks"), parts("n_m", slice_rows, SLICE).alias("slices"))
    sizes = io.written(sizes, io.scratch(queries.sparkSession, "blocks"))  # a row a key
    passed = F.col("n_q").cast("double") * F.least(F.col("n_m").cast("double"), F.col("slices").cast("double") * k * arms)
    totals = [F.col("blocks").cast("bigint") * F.col("slices"), F.col("n_q").cast("double") * F.col("n_m"), passed, F.col("n_q") * F.col("slices"), F.col("n_m") * F.col("blocks")]
    met, pairs, few, of_queries, of_memories = (x or 0 for x in sizes.agg(*[F.sum(x) for x in totals]).first())
    tasks = max(1, min(met, 64 + int(pairs / (1 << 24))))
    cell, dealt = ["key", "block", "slice"], F.broadcast(sizes)
    fact = F.col("fact").cast("array<bigint>" if memories.schema["fact"].dataType.typeName() == "array" else "bigint")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own_key = F.concat("key", F.lit("")).alias("key")  # both sides may come of one table
    q = _spread(queries.join(dealt, "key"), "query_id", of_queries).select(own_key, "query_id", F.col("fact").cast("bigint"), "q_embedding", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), every("slices").alias("slice"))
    m = _spread(memories.join(dealt, "key"), "memory_id", of_memories).select("key", "memory_id", fact.alias("fact"), "m_embedding", F.pmod(F.xxhash64("memory_id"), F.col("slices")).cast("int").alias("slice"), every("blocks").alias("block"))
    schema = "query_id bigint, memory_id bigint, score double, held bigint" + (", key string" if keyed else "")
    best = q.repartition(tasks, *cell).groupBy(*cell).cogroup(m.groupBy(*cell)).applyInArrow(_cell(k, arms, block, chunk, keyed), schema)
    return best.repartition(max(tasks, -(-int(few) // FEW)), "query_id")
