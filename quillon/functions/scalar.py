"""Scalar functions: guarded rates, vectors, hashes, text (RNK1-2, RNK5, COR1-2, STA16, FN1-14)."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def rate(numerator: Column, denominator: Column) -> Column:
    """FN7: NULL where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """RNK1: the exact inner product; vectors of different length raise."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors differ in dimension")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """RNK2: a zero vector raises."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.raise_error(F.lit("zero vector")))


def cosine(a: Column, b: Column) -> Column:
    """RNK2."""
    return dot(a, b) / (norm(a) * norm(b))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & ~x.isin(float("inf"), float("-inf"))


def identity(*parts: Column | str) -> Column:
    """Parts joined by a zero byte."""
    return F.concat_ws("\0", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def identity_seed(*parts: Column | str) -> Column:
    """STA16: the first 64 bits of SHA-256, as a decimal."""
    return F.conv(F.substring(F.sha2(identity(*parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def uniform(*parts: Column | str) -> Column:
    """COR1: a number in [0, 1) that hangs on identity only."""
    return identity_seed(*parts).cast("double") / F.lit(float(2**64))


def draw(n: Column, *parts: Column | str) -> Column:
    """An index 0 .. n-1 by identity."""
    return F.least(F.floor(uniform(*parts) * n), n - 1).cast("int")


def tokens(text: Column) -> Column:
    """RNK5: runs of letters, numbers and underscores, folded in case."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def normalize_answer(text: Column) -> Column:
    """FN2."""
    return F.array_join(tokens(text), " ")


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def normalize_disclosure(text: Column) -> Column:
    """FN1: NFKC and case folding (in Python only where a text isn't ASCII), the rest of [^a-z0-9] to single spaces."""
    folded = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(_compatible(text))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def disclosed(answer: Column, markers: Column) -> Column:
    """CFX13: any marker between token boundaries of the answer; both normalised."""
    return F.exists(markers, lambda m: (m != "") & F.contains(F.concat(F.lit(" "), answer, F.lit(" ")), F.concat(F.lit(" "), m, F.lit(" "))))


def truncate_utf8(text: Column, n: int) -> Column:
    """FN3: the longest prefix of whole characters within n bytes."""

    @F.pandas_udf("string")
    def cut(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else t.encode()[:n].decode(errors="ignore"))

    return F.when(F.octet_length(text) <= n, text).when(text.rlike(r"^\p{ASCII}*$"), F.substring(text, 1, n)).otherwise(cut(text))


def canonical_json(**fields: Column) -> Column:
    """FN4: keys sorted, nulls kept, compact."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def short_token(separator: str, length: int, *parts: Column) -> Column:
    """FN6."""
    return F.substring(F.sha2(F.concat_ws(separator, *parts), 256), 1, length)


def token_jaccard(a: Column, b: Column) -> Column:
    """CFX4: over sets of [a-z0-9]+; two empty sets give 1."""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))) for c in (a, b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(rate(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))))


def sequence_similarity(a: Column, b: Column, *, autojunk: bool) -> Column:
    """CFX5 (autojunk off) and the fuzzy part of NAT3 (on): the Ratcliff-Obershelp ratio."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q, autojunk=autojunk).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def argmax_label(labels: list[str], *p: Column) -> Column:
    """The first label of the greatest probability."""
    own = F.array(*p)
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(own, F.array_max(own)).cast("int"))


def sums_to_one(*p: Column, tolerance: float = 1e-4) -> Column:
    """FN14: a probability vector's check."""
    return (F.abs(sum(p[1:], p[0]) - 1) <= tolerance) & F.least(*p).between(0, 1) & F.greatest(*p).between(0, 1)
