"""Mixture-controlled packing: deficit round-robin over one queue of documents a source.

Each window gives source s a credit of its target share of `window` tokens. A queue sends the documents
whose tokens its credit covers, and carries the rest, its deficit, to the next window. With P(x) the
tokens of a queue up to and with document x, the credits after window w are floor(share * window * (w + 1)),
so x leaves in the first window w whose credits reach P(x). This is the round-robin in closed form: the
deficit at the start of any window, and so of any partition, follows from w alone, and no task has to
wait for another. Shares are whole numbers over a whole number, and turns are computed in decimals
without rounding.

Documents in the order (window, source, place in the queue) form one stream of tokens; sequence k is the
stream's tokens from k * length to (k + 1) * length. Only the last sequence can be short, and is padded
unless it is a power of two long.

The two running sums (along each queue, and along the stream) are taken over range partitions: sums
within a partition, plus one row a partition and source for what lies before. No queue is gathered in a
task, however many documents its source has. Token ids are written once, 16 bits each, to a file a task,
and stay there; the plan is a few numbers a document, and finds the ids by file and place.

Targets are token shares by source, EQUAL (the same for each source) or None (each source's share of all
tokens, so that all queues end together). A queue that has run dry gets no more credit: the others go on in
the proportions that they have among themselves, so their documents fill the sequences. Sources without a
target, or with 0, are sent after all others, one after the other.

Defined results: null and empty texts hold the end id only; null sources are one queue; null identifiers
and repeated rows are documents of their own; an empty table gives an empty result; other columns are
not read. Targets that are negative or all 0 are refused.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm._common import Scratch, checkpointed, filesystem, scratch, uncheckpointed, written

MEMO, KEPT, LONG = 1 << 19, 1 << 16, 64  # entries of a memo before it is cut, entries it is cut to, and characters of the longest
PLAIN = r"[!-~\u00A1-\u024F]+"  # Latin without blanks and combining marks: in normal form already, and lower-cased letter by letter
EQUAL = "equal"
SCALE = 10**9  # targets are rounded to so many parts
LAST = 2**62  # the turn of sources without a target
STORED = "row bigint, doc_id bigint, source string, n bigint, file string, start bigint"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def _byte_letters() -> list[str]:
    """The letter that byte-level models write for each byte: visible Latin-1 characters for themselves, the others from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in seen]
    return [chr(b) if b in seen else chr(256 + rest.index(b)) for b in range(256)]


class _Memo(dict):
    """Answers that are worked out where they are missing; `learn` decides what is kept."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        return self.learn(key)

    def cut(self) -> None:
        """Keeps what came first, which is what comes most."""
        first = list(islice(self.items(), KEPT))
        self.clear()
        self.update(first)


class Words:
    """Token ids of texts by a tokenizer that never joins across a blank, word by word with two memos.

    `pieces` holds the ids of the tokenizer's own pre-tokens (lower case, letters apart from marks and
    digits), which are far fewer than words as they stand in texts; `memo` those of such words. Latin words
    are lower-cased and split here, and only new pre-tokens go to the tokenizer's model; all other words go
    through the tokenizer as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.memo, self.pieces = _Memo(self._word), _Memo(self._piece)
        self.blank = regex.compile(r"[ \n\t\r]").split
        self.plain = regex.compile(PLAIN).fullmatch
        self.split = regex.compile(next(x["pattern"]["Regex"] for x in json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")).findall
        self.letters = dict(enumerate(_byte_letters()))
        self.of_model = self.tokenizer.model.tokenize

    def _piece(self, x: str) -> bytes:
        ids = [t.id for t in self.of_model(x if x.isascii() else x.encode().decode("latin-1").translate(self.letters))]
        out = struct.pack(f"<{len(ids)}H", *ids)
        if len(x) <= LONG:
            self.pieces[x] = out
        return out

    def _word(self, w: str) -> bytes:
        if self.plain(w) and "<|" not in w:  # special tokens begin so
            low = w.lower()
            out = self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, self.split(low)))
        else:
            out = np.asarray(self.tokenizer.encode_batch_fast([w], add_special_tokens=False)[0].ids, "<u2").tobytes()
        if len(w) <= LONG:
            self.memo[w] = out
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        for known in (self.memo, self.pieces):
            if len(known) > MEMO:
                known.cut()
        of_word = self.memo.__getitem__
        return [b"".join(map(of_word, self.blank(x) if "\t" in x or "\r" in x else x.replace("\n", " ").split(" "))) for x in texts]


    def rest(self) -> None:
        self.memo.cut()
        self.pieces.cut()


@lru_cache(2)
def words_of(path: str) -> Words:
    """Kept with what its memos hold at rest for the next task of the same process."""
    return Words(path)


def _store(root: str, path: str, end: int):
    types = (pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = words_of(path), np.array([end], "<u2").tobytes()
        at, base = filesystem(root)
        name, out, start = f"{uuid.uuid4().hex}.ids", None, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for own in words.encode([x or "" for x in part.column(3).to_pylist()]):
                    if out is None:
                        at.create_dir(base, recursive=True)
                        out = at.open_output_stream(f"{base}/{name}")
                    out.write(own + last)
                    rows.append((len(own) // 2 + 1, name, start))
                    start += len(own) // 2 + 1
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["row", "doc_id", "source", "n", "file", "start"])
        if out is not None:
            out.close()
        words.rest()

    return run


def tokenized(docs: DataFrame, root: str, path: str, *, end: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of row (unique), doc_id, source, n, and where the ids are with the end id: file below `root`, and start in ids."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_store(root, path, end), STORED)


def _running(rows: DataFrame, order: list[str], key: str | None, out: str) -> tuple[DataFrame, DataFrame]:
    """rows with the sum of n up to and with each, along `order`, for each key or for all; and the checkpoint that they are read from."""
    part = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    by = ["__part"] if key is None else ["__part", key]
    names = part.columns

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: dict[object, int] = {}
        for batch in batches:
            n = batch.column(names.index("n")).to_numpy()
            keys = batch.column(names.index(key)).to_pylist() if key else None
            total = np.empty(len(n), np.int64)
            cuts = [0, len(n)] if keys is None else [0, *(i for i in range(1, len(n)) if keys[i] != keys[i - 1]), len(n)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    k = keys[a] if keys else None
                    total[a:b] = np.cumsum(n[a:b]) + run.get(k, 0)
                    run = {k: int(total[b - 1])}  # the order has a key's rows together
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*names, out])

    local = part.mapInArrow(sums, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema) + f", {out} bigint")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1) if key is None else Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.groupBy(*by).agg(F.sum("n").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")  # a row a partition (and key)
    on = F.col("p.__part") == F.col("o.__part")
    if key is not None:
        on &= F.col(f"p.{key}").eqNullSafe(F.col(f"o.{key}"))
    return local.alias("p").join(offsets.alias("o"), on).select(*[f"p.{c}" for c in names if c != "__part"], (F.col(f"p.{out}") + F.col("o.__before")).alias(out)), part


def shares_of(rows: DataFrame, targets: dict[str | None, float] | str | None) -> DataFrame:
    """s, num and den (whole numbers): the target share num / den of each source; a row a source."""
    totals, every = rows.groupBy("source").agg(F.sum("n").alias("tokens")), Window.partitionBy(F.lit(1))  # over a row a source
    if targets is None:
        return totals.select(F.col("source").alias("s"), F.col("tokens").alias("num"), F.sum("tokens").over(every).alias("den"))
    if targets == EQUAL:
        return totals.select(F.col("source").alias("s"), F.lit(1).cast("bigint").alias("num"), F.count("*").over(every).alias("den"))
    if min(targets.values(), default=0) < 0 or not any(targets.values()):
        raise ValueError("targets must not be negative or all 0")
    given = rows.sparkSession.createDataFrame([(k, round(v * SCALE)) for k, v in targets.items()], "t string, share bigint")
    return totals.join(given, F.col("source").eqNullSafe(F.col("t")), "left").select(F.col("source").alias("s"), F.coalesce("share", F.lit(0)).cast("bigint").alias("num"), F.lit(SCALE).cast("bigint").alias("den"))


def plan(rows: DataFrame, *, window: int, targets: dict[str | None, float] | str | None = None) -> DataFrame:
    """A written table of rows (row, doc_id, source, n, file, start) with their turn (window), and at: the first token's place in the stream."""
    queue, first = _running(rows, ["source", "doc_id", "row"], "source", "sent")
    # The first w with floor(num * window * (w + 1) / den) >= sent is ceil(sent * den / (num * window)) - 1.
    turn = F.expr(f"CASE WHEN num > 0 THEN (CAST(sent AS DECIMAL(18, 0)) * CAST(den AS DECIMAL(18, 0)) - 1) DIV (CAST(num AS DECIMAL(18, 0)) * {int(window)}) ELSE {LAST} END")
    turned = queue.join(shares_of(rows, targets), F.col("source").eqNullSafe(F.col("s"))).withColumn("turn", turn.cast("bigint")).drop("s", "num", "den")
    stream, second = _running(turned, ["turn", "source", "sent", "row"], None, "upto")
    out = written(stream.withColumn("at", F.col("upto") - F.col("n")).drop("upto", "sent"), "plan")
    uncheckpointed(first)
    uncheckpointed(second)
    return out


def _cut(root: str, length: int, with_ids: bool):
    types = (*[pa.int64()] * 7, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by file and start."""
        (at, base), name, file = filesystem(root), None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for doc, n, own, place, first in zip(*(batch.slice(lo, 256).column(i).to_pylist() for i in range(5)), strict=True):
                    if own != name:
                        if file is not None:
                            file.close()
                        name, file = own, at.open_input_file(f"{base}/{own}")
                    ids, start = np.frombuffer(file.read_at(2 * n, 2 * place), "<u2").astype("<u4"), 0
                    while start < n:
                        sequence, offset = divmod(first + start, length)
                        piece = ids[start : start + length - offset].tobytes()
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None))
                        start += len(piece) // 4
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
        if file is not None:
            file.close()

    return run


def pack(docs: DataFrame, path: str, *, length: int = 4096, window: int | None = None, targets: dict[str | None, float] | str | None = None, end: int = 2, with_ids: bool = True, **columns) -> DataFrame:
    """The pieces of all documents, with the ids of each as little-endian 32-bit numbers (null without with_ids).

    window: tokens a window, by default one sequence's. The ids stay in the shared folder, where the pieces are cut from them.
    """
    spark = docs.sparkSession
    root, work = scratch(spark, "ids"), Scratch(spark, "packing")
    stored = work.written(tokenized(docs, root, path, end=end, **columns), "stored")
    placed = plan(stored, window=window or length, targets=targets)
    work.drop()
    rows = placed.select("doc_id", "n", "file", "start", "at").repartitionByRange("file", "start").sortWithinPartitions("file", "start")
    return rows.mapInArrow(_cut(root, length, with_ids), PIECES)
