"""Tokens per document from flat token files, by scanning for the separator.

`write_tokens` gives each input partition one flat file of 16- or 32-bit little-endian identifiers, in
which an end-of-document identifier follows each document; the files hold no index. A side table keeps
which document stands where in the order of a file.

`scan_tokens` knows files and sizes only. It cuts them into blocks of `block_tokens`, and each task
searches its blocks with numpy. A document that spans blocks is stitched by a prefix scan over one row a
block: the last separator before a block is the running maximum of the earlier blocks' last separators,
and the number of documents before it the running sum of their counts. The scan runs file by file, and
`roll_tokens` bounds a file.

Defined results: null and empty texts have 0 tokens; null identifiers and repeated rows get a row each;
ids after the last separator of a file belong to no document, and are reported by `unended`; a very long
text spans as many blocks as it takes; other columns aren't read, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._common import filesystem, scratch

ORDER = "file string, ordinal bigint, doc_id bigint, tokens bigint"


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def _write(root: str, path: str, pattern: str, eod: int, dtype: str, roll_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (at, base) = encoding(path, pattern), filesystem(root)
        end = np.array([eod], dtype).tobytes()
        out, name, ordinal, tokens = None, "", 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, rows = batch.slice(lo, 256), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if out is None:
                        at.create_dir(base, recursive=True)
                        name, ordinal, tokens = f"{uuid.uuid4().hex}.tok", 0, 0
                        out = at.open_output_stream(f"{base}/{name}")
                    ids = enc.encode_ordinary_batch([text], num_threads=1)[0] if text else []
                    out.write(np.asarray(ids, dtype).tobytes() + end)
                    rows.append((name, ordinal, doc))
                    ordinal, tokens = ordinal + 1, tokens + len(ids) + 1
                    if tokens >= roll_tokens:
                        out.close()
                        out = None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    return run


def write_tokens(docs: DataFrame, root: str, path: str, pattern: str, *, eod: int = 50256, dtype: str = "<u2", roll_tokens: int = 1 << 27, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files below root/tokens; returns which document stands where: file, ordinal, doc_id."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "file string, ordinal bigint, doc_id bigint"
    rows.mapInArrow(_write(f"{root}/tokens", path, pattern, eod, dtype, roll_tokens), schema).write.parquet(f"{root}/order")
    return docs.sparkSession.read.schema(schema).parquet(f"{root}/order")


def _sizes(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = filesystem(root)
        for batch in batches:
            names = batch.column(0).to_pylist()
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x.size for x in at.get_file_info([f"{base}/{n}" for n in names])], pa.int64())], names=["file", "bytes"])

    return run


def _scan(root: str, eod: int, dtype: str, block_tokens: int):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = filesystem(root)
        for batch in batches:
            for name, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with at.open_input_file(f"{base}/{name}") as f:
                    f.seek(block * block_tokens * width)
                    ids = np.frombuffer(f.read(block_tokens * width), dtype)
                ends = np.flatnonzero(ids == eod).astype(np.int64) + block * block_tokens
                lengths = np.diff(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends[0] if len(ends) else None], pa.int64()), pa.array([ends[-1] if len(ends) else None], pa.int64()), pa.array([lengths.tolist()], pa.list_(pa.int64()))],
                    names=["file", "block", "n", "ends", "first", "last", "lengths"],
                )

    return run


def scan_blocks(files: DataFrame, root: str, *, eod: int = 50256, dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """One row a block, with what precedes it in its file: before (documents), since (the last separator)."""
    sized = files.select("file").distinct().mapInArrow(_sizes(f"{root}/tokens"), "file string, bytes bigint")
    width = np.dtype(dtype).itemsize * block_tokens
    blocks = sized.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("bytes") - 1) / width))).alias("block"))
    found = blocks.repartition("file", "block").mapInArrow(_scan(f"{root}/tokens", eod, dtype, block_tokens), "file string, block bigint, n bigint, ends bigint, first bigint, last bigint, lengths array<bigint>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumns({"before": F.coalesce(F.sum("ends").over(earlier), F.lit(0).cast("bigint")), "since": F.coalesce(F.max("last").over(earlier), F.lit(-1).cast("bigint"))})


def scan_tokens(files: DataFrame, root: str, **options) -> DataFrame:
    """file, ordinal and n_tokens of every document that a separator ends."""
    blocks = scan_blocks(files, root, **options).where("ends > 0")
    spans = F.concat(F.array(F.col("first") - F.col("since") - 1), F.col("lengths"))
    return blocks.select("file", "before", F.posexplode(spans).alias("at", "n_tokens")).select("file", (F.col("before") + F.col("at")).alias("ordinal"), "n_tokens")


def unended(files: DataFrame, root: str, **options) -> DataFrame:
    """Ids after the last separator, by file that has any."""
    blocks = scan_blocks(files, root, **options)
    ends = blocks.groupBy("file").agg(F.sum("n").alias("n"), F.max(F.greatest("last", "since")).alias("last"))
    return ends.select("file", (F.col("n") - F.col("last") - 1).alias("n_tokens")).where("n_tokens > 0")


def token_counts(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and n_tokens of every row: written to token files, then counted from them.

    Both sides have a row a document, so they meet in a merge join: neither is ever broadcast, whatever
    its size on disk.
    """
    root = scratch(docs.sparkSession, "tokens")
    order = write_tokens(docs, root, path, pattern, id_col=id_col, text_col=text_col)
    return order.hint("merge").join(scan_tokens(order, root, **options).hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
