"""Exact deduplication as a stateful stream.

State is kept in a disk-backed store (RocksDB) and never expires. For each distinct text it holds the
digest, the smallest identifier, a locator of the text's bytes in a content store, and the count. A digest
that is known already is not trusted: the bytes behind both locators are read and compared, and texts
that differ under one digest are kept apart as variants. The state's keys are slots of the digest space, each
with the entries of some digests, for a call into Python costs far more than an entry; `slots` follows the
table's rows, about 32 each, and is kept with the state, whose keys it fixes. The state has a partition per
million rows, 16 at least: a store takes megabytes of memory and local disk however little it holds.

Texts don't travel through the shuffle. Each task writes the distinct texts of a batch to a content file
of its own in the shared folder, so a digest held by a third of all rows reaches the state as one row a
batch with the identifiers that share it.

Defined results: a null text counts as empty; a null identifier sorts after all others, and a group of
null identifiers only has a null keep_id; rows that repeat an identifier and a text each count and get
the same answer; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quillon.llm._common import filesystem, scratch

STAGED = "digest string, ids array<bigint>, nulls bigint, path string, start bigint, size bigint, n_bytes bigint"
FOUND = "digest string, variant int, ids array<bigint>, nulls bigint, keep_id bigint, group_size bigint, n_bytes bigint"
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}

PARTITIONS = "spark.sql.streaming.internal.stateStore.partitions"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _stage(content: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the distinct texts of each batch to a content file, and passes on digests, ids and locators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, root = filesystem(content)
        path, out, start = f"{root}/{uuid.uuid4().hex}.bin", None, 0
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            groups: dict[tuple[str, str], list] = {}
            for digest, text, doc in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                groups.setdefault((digest, text), []).append(doc)
            rows = []
            for (digest, text), ids in groups.items():
                if out is None:
                    at.create_dir(root, recursive=True)
                    out = at.open_output_stream(path)
                raw = text.encode()
                block = pack.compress(raw)
                out.write(block)
                known = [x for x in ids if x is not None]  # a null among them would turn them into floats on the way
                rows.append((digest, known, len(ids) - len(known), path, start, len(block), len(raw)))
                start += len(block)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["digest", "ids", "nulls", "path", "start", "size", "n_bytes"])
        if out is not None:
            out.close()

    return run


class _Content:
    """Reads texts back by locator, with a bounded number of open files."""

    def __init__(self, root: str, most: int = 32):
        self.at, self.open, self.most, self.unpack = filesystem(root)[0], OrderedDict(), most, zstandard.ZstdDecompressor()

    def read(self, path: str, start: int, size: int) -> bytes:
        if path not in self.open:
            self.open[path] = self.at.open_input_file(path)
            if len(self.open) > self.most:
                self.open.popitem(last=False)[1].close()
        self.open.move_to_end(path)
        return self.unpack.decompress(self.open[path].read_at(size, start))


def _smaller(a: int | None, b: int) -> int:
    return b if a is None else min(a, b)


def _keep(content: str) -> Callable:
    store: list[_Content] = []

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if not store:
            store.append(_Content(content))
        entries = json.loads(state.get[0]) if state.exists else {}  # by digest: [smallest id, path, start, size, bytes, count] of each variant
        rows, last, texts = [], None, {}
        for frame in frames:
            for digest, ids, nulls, *locator in frame[["digest", "ids", "nulls", "path", "start", "size", "n_bytes"]].itertuples(index=False, name=None):
                locator = [locator[0], *map(int, locator[1:])]
                variants = entries.setdefault(digest, [])
                if digest != last:
                    last, texts = digest, {}
                own, found = None, -1
                for k, v in enumerate(variants):
                    if v[1:4] == locator[:3]:
                        found = k
                    elif v[4] == locator[3]:
                        if own is None:
                            own = store[0].read(*locator[:3])
                        if k not in texts:
                            texts = {**(texts if len(texts) < 4 else {}), k: store[0].read(*v[1:4])}
                        if texts[k] == own:
                            found = k
                    if found == k:
                        break
                else:
                    found = len(variants)
                    variants.append([None, *locator, 0])
                ids = [int(x) for x in ids]
                if ids:
                    variants[found][0] = _smaller(variants[found][0], min(ids))
                variants[found][5] += len(ids) + int(nulls)
                rows.append((digest, found, ids, int(nulls)))
        state.update((json.dumps(entries, separators=(",", ":")),))
        own = [entries[r[0]][r[1]] for r in rows]
        yield pd.DataFrame(
            {
                "digest": [r[0] for r in rows],
                "variant": pd.Series([r[1] for r in rows], dtype="int32"),
                "ids": [r[2] for r in rows],
                "nulls": pd.Series([r[3] for r in rows], dtype="int64"),
                "keep_id": pd.Series([v[0] for v in own], dtype="Int64"),
                "group_size": pd.Series([v[5] for v in own], dtype="int64"),
                "n_bytes": pd.Series([v[4] for v in own], dtype="int64"),
            }
        )

    return update


def _slots(to: str, wanted: int) -> int:
    """The number of slots that the state at `to` was begun with."""
    at, root = filesystem(to)
    at.create_dir(root, recursive=True)
    name = f"{root}/slots"
    if at.get_file_info(name).type == pafs.FileType.NotFound:
        with at.open_output_stream(name) as f:
            f.write(str(wanted).encode())
    with at.open_input_stream(name) as f:
        return int(f.read())


def dedup_stream(stream: DataFrame, to: str, *, id_col: str = "doc_id", text_col: str = "text", slots: int = 1 << 12, partitions: int = 16, digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256)):
    """The started query that reads `stream` to its end in micro-batches and appends to the table `to`/found.

    Restarted with the same `to`, it goes on from its checkpoint with the state of all earlier runs.
    """
    spark = stream.sparkSession
    settings = STORE | {PARTITIONS: str(partitions)}
    old = {k: spark.conf.get(k, None) for k in settings}
    text = normalised(F.col(text_col).cast("string"))
    rows = stream.select(digest(text).alias("digest"), text.alias("text"), F.col(id_col).cast("bigint").alias("id"))
    staged = rows.mapInArrow(_stage(f"{to}/content"), STAGED).withColumn("slot", F.pmod(F.xxhash64("digest"), F.lit(_slots(to, slots))))
    found = staged.groupBy("slot").applyInPandasWithState(_keep(f"{to}/content"), FOUND, "entries string", "append", GroupStateTimeout.NoTimeout)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return found.writeStream.format("parquet").outputMode("append").option("path", f"{to}/found").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def decisions(spark: SparkSession, to: str) -> DataFrame:
    """One row per row read so far: doc_id, keep_id, group_size, kept, text_sha256 (the digest), n_bytes."""
    found = spark.read.schema(FOUND).parquet(f"{to}/found")
    groups = found.groupBy("digest", "variant").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
    ids = F.concat("ids", F.array_repeat(F.lit(None).cast("bigint"), F.col("nulls").cast("int")))  # of one batch
    rows = found.select("digest", "variant", "n_bytes", F.explode(ids).alias("doc_id"))
    return rows.join(groups, ["digest", "variant"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"), "n_bytes")


def exact_dedup(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", files_per_trigger: int = 1000, to: str | None = None, digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256)) -> DataFrame:
    """Decisions for all rows of the Parquet table at `path`, read as a stream of its files."""
    to = to or scratch(spark, "exact")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    rows = spark.read.parquet(path).count()
    slots = 1 << max(6, (rows // 32).bit_length())
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]" if single else path)  # a stream reads one file as a pattern
    dedup_stream(stream, to, id_col=id_col, text_col=text_col, slots=slots, partitions=max(16, rows >> 20), digest=digest).awaitTermination()
    return decisions(spark, to)
