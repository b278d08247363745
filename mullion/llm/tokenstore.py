"""Token-id shards with a minimal perfect hash index for constant-time keyed access.

A store is a folder with two tables Spark writes and reads anywhere it can reach:

* ``blocks``: one row per block of consecutive documents, in ascending doc_id order: ``shard``, ``block``, its first and
  last key, the raw ids of all its documents one after another (``payload``, little-endian, ``width`` bytes each) and
  the index over its keys: ``shift`` (displacements), and per slot ``mark`` (fingerprint), ``at`` and ``size`` (where the
  document's ids begin in the payload, and how many). ``keys`` lists the doc_ids in payload order for scans.
* ``starts``: per block, the ids of all documents before it, and the key range (the directory of ``lookup``).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from mullion.llm import mph
from mullion.llm.common import chunks, picked, plain
from mullion.llm.encoding import encoder

BLOCK_SCHEMA = ("shard int, block int, first_key bigint, last_key bigint, has_null boolean, docs int, tokens bigint, width int, "
                "keys binary, nulls binary, payload binary, shift binary, mark binary, at binary, size binary")
DOC_SCHEMA = "doc_id bigint, shard int, block int, at bigint, n_tokens bigint, ids_crc32 bigint, ids binary"


def _turns(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """How often each key of an ordered list has come before."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])))
    first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return np.arange(len(keys)) - first


def _block(shard: int, block: int, names: list, raws: list[bytes], width: int) -> list:
    nulls = np.array([n is None for n in names], bool)
    keys = np.array([0 if n is None else n for n in names], np.int64)
    size = np.array([len(r) // width for r in raws], np.int64)
    hashes = mph.key_hashes(keys, nulls, _turns(keys, nulls))
    shift = mph.build(hashes)
    slot = mph.slots(hashes, shift, len(hashes))
    mark, at, held = np.empty(len(hashes), "<u4"), np.empty(len(hashes), "<u8"), np.empty(len(hashes), "<u8")
    mark[slot], at[slot], held[slot] = mph.fingerprints(hashes), np.cumsum(size) - size, size
    real = keys[~nulls]
    return [shard, block, int(real[0]) if len(real) else None, int(real[-1]) if len(real) else None, bool(nulls.any()), len(names), int(size.sum()), width,
            keys.astype("<i8").tobytes(), np.packbits(nulls).tobytes(), b"".join(raws), shift.astype("<i4").tobytes(), mark.tobytes(), at.tobytes(), held.tobytes()]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
          block_docs: int = 2048, block_ids: int = 1 << 20) -> None:
    """Encode every whole text, ``end_id`` after it, and write the store in ascending doc_id order.

    Null and empty texts are the end id alone; null ids come first, rows that repeat an id side by side. A block closes
    at ``block_docs`` documents or ``block_ids`` ids, whichever comes first; a longer document is a block of its own.
    """
    def pack(batches):
        from pyspark import TaskContext

        coder, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{coder.width}").tobytes()
        block, names, raws, held = 0, [], [], 0
        fields = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("has_null", pa.bool_()),
                            ("docs", pa.int32()), ("tokens", pa.int64()), ("width", pa.int32()), *[(c, pa.binary()) for c in ("keys", "nulls", "payload", "shift", "mark", "at", "size")]])

        def close():
            nonlocal block, names, raws, held
            row = _block(shard, block, names, raws, coder.width)
            block, names, raws, held = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields)], schema=fields)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in chunks(texts, 1 << 22):
                for name, raw in zip(ids[lo:hi], coder.ids(texts[lo:hi])):
                    names.append(name)
                    raws.append(raw + end)
                    held += len(raw) // coder.width + 1
                    if len(names) >= block_docs or held >= block_ids:
                        yield close()
        if names:
            yield close()

    source = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), plain(F.col("text")).alias("text"))
    # The text's hash only spreads rows that repeat one id over several shards.
    ranged = source.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    ranged.mapInArrow(pack, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    spark = docs.sparkSession
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "block", "first_key", "last_key", "has_null", "docs", "tokens")
    # Two levels: running sums within a shard, then over one row per shard.
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(across), F.lit(0))).drop("all")
    starts = blocks.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(shards, "shard")
    starts.select("shard", "block", "first_key", "last_key", "has_null", "docs", "tokens", (F.col("base") + F.col("within")).alias("start")).write.parquet(f"{path}/starts")


def _reader(wanted: bool):
    """Reads documents of blocks by key through the index: the keys asked for, or every key of the block."""
    fields = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for r in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            n = r["docs"]
            if wanted:
                keys, nulls, turns = np.array([r["doc_id"]], np.int64), np.zeros(1, bool), np.zeros(1, np.int64)
            else:
                keys, nulls = np.frombuffer(r["keys"], "<i8"), np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=n).astype(bool)
                turns = _turns(keys, nulls)
            hashes = mph.key_hashes(keys, nulls, turns)
            slot = mph.slots(hashes, np.frombuffer(r["shift"], "<i4"), n)
            same = np.frombuffer(r["mark"], "<u4")[slot] == mph.fingerprints(hashes)
            at, size = np.frombuffer(r["at"], "<u8")[slot].astype(np.int64), np.frombuffer(r["size"], "<u8")[slot].astype(np.int64)
            ids = np.frombuffer(r["payload"], f"<u{r['width']}")
            rows = [ids[at[i]:at[i] + size[i]].astype("<u4").tobytes() for i in np.flatnonzero(same)]
            if not wanted and len(rows) != n:
                raise ValueError(f"block {r['shard']}/{r['block']}: {n - len(rows)} keys do not meet their fingerprints")
            names = [None if nulls[i] else int(keys[i]) for i in np.flatnonzero(same)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([r["shard"]] * len(rows), pa.int32()), pa.array([r["block"]] * len(rows), pa.int32()),
                 pa.array(at[same], pa.int64()), pa.array(size[same], pa.int64()), pa.array([zlib.crc32(x) for x in rows], pa.int64()), pa.array(rows, pa.binary())], schema=fields)

    return read


def read_all(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of the store, each found through its block's hash index: doc_id, start, n_tokens, ids_crc32, ids."""
    found = spark.read.parquet(f"{path}/blocks").mapInArrow(_reader(False), DOC_SCHEMA)
    starts = spark.read.parquet(f"{path}/starts").select("shard", "block", "start")
    out = (found if with_ids else found.drop("ids")).join(starts, ["shard", "block"])
    return out.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """The documents of a short list of keys (the first row of a repeated one); only blocks whose key range holds one are read (pushed down to Parquet)."""
    if not keys:
        return read_all(spark, path).limit(0)
    near = F.lit(False)
    for k in keys:
        near = near | (F.col("first_key") <= k) & (F.col("last_key") >= k)
    asked = spark.createDataFrame([(int(k),) for k in set(keys)], "doc_id bigint")
    blocks = spark.read.parquet(f"{path}/blocks").filter(near)
    met = blocks.join(F.broadcast(asked), F.col("doc_id").between(F.col("first_key"), F.col("last_key")))
    starts = spark.read.parquet(f"{path}/starts").select("shard", "block", "start")
    return met.mapInArrow(_reader(True), DOC_SCHEMA).join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
