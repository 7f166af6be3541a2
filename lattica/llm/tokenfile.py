"""Token ids in fixed-width bit-packed blocks.

The file format is a folder of Parquet files in ascending doc_id order, so that
any store Spark can write holds it, and a lost task leaves nothing half-written.
A row is one block of whole documents:

``shard, block``   its place: ascending (shard, block) is ascending doc_id
``first``          number of ids in the shard before it
``bits``           width of an id: the least that holds the vocabulary
``doc_ids, starts, lengths``  the documents, and where their ids lie in the block
``payload``        the ids, ``bits`` bits each, lowest bit first, end to end

Id i of a block begins at bit ``i * bits`` of the payload, so any document can
be read by itself, and ``unpack`` is vectorised.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick
from .tokens import json_encoder

SCHEMA = ("shard int, block int, first bigint, bits int, doc_ids array<bigint>, starts array<bigint>, "
          "lengths array<bigint>, payload binary")
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id; one at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` (below 2**bits, bits to 32) end to end; the last byte is filled with zeros."""
    n = len(ids)
    rows = np.zeros((-(-n // 8), 8), np.uint64)
    rows.reshape(-1)[:n] = ids
    out = np.zeros((len(rows), bits + 8), np.uint8)  # eight ids fill ``bits`` bytes
    for lane in range(8):
        at, shift = divmod(lane * bits, 8)
        value = rows[:, lane] << np.uint64(shift)
        for k in range((bits + shift + 7) // 8):
            out[:, at + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :bits].tobytes()[:-(-n * bits // 8)]


def unpack(payload: bytes, bits: int, start: int, length: int) -> np.ndarray:
    """Ids ``start`` to ``start + length`` of a payload, reading only their bytes."""
    if not length:
        return np.zeros(0, np.uint32)
    group = start // 8  # eight ids begin at a whole byte
    skip = start - 8 * group
    n = -(-(skip + length) // 8)
    raw = np.frombuffer(payload, np.uint8)[group * bits:(group + n) * bits]
    rows = np.zeros(n * bits + 8, np.uint8)
    rows[:len(raw)] = raw
    out = np.empty((n, 8), np.uint32)
    for lane in range(8):
        at, shift = divmod(lane * bits, 8)
        value = np.zeros(n, np.uint64)
        for k in range((bits + shift + 7) // 8):
            value |= rows[at + k:at + k + (n - 1) * bits + 1:bits].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[skip:skip + length]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every document and ``end_id`` to a new folder.

    Documents are ordered by doc_id, null first, and those of one id by the hash
    of their text.  A null text has the end id alone.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_hash"]
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def write(batches):
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        shard, block, first = TaskContext.get().partitionId(), 0, 0
        bits = bits_for(Tokenizer.from_file(tokenizer).get_vocab_size())
        encode, end = json_encoder(tokenizer).encode, np.array([end_id], "<u4").tobytes()
        doc_ids, ids, lengths, total = [], [], [], 0

        def full():
            starts = np.cumsum([0, *lengths[:-1]]).tolist()
            payload = pack(np.frombuffer(b"".join(ids), "<u4"), bits)
            row = [shard, block, first, bits, doc_ids, starts, lengths, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                got = encode(text.as_py()) + end
                doc_ids.append(doc_id)
                ids.append(got)
                lengths.append(len(got) // 4)
                total += lengths[-1]
                if total >= block_ids:
                    yield full()
                    block, first = block + 1, first + total
                    doc_ids, ids, lengths, total = [], [], [], 0
        if doc_ids:
            yield full()

    rows.select("doc_id", "text").mapInArrow(write, SCHEMA).write.option("compression", "none").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the checksum is of the
    ids as read back, as little-endian unsigned 32-bit integers.
    """
    blocks = read_blocks(spark, path)
    # One row for each written part: its number of ids, and those of the parts before.
    sizes = blocks.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            shard, first, bits, doc_ids, starts, lengths, payload = (batch.column(c) for c in ("shard", "first", "bits", "doc_ids", "starts", "lengths", "payload"))
            for i in range(batch.num_rows):
                s, n = starts[i].values.to_numpy(), lengths[i].values.to_numpy()
                content = unpack(payload[i].as_py(), bits[i].as_py(), 0, int(n.sum())).astype("<u4").tobytes()
                crc = [zlib.crc32(content[4 * a:4 * (a + k)]) for a, k in zip(s.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard[i].as_py()] * len(n), pa.int32()), doc_ids[i].values, pa.array(s + first[i].as_py()), pa.array(n), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(read, "shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    # One small row per part, so the join may be a broadcast if Spark finds it small.
    return rows.join(sizes, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents with this id: random access to their blocks only."""
    found = read_blocks(spark, path).filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    return [unpack(r["payload"], r["bits"], s, n) for r in found.collect()
            for d, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]) if d == doc_id]
