"""Token ids in bit-plane shuffled shards.

The ids of all documents, in ascending doc_id order, are cut into shards of whole
documents. A shard holds its ids in blocks of BLOCK ids; every block is transposed
into byte planes (or bit planes), each plane is compressed with zstandard on its
own, and a chunk index at the front of the shard says where each plane lies. Shards
are binary cells of a Parquet data set, so that Spark's commit protocol covers a
lost executor and any store that Spark reaches can hold them. A shard can be read
without any other, and needs no shuffle.

Defined results: a null text is empty and holds its end id alone; null doc_ids come
first; rows with equal doc_ids are ordered by text; other columns are ignored; an
empty table gives a data set without shards.

Shard layout, little-endian: magic, kind of planes (uint32), number of ids (uint64),
ids a block (uint32), number of planes (uint32), then for each plane the end of its
bytes after the header (uint64), then the planes.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.encode import library_encoder, slices
from palisade.llm.common import text_of

MAGIC = b"PLN1"
HEADER = struct.Struct("<4sIQII")
BLOCK = 1 << 16
#: A shard is closed by the document that fills it.
SHARD_IDS = 1 << 20
BYTES, BITS = 0, 1
LEVEL = 3
#: Units of a generation of the encoder: at most two of them and a run of texts, about 200 MB a worker.
KEPT_UNITS = 300_000


def _planes(block: np.ndarray, kind: int) -> list[bytes]:
    as_bytes = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTES:
        return [as_bytes[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def _block(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTES:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack(ids: np.ndarray, kind: int = BYTES, block: int = BLOCK) -> bytes:
    """A shard of these ids."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    planes = [squeeze(p) for i in range(0, len(ids), block) for p in _planes(ids[i : i + block], kind)]
    ends = np.cumsum([len(p) for p in planes], dtype="<u8")
    return HEADER.pack(MAGIC, kind, len(ids), block, len(planes)) + ends.tobytes() + b"".join(planes)


def unpack(shard: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a shard from first to last, reading only the blocks that hold them."""
    import zstandard

    magic, kind, n, block, n_planes = HEADER.unpack_from(shard)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, "<u4")
    ends = np.frombuffer(shard, "<u8", n_planes, HEADER.size)
    base, each = HEADER.size + 8 * n_planes, 4 if kind == BYTES else 32
    expand = zstandard.ZstdDecompressor().decompress
    begin = lambda k: base + (int(ends[k - 1]) if k else 0)
    read = []
    for b in range(first // block, (last - 1) // block + 1):
        at = range(b * each, (b + 1) * each)
        planes = [expand(shard[begin(k) : base + int(ends[k])]) for k in at]
        read.append(_block(planes, min(block, n - b * block), kind))
    skip = first // block * block
    return np.concatenate(read)[first - skip : last - skip]


SHARDS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_tokens", T.ArrayType(T.LongType())),
        T.StructField("ids", T.BinaryType()),
    ]
)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, keeps_space: bool = True, kind: int = BYTES, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of docs (doc_id, text) to folder; end_id ends every document."""

    def encode(batches):
        from pyspark import TaskContext

        encoder, end = library_encoder(tokenizer, keeps_space, KEPT_UNITS), np.array([end_id], "<u4").tobytes()
        part, shard, held, owners, lengths, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def closed():
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [shard], [n], [len(owners)], [owners], [lengths], [pack(ids, kind)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=SHARDS.names)

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for texts in slices(batch.column(1).to_pylist()):
                for ids in encoder.encode(texts):
                    held += [ids, end]
                    owners.append(doc_ids[at])
                    lengths.append(len(ids) // 4 + 1)
                    n, at = n + lengths[-1], at + 1
                    if n >= shard_ids:
                        yield closed()
                        shard, held, owners, lengths, n = shard + 1, [], [], [], 0
        if owners:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(encode, SHARDS).write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary,
    little-endian unsigned 32-bit integers) of every document in folder."""
    shards = spark.read.schema(SHARDS).parquet(folder)
    # Partitions are as many as the writer had tasks; shards are summed within them.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        shards.select("part", "shard", "n_ids")
        .withColumn("shard_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(parts, "part")
        .select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("shard_start"))
    )

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, end = unpack(row["ids"]).tobytes(), np.cumsum([0, *row["n_tokens"]])
                for i in range(0, len(row["doc_ids"]), 512):
                    here = range(i, min(i + 512, len(row["doc_ids"])))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["part"]] * len(here), pa.int32()),
                            pa.array([row["shard"]] * len(here), pa.int32()),
                            pa.array([row["doc_ids"][k] for k in here], pa.int64()),
                            pa.array([int(end[k]) for k in here], pa.int64()),
                            pa.array([row["n_tokens"][k] for k in here], pa.int64()),
                            pa.array([ids[4 * end[k] : 4 * end[k + 1]] for k in here], pa.binary()),
                        ],
                        names=["part", "shard", "doc_id", "within", "n_tokens", "ids"],
                    )

    read = shards.select("part", "shard", "doc_ids", "n_tokens", "ids").mapInArrow(
        decode, "part int, shard int, doc_id long, within long, n_tokens long, ids binary"
    )
    # A few numbers a shard of a million ids: checked below before it is broadcast.
    small = starts if shards.select("shard").count() > 1_000_000 else F.broadcast(starts)
    return read.join(small, ["part", "shard"]).select(
        "doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids"
    )
