"""Token-id files by plane shuffling.

A corpus is written in ascending id order as *chunks* of whole documents.  A chunk's ids are cut into
blocks of fixed size; each block is transposed into byte planes (or bit planes), and every plane is
compressed on its own with zstandard.  Planes of zeros take no bytes.  A chunk begins with its own
plane index; a separate chunk index gives each chunk's place in the id stream, documents and bytes,
so a reader can fetch any id range.

Payload of a chunk, little-endian: ``b"IDP1"``, plane kind (1 byte or 8 bit planes), 3 zero bytes,
block size u32, ids u64, blocks u32; per block and plane the compressed size u32; then the planes.

Chunks are rows of Parquet files (written without further compression), so any store that Spark
writes to will do, and retried tasks leave no partial files.

Defined cases: null or empty text is the end id alone; rows that share an id are written next to
each other in the order of their texts' hashes; null ids come first; an empty table gives no chunks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import load_tokenizer, probe_classes, worker_encoder
from .common import byte_view, narrow, pieces, prepare

MAGIC = b"IDP1"
BLOCK_IDS = 16_384
# Ids after which a chunk is closed, at the next document boundary.
CHUNK_IDS = 131_072
LEVEL = 3
_HEAD = struct.Struct("<4sB3xIQI")


def _planes(block: np.ndarray, kind: int) -> np.ndarray:
    columns = np.ascontiguousarray(block.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == 1:
        return columns
    return np.stack([np.packbits((columns[b] >> s) & 1) for b in range(4) for s in range(8)])


def _unplanes(planes: np.ndarray, n: int, kind: int) -> np.ndarray:
    if kind == 1:
        return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")
    out = np.zeros(n, np.uint32)
    for k in range(32):
        out |= np.unpackbits(planes[k], count=n).astype(np.uint32) << np.uint32(k)
    return out


def pack_ids(ids: np.ndarray, kind: int = 1, block: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """Payload of one chunk; ``kind`` 1 for byte planes, 8 for bit planes."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    sizes, body = [], []
    n_blocks = -(-len(ids) // block)
    for k in range(n_blocks):
        for plane in _planes(ids[k * block:(k + 1) * block], kind):
            data = squeeze(plane.tobytes()) if plane.any() else b""
            sizes.append(len(data))
            body.append(data)
    return b"".join([_HEAD.pack(MAGIC, kind, block, len(ids), n_blocks), np.array(sizes, "<u4").tobytes(), *body])


def unpack_ids(payload: bytes) -> np.ndarray:
    magic, kind, block, n, n_blocks = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a plane-shuffled id chunk")
    per = 4 if kind == 1 else 32
    sizes = np.frombuffer(payload, "<u4", n_blocks * per, _HEAD.size).reshape(n_blocks, per)
    at, grow, out = _HEAD.size + sizes.nbytes, zstandard.ZstdDecompressor().decompress, []
    for k in range(n_blocks):
        ids = min(block, n - k * block)
        width = ids if kind == 1 else -(-ids // 8)
        planes = np.zeros((per, width), np.uint8)
        for p in range(per):
            if size := int(sizes[k, p]):
                planes[p] = np.frombuffer(grow(payload[at:at + size], max_output_size=width), np.uint8)
                at += size
        out.append(_unplanes(planes, ids, kind))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, kind: int = 1,
              chunk_ids: int = CHUNK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``path/chunks`` and ``path/index``."""
    spark = docs.sparkSession
    prepare(spark)
    own = narrow(docs, id_col, text_col)
    classes = spark.sparkContext.broadcast(probe_classes(load_tokenizer(tokenizer_path)))
    id_type = own.schema["doc_id"].dataType
    names = ["part", "chunk", "n_docs", "n_ids", "doc_ids", "doc_sizes", "payload"]

    def run(batches):
        encoder, part = worker_encoder(tokenizer_path, classes.value), TaskContext.get().partitionId()
        keys, held, sizes, n, chunk = [], [], [], 0, 0

        def flush():
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([chunk], pa.int64()), pa.array([len(sizes)], pa.int64()),
                pa.array([len(ids)], pa.int64()), _one_list(pa.concat_arrays(keys)),
                _one_list(pa.array(sizes, pa.int64())), pa.array([pack_ids(ids, kind)], pa.binary())], names)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for i, j in pieces(byte_view(batch.column("text"))[1], 256 << 10):
                ids, off = encoder.encode(texts[i:j], end_id)
                keys.append(batch.column("doc_id").slice(i, j - i))
                held.append(ids)
                sizes += np.diff(off).tolist()
                n += len(ids)
                if n >= chunk_ids:
                    yield flush()
                    keys, held, sizes, n, chunk = [], [], [], 0, chunk + 1
        if sizes:
            yield flush()

    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, f"part int, chunk long, n_docs long, n_ids long, doc_ids array<{id_type.simpleString()}>, "
                            "doc_sizes array<long>, payload binary").write.option("compression", "none").parquet(
        f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks").select(
        "part", "chunk", "n_docs", "n_ids", F.element_at("doc_ids", 1).alias("first_doc"),
        F.element_at("doc_ids", -1).alias("last_doc"), F.octet_length("payload").alias("n_bytes"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("chunk")) - F.col("n_ids")
    # one row per written part: a file each
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn(
        "base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    chunks.withColumn("inside", inside).join(parts, "part").withColumn(
        "first_id", F.col("base") + F.col("inside")).drop("base", "inside").write.parquet(f"{path}/index")


def _one_list(values: pa.Array) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values).cast(pa.list_(values.type))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Every document from the files: doc_id, start in the id stream, n_tokens, ids_crc32 (and its ids)."""
    prepare(spark)
    chunks = spark.read.parquet(f"{path}/chunks")
    id_type = chunks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                keys, sizes = b.column("doc_ids")[k].values, np.asarray(b.column("doc_sizes")[k].values)
                raw = unpack_ids(b.column("payload")[k].as_py()).astype("<u4")
                ends = np.cumsum(sizes)
                data, at = memoryview(raw.tobytes()), (4 * ends).tolist()
                crc = [zlib.crc32(data[x:y]) for x, y in zip([0, *at], at)]
                cols = [keys, pa.array(np.full(len(sizes), b.column("part")[k].as_py(), np.int32)),
                        pa.array(np.full(len(sizes), b.column("chunk")[k].as_py(), np.int64)),
                        pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "chunk", "inside", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()),
                                                         pa.array(raw.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
    out = chunks.select("part", "chunk", "doc_ids", "doc_sizes", "payload").mapInArrow(
        run, f"doc_id {id_type}, part int, chunk long, inside long, n_tokens long, ids_crc32 long"
             + (", ids array<int>" if with_ids else ""))
    index = spark.read.parquet(f"{path}/index").select("part", "chunk", "first_id")
    return out.join(index, ["part", "chunk"]).withColumn("start", F.col("first_id") + F.col("inside")).select(
        "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
