"""Token ids in a binary table: bit-plane shuffling, zstandard and a chunk index.

Texts are dealt to shards by ranges of their id and sorted inside a shard, so
that shards follow each other in ascending order.  A shard is a sequence of
chunks; a chunk holds whole documents, at least ``CHUNK`` ids of them unless it
is the shard's last.  Its ids are cut into blocks of ``BLOCK`` ids, each block
is transposed into planes, plane k with bit (or byte) k of every id, and each
plane is compressed with zstandard; an empty plane takes no bytes.  The chunk
index (shard, chunk, first id, number of ids, and the documents with their
lengths) lies beside the planes as columns of the same row.

The table is written and read by Spark as Parquet rows with binary columns, so
that it can lie in any store that Spark reaches, lost executors repeat their
part, and the index is read without the planes.

Defined results: a null or empty text is the end id alone; a null id comes
first; rows that repeat an id follow each other by text; extra columns are
ignored; an empty table gives an empty file and an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Memo, Vocabulary, read_vocabulary, text_lists
from .common import materialize, shared_dir, shuffle_partitions

VOCABULARY, END = "byte_bpe_50k.json", 0
BLOCK, CHUNK = 1 << 15, 1 << 16
SCHEMA = (
    "shard int, chunk int, first long, n_ids long, layout string, "
    "blocks array<struct<n:int,planes:array<binary>>>, docs array<struct<doc_id:bigint,n_tokens:bigint>>"
)


def to_planes(ids: np.ndarray, layout: str, compress: zstandard.ZstdCompressor) -> list[bytes]:
    """Planes of a block of unsigned 32-bit ids, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    used = 4 if not len(ids) else max(1, (int(ids.max()).bit_length() + 7) // 8)
    raw = raw[:, :used]
    planes = raw.T if layout == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)
    return [compress.compress(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, layout: str, decompress: zstandard.ZstdDecompressor) -> np.ndarray:
    width = n if layout == "byte" else (n + 7) // 8
    rows = [np.frombuffer(decompress.decompress(p), np.uint8) if p else np.zeros(width, np.uint8) for p in planes]
    raw = np.stack(rows) if layout == "byte" else np.packbits(np.stack([np.unpackbits(r)[:n] for r in rows]).T, axis=1, bitorder="little").T
    out = np.zeros((n, 4), np.uint8)
    out[:, : len(raw)] = raw.T
    return out.reshape(-1).view("<u4")


_encoders: dict[str, Memo] = {}


def _encoder(data: str) -> Memo:
    """Ids by the tokenizers library, each distinct piece of a text once."""
    key = hashlib.sha256(data.encode()).hexdigest()
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        vocabulary = Vocabulary(data)

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum())), size

        _encoders[key] = Memo(encode, vocabulary.special, vocabulary.cut)
    return _encoders[key]


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, layout: str = "byte", level: int = 1) -> None:
    """Encode all texts and write them to ``path`` in ascending order of doc_id."""
    if layout not in ("byte", "bit"):
        raise ValueError("layout is byte or bit")
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_vocabulary(vocabulary))  # a fixed file of about two MB

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _encoder(shipped.value)
        compress = zstandard.ZstdCompressor(level=level)
        shard = TaskContext.get().partitionId()
        chunk = first = held_n = 0
        held: list[np.ndarray] = []
        documents: list[dict] = []

        def flush() -> pa.RecordBatch:
            nonlocal chunk, first, held_n
            ids = np.concatenate(held)
            blocks = [{"n": len(x), "planes": to_planes(x, layout, compress)} for x in (ids[k : k + BLOCK] for k in range(0, len(ids), BLOCK))]
            row = [[shard], [chunk], [first], [len(ids)], [layout], [blocks], [list(documents)]]
            chunk, first, held_n = chunk + 1, first + len(ids), 0
            held.clear()
            documents.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for lo, hi, texts in text_lists(batch.column("text")):
                for doc_id, ids in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), memo.texts(texts), strict=True):
                    held.append(np.append(ids, np.int32(end)))
                    documents.append({"doc_id": doc_id, "n_tokens": len(ids) + 1})
                    held_n += len(ids) + 1
                    if held_n >= CHUNK:
                        yield flush()
        if documents:
            yield flush()

    names = ["shard", "chunk", "first", "n_ids", "layout", "blocks", "docs"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("n", pa.int32()), ("planes", pa.list_(pa.binary()))])), pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))]
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = chosen.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ranged.mapInArrow(apply, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index: shard, chunk, first (within the file), n_ids."""
    chunks = spark.read.schema(SCHEMA).parquet(path).select("shard", "chunk", "first", "n_ids")
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    # One row a shard, so one window over all is small.
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")).alias("base"))
    return chunks.join(shards, "shard").select("shard", "chunk", (F.col("base") + F.col("first")).alias("first"), "n_ids")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, asked for, its ids."""
    chunks = spark.read.schema(SCHEMA).parquet(path)
    bases = materialize(index(spark, path).where("chunk = 0").select(F.col("shard"), F.col("first").alias("base")))  # one row a shard

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                stream = np.concatenate([from_planes(b["planes"], b["n"], row["layout"], decompress) for b in row["blocks"]])
                size = np.array([d["n_tokens"] for d in row["docs"]], np.int64)
                at = np.cumsum(size) - size
                if size.sum() != len(stream) or len(stream) != row["n_ids"]:
                    raise ValueError(f"chunk {row['chunk']} of shard {row['shard']} is damaged")
                parts = [stream[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                columns = [
                    pa.array([d["doc_id"] for d in row["docs"]], pa.int64()),
                    pa.array(at + row["first"] + row["base"]),
                    pa.array(size),
                    pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in parts], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([x.astype(np.int64).tolist() for x in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return chunks.join(bases, "shard").mapInArrow(apply, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: write all documents, read the file back."""
    from .common import table

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, ids=False)
