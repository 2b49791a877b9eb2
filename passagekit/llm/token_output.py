"""Binary output of token ids in bit or byte planes.

A bin is one self-contained file image, held as a row of a Parquet table so that
Spark's committer, any file system and lost executors are taken care of:

    "PLNIDS01" | planes a block (8 or 32) | ids a block | documents | ids | blocks
    document table (zstandard): ids, null flags, lengths
    blocks: each plane of block_ids ids compressed apart with zstandard
    chunk index: for each block its first byte and the planes' compressed sizes
    position of the chunk index (8 bytes)

Byte planes hold byte k of every id of the block, bit planes bit k. Bins follow
each other in ascending document id (null first): by part, then bin.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MAGIC = b"PLNIDS01"
_HEAD = struct.Struct("<8sIIQQQQ")


def pack_bin(doc_ids: list[int | None], lengths: list[int], ids: bytes, planes: str = "byte", block_ids: int = 1 << 16) -> bytes:
    """The file image of some documents' ids (little-endian unsigned 32-bit, one after the other)."""
    import numpy as np
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    flat = np.frombuffer(ids, "<u4")
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(lengths, "<i8").tobytes()
    table = z.compress(table)
    n_planes = 4 if planes == "byte" else 32
    out, index = [table], []
    at = _HEAD.size + len(table)
    for i in range(0, len(flat), block_ids):
        raw = np.ascontiguousarray(flat[i : i + block_ids]).view(np.uint8).reshape(-1, 4)
        if planes == "bit":
            rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
        else:
            rows = np.ascontiguousarray(raw.T)
        parts = [z.compress(r.tobytes()) for r in rows]
        index.append([at, *map(len, parts)])
        out += parts
        at += sum(index[-1][1:])
    head = _HEAD.pack(_MAGIC, n_planes, block_ids, len(doc_ids), len(flat), len(index), len(table))
    return b"".join([head, *out, np.array(index, "<u8").tobytes(), struct.pack("<Q", at)])


def unpack_block(data: bytes, k: int) -> bytes:
    """The ids of block k, found through the chunk index."""
    import numpy as np
    import zstandard

    _, n_planes, block_ids, _, n_ids, n_blocks, _ = _HEAD.unpack_from(data)
    (at,) = struct.unpack_from("<Q", data, len(data) - 8)
    first, *sizes = map(int, np.frombuffer(data, "<u8", 1 + n_planes, at + 8 * (1 + n_planes) * k))
    n = min(block_ids, n_ids - k * block_ids)
    z, rows = zstandard.ZstdDecompressor(), []
    for s in sizes:
        rows.append(np.frombuffer(z.decompress(data[first : first + s]), np.uint8))
        first += s
    if n_planes == 32:
        bits = np.unpackbits(np.stack(rows), axis=1, count=n, bitorder="little")
        return np.packbits(bits.T, axis=1, bitorder="little").tobytes()
    return np.stack(rows, axis=1).tobytes()


def unpack_bin(data: bytes) -> tuple[list[int | None], list[int], bytes]:
    """What pack_bin was given."""
    import numpy as np
    import zstandard

    magic, _, _, n_docs, _, n_blocks, table = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a file of token ids")
    raw = zstandard.ZstdDecompressor().decompress(data[_HEAD.size : _HEAD.size + table])
    ids, nulls = np.frombuffer(raw, "<i8", n_docs), raw[8 * n_docs : 9 * n_docs]
    lengths = np.frombuffer(raw, "<i8", n_docs, 9 * n_docs).tolist()
    return [None if z else d for d, z in zip(ids.tolist(), nulls, strict=True)], lengths, b"".join(unpack_block(data, k) for k in range(n_blocks))


def write_ids(
    df: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 1,
    planes: str = "byte",
    block_ids: int = 1 << 16,
    bin_ids: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every whole text, append end_id and write the bins to path.

    The texts are range-partitioned by id once and encoded after that, so ids are
    never shuffled; a bin closes at bin_ids ids or more. Null texts give end_id
    alone, repeated ids follow each other, an empty table gives no bins.
    """
    schema = "part int, bin int, first long, n_docs long, n_ids long, data binary"

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder as own_encoder

        encoder, part = own_encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        docs: list = []
        lengths: list[int] = []
        ids: list[bytes] = []
        state = {"bin": 0, "first": 0, "n": 0}

        def close() -> pa.RecordBatch:
            data = pack_bin(docs, lengths, b"".join(ids), planes, block_ids)
            row = [part], [state["bin"]], [state["first"]], [len(docs)], [state["n"]], [data]
            types = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            state.update(bin=state["bin"] + 1, first=state["first"] + state["n"], n=0)
            docs.clear(), lengths.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "bin", "first", "n_docs", "n_ids", "data"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = encoder.encode([text.as_py()])[0] + end
                docs.append(doc)
                lengths.append(len(own) // 4)
                ids.append(own)
                state["n"] += len(own) // 4
                if state["n"] >= bin_ids:
                    yield close()
        if docs:
            yield close()

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    rows = rows.repartitionByRange(id_col).sortWithinPartitions(id_col)
    rows.mapInArrow(pack, schema).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the bins at path: id, start, n_tokens, ids."""
    bins = spark.read.schema("part int, bin int, first long, n_docs long, n_ids long, data binary").parquet(path)

    def unpack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs, lengths, ids = unpack_bin(data.as_py())
                n = np.array(lengths, np.int64)
                ends = np.cumsum(n)
                starts = ends - n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(docs), pa.int32()),
                        pa.array(docs, pa.int64()),
                        pa.array(starts + first, pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    ],
                    ["part", "doc", "local", "n_tokens", "ids"],
                )

    docs = bins.select("part", "first", "data").mapInArrow(unpack, "part int, doc long, local long, n_tokens long, ids binary")
    # one row a part of the writer: this window orders parts, never documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = bins.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(parts), "part").select(
        F.col("doc").alias(id_col), (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids"
    )
