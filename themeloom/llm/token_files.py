"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

A file is a Parquet table of blocks. Each block holds whole documents in ascending ``doc_id`` order and
one binary payload:

    magic, version, n_docs, n_ids   header
    has_id   uint8  x n_docs        0 for a null doc_id
    doc_id   int64  x n_docs
    size     uint32 x n_docs        ids of the document
    control  ceil(n_ids / 4)        two bits an id: bytes of its rank less one, first id in the low bits
    data                            ranks, 1 to 4 bytes each, low byte first

A rank is the place of an id when all ids are sorted by falling count over all documents; the table
``ranks`` beside the blocks maps it back. Frequent ids thus take one byte.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import python_ready, stored
from themeloom.session import scratch_path

MAGIC, VERSION = b"TLID", 1
HEADER = struct.Struct("<4sIQQ")
#: Ids after which a block is closed at the next document's end.
BLOCK_IDS = 500_000

#: Bytes of the four ranks that a control byte announces.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks > 0xFF) + (ranks > 0xFFFF).astype(np.int64) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    cells = ranks.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), cells[np.arange(4) < sizes[:, None]].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The numbers back, by a table lookup of their sizes."""
    sizes = LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    first = np.cumsum(sizes) - sizes
    out = data[first].astype(np.uint32) if n else np.empty(0, np.uint32)
    for b in (1, 2, 3):
        more = np.flatnonzero(sizes > b)
        out[more] |= data[first[more] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def pack_block(doc_ids: list[int | None], sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_ranks(ranks)
    return b"".join(
        [
            HEADER.pack(MAGIC, VERSION, len(doc_ids), len(ranks)),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            sizes.astype("<u4").tobytes(),
            control,
            data,
        ]
    )


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    magic, version, docs, n = HEADER.unpack_from(block)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of token ids")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, count, at)
        at += out.nbytes
        return out

    known, doc_ids, sizes = take("u1", docs), take("<i8", docs), take("<u4", docs)
    control = take("u1", -(-n // 4))
    ranks = unpack_ranks(control, np.frombuffer(block, np.uint8, offset=at), n)
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], sizes, ranks


def token_rows(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", kind: str = "<u4") -> DataFrame:
    """One row a document: ``doc_id``, ``ids`` (little-endian numbers of ``kind``, ``end`` last), ``n_tokens``.

    A null text counts as empty and gives ``end`` alone.
    """
    python_ready(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.word_ids import encoder, filled, portions

        words = encoder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column(0), filled(batch.column(1))
            for low, high in portions(texts):
                ids, sizes = words.encode(texts.slice(low, high - low), end)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                ids = ids.astype(kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(low, high - low),
                        pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                        pa.array(sizes, pa.int64()),
                    ],
                    names=["doc_id", "ids", "n_tokens"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary, n_tokens long")


def id_counts(rows: DataFrame, kind: str) -> DataFrame:
    """``id``, ``n``: how often each id occurs over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=len(total))
            found[: len(total)] += total
            total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode all documents and write them below ``path`` in ascending ``doc_id`` order (nulls first).

    Rows with one doc_id stay apart, ordered by their ids. What the driver holds is bounded by the
    vocabulary. An empty table writes an empty file.
    """
    from tokenizers import Tokenizer

    spark = python_ready(docs)
    kind = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
    rows = stored(token_rows(docs, tokenizer, end, key, text, kind), "ids")
    counts = sorted(((r.n, r.id) for r in id_counts(rows, kind).collect()), key=lambda x: (-x[0], x[1]))
    ranked = [i for _, i in counts]
    spark.createDataFrame(list(enumerate(ranked)), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.token_files import BLOCK_IDS, pack_block

        doc_ids, sizes, held, before, part = [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal doc_ids, sizes, held, before
            ranks = rank_of[np.concatenate(held)]
            out = pa.RecordBatch.from_pydict(
                {"part": [part], "ids_before": [before], "n_ids": [len(ranks)], "block": [pack_block(doc_ids, np.array(sizes), ranks)]},
                pa.schema([("part", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())]),
            )
            before += len(ranks)
            doc_ids, sizes, held = [], [], []
            return out

        waiting = 0
        for batch in batches:
            for part_id, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = part_id
                doc_ids.append(doc_id)
                held.append(np.frombuffer(ids, kind))
                sizes.append(len(held[-1]))
                waiting += sizes[-1]
                if waiting >= BLOCK_IDS:
                    yield block()
                    waiting = 0
        if doc_ids:
            yield block()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(
        pack, "part int, ids_before long, n_ids long, block binary"
    ).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian uint32)."""
    ranked = [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    id_of = np.array(ranked, "<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    python_ready(blocks)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("part_start"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.token_files import unpack_block

        for batch in batches:
            for start, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, sizes, ranks = unpack_block(block)
                ids, cuts = id_of[ranks], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(start + cuts[:-1], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    placed = blocks.join(parts, "part").select((F.col("part_start") + F.col("ids_before")).alias("start"), "block")
    return placed.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from themeloom.llm.common import read

    path = scratch_path(spark, "token-file")
    write_token_file(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    rows = read_token_file(spark, path)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
