"""Byte-level BPE encoding and decoding by a sentencepiece model written straight from a rank file.

Each byte of a token is mapped to one printable character, so every token is a piece of text; its score
is its negative rank, so the library joins the pair of lowest rank first, as byte-level BPE does. The
normaliser is the identity. Texts are cut by the pattern, each distinct piece is encoded once per
worker, and decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import python_ready
from themeloom.llm.word_ids import byte_letters

#: Fixed values of the sentencepiece model format: type BPE, piece types, field numbers by name.
MODEL_BPE, NORMAL, UNKNOWN = 2, 1, 2
FIELDS = {"pieces": 1, "trainer": 2, "normalizer": 3, "piece": 1, "score": 2, "type": 3, "model_type": 3, "vocab_size": 4, "unk_id": 40, "bos_id": 41, "eos_id": 42, "pad_id": 43, "name": 1, "add_dummy_prefix": 3, "remove_extra_whitespaces": 4, "escape_whitespaces": 5}


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, token of rank i at place i."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: str, value: int) -> bytes:
    return _varint(FIELDS[field] << 3) + _varint(value)


def _block(field: str, value: bytes) -> bytes:
    return _varint(FIELDS[field] << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; one unknown piece follows them."""
    letters = byte_letters()
    score = _varint(FIELDS["score"] << 3 | 5)
    pieces = [
        _block("pieces", _block("piece", "".join([letters[b] for b in token]).encode()) + score + struct.pack("<f", -rank) + _number("type", NORMAL))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_block("pieces", _block("piece", b"<unk>") + score + struct.pack("<f", 0) + _number("type", UNKNOWN)))
    trainer = _number("model_type", MODEL_BPE) + _number("vocab_size", len(tokens) + 1) + _number("unk_id", len(tokens))
    trainer += b"".join(_number(f, -1) for f in ("bos_id", "eos_id", "pad_id"))
    normalizer = _block("name", b"identity") + b"".join(_number(f, 0) for f in ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces"))
    return b"".join(pieces) + _block("trainer", trainer) + _block("normalizer", normalizer)


class PieceCodec:
    def __init__(self, path: str, pattern: str, limit: int = 400_000):
        import regex
        import sentencepiece

        self.tokens = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        letters = byte_letters()
        self.table = str.maketrans({chr(b): letters[b] for b in range(256)})
        self.limit = limit
        self.whole = {token: (rank,) for rank, token in enumerate(self.tokens)}
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: set[str]) -> None:
        """A piece that is a token itself has its rank, as in the rank-file library; others go through the model."""
        new = []
        for p in pieces:
            raw = p.encode()
            ids = self.whole.get(raw)
            if ids is None:
                new.append((p, raw.decode("latin-1").translate(self.table)))
            else:
                self.known[p] = ids
        for (p, _), ids in zip(new, self.model.encode([m for _, m in new], num_threads=1), strict=True):
            self.known[p] = tuple(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.limit:
            self.known = {}
        split = [self.find(t) for t in texts]
        missing = {p for pieces in split for p in pieces}.difference(self.known)
        self._learn(missing)
        get = self.known.__getitem__
        return [np.fromiter((i for ids in map(get, pieces) for i in ids), "<u4") for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_HELD: dict[tuple[str, str], PieceCodec] = {}


def codec(path: str, pattern: str) -> PieceCodec:
    if (path, pattern) not in _HELD:
        _HELD[path, pattern] = PieceCodec(path, pattern)
    return _HELD[path, pattern]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``ids`` (little-endian uint32), ``n_tokens``.

    A null or empty text gives no ids; null and repeated doc_ids are rows like any other.
    """
    python_ready(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.byte_bpe import codec
        from themeloom.llm.word_ids import filled, portions

        pieces = codec(ranks, pattern)
        for batch in batches:
            texts = filled(batch.column(1))
            for low, high in portions(texts, 4_000_000):
                found = pieces.encode(texts.slice(low, high - low).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array([i.tobytes() for i in found], pa.binary()), pa.array(list(map(len, found)), pa.int64())],
                    names=["doc_id", "ids", "n_tokens"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The rows of ``encode_documents`` with the bytes that the ids stand for in ``decoded``."""
    python_ready(encoded)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.byte_bpe import codec

        pieces = codec(ranks, pattern)
        for batch in batches:
            texts = pa.array([pieces.decode(i) for i in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["doc_id", "ids", "n_tokens", "decoded"])

    return encoded.select("doc_id", "ids", "n_tokens").mapInArrow(decode, "doc_id long, ids binary, n_tokens long, decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from themeloom.llm.common import read

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = decode_documents(encode_documents(read(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
