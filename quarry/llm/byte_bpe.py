"""Byte-level BPE encoding and decoding through a sentencepiece model that is made from a rank file.

The model is serialised here, straight from the vocabulary: every token's bytes become characters one to one (byte b is
U+0100 + b), a piece's score is its negative rank, and the normaliser changes nothing. sentencepiece then merges the
adjacent pair of the best score first, which is the pair of the lowest rank. Texts are split by the vocabulary's
pattern first and each match is encoded by itself; matches repeat much, so each worker keeps a bounded cache.

Defined results: null text is empty and has no tokens; very long texts and matches are encoded whole; rows are
independent, so repeated rows and repeated or null ids each give a row; an empty table gives an empty result; other
columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CACHED = 400_000  # matches kept by a worker
CACHED_CHARS = 64  # longer matches are encoded afresh
_TO_CHAR = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, space, rank per line) by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[k] for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: length-delimited for bytes, varint for int, 32 bits for float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def mapped(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_CHAR)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose ids are ranks; the unknown piece comes after the last token."""
    # Fixed values, sentencepiece_model.proto: ModelProto.pieces 1 (piece 1, score 2, type 3: unknown 2), trainer_spec 2
    # (model_type 3: BPE 2, vocab_size 4, unk_id 40), normalizer_spec 3 (name 1, add_dummy_prefix 3,
    # remove_extra_whitespaces 4, escape_whitespaces 5).
    pieces = [_field(1, _field(1, mapped(t).encode()) + _field(2, float(-rank))) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """encode() gives ids as little-endian unsigned 32-bit integers, decode() the bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import sentencepiece

        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        whole = {t: k for k, t in enumerate(tokens)}
        model = self.model

        class Cache(dict):
            def __missing__(self, match: str) -> bytes:
                octets = match.encode()
                rank = whole.get(octets)
                ids = model.encode(mapped(octets)) if rank is None else (rank,)
                packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(match) <= CACHED_CHARS:
                    if len(self) >= CACHED:
                        self.clear()
                    self[match] = packed
                return packed

        self.cache = Cache()

    def encode(self, text: str) -> bytes:
        return b"".join([*map(self.cache.__getitem__, self.pattern.findall(text))])

    def decode(self, ids: bytes) -> bytes:
        return b"".join([*map(self.tokens.__getitem__, memoryview(ids).cast("I"))])


_made: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One per worker process."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _made[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: the id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids (array) and decoded (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            out: list[list] = [[], [], []]
            ids, decoded = [], []
            for text in b.column(1).to_pylist():
                packed = bpe.encode(text or "")
                back = bpe.decode(packed)
                for column, value in zip(out, (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())):
                    column.append(value)
                if with_ids:
                    ids.append(memoryview(packed).cast("I").tolist())
                    decoded.append(back)
            columns = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())
    names = schema.names
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
