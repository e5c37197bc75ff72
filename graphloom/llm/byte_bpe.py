"""Byte-level BPE with a sentencepiece model written straight from a rank vocabulary.

Each byte stands as one character, each vocabulary entry as a piece whose score is minus its rank and whose id is its
rank; normalisation is the identity. Merging the best-scored pair, the leftmost first, is then the rank merge of
byte-level BPE. Texts are cut into pre-tokens by the vocabulary's pattern, pre-tokens are encoded one by one (an entry
as a whole is its own id), and decoding maps ids back to bytes.

Defined cases: a null or empty text has no ids; repeated rows are encoded one by one; an empty table gives an empty
result; texts of any length are encoded whole, pre-token by pre-token; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import batch, map_arrow, texts_of
from graphloom.llm.pieces import split_pieces

#: Pieces and pre-tokens a worker remembers.
MEMORY = 350_000
#: Piece types and field numbers of the sentencepiece model format.
NORMAL, UNKNOWN, BPE = 1, 2, 2
_BYTE_CHARS = {i: chr(256 + i) for i in range(256)}
_coders: dict[int, Coder] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 entry and its rank a line."""
    return {base64.b64decode(a): int(r) for a, r in (line.split() for line in data.splitlines() if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def byte_chars(raw: bytes) -> str:
    """One character for each byte."""
    return raw.decode("latin-1").translate(_BYTE_CHARS)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece follows the last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = []
    for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, _field(1, byte_chars(raw).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, NORMAL)))
    pieces.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, UNKNOWN)))
    none = (1 << 64) - 1
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(k, none) for k in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Coder:
    """Encoder and decoder of one vocabulary; remembers pieces and pre-tokens, up to a bound."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(vocabulary)
        self.table = [b""] * len(self.ranks)
        for raw, rank in self.ranks.items():
            self.table[rank] = raw
        self.decimal = [str(i) for i in range(len(self.table))]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.cut = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.tokens: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: list[str]) -> None:
        cut = {p: self.cut(p) for p in pieces}
        new = list({t for tokens in cut.values() for t in tokens if t not in self.tokens})
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        hard = [i for i, r in enumerate(raw) if r not in self.ranks]
        coded = dict(zip(hard, self.model.encode([byte_chars(raw[i]) for i in hard], num_threads=1), strict=True)) if hard else {}
        for i, t in enumerate(new):
            self.tokens[t] = tuple(coded[i]) if i in coded else (self.ranks[raw[i]],)
        for p, tokens in cut.items():
            self.pieces[p] = tuple(chain.from_iterable(map(self.tokens.__getitem__, tokens)))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; what is new in all of them is encoded first."""
        cut = [split_pieces(t) for t in texts]
        known = self.pieces
        if len(known) > MEMORY or len(self.tokens) > MEMORY:
            known.clear()
            self.tokens.clear()
        new = {p for pieces in cut for p in pieces if p not in known}
        if new:
            self._learn(list(new))
        return (list(chain.from_iterable([known[p] for p in pieces])) for pieces in cut)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def coder(vocabulary: bytes, pattern: str) -> Coder:
    """The worker's coder of a vocabulary."""
    key = zlib.crc32(vocabulary + pattern.encode())
    if key not in _coders:
        _coders[key] = Coder(vocabulary, pattern)
    return _coders[key]


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern))
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        encode = coder(*shared.value).encode_all
        for b in batches:
            yield batch(out, doc_id=b.column("doc_id"), ids=list(encode(texts_of(b))))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(doc_id, raw) of every row of (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast((vocabulary, pattern))
    out = pa.schema([("doc_id", pa.int64()), ("raw", pa.binary())])

    def run(batches):
        decode = coder(*shared.value).decode
        for b in batches:
            yield batch(out, doc_id=b.column("doc_id"), raw=[decode(i or []) for i in b.column("ids").to_pylist()])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, raw binary")


def code_documents(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids of every row and the digest of the bytes decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def run(batches):
        c = coder(*shared.value)
        for b in batches:
            coded = list(c.encode_all(texts_of(b)))
            yield batch(out, doc_id=b.column("doc_id"), n_tokens=[len(x) for x in coded], ids=coded, decoded_sha256=[hashlib.sha256(c.decode(x)).hexdigest() for x in coded])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def round_trip(docs: DataFrame, vocabulary: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = coder(*shared.value)
        decimal = c.decimal.__getitem__
        for b in batches:
            n, first, second = [], [], []
            for ids in c.encode_all(texts_of(b)):
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield batch(out, doc_id=b.column("doc_id"), n_tokens=n, ids_sha256=first, decoded_sha256=second)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
