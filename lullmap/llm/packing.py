"""Packing by power-of-two decomposition: every piece is a sequence of its own length bucket."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullmap.llm.common import query, table, text_of

MAX_TOKENS = 2048
END_ID = 1
# Pieces of text whose ids a worker remembers.
CACHED_PIECES = 400_000

# Letters, digits and white space among the first 256 characters, as the vocabulary's rules see them.
_LETTERS, _DIGITS, _SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
_PIECES = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")


def _byte_letters() -> dict[int, str]:
    """The printable characters that stand for the UTF-8 bytes of the first 256 characters."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class PieceIds(dict):
    """Token ids of a piece of text, as little-endian 32-bit integers.

    The tokenizer's rules cut a lower-cased text into pieces and encode each by itself, so a
    piece that was met before need not be encoded again. That is done for texts of the first
    256 characters, which its normalisation only lowers; others are given to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        ids = [t.id for t in self.model.tokenize(piece.translate(self.letters))]
        got = self[piece] = np.array(ids, "<u4").tobytes()
        return got

    def of(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            narrow = not any(s in text for s in self.special)
        except UnicodeEncodeError:
            narrow = False
        if not narrow:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, _PIECES.findall(text.lower())))


def lengths(tokens: int, most: int = MAX_TOKENS) -> list[int]:
    """Binary lengths of a document's pieces, largest first; ``most`` is a power of two."""
    full, rest = divmod(tokens, most)
    return [most] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, most: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Cut every document into pieces of power-of-two length; equal lengths form a bucket.

    Pieces hold the tokenizer's ids and then the end id, each exactly once. A piece is a whole
    sequence: none holds two documents and none needs padding. ``length`` is the bucket;
    ``write_buckets`` stores each bucket apart. Work is one pass without a shuffle.

    Null and empty texts give one piece with the end id. Null ids stay null and repeated rows
    are packed each for itself; ``sequence_id`` is unique over all. Other columns are ignored.
    """
    assert most & (most - 1) == 0, "the longest sequence must be a power of two"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PieceIds(tokenizer)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = known.of(text.as_py()) + end
                view, at = memoryview(ids), 0
                for n in lengths(len(ids) // 4, most):
                    piece = view[4 * at : 4 * (at + n)]
                    row = (doc_id.as_py(), at, n, zlib.crc32(piece), len(ids) // 4)
                    out.append((*row, bytes(piece)) if with_ids else row)
                    at += n
                if len(out) > 20_000:
                    yield rows(out, batch.column(0).type)
                    out = []
            if out:
                yield rows(out, batch.column(0).type)

    def rows(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = [id_type, *[pa.int64()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if with_ids:
        schema, names = f"{schema}, ids binary", [*names, "ids"]
    out = docs.select("doc_id", text_of(F.col("text"))).mapInArrow(pieces, schema)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store the pieces in a folder per length, as batches of one shape are drawn from."""
    pieces.write.partitionBy("length").parquet(path)


@query("op1_packing")
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
