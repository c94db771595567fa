"""Byte-level BPE encoding and decoding by a local rank file.

Long texts are cut before encoding, only where the splitting pattern must cut in any case: after a
non-space character and before a space or line feed, so that the ids are those of the whole text.
Decoding joins the raw bytes of the ids; nothing passes through str, and invalid UTF-8 survives.

Cases: a null text is empty and has no ids; equal rows and null ids of documents are kept as they
are; a text without any safe boundary is encoded in one piece; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.llm._common import ship, table

#: Characters of a piece after which the next safe boundary is taken.
PIECE_CHARS = 1 << 15
RANKS = "byte_bpe_50k.tiktoken"

_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?=[ \n])")
_CODECS: dict[tuple[str, str], Codec] = {}


class Codec:
    """An encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(len(self.bytes_of))]

    def pieces(self, text: str, size: int = PIECE_CHARS) -> Iterator[str]:
        at = 0
        while len(text) - at > size:
            cut = _SAFE.search(text, at + size)
            if not cut or cut.start() == len(text):
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, text: str, size: int = PIECE_CHARS) -> list[int]:
        if len(text) <= size:
            return self.encoding.encode_ordinary(text)
        return [i for piece in self.pieces(text, size) for i in self.encoding.encode_ordinary(piece)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The codec of a file, built once in a process."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def with_tokens(_: Codec, __: str, ids: list[int], decoded: bytes) -> dict:
    """The plain output: the ids and the decoded bytes."""
    return {"ids": ids, "decoded": decoded}


def encode_decode(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    output: Callable[[Codec, str, list[int], bytes], dict] = with_tokens,
    schema: str = "ids array<int>, decoded binary",
) -> DataFrame:
    """Encodes and decodes each text. output makes the columns of schema from (codec, text, ids, decoded bytes) in the worker."""
    spark = docs.sparkSession
    ship(spark)
    path = path or public_tokenizers.path(RANKS)
    given = docs.select(*keep, text)
    whole = StructType([given.schema[k] for k in keep] + list(StructType.fromDDL(schema)))
    target = to_arrow_schema(whole)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            rows = []
            for t in b.column(len(keep)).to_pylist():
                ids = c.encode(t or "")
                rows.append(output(c, t or "", ids, c.decode(ids)))
            made = [pa.array([r[f.name] for r in rows], f.type) for f in list(target)[len(keep) :]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], schema=target)

    return given.mapInArrow(work, whole)


def digests(c: Codec, _: str, ids: list[int], decoded: bytes) -> dict:
    """What op3 returns of a document's ids and bytes."""
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(decoded).hexdigest(),
    }


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, output=digests, schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string")
