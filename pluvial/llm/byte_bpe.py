"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship

#: Texts of more characters than this are cut, where the pattern allows it, at about this many.
LONG = 1 << 16
ROWS = 512
# a space that a letter, digit or other non-space follows: no match crosses it or looks beyond it
_SAFE = regex.compile(r" (?=\S)")


@lru_cache(maxsize=4)
def _encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = LONG) -> Iterator[str]:
    """``text`` in pieces whose ids, put together, are those of the whole text."""
    a = 0
    while len(text) - a > size:
        cut = _SAFE.search(text, a + size)
        if cut is None:
            break
        yield text[a : cut.start()]
        a = cut.start()
    yield text[a:]


def encode(enc, text: str) -> bytes:
    return b"".join([enc.encode_to_numpy(p, disallowed_special=()).astype("<u4", copy=False).tobytes() for p in parts(text)]) if text else b""


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Token ids of every whole text, and the bytes that the ids stand for.

    Returns ``doc_id`` (the type of ``id_col``), ``ids`` binary (little-endian
    unsigned 32-bit integers), ``n_tokens`` long and, with ``decode``,
    ``decoded`` binary. A null or empty text has no ids. Texts of any length are
    cut where the split pattern cannot join the sides, so ids are those of
    ``encode_ordinary`` on the whole text. Rows that repeat come out as often
    as they came; a null id stays null; other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches):
        enc = _encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                ids = [encode(enc, t or "") for t in own.column(1).to_pylist()]
                cols = [own.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decode:
                    cols.append(pa.array([enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_tokens", "decoded"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint" + ", decoded binary" * decode)


def digests(encoded: DataFrame) -> DataFrame:
    """``n_tokens``, and SHA-256 of the ids and of the decoded bytes, for each document."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
