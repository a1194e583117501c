"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of a range of documents, one after the other, in blocks
of ``BLOCK`` values. Of each block the minimum is subtracted; the rest is
packed at the smallest width that fits ``PERCENTILE`` per cent of the block's
values, and what doesn't fit keeps its low bits there and its high bits in the
block's exception list. Layout, all little-endian:

    b"PFR1" | segments | document index | footer | u64 place of the footer | b"PFR1"

    segment: packed words of its blocks, grouped by width, then the exceptions'
        positions (u32 from the segment's start) and high bits (u32)
    footer: JSON with each segment's place, counts and block table (minimum u32,
        width u8, start u32 of the packed words), and the document index's place
    document index: ids (i64) and lengths (as a segment of their own)
"""

from __future__ import annotations

import io
import json
import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import BatchEncoder
from ._shared import local_path, new_folder, ship, text_bytes
from ._words import groups

MAGIC, BLOCK, PERCENTILE, SEGMENT, SLICE = b"PFR1", 128, 90, 1 << 20, 8 << 20


def pack(values: np.ndarray) -> tuple[dict, bytes]:
    """One segment: its table and its bytes. ``values``: unsigned 32-bit."""
    n = len(values)
    full = np.zeros(-(-n // BLOCK) * BLOCK, np.uint32)
    full[:n] = values
    if n % BLOCK:
        full[n:] = values[-1]
    blocks = full.reshape(-1, BLOCK)
    low = blocks.min(axis=1)
    rest = blocks - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = np.partition(bits, rank, axis=1)[:, rank]
    over = bits > width[:, None]
    spot = np.flatnonzero(over.ravel()).astype("<u4")
    high = (rest[over].astype(np.uint64) >> np.broadcast_to(width[:, None], rest.shape)[over].astype(np.uint64)).astype("<u4")
    starts = np.zeros(len(blocks), "<u4")
    out, at = [], 0
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        words = _pack_width(rest[own], int(w))
        starts[own] = at + np.arange(len(own)) * words.shape[1]
        out.append(words.astype("<u8").tobytes())
        at += words.size
    body = [*out, low.astype("<u4").tobytes(), width.tobytes(), starts.tobytes(), spot.tobytes(), high.tobytes()]
    return {"n": n, "blocks": len(blocks), "words": at, "exceptions": len(spot)}, b"".join(body)


def _pack_width(v: np.ndarray, w: int) -> np.ndarray:
    """Rows of BLOCK values to rows of 64-bit words with ``w`` bits a value."""
    out = np.zeros((BLOCK * w // 64, len(v)), np.uint64)
    if w:
        cols = np.ascontiguousarray(v.T).astype(np.uint64) & np.uint64((1 << w) - 1)
        for i in range(BLOCK):
            k, s = divmod(i * w, 64)
            out[k] |= cols[i] << np.uint64(s)
            if s + w > 64:
                out[k + 1] |= cols[i] >> np.uint64(64 - s)
    return np.ascontiguousarray(out.T)


def _unpack_width(words: np.ndarray, w: int) -> np.ndarray:
    out = np.zeros((BLOCK, len(words)), np.uint64)
    if w:
        rows, mask = np.ascontiguousarray(words.T), np.uint64((1 << w) - 1)
        for i in range(BLOCK):
            k, s = divmod(i * w, 64)
            x = rows[k] >> np.uint64(s)
            if s + w > 64:
                x = x | rows[k + 1] << np.uint64(64 - s)
            out[i] = x & mask
    return np.ascontiguousarray(out.T)


def unpack(table: dict, data: bytes) -> np.ndarray:
    nb, at = table["blocks"], table["words"] * 8
    words = np.frombuffer(data, "<u8", table["words"])
    low = np.frombuffer(data, "<u4", nb, at)
    width = np.frombuffer(data, "u1", nb, at + 4 * nb)
    starts = np.frombuffer(data, "<u4", nb, at + 5 * nb)
    spot = np.frombuffer(data, "<u4", table["exceptions"], at + 9 * nb)
    high = np.frombuffer(data, "<u4", table["exceptions"], at + 9 * nb + 4 * table["exceptions"])
    out = np.zeros((nb, BLOCK), np.uint64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        k = BLOCK * int(w) // 64
        out[own] = _unpack_width(words[starts[own][:, None] + np.arange(k)], int(w))
    flat = out.ravel()
    flat[spot] |= high.astype(np.uint64) << width[spot // BLOCK].astype(np.uint64)
    return (out + low[:, None]).ravel()[: table["n"]].astype(np.uint32)


class Writer:
    """Writes one file; ``close`` makes it visible under its name and returns the counts."""

    def __init__(self, folder: str, name: str):
        os.makedirs(folder, exist_ok=True)
        self.path, self.part = os.path.join(folder, name), os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        self.file = open(self.part, "wb")
        self.file.write(MAGIC)
        self.segments, self.docs, self.lengths, self.waiting, self.held = [], [], [], [], 0

    def add(self, docs: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents with their ids one after the other, and the number of each one's."""
        self.docs += docs
        self.lengths += lengths.tolist()
        self.waiting.append(ids.astype(np.uint32, copy=False))
        self.held += len(ids)
        while self.held >= SEGMENT:
            self._segment(SEGMENT)

    def _segment(self, n: int) -> None:
        values = np.concatenate(self.waiting)
        table, data = pack(values[:n])
        self.segments.append(table | {"at": self.file.tell(), "size": len(data)})
        self.file.write(data)
        self.waiting, self.held = [values[n:]], len(values) - n

    def close(self) -> tuple[int, int]:
        if self.held:
            self._segment(self.held)
        ids = np.asarray([0 if x is None else x for x in self.docs], "<i8")
        null = np.packbits(np.asarray([x is None for x in self.docs], bool))
        at = self.file.tell()
        table, data = pack(np.asarray(self.lengths, np.uint32)) if self.docs else ({"n": 0}, b"")
        self.file.write(ids.tobytes() + null.tobytes() + data)
        foot = json.dumps({"segments": self.segments, "docs": len(ids), "docs_at": at, "lengths": table | {"size": len(data)}}).encode()
        place = self.file.tell()
        self.file.write(foot + place.to_bytes(8, "little") + MAGIC)
        self.file.close()
        os.replace(self.part, self.path)
        return len(self.docs), sum(self.lengths)


class Reader:
    def __init__(self, path: str):
        self.file = open(path, "rb")
        self.file.seek(-12, io.SEEK_END)
        tail = self.file.read(12)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path}: not a file of token blocks")
        self.file.seek(place := int.from_bytes(tail[:8], "little"))
        foot = json.loads(self.file.read()[:-12])
        assert place > 0
        self.segments, n = foot["segments"], foot["docs"]
        self.file.seek(foot["docs_at"])
        self.docs = np.frombuffer(self.file.read(8 * n), "<i8")
        self.null = np.unpackbits(np.frombuffer(self.file.read(-(-n // 8)), "u1"), count=n).astype(bool)
        self.lengths = unpack(foot["lengths"], self.file.read(foot["lengths"]["size"])) if n else np.zeros(0, np.uint32)

    def ids(self):
        """The ids of one document after another, a segment in memory at a time."""
        segments, rest = iter(self.segments), np.zeros(0, np.uint32)
        for length in self.lengths.tolist():
            have = [rest]
            got = len(rest)
            while got < length:
                s = next(segments)
                self.file.seek(s["at"])
                have.append(unpack(s, self.file.read(s["size"])))
                got += len(have[-1])
            rest = np.concatenate(have) if len(have) > 1 else rest
            yield rest[:length]
            rest = rest[length:]


@lru_cache(maxsize=2)
def _encoder(path: str) -> BatchEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tok = Tokenizer.from_file(path)
    about = json.loads(tok.to_str())
    first = about["pre_tokenizer"] or {}
    if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True) or about["normalizer"]:
        raise ValueError(f"{path}: texts are cut where byte-level BPE without a normalizer allows it")
    one_byte = set(ByteLevel.alphabet())  # the vocabulary writes each byte as one of these characters
    vocab = tok.get_vocab()
    token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        token_bytes[i] = len(token) if set(token) <= one_byte else len(token.encode())
    return BatchEncoder(lambda text: np.asarray(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32), token_bytes)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of ``id_col``.

    Returns the manifest, one row for each file: ``part`` int, ``path``,
    ``docs`` and ``ids`` long, ``start`` long (ids in all files before it); it
    has as many rows as there are partitions. Null and empty texts have the end
    id alone; null ids come first; rows of equal id lie in the order of their
    texts, so reruns agree. The strings of the tokenizer's special tokens are
    these tokens, as they are by the library's default. Other columns are not
    read. A task that runs twice writes under another name, and the manifest
    names the file of the attempt that counts. Stretches of text are told apart
    by 64-bit hashes. Only byte-level BPE without a normalizer or a first space
    is taken: for it alone texts may be cut.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "tokens")
    place = local_path(folder)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer, coder = None, _encoder(tokenizer_path)
        for batch in batches:
            writer = writer or Writer(place, f"part-{part:05d}-{TaskContext.get().taskAttemptId()}.pfr")
            doc_ids = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for a, b in groups(offsets, SLICE, 1 << 14):
                ids, ends = coder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                writer.add(doc_ids[a:b], np.insert(ids, ends[1:], end_id), np.diff(ends) + 1)
        if writer:
            n, ids = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [writer.path], "docs": [n], "ids": [ids]})

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    files = picked.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "part int, path string, docs bigint, ids bigint")
    start, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r.part):  # a row for each partition
        rows.append((r.part, r.path, r.docs, r.ids, start))
        start += r.ids
    return spark.createDataFrame(rows, "part int, path string, docs bigint, ids bigint, start bigint")


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` binary.

    Repeated and null ids come out as they were written; an empty manifest gives no rows; a file that is gone is an error.
    """

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = Reader(path)
                lengths = r.lengths.astype(np.int64)
                starts = start + np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
                at, crc, ids = 0, [], []
                doc_ids = pa.array(r.docs, pa.int64(), mask=r.null)

                def rows(a, b):
                    cols = [doc_ids.slice(a, b - a), pa.array(starts[a:b]), pa.array(lengths[a:b]), pa.array(crc, pa.int64())]
                    return pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary())] if with_ids else cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

                for k, x in enumerate(r.ids()):
                    raw = x.astype("<u4").tobytes()
                    crc.append(zlib.crc32(raw))
                    ids += [raw] if with_ids else []
                    if len(crc) == 4096:
                        yield rows(at, k + 1)
                        at, crc, ids = k + 1, [], []
                if crc:
                    yield rows(at, len(lengths))

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids)
