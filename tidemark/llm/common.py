"""Helpers shared by the text operators: staged tables, packed arrays, whole-table readers."""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, prepare

#: ASCII white space as the contracts write it; ``bytes.split`` and ``bytes.strip`` use the same set.
WS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The files outlive lost executors, the lineage ends here, and later readers take single columns of it.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)




def pack(a, level: int = 3, planes: bool = True) -> bytes:
    """An unsigned array under zstd, as byte planes (small values cost little) or as it is (repeats cost little)."""
    a = np.ascontiguousarray(a)
    cut = a.view(np.uint8).reshape(-1, a.itemsize)
    keep = next((k for k in range(a.itemsize, 0, -1) if cut[:, k - 1].any()), 0) if planes else 255
    head = bytes([a.itemsize, keep]) + len(a).to_bytes(8, "little")
    return head + zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(cut[:, :keep].T).tobytes() if planes else a.tobytes())


def unpack(b: bytes) -> np.ndarray:
    size, keep, n = b[0], b[1], int.from_bytes(b[2:10], "little")
    if keep == 255:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(b[10:], max_output_size=n * size), f"<u{size}") if n else np.zeros(0, f"<u{size}")
    out = np.zeros((n, size), np.uint8)
    if n and keep:
        raw = zstandard.ZstdDecompressor().decompress(b[10:], max_output_size=n * keep)
        out[:, :keep] = np.frombuffer(raw, np.uint8).reshape(keep, n).T
    return out.reshape(-1).view(f"<u{size}")


def pack_words(words: list[bytes]) -> bytes:
    lens = pack(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(lens).to_bytes(8, "little") + lens + zstandard.ZstdCompressor(level=12).compress(b"".join(words))


def unpack_words(b: bytes) -> list[bytes]:
    k = int.from_bytes(b[:8], "little")
    ends = np.cumsum(unpack(b[8 : 8 + k]).astype(np.int64))
    if not len(ends):
        return []
    blob = zstandard.ZstdDecompressor().decompress(b[8 + k :], max_output_size=max(1, int(ends[-1])))
    ends = ends.tolist()
    return [blob[i:j] for i, j in zip([0, *ends], ends)]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lens[i] - 1, one run after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as bytes objects; null is the empty text."""
    return [b if b is not None else b"" for b in column.cast(pa.large_binary()).to_pylist()]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def small(batches, rows: int = 1000):
    """Arrow batches in slices, so that only few texts are Python objects at the same time."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


def in_fold(column: str, remainder: int, folds: int = 5):
    """Whether crc32 of the id as text has this remainder; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds) == remainder


def fold_of(doc_id, folds: int = 5) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def groups_for(total: int, each: int, least: int = 1) -> int:
    """How many groups keep each near ``each`` units."""
    return max(least, math.ceil(total / each))
