"""Shared pieces of the training-data operators: table access, scratch tables, batch text arrays."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.sources.session import shared_dir


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by the path Spark's own reader opens. Arrow batches are held to 8 MB, so
    that a Python worker's memory does not follow the length of texts."""
    if int(spark.conf.get(BATCH).removesuffix("b")) > 8 << 20:
        spark.conf.set(BATCH, str(8 << 20))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, so a lost
    executor costs a re-read and never a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame, free: bool = True) -> None:
    """Delete staged tables that no later step reads, and (unless little was shuffled) let Spark drop the shuffle files of
    finished steps (it does so when the driver collects its garbage): both would else stay until the end."""
    if not staged:
        return
    jvm = staged[0].sparkSession._jvm
    conf = staged[0].sparkSession.sparkContext._jsc.hadoopConfiguration()
    for df in staged:
        path = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(conf).delete(path, True)
    if free:
        release(staged[0].sparkSession)


def ints(values: list) -> pd.arrays.IntegerArray:
    """A nullable 64-bit column; a plain list with nulls would go through doubles and lose digits."""
    return pd.array([None if pd.isna(v) else int(v) for v in values], dtype="Int64")


def release(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return a Python worker's freed memory to the system: workers serve stage after stage, and what one has freed
    would else count against the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def free_name(taken: list[str], base: str) -> str:
    """base, with as many underscores as keep it apart from the names taken."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base += "_"
    return base


def whole_row(docs: DataFrame) -> Column:
    """A row of docs as one struct, so that columns an operator adds can have any name."""
    return F.struct(*[docs[c] for c in docs.columns])


def row_key() -> list[Column]:
    """id0 and th: a row's id (0 for null), and the hash of its text and of whether the id is null."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id0"), F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("th")]


def with_text(rows: DataFrame, docs: DataFrame, row: str, changed: Column, text: Column) -> DataFrame:
    """docs' columns out of the struct `row`; where `changed`, with the new text and, if there is one, n_chars counted anew."""
    out = []
    for c in docs.columns:
        old = F.col(row)[c]
        if c == "text":
            old = F.when(changed, text).otherwise(old)
        elif c == "n_chars":
            old = F.when(changed, F.length(text)).otherwise(old).cast(docs.schema[c].dataType)
        out.append(old.alias(c))
    return rows.select(*out)


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(k))


def share(h: Column, bound: int, rows: int) -> Column:
    """Rows whose hash lies in the lowest bound / rows of its range: about `bound` of them, whatever `rows` is, chosen
    where they are and without a sort."""
    return F.pmod(h, F.lit(1 << 40)) < math.ceil(min(1.0, bound / max(rows, 1)) * (1 << 40))


# ---- text batches as numpy arrays -------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_POW: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POW[base] = have
    return have[:n]


def powers(n: int) -> np.ndarray:
    """The powers by which `span_hash` weighs n positions."""
    return _powers(n, _BASE)


BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64))
_INV = pow(_BASE, -1, 1 << 64)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of key(buf[j]) * base^j over j < i, modulo 2^64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[buf] * _powers(len(buf), _BASE), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] for many spans; equal spans hash alike wherever they stand."""
    inv = _powers(len(prefix), _INV)
    h = (prefix[end] - prefix[start]) * inv[start]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of a batch of texts, as arrays over the joined bytes."""

    def __init__(self, texts: list[bytes]):
        self.lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.doc_start = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(self.lens + 1, out=self.doc_start[1:])  # a line end after each text
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = is_space(self.buf)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.start = self.start[: len(self.end)]
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # first word of each text

    def hashes(self, buf: np.ndarray | None = None) -> np.ndarray:
        return span_hash(prefix_hash(self.buf if buf is None else buf), self.start, self.end)


def small_batches(ids: list, texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of whole texts of about `most` bytes together; a longer text makes a run of its own."""
    a, b, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if b and size + len(raw) > most:
            yield a, b
            a, b, size = [], [], 0
        a.append(i)
        b.append(raw)
        size += len(raw) + 1
    if b:
        yield a, b
