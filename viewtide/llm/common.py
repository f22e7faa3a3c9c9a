"""Helpers the corpus operators share: exact column picking, staged tables, words and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from viewtide.session import scratch_path

#: Bytes of a batch that are handled at once.
SLICE_BYTES = 4 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """The same rows under positional names c0, c1, ...: any clash of names is out of the way."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def position(df: DataFrame, name: str) -> int:
    """Place of the column of exactly this name; else of the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    same = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(same) != 1:
        raise ValueError(f"column {name} is missing")
    return same[0]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, whatever else the table carries."""
    flat = numbered(df)
    return flat.select(*[flat[f"c{position(df, n)}"].alias(n) for n in names])


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_at(df: DataFrame, label: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """``stage``, with the folder, for a table that is discarded when its last reader is done."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def whole_text(name: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def give_back() -> None:
    """Hand freed memory to the system: an idle worker would keep the most that any of its tasks held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, function, schema: str, after=None) -> DataFrame:
    """Apply ``function(dict of column name -> pyarrow array) -> dict of columns`` to every batch, some MB at a time.

    ``after`` is called at the end of a task: workers outlive their tasks, and so would what they remember.
    """
    wanted = T.StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                step = max(1, batch.num_rows * SLICE_BYTES // max(SLICE_BYTES, batch.nbytes))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    columns = function({n: part.column(i) for i, n in enumerate(part.schema.names)})
                    if columns is not None:
                        yield pa.RecordBatch.from_arrays(
                            [c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, type=f.type)
                             for f, c in ((f, columns[f.name]) for f in target)], schema=target)
        finally:
            batch = part = columns = None
            if after is not None:
                after()
            give_back()

    return df.mapInArrow(run, wanted)


def text_bytes(array: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text without decoding it; None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return array.cast(kind).to_pylist()


LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes:
    """64-bit hashes of words; a word is hashed once while it stays in the table of bounded size."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words; of the whole sequence if it is shorter; none for no words."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        out = np.full(n, size, dtype=np.uint64)
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n])
    return out


BLOCK = 1 << 20


def word_blocks(text: bytes, size: int = BLOCK):
    """The words of a text, in lists from blocks of about ``size`` bytes: a very long text never becomes one list."""
    at, end = 0, len(text)
    while at < end:
        upto = at + size
        while upto < end and text[upto] not in b" \t\n\r\x0b\x0c":
            upto += 1
        words = (text[at:upto] if at or upto < end else text).split()
        if words:
            yield words
        at = upto


def text_hashes(text: bytes | None, hasher: WordHashes) -> np.ndarray:
    """The hash of every word of a text, A-Z in lower case."""
    parts = [hasher.of(words) for words in word_blocks((text or b"").lower())]
    if len(parts) == 1:
        return parts[0]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
