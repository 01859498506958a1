"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all operators that count or shingle words: runs of anything but these ASCII separators.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bounds of one Arrow batch. Texts may be long, so bytes bound it; a row that is larger goes alone.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20

_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """Lower-cases A-Z only."""
    return text.lower() if text.isascii() else text.translate(_ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Python workers then hold few long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives memory that a worker has freed back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library; it keeps what it keeps


def releasing(run: Callable) -> Callable:
    """A function over a partition's batches that gives freed memory back when it ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, as in tests, one is made, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="isopleth-"))
    return context.getCheckpointDir().get()


def materialize(df: DataFrame, options: dict | None = None) -> DataFrame:
    """Writes the frame as Parquet, with the writer's options, in the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    spark.sparkContext._jvm.System.gc()  # shuffle files of the step that is over go once its plan is collected
    return spark.read.schema(df.schema).parquet(path)


def named(columns: Sequence[str]) -> Column:
    """The columns as one struct, under which none can clash with a name used inside."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(1).alias("none"))


def with_made(docs: DataFrame, keep: Sequence[str], inputs: Sequence[Column], made: str, start: Callable[[], Callable[..., list]]) -> DataFrame:
    """The columns in keep, unchanged, and those of the schema `made`; a made column replaces a kept one of its name.

    start() gives a worker its function from the inputs of a batch, each a list of values, to a list for each made
    column. Kept values stay Arrow data, so ids beside a null id keep all their digits.
    """
    spec = docs.sparkSession.createDataFrame([], made).schema
    keep = [c for c in keep if c not in spec.names]
    src = docs.select(named(keep).alias("kept"), *(c.alias(f"in{i}") for i, c in enumerate(inputs)))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in spec]
        work = start()
        for b in batches:
            got = work(*(c.to_pylist() for c in b.columns[1:]))
            cols = [pa.array(v, type=f.type) for v, f in zip(got, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(cols, fields=fields)], names=["kept", "made"])

    out = src.mapInArrow(releasing(run), _typed(src, spec))
    return out.select(*(F.col(f"kept.`{c}`") for c in keep), *(F.col(f"made.`{c}`") for c in spec.names))


def _typed(src: DataFrame, spec):
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField("kept", src.schema["kept"].dataType), StructField("made", spec)])


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; lone surrogates, which Spark never yields, become '?'."""
    return (text or "").encode("utf-8", "replace")


def crc_mod(column: str, n: int):
    """crc32 of a value as text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (Steele et al. 2014), elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0xD1342543DE82EF95, dtype=np.uint64))


_POWERS = _powers(4096)


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of UTF-8 bytes (a run without ASCII white space) its 64-bit hash, start and end; A-Z count as a-z if lower."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    sizes = ends - starts
    at = np.flatnonzero(inside)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    longest = int(sizes.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    chars = raw[at]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[_LOWER[chars] if lower else chars] * powers[place], first)
        return mix64(sums + sizes.astype(np.uint64)), starts, ends


def _rolled(words: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            out ^= out >> np.uint64(29)
        return mix64(out)


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, how many each text has, and each word's start and end in its own text's bytes."""
    hashes, starts, ends = word_hashes(b" ".join(texts))
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    base = np.cumsum(sizes) - sizes
    bounds = np.searchsorted(starts, np.append(base, sizes.sum()))
    counts = np.diff(bounds)
    shift = np.repeat(base, counts)
    return hashes, counts, starts - shift, ends - shift


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, one text after the other, and how many each has.

    A text with fewer than k words has its whole sequence as one shingle; one without words has none.
    """
    words, counts, _, _ = batch_words(texts)
    stops = np.cumsum(counts)
    rolled = _rolled(words, k)
    parts = []
    for i in range(len(texts)):
        n, stop = int(counts[i]), int(stops[i])
        part = rolled[stop - n : stop - k + 1] if n >= k else _rolled(words[stop - n : stop], n) if n else words[:0]
        part.sort()
        parts.append(part)
    h = np.concatenate(parts) if parts else words
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
    new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    owner = np.repeat(np.arange(len(parts)), sizes)
    return h[new], np.bincount(owner[new], minlength=len(parts))


def marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between < and >, and the words' sizes with these marks."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return codes, np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2


def gram_hashes(codes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of marked words, and the index of each one's word; single letters go without the marks."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    size = np.repeat(sizes, sizes)
    at = np.flatnonzero((place + n <= size) if n > 1 else (place >= 1) & (place < size - 1))
    h = np.full(len(at), n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return mix64(h), owner[at]


def word_hash(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each whole marked word."""
    place = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
    with np.errstate(over="ignore"):
        each = mix64(codes * np.uint64(0x9E3779B97F4A7C15) + place)
        return mix64(np.add.reduceat(each, np.cumsum(sizes) - sizes)) if len(sizes) else each
