"""Helpers that the operators of this subpackage share.

Texts reach Python in Arrow batches and are handled there as flat byte arrays, in slices of a
few megabytes, so that a task's memory does not depend on the size of its partition.  One
single text is the smallest unit of work: a row has to fit in memory, as it has to in Spark.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of text that a task turns into arrays at a time.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4000
#: Spark's setting by which the shuffle files of a query are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one, in local mode
    only, as other executors don't see it."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read again, its lineage cut.

    A table is compressed and computed once; checkpoint() keeps rows as they are in memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def released_shuffles(spark: SparkSession):
    """Shuffle files of what is executed inside go at its end, as nothing reads a finished write's again;
    otherwise they stay until the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def forget(df: DataFrame | None) -> None:
    """Deletes the table behind a result of checkpoint() that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()} if df is not None else ():
        if "/table-" in path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... so that none clashes with a working column, and their
    new names; ``df.columns`` in place of these gives the old names back."""
    new = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new, strict=True))


#: Keys that may count as hot at most, the least rows of one, and over how many salts its rows go.
HOT_KEYS, HOT_ROWS, SALTS = 200, 200, 32


def hot_keys(many: DataFrame, key: str) -> list:
    """Keys with more than one in ``HOT_KEYS`` of the rows, so fewer than ``HOT_KEYS`` of them."""
    per = many.groupBy(key).count()
    least = max(HOT_ROWS, many.count() // HOT_KEYS)
    return [r[0] for r in per.filter((F.col("count") > least) & F.col(key).isNotNull()).select(key).collect()]


def spread_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``many.join(few, key, how)`` with the rows of hot keys dealt over several tasks; ``few``
    has the rows of such a key once for each salt."""
    if hot is None:
        hot = hot_keys(many, key)
    if not hot:
        return many.join(few, key, how)
    is_hot = F.col(key).isin(hot)
    zero = F.lit(0).cast("long")
    a = many.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*many.columns), F.lit(SALTS))).otherwise(zero))
    b = few.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(zero, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(zero))))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, uid: str = "uid") -> DataFrame:
    """A number for each row, as doc_id may be null or repeated."""
    return df.withColumn(uid, F.monotonically_increasing_id())


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of rows of about ``limit`` bytes, one row at least and ``SLICE_ROWS`` at most."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n, i + SLICE_ROWS)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the published splitmix64 finalizer)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: Bytes of a word from which on it is named by a cryptographic digest.
LONG_WORD = 256


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit names of the words of a byte array, chained over pieces of eight bytes.

    Each step spreads every bit, so words of any structure have names that look independent,
    which a polynomial modulo a power of two has not.
    """
    length = end - start
    h = mix(length.astype(np.uint64) + U64((seed * 0x9E3779B97F4A7C15 + 1) % (1 << 64)))
    padded = np.concatenate([np.ascontiguousarray(data), np.zeros(8, np.uint8)])
    piece_at = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    left, at, todo = length, start, slice(None)
    while len(left):
        odd = np.minimum(left, 8).astype(np.uint64) * U64(8)
        piece = piece_at[at] & np.where(odd < 64, (U64(1) << (odd & U64(63))) - U64(1), ~U64(0))
        h[todo] = mix(h[todo] * U64(0x9E3779B97F4A7C15) + piece)
        more = (left > 8) & (left <= LONG_WORD)
        todo = np.flatnonzero(more) if isinstance(todo, slice) else todo[more]
        left, at = left[more] - 8, at[more] + 8
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little"))
        h[i] = int.from_bytes(digest.digest(), "little")
    return h


#: Bytes of a substring from which on sums modulo 2**64 aren't safe: periodic signs cancel there.
STRUCTURED = 512


class Rolling:
    """Fingerprints of substrings of fewer than ``STRUCTURED`` bytes from one prefix sum modulo 2**64.

    Byte values go through a table of random words, so a fingerprint depends on a substring
    only, not on where it stands.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(7919 + seed)
        table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        base = int(rng.integers(1 << 62, dtype=np.int64)) * 8 + 5
        n = len(data) + 1
        have = self._powers.get(seed)
        if have is None or len(have[0]) < n:
            size = max(n, SLICE_BYTES + 1)
            inverse = pow(base, -1, 1 << 64)
            powers = []
            for b in (base, inverse):
                p = np.full(size, U64(b % (1 << 64)))
                p[0] = 1
                powers.append(np.cumprod(p))
            have = self._powers[seed] = tuple(powers)
        self.inverse = have[1]
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(table[data] * have[0][: n - 1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


PRIME = (1 << 61) - 1


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves of 31 bits."""
    low = U64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U64(31), a & low, b >> U64(31), b & low
    middle = a0 * b1 + a1 * b0
    return reduced(reduced(a1 * b1 * U64(2) + (middle >> U64(30)) + ((middle & U64((1 << 30) - 1)) << U64(31))) + reduced(a0 * b0))


class PrimeRolling:
    """As ``Rolling`` for substrings of any length: a prefix sum modulo the prime 2**61 - 1."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(104729 + seed)
        table = rng.integers(1, PRIME, 256, dtype=np.uint64)
        base = int(rng.integers(1 << 32, PRIME, dtype=np.int64))
        n = len(data) + 1
        have = self._powers.get(seed)
        if have is None or len(have[0]) < n:
            have = self._powers[seed] = tuple(powers(b, max(n, SLICE_BYTES + 1)) for b in (base, pow(base, -1, PRIME)))
        self.inverse = have[1]
        term = product(table[data], have[0][: n - 1])
        self.prefix = np.zeros(n, np.uint64)
        high, low = np.cumsum(term >> U64(30)), np.cumsum(term & U64((1 << 30) - 1))
        self.prefix[1:] = reduced(product(reduced(high), np.full(n - 1, U64(1 << 30))) + reduced(low))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        difference = reduced(self.prefix[end] + U64(PRIME) - self.prefix[start])
        return mix(product(difference, self.inverse[start]) + ((end - start).astype(np.uint64) << U64(32)))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, product(out, np.full(len(out), U64(pow(base, len(out), PRIME))))])
    return out[:n]


def rolling(length: int) -> type:
    """The class whose fingerprints of ``length`` bytes are safe."""
    return Rolling if length < STRUCTURED else PrimeRolling


def as_strings(values: list[bytes | None]) -> pa.Array:
    """Bytes as a string column, though they may be no UTF-8; Spark's strings can hold such bytes."""
    return pa.array(values, pa.binary()).view(pa.string())


def words(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` and the row it stands in."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = gap[:-1]
    edges = off[(off > 0) & (off < len(data))]
    first[edges] = True
    start = np.flatnonzero(first & ~gap)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = gap[1:]
    last[edges - 1] = True
    end = np.flatnonzero(last & ~gap) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``m``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def arrow_type(dtype: str) -> pa.DataType:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "short": pa.int16()}
    return pa.list_(kinds[dtype[6:-1]]) if dtype.startswith("array<") else kinds[dtype]


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    """A record batch of numpy arrays or lists for a schema like ``a long, b array<int>``."""
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=arrow_type(t)) for c, (_, t) in zip(columns, fields, strict=True)],
        names=[n for n, _ in fields],
    )


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """A list column from its flat values and the length of each row's list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
