"""Shared pieces of the operators: scratch tables, words, hashes, worker-side mapping."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable

#: ASCII white space, the only separators of words.
SPACE = " \t\n\x0b\x0c\r"
UINT64 = np.uint64
_WORDS_KEPT = 1 << 19


# ---------------------------------------------------------------- scratch tables


_stored: list[set[tuple[str, str | None]]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``). Where it
    is unset, a local session, whose executor is the driver, gets a folder of its own; a
    cluster gets an error, since no folder of one machine would do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set; with master {master} it must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/folioflow-{tag}-{uuid.uuid4().hex}"


def store(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a
    lost executor costs only the tasks that read its part again."""
    path = scratch_path(df.sparkSession, tag)
    for kept in _stored:
        kept.add((path, None))
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folioflow_path = path
    return out


def bucketed(df: DataFrame, tag: str, *keys: str) -> DataFrame:
    """``df`` as a table whose rows are dealt by ``keys`` into as many buckets as a shuffle has
    partitions, so that a join on just these keys moves the other side only. Rows that come
    from a join on the same keys are written where they are."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    name = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    for kept in _stored:
        kept.add((path, name))
    df.write.bucketBy(shuffle_parts(spark), *keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out._folioflow_path, out._folioflow_table = path, name
    return out


@contextmanager
def temporary(spark: SparkSession):
    """Every table that ``store`` or ``bucketed`` makes inside goes at the end, also after a
    failure; what is wanted for longer must have been written elsewhere by then."""
    _stored.append(set())
    try:
        yield
    finally:
        for path, table in _stored.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            remove_path(spark, path)


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        if getattr(df, "_folioflow_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._folioflow_table}")
        path = getattr(df, "_folioflow_path", None)
        if path:
            remove_path(df.sparkSession, path)


def hadoop_path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def remove_path(spark: SparkSession, path: str) -> None:
    fs, where = hadoop_path(spark, path)
    fs.delete(where, True)


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write a small JSON file beside its final name and rename it into place."""
    fs, where = hadoop_path(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    if fs.exists(where):
        fs.delete(where, False)
    fs.rename(part, where)


def read_json(spark: SparkSession, path: str):
    fs, where = hadoop_path(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- rows that need not move

#: Bits of the largest filter (16 MB), and bits for each name below that.
FILTER_BITS, BITS_A_NAME = 1 << 27, 16


def maybe_among(names: list, wanted: DataFrame):
    """A condition that holds for every row whose ``names`` (columns) are those of a row of
    ``wanted``, which has as many columns, of the same types, and for few others: a bit filter of
    their hashes, so that rows that surely aren't wanted stay where they are.

    The filter's words are summed up in tasks and by a shuffle; the driver gets at most two
    million of them, whatever ``wanted`` holds. Of more names than ``FILTER_BITS`` it would let
    nearly all through: the condition is then always true.
    """
    spark = wanted.sparkSession
    n = wanted.count()
    if n > FILTER_BITS:
        return F.lit(True)
    bits = min(FILTER_BITS, 1 << max(10, (n * BITS_A_NAME).bit_length()))
    place = F.pmod(F.xxhash64(*wanted.columns), F.lit(bits))
    words = wanted.select(F.shiftright(place, 6).alias("word"), (place % 64).cast("int").alias("bit"))
    words = words.select("word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    held = np.zeros(bits >> 6, np.int64)
    held[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    sent = spark.sparkContext.broadcast(held)

    import pandas as pd  # not for workers that have no filter to ask

    def test(places):
        at = places.to_numpy()
        return pd.Series((sent.value[at >> 6] >> (at & 63)) & 1 == 1)

    test.__annotations__ = {"places": pd.Series, "return": pd.Series}
    bound_batches(spark)
    return F.pandas_udf(test, "boolean")(F.pmod(F.xxhash64(*names), F.lit(bits)))


# ---------------------------------------------------------------- worker-side mapping


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterable[dict]], schema: str, rows: int = 512) -> DataFrame:
    """``mapInArrow`` with plain dictionaries of Python lists.

    ``fn`` is made for each partition and gets an iterator of batches, each a dict from
    column to list, and yields dicts of the columns of ``schema``. Batches are re-cut to at
    most ``rows`` rows, so that a worker holds a bounded number of texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches):
        def columns():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    yield {n: _listed(part.column(i)) for i, n in enumerate(part.schema.names)}

        for got in fn(columns()):
            arrays = [_array(got[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, out)


def _listed(column: pa.Array) -> list:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return column.to_pylist()


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind) if values.type != kind else values
    if isinstance(values, np.ndarray):
        return pa.array(values).cast(kind)
    if pa.types.is_list(kind) and values and any(isinstance(v, np.ndarray) for v in values):
        filled = [v for v in values if v is not None]
        flat = np.concatenate(filled) if filled else np.zeros(0, np.int64)
        ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)]).astype(np.int32)
        mask = pa.array([v is None for v in values])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind.value_type), type=kind, mask=mask)
    return pa.array(values, type=kind)


def bound_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Rows are handed to Python workers in batches of bounded size: some texts are long."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


# ---------------------------------------------------------------- words and hashes


def words_of(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; bytes.split() has just these separators."""
    return text.split() if text else []


def lowered(text: bytes | None) -> bytes:
    """A-Z in lower case, all else unchanged."""
    return text.lower() if text else b""


#: Longer words are hashed one by one; longer texts in pieces that end between words.
_WORD_BYTES, _PIECE = 64, 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SPACE.encode())] = False


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order. Every (place in the word, byte) has a
    random value; a word's are summed and mixed with its length, all words at once."""
    if not text:
        return np.zeros(0, UINT64)
    if len(text) <= _PIECE:
        return _piece_hashes(text)
    parts, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, min(at + _PIECE, len(text)))
        end = gap.start() if gap else len(text)
        parts.append(_piece_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


def _piece_hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    inside = _IN_WORD[raw]
    kept = raw[inside]
    if not len(kept):
        return np.zeros(0, UINT64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = np.flatnonzero(first[inside])
    size = np.diff(begin, append=len(kept))
    place = np.arange(len(kept)) - np.repeat(begin, size)
    long = np.flatnonzero(size > _WORD_BYTES)
    if len(long):
        place = np.minimum(place, _WORD_BYTES - 1)
    place <<= 8
    place |= kept
    out = mixed(np.add.reduceat(_VALUES[place], begin) + size.astype(UINT64) * _BASE)
    for k in long:
        out[k] = xxhash.xxh3_64_intdigest(kept[begin[k] : begin[k] + size[k]].tobytes())
    return out


class WordHashes(dict):
    """Word to its 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), UINT64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (public splitmix64 constants)."""
    x = x ^ (x >> UINT64(30))
    x = x * UINT64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> UINT64(27))
    x = x * UINT64(0x94D049BB133111EB)
    return x ^ (x >> UINT64(31))


_BASE = UINT64(0x9E3779B97F4A7C15)
_BASE2 = UINT64(0xD6E8FEB86659FD93)
_VALUES = mixed(mixed(np.arange(_WORD_BYTES << 8, dtype=UINT64) * _BASE + _BASE2))


def tree_hashes(hashes: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash of each ``width`` neighbours, made of hashes of 1, 2, 4, … of them. Each step
    mixes, so no sum or power is left in which different sequences could cancel out."""
    salt = UINT64(salt)
    span, done, reach, now = 1, None, 0, mixed(hashes ^ salt)
    while True:
        if width & span:
            done = now if done is None else _joined(done, now[reach:], salt)
            reach += span
        span *= 2
        if span > width:
            return done
        now = _joined(now, now[span // 2 :], salt)


def _joined(a: np.ndarray, b: np.ndarray, salt: np.uint64) -> np.ndarray:
    n = min(len(a), len(b))
    return mixed(a[:n] * _BASE + (b[:n] ^ salt))


class Powers:
    """Window hashes of any width in time linear in the text: differences of prefix sums,
    brought to the same origin by powers of the inverse of an odd base."""

    def __init__(self, base: int = int(_BASE)):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, UINT64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)

    def windows(self, hashes: np.ndarray, width: int) -> np.ndarray:
        n = len(hashes)
        if n < width:
            return np.zeros(0, UINT64)
        self._grow(n + 1)
        sums = np.zeros(n + 1, UINT64)
        np.cumsum(hashes * self.up[:n], out=sums[1:])
        return mixed((sums[width:] - sums[: n - width + 1]) * self.down[: n - width + 1])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, UINT64)
    filled, step = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * UINT64(step)
        filled, step = filled + more, step * step % (1 << 64)
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(UINT64, copy=False).view(np.int64)


def shingles_of(hashes: np.ndarray, powers: Powers, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; with fewer words, of the
    whole sequence as one."""
    if not len(hashes):
        return np.zeros(0, UINT64)
    if len(hashes) < width:
        return powers.windows(hashes, len(hashes)) ^ UINT64(len(hashes))
    values = np.sort(powers.windows(hashes, width))
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of ``known``, which is sorted and not empty."""
    place = np.searchsorted(known, values)
    place[place == len(known)] = 0
    return known[place] == values


def n_words(column) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
