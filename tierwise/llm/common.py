"""Shared parts of the training-data operators: stored intermediates, word hashes, id filters, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: the bytes bind where texts are long, the rows where columns are narrow.
BATCH_ROWS, BATCH_BYTES = 1 << 16, 1 << 20

#: 64-bit words of an id filter: 512 KB at least and 8 MB at most, in between by the number of ids.
FILTER_WORDS = 1 << 16, 1 << 20

#: Entries after which a worker's word cache starts anew.
CACHE_LIMIT = 1 << 17


#: Settings of the allocator in Python workers, so that idle ones hold little: Arrow allocates from the system, and large blocks go back to it at once.
ALLOCATOR = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144"}


def prepare(spark: SparkSession) -> None:
    """Session settings that the Arrow operators rely on; Python workers find this package where the driver did."""
    worker = spark.sparkContext.environment
    worker.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    for name, value in ALLOCATOR.items():
        worker.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session that names none gets a temporary one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tierwise-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stored:
    """Written tables that cut lineage; a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tierwise-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tierwise_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._tierwise_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory of a reused Python worker to the system, so that operators run one after another do not add up."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def releasing(run: Callable, *forget: Callable[[], None]) -> Callable:
    """An Arrow function that forgets its memories at the end of a task and gives their pages back.

    forget: functions of a module, which reach the worker by name; a memory itself would reach it as a copy. Spark keeps more Python workers than
    run at once and deals tasks to them in turn, so that what an idle worker holds counts against the executor too.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            give_back()

    return wrapped


#: Numbers of glibc's mallopt for the size from which blocks come from the system alone and for the free memory kept at the end of the heap.
MMAP_THRESHOLD, TRIM_THRESHOLD = -3, -1


def reusing(run: Callable) -> Callable:
    """An Arrow function whose task keeps freed blocks for its next arrays: for numpy work that makes arrays of the same few MB over and over.

    ALLOCATOR's settings hold again after the task; used within releasing(), which then gives the blocks back.
    """

    def set_to(large: int, kept: int) -> None:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):  # glibc
            libc.mallopt(MMAP_THRESHOLD, large)
            libc.mallopt(TRIM_THRESHOLD, kept)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_to(1 << 25, 1 << 27)
        try:
            yield from run(batches)
        finally:
            set_to(int(ALLOCATOR["MALLOC_MMAP_THRESHOLD_"]), int(ALLOCATOR["MALLOC_TRIM_THRESHOLD_"]))

    return wrapped


class WordHash(dict):
    """64-bit hash of a word, remembered; bounded by trim()."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def trim(self, limit: int = CACHE_LIMIT) -> None:
        if len(self) > limit:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def binary_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> list[int | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def to_batch(columns: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_with_key(docs: DataFrame, *more: Column) -> DataFrame:
    """The only columns the operators read, whatever else the table has."""
    return docs.select("doc_id", "text", *more)


class IdFilter:
    """Bit set of hashed ids, about 16 bits an id up to its largest size: no id is missed; beyond, more others pass."""

    def __init__(self, ids: DataFrame):
        least, most = FILTER_WORDS
        n = ids.count()
        self.words = min(most, max(least, 1 << (n // 4).bit_length()))
        h = F.xxhash64(F.col(ids.columns[0]))
        rows = (
            ids.select(F.pmod(h, F.lit(self.words)).cast("int").alias("w"), F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int").alias("b"))
            .groupBy("w")
            .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
            .toArrow()  # FILTER_WORDS rows at most, whatever the number of ids
        )
        self.bits, self.empty = np.zeros(self.words, np.int64), not n
        self.bits[rows["w"].to_numpy()] = rows["bits"].to_numpy()

    @staticmethod
    def key(name: str = "doc_id") -> Column:
        return F.xxhash64(F.col(name)).alias("_key")

    def has(self, key: np.ndarray) -> np.ndarray:
        w = np.mod(key, self.words)
        return (self.bits[w] >> (np.right_shift(key, 32) & 63)) & 1 == 1


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with the key of their id in the first column, for letting_through()."""
    return docs.select(IdFilter.key(), *docs.columns)


def letting_through(batches: Iterator[pa.RecordBatch], keep: IdFilter, outside: bool = False) -> Iterator[pa.RecordBatch]:
    """Of keyed rows those whose id may be in the filter, or with outside those whose id is certainly not; without the key. Null ids are outside.

    It runs inside an operator's own Arrow function, so that a task needs one Python worker and not one more for the filter.
    """
    for b in batches:
        at = keep.has(b.column(0).to_numpy(zero_copy_only=False))
        at &= b.column(b.schema.get_field_index("doc_id")).is_valid().to_numpy(zero_copy_only=False)
        got = b.filter(pa.array(~at if outside else at))
        if got.num_rows:
            yield got.select(range(1, b.num_columns))


def filtered(docs: DataFrame, keep: IdFilter) -> DataFrame:
    """Rows whose id may be in the filter, for a join that follows."""
    shared = docs.sparkSession.sparkContext.broadcast(keep)
    return keyed(docs).mapInArrow(lambda batches: letting_through(batches, shared.value), docs.schema)


def components(edges: DataFrame, stored: Stored, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id that has an edge: (id, root).

    Alternates large-star and small-star steps, each a partial minimum and a join on the id, until no
    edge changes. edges: (a, b); loops and repeats are harmless. An empty input gives an empty result.
    """
    now = stored.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    for _ in range(rounds):
        n, s = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, s) == before or not n:
            break
        before = n, s
        # The minima are written before the join, so that it exchanges both sides and splits skewed ids.
        both = now.union(now.select("b", "a"))
        low = stored.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored.keep(large.where("a <> b").distinct())
        least = stored.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        after = stored.keep(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        stored.drop(low, least)
        stored.drop(now, large)
        now = after
    else:
        raise RuntimeError(f"components: no fixed point in {rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
    return roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
