"""Words of a corpus as dense global codes, without moving the words of texts.

A scan cuts texts into shards and codes the words of each shard by a dictionary of its own; only those dictionaries are
shuffled, counted and numbered. A shard then learns the global code of each of its own codes. A common word is one row
for each shard, however often it stands there.

Shards are rows with ``shard`` (long), ``words`` (array of binary), ``counts`` (array of long, occurrences of each word in
the shard) and any other columns, of which ``keys`` part the dictionary, as a language does.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import textscan as ts
from textloom.llm.shared import shared_folder

#: Bytes of text in one shard; a longer text is a shard by itself.
SHARD_BYTES = 4 << 20
#: Bits of a row's number within its partition, in numbers that Spark gives.
_PARTITION_BITS = 33

_folders: dict[str, str] = {}


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder and read again, so that later readers take single columns.

    All tables of a session lie in one folder, which goes when the session's Python ends.
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    if application not in _folders:
        _folders[application] = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        atexit.register(_removed, spark, _folders[application])
    path = f"{_folders[application]}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of this module, unless the session has ended before."""
    if spark.sparkContext._jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def coded(texts: ts.Texts) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of a batch, the code of every word in order, and the words' starts and ends."""
    starts, ends = texts.words()
    # a word's bytes are those that are no white space, so the words' bytes stand in order once white space is taken out
    inner = texts.bytes[~ts._SPACE[texts.bytes]]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(inner))])
    encoded = words.dictionary_encode()
    return encoded.dictionary.cast(pa.binary()), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32), starts, ends


class Words:
    """A dictionary that grows with each batch of a shard; its words lie in one Arrow array, in order of their codes."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.binary())
        self.counts = np.zeros(0, dtype=np.int64)

    def add(self, words: pa.Array, codes: np.ndarray) -> np.ndarray:
        """The codes here of all words of a batch, given by its own distinct words and codes."""
        found = pc.index_in(words, value_set=self.words)
        fresh = found.is_null()
        mapped = found.fill_null(0).to_numpy(zero_copy_only=False)
        new = fresh.to_numpy(zero_copy_only=False)
        mapped = np.where(new, len(self.words) + np.cumsum(new) - 1, mapped).astype(np.int32)
        self.words = pa.concat_arrays([self.words, words.filter(fresh)])
        counts = np.zeros(len(self.words), dtype=np.int64)
        counts[: len(self.counts)] = self.counts
        if len(mapped):
            counts[mapped] += np.bincount(codes, minlength=len(mapped))
        self.counts = counts
        return mapped[codes] if len(codes) else codes


def one_row(values: pa.Array, kind: pa.DataType) -> pa.Array:
    """An array of one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def numbered(df: DataFrame, name: str = "id") -> DataFrame:
    """df, stored, with numbers from 1 without gaps. Only the sizes of its partitions pass through the driver."""
    raw = stored(df.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(name), _PARTITION_BITS)
    sizes = sorted((r["part"], r["n"]) for r in raw.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    if not sizes:
        return raw
    before = dict(zip((p for p, _ in sizes), np.cumsum([1, *(n for _, n in sizes[:-1])]).tolist()))
    shifts = raw.sparkSession.createDataFrame([(p, b) for p, b in before.items()], "part_ int, before_ long")
    local = F.col(name).bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    return raw.withColumn("part_", part.cast("int")).join(F.broadcast(shifts), "part_").withColumn(name, F.col("before_") + local).drop("part_", "before_")


def dictionary(shards: DataFrame, keys: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """keys, word, f (its occurrences) and a dense id from 1, for words that occur at least so often."""
    words = shards.select(*keys, F.explode(F.arrays_zip("words", "counts")).alias("w")).select(*keys, "w.words", "w.counts")
    counted = words.groupBy(*keys, F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    return numbered(counted.where(F.col("f") >= least))


#: A place and an id share one number: ids below 2^36, places below 2^27.
_ID_BITS = 36


def with_ids(shards: DataFrame, words: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """shards without their words, but with ``ids`` (array of long): place and id, in one number, of each word that is in the dictionary."""
    own = shards.select("shard", *keys, F.posexplode("words").alias("place", "word"))
    both = F.shiftleft(F.col("place").cast("long"), _ID_BITS).bitwiseOR(F.col("id"))
    found = own.join(words.select(*keys, "word", "id"), [*keys, "word"]).groupBy("shard").agg(F.collect_list(both).alias("ids"))
    return shards.drop("words", "counts").join(found, "shard", "left")


def id_table(ids: pa.Scalar, size: int) -> np.ndarray:
    """The global id of each local code of a shard; 0 for words that are not in the dictionary."""
    table = np.zeros(size, dtype=np.int64)
    if ids.is_valid:
        both = ids.values.to_numpy(zero_copy_only=False)
        table[both >> _ID_BITS] = both & ((1 << _ID_BITS) - 1)
    return table
