"""Sources and sinks: Markdown files, file listings, versioned chunk sets, JSON exports."""

from __future__ import annotations

import tempfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import answers as A
from textloom.functions import text as T
from textloom.operators import catalog as C


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, a new local one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scan_markdown(spark: SparkSession, path: str) -> DataFrame:
    """name, stem, content of every Markdown file below path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select("value", F.col("_metadata.file_name").alias("name"))
    return files.select("name", T.safe_stem(F.col("name")).alias("stem"), F.col("value").alias("content"))


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, length, modificationTime of PDF and Markdown files; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,md}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length", "modificationTime")


def save_chunk_set(chunks: DataFrame, path: str, run_ts: str, strategy: str, form: str = "parquet") -> None:
    """Append one version of each document's chunks; chunks has a column stem. Rows of a stem go to few files.

    The manifest below ``path/_versions`` gets a row for each stem, read back from what was written, so chunks is computed once.
    """
    rows = chunks.withColumn("run_ts", F.lit(run_ts)).withColumn("strategy", F.lit(strategy))
    rows.repartition("stem").write.mode("append").format(form).partitionBy("run_ts").save(path)
    written = load_chunk_sets(chunks.sparkSession, path, form).where(F.col("run_ts") == run_ts)
    written.select("stem").distinct().withColumn("run_ts", F.lit(run_ts)).write.mode("append").parquet(f"{path}/{VERSIONS}")


def load_chunk_sets(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).load(path).withColumn("run_ts", F.col("run_ts").cast("string"))


#: The folder of the manifest; names with an underscore are no data to Spark's readers.
VERSIONS = "_versions"
#: Versions that may be named in a filter of folders; with more of them only the join below tells.
NAMED_VERSIONS = 1_000


def load_latest_chunk_set(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """The newest version of each document's chunks. The manifest tells which folders hold any, and only these are read."""
    newest = spark.read.parquet(f"{path}/{VERSIONS}").groupBy("stem").agg(F.max("run_ts").alias("run_ts"))
    runs = [r[0] for r in newest.select("run_ts").distinct().limit(NAMED_VERSIONS + 1).collect()]
    rows = load_chunk_sets(spark, path, form)
    if len(runs) <= NAMED_VERSIONS:
        rows = rows.where(F.col("run_ts").isin(runs))
    return rows.join(newest, ["stem", "run_ts"], "left_semi")


def _numbered(path: str, kind: str) -> dict[int, str]:
    """The finished folders ``kind=number`` of a path, by number."""
    store, root = fs.FileSystem.from_uri(path)
    found = [x for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith(f"{kind}=")]
    done = store.get_file_info([f"{x.path}/_SUCCESS" for x in found])
    return {int(x.base_name.split("=")[1]): f"{path}/{x.base_name}" for x, d in zip(found, done) if d.type == fs.FileType.File}


def write_upsert(batch: DataFrame, path: str, number: int, every: int = 16) -> None:
    """A batch of versions(stem, run_ts, ...) as a folder of its own; every so many, all that came before become one base.

    A repeated batch replaces itself, or is left out where a base has it already. Files below a base go once it is finished, so at
    most one base and ``every`` batches stay.
    """
    spark = batch.sparkSession
    if max(_numbered(path, "base"), default=-1) < number:
        C.latest_versions(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % every == 0:
            C.latest_versions(_upserts(spark, path, number)).write.mode("overwrite").parquet(f"{path}/base={number}")
    base = max(_numbered(path, "base"), default=-1)
    store, root = fs.FileSystem.from_uri(path)
    for x in store.get_file_info(fs.FileSelector(root)):
        kind, _, n = x.base_name.partition("=")
        if (kind == "batch" and int(n) <= base) or (kind == "base" and int(n) < base):
            store.delete_dir(x.path)


def _upserts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    bases, batches = _numbered(path, "base"), _numbered(path, "batch")
    base = max(bases, default=-1)
    parts = [p for n, p in sorted(batches.items()) if n > base and (upto is None or n <= upto)]
    return spark.read.parquet(*([bases[base]] if bases else []), *parts)


def load_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each stem among the base and the batches after it."""
    return C.latest_versions(_upserts(spark, path))


LEGACY = {"content": "Chunk", "cleaned_chunk": "CleanedChunk", "title": "Title", "context": "Context", "summary": "Summary", "keywords": "Keywords", "questions": "Questions"}


def normalise_chunk_records(rows: DataFrame, json: str = "json") -> DataFrame:
    """rows with the chunk fields of a JSON object: new names before legacy ones, then defaults. An explicit null counts as absent."""
    value = lambda name: F.get_json_object(json, f"$.{name}")  # noqa: E731  names differ by case only
    out = [F.coalesce(value(c).cast("int"), F.lit(0)).alias(c) for c in ("index", "start", "end")]
    for new, old in LEGACY.items():
        if new in A.LISTS:
            out.append(F.coalesce(F.from_json(value(new), "array<string>"), F.from_json(value(old), "array<string>"), F.array().cast("array<string>")).alias(new))
        else:
            out.append(F.coalesce(value(new), value(old), F.lit("")).alias(new))
    return rows.select(*rows.columns, *out)


def split_corrupt(rows: DataFrame, json: str, required: tuple[str, ...]) -> DataFrame:
    """rows with ``error``: null for a JSON object that has the required fields, else why it isn't loaded."""
    c = F.trim(json)
    whole = A.is_object(c) & (A.last_close(c) == F.length(c))
    parsed = F.from_json(F.when(whole, c), "map<string,string>", {"allowSingleQuotes": "false"})
    missing = F.lit(False)
    for f in required:
        missing = missing | F.get_json_object(c, f"$.{f}").isNull()
    return rows.withColumn("error", F.when(parsed.isNull(), "not a JSON object").when(missing, "a required field is missing"))


def export_chunk_json(chunks: DataFrame, timestamp: str) -> DataFrame:
    """stem, payload: {filename, timestamp, total_chunks, chunks} as JSON, chunks in order."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "content", "start", "end")))
    grouped = chunks.groupBy("stem").agg(ordered.alias("chunks"))
    payload = F.struct(F.concat("stem", F.lit(".md")).alias("filename"), F.lit(timestamp).alias("timestamp"), F.size("chunks").alias("total_chunks"), "chunks")
    return grouped.select("stem", F.to_json(payload).alias("payload"))
