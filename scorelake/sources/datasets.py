"""Sample datasets: a folder per sample, its files assembled into one row."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake import schemas
from scorelake.functions.values import decoded, strip
from scorelake.sources.workspace import new_folder, path_exists, qualified

_FILE = r"([^/]+)/([^/]+)/(mutants/[^/]+|[^/]+)$"
#: Listed names that one task reads, about; names and bytes of texts that travel as one batch.
TASK_NAMES, BATCH_NAMES, BATCH_BYTES = 8192, 4096, 1 << 22
#: File systems that tasks list and read themselves; folders elsewhere are listed by the driver.
_IN_TASKS = ("file", "hdfs", "s3", "gs")


def _system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, and the path on it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _entries(system: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Path of each entry of a folder and whether it is a folder, without names that Spark's readers pass over."""
    if system.type_name == "local":
        with os.scandir(folder) as found:
            for entry in found:
                if not _hidden(entry.name):
                    yield entry.path, entry.is_dir()
    else:
        for entry in system.get_file_info(pafs.FileSelector(folder)):
            if not _hidden(entry.base_name):
                yield entry.path, entry.type == pafs.FileType.Directory


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _files_below(system: pafs.FileSystem, path: str, folder: bool) -> Iterator[str]:
    if not folder:
        yield path
        return
    for inner, deeper in _entries(system, path):
        yield from _files_below(system, inner, deeper)


def _listing(folders: DataFrame, uri: str) -> DataFrame:
    """The entries (path, folder) of each folder (path, folder) in tasks; files stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _system(uri)
        names: list[tuple[str, bool]] = []
        for batch in batches:
            for path, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for entry in _entries(system, path) if folder else ((path, False),):
                    names.append(entry)
                    if len(names) == BATCH_NAMES:
                        yield _batch(names)
                        names = []
        yield _batch(names)

    def _batch(names: list[tuple[str, bool]]) -> pa.RecordBatch:
        paths, kinds = [n for n, _ in names], [k for _, k in names]
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.bool_())], names=["path", "folder"])

    return folders.mapInArrow(run, "path string, folder boolean")


def read_texts(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """The files of a folder as (path, text): those whose name matches a pattern, or all at any depth.

    Tasks list the folders and read the files; the driver sees no names, only their number. Names are written down
    once, and TASK_NAMES of them make a task. Empty files are left out, as Spark's readers do.
    """
    uri = qualified(spark, root)
    if not path_exists(spark, root):
        raise FileNotFoundError(root)
    if uri.split(":")[0] not in _IN_TASKS:
        reader = spark.read.option("recursiveFileLookup", pattern is None)
        files = reader.text(root if pattern is None else f"{root}/*", wholetext=True)
        found = files.select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
        return found if pattern is None else found.where(F.col("path").rlike(pattern))
    names = _listing(spark.createDataFrame([(_system(uri)[1], True)], "path string, folder boolean"), uri)
    if pattern is None:
        # The second level may be wide, so each folder of the first is listed by a task of its own.
        names = _listing(names.repartition(max(8, spark.sparkContext.defaultParallelism)), uri)
    else:
        names = names.where(~F.col("folder") & F.col("path").rlike(pattern))
    names.write.parquet(folder := new_folder(spark, "listing"))
    names = spark.read.parquet(folder)
    tasks = max(spark.sparkContext.defaultParallelism, -(-names.count() // TASK_NAMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _system(uri)
        paths: list[str] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for path, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for file in _files_below(system, path, folder):
                    with system.open_input_stream(file) as stream:
                        text = stream.read()
                    if not text:
                        continue
                    paths.append(file)
                    texts.append(text)
                    size += len(text)
                    if size >= BATCH_BYTES or len(texts) == BATCH_NAMES:
                        yield _batch(paths, texts)
                        paths, texts, size = [], [], 0
        yield _batch(paths, texts)

    def _batch(paths: list[str], texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "text"])

    files = names.repartition(tasks).mapInArrow(run, "path string, text binary")
    return files.select("path", F.col("text").cast("string").alias("text"))


def write_texts(rows: DataFrame, root: str) -> int:
    """Writes a text file per row (path, text) below a folder that executors reach; returns how many.

    A file is written under a hidden name, which no reader lists, and then renamed, so a task that is repeated
    replaces whole files by the same ones. A path that leaves the folder is an error; a NULL text is an empty file.
    """
    uri = qualified(rows.sparkSession, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(uri)
        attempt, made = TaskContext.get().taskAttemptId(), set()
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = posixpath.normpath(name)
                if path.startswith(("/", "..")):
                    raise ValueError(f"{name} is outside the folder")
                folder, file = posixpath.split(f"{base}/{path}")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/.{file}.{attempt}") as out:
                    out.write((text or "").encode())
                if system.type_name != "local" and system.get_file_info(f"{folder}/{file}").type != pafs.FileType.NotFound:
                    system.delete_file(f"{folder}/{file}")
                system.move(f"{folder}/.{file}.{attempt}", f"{folder}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_sample_files(files: DataFrame, root: str) -> int:
    """Writes dataset files (track, sample_id, relpath, text), a folder per sample; returns how many."""
    return write_texts(files.select(F.concat_ws("/", "track", "sample_id", "relpath").alias("path"), "text"), root)


def read_sample_files(spark: SparkSession, root: str) -> DataFrame:
    """Every dataset file below ``root/<track>/<sample>/`` as (track, sample_id, relpath, text).

    Tasks list the folders of the tracks and read the samples; see ``read_texts``.
    """
    files = read_texts(spark, root)
    parts = {"track": 1, "sample_id": 2, "relpath": 3}
    return files.select(
        *(F.regexp_extract("path", _FILE, i).alias(n) for n, i in parts.items()),
        "text",
    )


def assemble_samples(files: DataFrame) -> DataFrame:
    """One row per sample with the payload of its track.

    Mutants keep file-name order. A sample is a handful of files, so a group is small.
    """

    def file(name: str) -> Column:
        return F.max(F.when(F.col("relpath") == name, F.col("text")))

    mutant = F.col("relpath").startswith("mutants/") & F.col("relpath").endswith(".py")
    grouped = files.filter(F.col("track").isin(*fixed.TRACK_NAMES)).groupBy("track", "sample_id").agg(
        file("meta.json").alias("_meta"),
        F.coalesce(file("source.py"), file("buggy.py")).alias("_source"),
        file("test_hidden.py").alias("_test"),
        file("requirement.md").alias("_requirement"),
        file("reference_classes.json").alias("_reference"),
        file("flow.md").alias("_flow"),
        file("broken.spec.ts").alias("_broken"),
        file("error.txt").alias("_error"),
        F.array_sort(F.collect_list(F.when(mutant, F.struct("relpath", "text")))).alias("_mutants"),
    )
    reference = schemas.PAYLOAD["reference"].dataType
    read = grouped.withColumns(
        {
            "_meta": F.from_json("_meta", schemas.SAMPLE_META),
            "_reference": F.from_json("_reference", reference),
        }
    )
    track, meta = F.col("track"), F.col("_meta")
    unit = track == "unit_test_gen"
    e2e = track.isin(*fixed.E2E_TRACKS)
    default_url = F.lit(None).cast("string")
    for name, url in fixed.DEFAULT_BASE_URL.items():
        default_url = F.when(track == name, url).otherwise(default_url)
    payload = {
        "source": F.col("_source"),
        "module_name": meta["module_name"],
        "mutants": F.when(unit, F.transform("_mutants", lambda m: m["text"])),
        "fault_lines": meta["fault_lines"],
        "symptom": F.when(track == "bug_localization", F.coalesce(meta["symptom"], F.lit(""))),
        "test": F.col("_test"),
        "requirement": F.col("_requirement"),
        "reference": F.col("_reference"),
        "flow": F.col("_flow"),
        "base_url": F.coalesce(meta["base_url"], default_url),
        "success": F.when(e2e, F.coalesce(meta["success_assertion"], F.lit(""))),
        "expected_pattern": F.when(
            track.isin(*fixed.PATTERN_TRACKS), F.coalesce(meta["expected_pattern"], F.lit(""))
        ),
        "broken_test": F.col("_broken"),
        "error": F.col("_error"),
    }
    language = F.lit(None).cast("string")
    for name, value, *_ in fixed.TRACKS:
        language = F.when(track == name, value).otherwise(language)
    return read.select(
        "track",
        "sample_id",
        language.alias("language"),
        F.struct(*(payload[f.name].cast(f.dataType).alias(f.name) for f in schemas.PAYLOAD.fields)).alias(
            "payload"
        ),
    )


def read_samples(spark: SparkSession, root: str) -> DataFrame:
    """The samples of a dataset folder, by track and id."""
    return assemble_samples(read_sample_files(spark, root)).orderBy("track", "sample_id")


def read_prompts(spark: SparkSession, root: str) -> DataFrame:
    """System prompts: one Markdown file per track, with its text and hash."""
    return prompt_rows(read_texts(spark, root, r"\.md$"))


def prompt_rows(files: DataFrame) -> DataFrame:
    """(track, text, prompt_hash) out of (path, text), sorted by track."""
    from scorelake.functions.prompting import prompt_hash

    text = strip(F.col("text"))
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("track"), text.alias("text")
    ).withColumn("prompt_hash", prompt_hash(F.col("text"))).orderBy("track")


