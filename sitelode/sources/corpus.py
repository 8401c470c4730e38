"""Text corpora and file inventories."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.functions.text import quote_pattern
from sitelode.operators.content import front_matter

# Folders no scan enters, and those a public-page scan leaves out as well.
SKIPPED_FOLDERS = ("node_modules", "scripts")
PRIVATE_FOLDERS = ("node_modules", "assets", "_originals", "squoosh-queue", "squoosh-out", "content", "scripts")
# Extensions of the files that may name an asset.
TEXT_EXTENSIONS = ("html", "js", "mjs", "css", "md", "txt", "json", "xml")


def _relative(root: str) -> Column:
    # The scheme part of a file URI differs by file system, so it is cut with the root.
    full = F.regexp_replace(F.try_url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/+", "/")
    bare = "/" + root.split("://")[-1].split(":")[-1].strip("/")
    return F.regexp_replace(full, "^" + quote_pattern(bare) + "/", "")


def _outside(path: Column, folders: Sequence[str]) -> Column:
    parts = F.split(path, "/")
    names = F.slice(parts, F.lit(1), F.size(parts) - 1)
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".git")))
    return ~F.arrays_overlap(names, F.array(*[F.lit(f) for f in folders])) & ~hidden


# Folders at most whose subfolders the driver names; what lies below them is listed by tasks.
TOP_FOLDERS = 256
# Paths in one block of a listing, and bytes of whole texts in one block.
LISTED_FILES = 10_000
BLOCK_BYTES = 1 << 20


def _mounted(spark: SparkSession, root: str) -> str | None:
    """``root`` as a path that tasks open themselves, if it lies on a file system that is mounted."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    return system.makeQualified(path).toUri().getPath() if system.getScheme() == "file" else None


def _packed(spark: SparkSession, extension: str) -> bool:
    """Whether Spark's readers unpack files of this extension."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    return codecs.getCodec(hadoop.fs.Path(f"x.{extension}")) is not None


def _hidden(name: bytes) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(b"_") and b"=" not in name or name.startswith(b".") or name.endswith(b"._COPYING_")


def _entered(entry: os.DirEntry[bytes]) -> bool:
    return entry.is_dir() and (not _hidden(entry.name) or entry.name.startswith((b"_metadata", b"_common_metadata")))


def _top_folders(root: bytes, enough: int = TOP_FOLDERS) -> list[tuple[bytes, bool]]:
    """Folders that hold all files below ``root``: by themselves, or with all that lies below them."""
    alone, whole = [], [root]
    while whole and len(alone) + len(whole) < enough:
        below = []
        for folder in whole:
            with os.scandir(folder) as entries:
                below += [e.path for e in entries if _entered(e)]
        alone, whole = alone + whole, below
    return [(folder, False) for folder in alone] + [(folder, True) for folder in whole]


def _file_lister(root: bytes, ends: tuple[bytes, ...], most: int = LISTED_FILES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The paths, relative to ``root``, of the files in folders of ``_top_folders``."""
    cut = len(root.rstrip(b"/")) + 1

    def listed(paths: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary())], names=["path"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[bytes] = []
        for batch in batches:
            for top, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folders = [top]
                while folders:
                    with os.scandir(folders.pop()) as entries:
                        for entry in entries:
                            if entry.name.endswith(ends) and not _hidden(entry.name) and entry.is_file():
                                paths.append(entry.path[cut:])
                                if len(paths) == most:
                                    yield listed(paths)
                                    paths = []
                            elif whole and _entered(entry):
                                folders.append(entry.path)
        yield listed(paths)

    return run


def _file_reader(root: bytes, column: str, most: int = BLOCK_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the files of these paths. Empty files give no row, as in Spark's readers."""

    def block(paths: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.binary()), pa.array(texts, pa.binary())], names=["path", column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: list[bytes] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(os.path.join(root, path), "rb") as file:
                    text = file.read()
                if text:
                    paths.append(path)
                    texts.append(text)
                    size += len(text)
                if size >= most:
                    yield block(paths, texts)
                    paths, texts, size = [], [], 0
        yield block(paths, texts)

    return run


def scan_text(
    spark: SparkSession,
    root: str,
    extensions: Sequence[str] = ("html",),
    skip: Sequence[str] = SKIPPED_FOLDERS,
    column: str = "html",
) -> DataFrame:
    """Whole files below ``root`` as ``(path, text)``, with paths relative to it.

    The filters work on the file listing, so other files are never opened. On a file system that is mounted, tasks list
    the folders and read the files, whose paths are dealt out evenly; the driver only names the topmost folders.
    Elsewhere, and for packed files, Spark's reader lists all files through the driver.
    """
    folder = _mounted(spark, root)
    if folder is None or not os.path.isdir(folder) or any(_packed(spark, e) for e in extensions):
        files = spark.read.text(
            root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(extensions) + "}"
        ).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias(column))
        return files.select(_relative(root).alias("path"), column).where(_outside(F.col("path"), skip))
    home = os.fsencode(folder)
    folders = spark.createDataFrame([(bytearray(f), whole) for f, whole in _top_folders(home)], "folder binary, whole boolean")
    paths = folders.mapInArrow(_file_lister(home, tuple(os.fsencode("." + e) for e in extensions)), "path binary")
    # The names weigh so little that Spark, left to itself, would read all files in one task.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = paths.where(_outside(F.col("path").cast("string"), skip)).repartition(parts, "path")
    files = read.mapInArrow(_file_reader(home, column), f"path binary, `{column}` binary")
    return files.select(F.col("path").cast("string").alias("path"), F.col(column).cast("string").alias(column))


# Files in one folder that a task writes: listings of folders are shared out among tasks.
FOLDER_FILES = 1000
# What Spark names the folder of a null or empty value, and the signs it escapes there.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile("[\\x01-\\x1f\"#%'*/:=?\\\\\\x7f{\\[\\]^]")


def _file_name(name: str | None) -> str:
    if name == NO_NAME:
        return f"=%5F{name[1:]}.txt"
    return "=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name or NO_NAME) + ".txt"


def _file_writer(root: str, most: int = FOLDER_FILES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a task's rows, in the order of their names, below a hidden folder of the attempt, whose name it gives."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = f"part-{task.partitionId():05d}"
        hidden = f"_{own}.{task.taskAttemptId()}"
        held, n, file = None, 0, None
        try:
            for batch in batches:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    name = _file_name(name)
                    if name != held:
                        if file is not None:
                            file.close()
                        folder = f"{root}/{hidden}/{n // most:05d}"
                        if n % most == 0:
                            os.makedirs(folder)
                        held, n, file = name, n + 1, open(f"{folder}/{name}", "wb")
                    file.write(value or b"")
                    file.write(b"\n")
        finally:
            if file is not None:
                file.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([own]), pa.array([hidden])], names=["own", "hidden"])

    return write


def write_files(rows: DataFrame, root: str, name: Column, text: Column) -> None:
    """One file per name below ``root``; several rows of a name are its parts: of one task in one file.

    ``text`` may be bytes, which are written as they are. Each file ends with a line feed. Names may hold anything.
    On a file system that is mounted, tasks write their files themselves, and each task's folder is then shown by one
    renaming. Elsewhere Spark's writer makes a folder for each name, and tasks move their own files.
    """
    named = rows.select(name.cast("string").alias("name"), text.cast("string").alias("value"))
    folder = _mounted(rows.sparkSession, root)
    if folder is None:
        named.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(root)
        return
    os.makedirs(folder)
    ordered = named.select("name", F.col("value").cast("binary").alias("value")).sortWithinPartitions("name")
    for done in ordered.mapInArrow(_file_writer(folder), "own string, hidden string").collect():
        os.rename(f"{folder}/{done['hidden']}", f"{folder}/{done['own']}")


def _written(path: Column) -> Column:
    """``struct<folder, name>`` of a path that ``write_files`` made, in either way."""
    ends = r"(?:part-\d+/\d+/=[^/]*\.txt|name=[^/]*/[^/]*)\z"
    own = F.regexp_extract(path, r"(?:^|/)part-\d+/\d+/=([^/]*)\.txt\z", 1)
    name = F.when(own != "", own).otherwise(F.regexp_extract(path, r"(?:^|/)name=([^/]*)/[^/]*\z", 1))
    return F.struct(
        F.regexp_extract(path, r"^(?:(.*?)/)?" + ends, 1).alias("folder"),
        F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"),
    )


def scan_files(spark: SparkSession, root: str, skip: Sequence[str] = SKIPPED_FOLDERS, column: str = "html") -> DataFrame:
    """``folder, name`` and text of the files that ``write_files`` wrote in folders below ``root``, without their last line feed."""
    files = scan_text(spark, root, ("txt",), skip, column).withColumn("_written", _written(F.col("path")))
    return files.select("_written.*", F.regexp_replace(column, r"\n\z", "").alias(column))


def scan_public_pages(spark: SparkSession, root: str) -> DataFrame:
    """The pages a visitor can reach."""
    return scan_text(spark, root, ("html",), PRIVATE_FOLDERS)


def scan_referring_text(spark: SparkSession, root: str, column: str = "html") -> DataFrame:
    """Every text file that may name an asset, scripts included: the wider set used to count references."""
    return scan_text(spark, root, TEXT_EXTENSIONS, ("node_modules", "assets", "_originals"), column)


def written_paths(files: DataFrame) -> DataFrame:
    """An inventory of files that ``write_files`` wrote, by the ``name`` of each instead of its path."""
    return files.withColumn("path", _written(F.col("path"))["name"]).withColumnRenamed("path", "name")


def scan_inventory(spark: SparkSession, root: str, pattern: str = "*", prefix: str = "/") -> DataFrame:
    """``(path, length)`` of every file. The contents are pruned: only the listing is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(F.col("_metadata.file_path").alias("_file"), "length")
    )
    return files.select(F.concat(F.lit(prefix), _relative(root)).alias("path"), "length").where(
        _outside(F.col("path"), SKIPPED_FOLDERS)
    )


def scan_images(spark: SparkSession, root: str, prefix: str = "/", pattern: str = "*.{png,webp,jpg,jpeg}") -> DataFrame:
    """``(path, content)`` of the image files, for their dimensions."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select(F.col("_metadata.file_path").alias("_file"), "content")
    )
    return files.select(F.concat(F.lit(prefix), _relative(root)).alias("path"), "content")


def slug_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.md\z", 1)


def scan_markdown(spark: SparkSession, root: str, dialect: str = "tolerant", written: bool = False) -> DataFrame:
    """``(path, slug, text, meta, body)`` of every Markdown file, or of those that ``write_files`` wrote by their slug."""
    if written:
        docs = scan_files(spark, root, ("node_modules",), "text")
        return front_matter(docs.select(F.col("folder").alias("path"), F.col("name").alias("slug"), "text"), "text", dialect)
    docs = scan_text(spark, root, ("md",), skip=("node_modules",), column="text")
    return front_matter(docs.withColumn("slug", slug_of(F.col("path"))), "text", dialect)


def own_page_urls(texts: DataFrame, keys: Sequence[str], site_origin: str, column: str = "text") -> DataFrame:
    """Every ``.html`` URL of the own site in prose: ``keys, pos, url``."""
    pattern = rf"https?://{quote_pattern(site_origin)}/[^\s)]+?\.html"
    return texts.select(*keys, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("pos", "url"))
