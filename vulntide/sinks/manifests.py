"""Batches and versions of a table, each shown by one small file.

The files of a batch are written to a folder of their own, where no reader looks. An entry
that names them is put in place last, and readers take the files from the entries alone. So
nothing has to move at once: neither folders nor many files, and object stores will do. An
entry is never changed. One that is not whole, because its writer was lost, counts for
nothing; the batch is then published under the next entry.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRIES = "_manifests"
DATA = "_data"


@dataclass(frozen=True)
class Entry:
    """A published batch: its name, its files below the table's folder, and what it replaces."""

    name: str
    files: tuple[str, ...]
    replaces: frozenset[str] = field(default_factory=frozenset)


# Whole entries by path; they never change.
_known: dict[str, Entry] = {}


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files of a folder, hidden ones left out; none if there is no folder."""
    place, fs = _at(spark, folder)
    if not fs.exists(place):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(place)]
    return sorted(name for name in names if name[0] not in "._")


def _data_files(spark: SparkSession, folder: str, below: str = "") -> list[str]:
    """Data files below a folder, as paths relative to it."""
    place, fs = _at(spark, f"{folder}/{below}")
    found = []
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if status.isDirectory():
            found += _data_files(spark, folder, f"{below}{name}/")
        elif name[0] not in "._":
            found.append(below + name)
    return sorted(found)


def encode_entry(entry: Entry) -> str:
    """An entry as text; the last line tells whether it is whole."""
    body = json.dumps({"name": entry.name, "files": entry.files, "replaces": sorted(entry.replaces)})
    return f"{body}\n{zlib.crc32(body.encode())}\n"


def decode_entry(text: str) -> Entry | None:
    """The entry, or None if the text is not a whole one."""
    body, _, rest = text.partition("\n")
    if rest != f"{zlib.crc32(body.encode())}\n":
        return None
    told = json.loads(body)
    return Entry(told["name"], tuple(told["files"]), frozenset(told["replaces"]))


def read_entry(spark: SparkSession, path: str) -> Entry | None:
    if path not in _known:
        place, fs = _at(spark, path)
        stream = fs.open(place)
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
        except Py4JJavaError as error:
            # A file system with checksums refuses a file that is not whole.
            if "ChecksumException" not in str(error.java_exception):
                raise
            return None
        finally:
            stream.close()
        entry = decode_entry(text)
        if entry is None:
            return None
        _known[path] = entry
    return _known[path]


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place, written aside first; False if there is one already."""
    folder, _, name = path.rpartition("/")
    place, fs = _at(spark, path)
    aside, _ = _at(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.exists(place) and fs.rename(aside, place):
        return True
    fs.delete(aside, False)
    return False


def has_manifests(spark: SparkSession, root: str) -> bool:
    """Whether a table is published by entries."""
    place, fs = _at(spark, f"{root}/{ENTRIES}")
    return fs.exists(place)


def entries(spark: SparkSession, root: str) -> list[Entry]:
    """Published batches by name, without those that a later entry replaces."""
    found: dict[str, Entry] = {}
    for name in _listed(spark, f"{root}/{ENTRIES}"):
        entry = read_entry(spark, f"{root}/{ENTRIES}/{name}")
        if entry:
            found.setdefault(entry.name, entry)
    gone = {name for entry in found.values() for name in entry.replaces}
    return [found[name] for name in sorted(found) if name not in gone]


def is_published(spark: SparkSession, root: str, name: str) -> bool:
    """True once a batch has been published, whether or not another has replaced it since."""
    names = [n for n in _listed(spark, f"{root}/{ENTRIES}") if n.rpartition(".")[0].rpartition(".")[0] == name]
    return any(read_entry(spark, f"{root}/{ENTRIES}/{n}") for n in names)


def publish(
    spark: SparkSession, root: str, name: str, write: Callable[[str], None], replaces: Iterable[str] = ()
) -> bool:
    """Write a batch into a folder of its own, and show it by an entry.

    A batch that is published already stays as it is, and False comes back. Files of an
    attempt that was lost are named by no entry, so they are never read.
    """
    if is_published(spark, root, name):
        return False
    folder = f"{DATA}/{name}-{uuid.uuid4().hex}"
    write(f"{root}/{folder}")
    files = tuple(f"{folder}/{file}" for file in _data_files(spark, f"{root}/{folder}"))
    text = encode_entry(Entry(name, files, frozenset(replaces)))
    for attempt in range(1000):
        path = f"{root}/{ENTRIES}/{name}.{attempt:03d}.json"
        if _put_if_absent(spark, path, text):
            return True
        if read_entry(spark, path):
            return False  # another writer was first
    raise OSError(f"cannot publish {name} in {root}")


def paths(root: str, published: Iterable[Entry], wanted: Callable[[str], bool] = lambda file: True) -> list[str]:
    return [f"{root}/{file}" for entry in published for file in entry.files if wanted(file)]


def read_files(spark: SparkSession, files: list[str], schema: StructType | str | None = None, kind: str = "parquet") -> DataFrame:
    """Rows of the named files; no files give an empty table of ``schema``."""
    if not files and schema is not None:
        return spark.createDataFrame([], schema)
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema is not None else reader).load(files)


def read(spark: SparkSession, root: str, schema: StructType | str | None = None, kind: str = "parquet") -> DataFrame:
    """All rows that are published when this is called."""
    return read_files(spark, paths(root, entries(spark, root)), schema, kind)


def stream_entries(spark: SparkSession, root: str, max_entries: int | None = None) -> DataFrame:
    """The table's entries as a stream, ``_manifest`` with each one's path.

    :func:`entered_rows` gives the rows of a micro-batch of them.
    """
    # The entries' paths alone: their content is not read here.
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if max_entries:
        reader = reader.option("maxFilesPerTrigger", max_entries)
    return reader.option("pathGlobFilter", "*.json").load(f"{root}/{ENTRIES}").select(F.col("path").alias("_manifest"))


def entered_rows(batch: DataFrame, schema: StructType) -> DataFrame:
    """Rows of the batches whose entries a micro-batch holds.

    An entry that is not whole gives none: its batch comes with the next entry. One that only
    replaces others gives none either, since a stream has had their rows.
    """
    spark, files = batch.sparkSession, []
    for row in batch.select("_manifest").distinct().collect():
        entry = read_entry(spark, row[0])
        if entry and not entry.replaces:
            files += paths(row[0].rpartition(f"/{ENTRIES}/")[0], [entry])
    return read_files(spark, sorted(files), schema)


def compact(spark: SparkSession, root: str, write: Callable[[DataFrame, str], None], least: int = 2) -> bool:
    """Rewrite all published batches as one, if there are ``least`` or more.

    ``write(rows, folder)`` stores the rows. The new entry replaces the old ones in one step;
    their files stay for readers that have begun, and can go once those have ended.
    """
    now = entries(spark, root)
    if len(now) < least:
        return False
    rows = read_files(spark, paths(root, now))
    name = f"{now[-1].name}-compact"
    return publish(spark, root, name, lambda folder: write(rows, folder), [entry.name for entry in now])
