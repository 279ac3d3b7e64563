"""Line-delimited JSON logs and whole JSON documents, through Hadoop's file systems, so any path that Spark reads will do.

Tables that this package writes itself are Parquet, whose commits are atomic; these readers are for logs of other writers,
which append rows and may die within one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # without checksum files beside it, which would be wrong once another writer appends
    return (fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _bytes(spark: SparkSession, path: str, start: int, length: int) -> bytes:
    fs, p = _fs(spark, path)
    handle = fs.open(p)
    try:
        handle.seek(start)
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.readFully(handle, length))
    finally:
        handle.close()


def _replace(spark: SparkSession, path: str, fill) -> None:
    """fill(stream) writes a file beside its place, which then takes the place in one step: readers see the old or the new file."""
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs, p = _fs(spark, path)
    out = fs.create(aside, True)
    try:
        fill(out)
        out.hsync()
    finally:
        out.close()
    to = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    to.rename(fs.makeQualified(aside), fs.makeQualified(p), options)
    if fs.getUri().getScheme() == "file":  # the checksum file of a writer that keeps them would be of the old content
        fs.delete(jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.crc"), False)


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    _replace(spark, path, lambda out: out.write(bytearray(data)))


def _copy(spark: SparkSession, path: str, length: int, more: bytes) -> None:
    """Replaces a file by its first bytes and more, streamed by the JVM."""
    fs, p = _fs(spark, path)

    def fill(out) -> None:
        handle = fs.open(p)
        try:
            spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge(handle, out, 0, length)
        finally:
            handle.close()
        if more:
            out.write(bytearray(more))

    _replace(spark, path, fill)


def _extend(spark: SparkSession, path: str, more: bytes) -> None:
    """Adds bytes at the end, in place where the file system can."""
    fs, p = _fs(spark, path)
    try:
        out = fs.append(p)
    except Exception:  # noqa: BLE001  file systems without appends raise what they like
        _copy(spark, path, fs.getFileStatus(p).getLen(), more)
        return
    try:
        out.write(bytearray(more))
    finally:
        out.close()


def _tail(spark: SparkSession, path: str, step: int = 1 << 16) -> bytes:
    """What follows the last line feed; read backwards in steps."""
    fs, p = _fs(spark, path)
    end, found = fs.getFileStatus(p).getLen(), b""
    while end > 0:
        start = max(0, end - step)
        part = _bytes(spark, path, start, end - start)
        if (at := part.rfind(b"\n")) >= 0:
            return part[at + 1 :] + found
        found, end = part + found, start
    return found


def _row(raw: bytes) -> bool:
    try:
        return isinstance(json.loads(raw.decode("utf-8")), dict)
    except ValueError:
        return False


def _head(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(value): the lines of a file's first bytes, which end with a line feed. The rest, a broken tail, is dropped by its place: a line begins there."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"))
    # the tail is the last line of the last block that has lines; splits are read in order within a block
    if not length:
        return lines.select("value").limit(0)
    last = lines.select(F.max(F.struct("_block", "_order")).alias("m")).first()["m"]
    return lines.where((F.col("_block") != last["_block"]) | (F.col("_order") != last["_order"])).select("value")


def read_log(spark: SparkSession, path: str, schema: types.StructType) -> DataFrame:
    """Rows of a log: none if it is missing; blank lines are skipped, and so is a broken last line without its line feed. Any other line that is no JSON object raises, when the rows are read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    tail = _tail(spark, path)
    size = _fs(spark, path)[0].getFileStatus(_fs(spark, path)[1]).getLen()
    lines = spark.read.text(path, lineSep="\n").where(F.trim("value") != "")
    if tail.strip() and not _row(tail):
        # the broken tail is told by where it is: what is read is the part of the file before it, in a view of its own
        lines = _head(spark, path, size - len(tail)).where(F.trim("value") != "")
    good = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    checked = F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))))
    return lines.select(F.from_json(checked, schema).alias("r")).select("r.*")


def repair_log(spark: SparkSession, path: str) -> bool:
    """Mends only the end of a log: a whole last object gets its line feed, a broken one is cut off. Says whether it changed."""
    if not exists(spark, path) or not (tail := _tail(spark, path)):
        return False
    fs, p = _fs(spark, path)
    if _row(tail):
        _extend(spark, path, b"\n")
    else:
        _copy(spark, path, fs.getFileStatus(p).getLen() - len(tail), b"")
    return True


#: The logs of a run that only grow.
RUN_LOGS = ("accepted_problems", "candidate_events", "label_observations", "score_observations", "training_events")


def repair_logs(spark: SparkSession, folder: str, names: tuple[str, ...] = RUN_LOGS) -> list[str]:
    """Repairs each log of a run before any is read; the names of those that changed."""
    return [name for name in names if repair_log(spark, f"{folder}/{name}.jsonl")]


def append_log(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Adds rows, in stable JSON, after repair."""
    repair_log(spark, path)
    more = "".join(stable_json(r) + "\n" for r in rows).encode()
    if exists(spark, path):
        _extend(spark, path, more)
    else:
        _write(spark, path, more)


def stable_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def write_document(spark: SparkSession, path: str, value: object) -> None:
    _write(spark, path, (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode())


def read_document(spark: SparkSession, path: str) -> object:
    fs, p = _fs(spark, path)
    return json.loads(_bytes(spark, path, 0, fs.getFileStatus(p).getLen()).decode())


def file_hash(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256)."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def prefix_faults(spark: SparkSession, path: str, offset: int, digest: str) -> DataFrame:
    """(key, fault) if the first offset bytes of a log are not those of a checkpoint: too short, changed, or cut within a row. Later rows are free."""
    if offset == 0:
        return spark.createDataFrame([], "key string, fault string")
    if not exists(spark, path):
        return spark.createDataFrame([(path, "shorter_than_checkpoint")], "key string, fault string")
    fs, p = _fs(spark, path)
    fault = None
    if fs.getFileStatus(p).getLen() < offset:
        fault = "shorter_than_checkpoint"
    elif _digest(spark, path, offset) != digest:
        fault = "prefix_changed"
    elif _bytes(spark, path, offset - 1, 1) != b"\n":
        fault = "not_at_row_end"
    return spark.createDataFrame([(path, fault)] if fault else [], "key string, fault string")


def _digest(spark: SparkSession, path: str, length: int) -> str:
    """sha256 of a file's first bytes, streamed by the JVM."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    handle = fs.open(p)
    try:
        some = jvm.org.apache.commons.io.input.BoundedInputStream(handle, length)
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(some)
    finally:
        handle.close()
