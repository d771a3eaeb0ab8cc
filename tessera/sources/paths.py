"""Files in any store that Spark's Hadoop configuration knows, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession

BUFFER = 1 << 16


def located(spark: SparkSession, path: str):
    """The store and Java's form of a path."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    store, own = located(spark, path)
    return store.exists(own)


def is_file(spark: SparkSession, path: str) -> bool:
    store, own = located(spark, path)
    return store.exists(own) and store.getFileStatus(own).isFile()


def remove(spark: SparkSession, path: str) -> None:
    store, own = located(spark, path)
    store.delete(own, True)


def read_text(spark: SparkSession, path: str) -> str:
    """The whole of a small file, such as a configuration or a report."""
    found = spark.read.text(path, wholetext=True).first()
    return found[0] if found else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    store, own = located(spark, path)
    out = store.create(own, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def parts(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Paths and sizes of the part files that Spark wrote to a folder, in the order of its partitions."""
    store, own = located(spark, folder)
    found = [(f.getPath().toString(), f.getLen()) for f in store.listStatus(own)]
    return sorted((p, n) for p, n in found if p.rsplit("/", 1)[-1].startswith("part-") and n)


def joined(spark: SparkSession, folder: str, path: str, before: bytes = b"", behind: bytes = b"", cut: int = 0) -> None:
    """One file of the part files of a folder, a stretch at a time, under a temporary name until it is whole.

    ``cut`` bytes of the last part's end are left out. Nothing is held but a buffer.
    """
    jvm, each = spark.sparkContext._jvm, parts(spark, folder)
    store, target = located(spark, path)
    own = located(spark, f"{path}._joining")[1]
    out = store.create(own, True)
    try:
        out.write(bytearray(before))
        for i, (part, size) in enumerate(each):
            source = located(spark, part)
            stream = source[0].open(source[1])
            try:
                last = cut if i + 1 == len(each) else 0
                wanted = jvm.org.apache.commons.io.input.BoundedInputStream(stream, size - last) if last else stream
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(wanted, out, BUFFER, False)
            finally:
                stream.close()
        out.write(bytearray(behind))
    finally:
        out.close()
    store.delete(target, False)
    if not store.rename(own, target):
        raise OSError(f"can't write {path}")
