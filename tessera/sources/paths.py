"""Looking at paths through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    target, files = _file_system(spark, path)
    return files.exists(target)


def matching(spark: SparkSession, directory: str, pattern: str) -> list[str]:
    """The files and folders of `directory` whose names match, in order."""
    target, files = _file_system(spark, f"{directory.rstrip('/')}/{pattern}")
    return sorted(str(found.getPath()) for found in files.globStatus(target) or ())


def files_under(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of a file, or of all files in a folder and its folders, in order."""
    target, files = _file_system(spark, path)
    listed, found = files.listFiles(target, True), []
    while listed.hasNext():
        status = listed.next()
        found.append((str(status.getPath()), status.getLen(), status.getModificationTime()))
    return sorted(found)


def publish(spark: SparkSession, written: str, path: str) -> bool:
    """Renames the folder `written` to `path` in one step; where that exists already it stays, and `written` goes."""
    source, files = _file_system(spark, written)
    target, _ = _file_system(spark, path)
    done = not files.exists(target) and files.rename(source, target)
    if not done:
        files.delete(source, True)
    # Of two writers in the same moment the later one may land inside the table of the other.
    inner, _ = _file_system(spark, f"{path}/{source.getName()}")
    if files.exists(inner):
        files.delete(inner, True)
        done = False
    return done
