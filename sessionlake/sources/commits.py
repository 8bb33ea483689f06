"""One small file put in place as a whole, by whoever is first."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Where a rename that must not overwrite is one atomic step.
ATOMIC = ("file", "hdfs", "viewfs", "abfs", "abfss")


def file_system(spark: SparkSession, folder: str):
    """A folder's path and file system, as Hadoop's classes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def check_atomic(spark: SparkSession, folder: str, one_writer: bool) -> None:
    """Refuses a file system on which two writers could both commit, unless there is only one."""
    scheme = file_system(spark, folder)[1].getScheme()
    if scheme not in ATOMIC and not one_writer:
        raise ValueError(f"two writers could both commit on {scheme}: say one_writer=True where there is one")


def create(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Writes a file aside and renames it into place; False where the name is taken."""
    path, files = file_system(spark, folder)
    files.mkdirs(path)
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    place = jvm.org.apache.hadoop.fs.Path(path, name)
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), configuration)
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(place), no_overwrite)
    except Exception as error:
        files.delete(aside, False)
        if files.exists(place):
            return False
        raise error
    return True
