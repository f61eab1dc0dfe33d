"""Files and folders in whatever store Spark reads, through its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies directly in a folder; nothing where there is none."""
    place, store = _at(spark, folder)
    return sorted(status.getPath().getName() for status in store.listStatus(place)) if store.exists(place) else []


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a folder with all in it; whether there was one."""
    place, store = _at(spark, path)
    return store.delete(place, True)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not be there yet; False if it is, as when another run came first."""
    place, store = _at(spark, path)
    store.mkdirs(place.getParent())
    if store.exists(place):
        return False
    # written aside and renamed: whoever lists the folder finds the whole file or none
    aside = place.suffix(f".{abs(hash(text)):x}.tmp")
    stream = store.create(aside, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    if store.exists(place) or not store.rename(aside, place):
        store.delete(aside, False)
        return False
    return True


def text(spark: SparkSession, path: str) -> str:
    place, store = _at(spark, path)
    stream = store.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
