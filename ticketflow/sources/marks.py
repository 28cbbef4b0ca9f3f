"""High marks of a log: which ids each append has taken, in small files next to the data.

``<log>/_marks/<number>`` holds the first id of an append, the first id after it, and who wrote it. Readers of the log skip the folder, as its
name starts with an underscore. An append lists the folder and opens one mark; no data file of the log is read. A mark is made
before its rows are written, so ids are never given twice; those of an append that fails in between stay unused.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_marks"


def _at(spark: SparkSession, path: str, number: int | None = None):
    name = f"{path}/{FOLDER}" + ("" if number is None else f"/{number:012d}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _read(spark: SparkSession, path: str, number: int) -> dict:
    fs, target = _at(spark, path, number)
    stream = fs.open(target)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    if not text:
        raise RuntimeError(f"mark {number} of {path} is being written, or its writer was lost; remove it if no writer is left")
    return json.loads(text) | {"number": number}


def mark_of(spark: SparkSession, path: str, number: int) -> dict | None:
    """The mark of one append, None without it."""
    fs, target = _at(spark, path, number)
    return _read(spark, path, number) if fs.exists(target) else None


def last_mark(spark: SparkSession, path: str, below: int | None = None) -> dict | None:
    """The newest mark (of those with a smaller number than ``below``): ``number, first, next, owner``; None without any."""
    fs, folder = _at(spark, path)
    if not fs.exists(folder):
        return None
    names = (f.getPath().getName() for f in fs.listStatus(folder))
    numbers = [int(n) for n in names if n.isdigit() and (below is None or int(n) < below)]
    return _read(spark, path, max(numbers)) if numbers else None


def claim(spark: SparkSession, path: str, number: int, first: int, count: int, owner: str = "") -> None:
    """Take ``count`` ids from ``first`` on for append ``number``. Of two writers one gets an error and has written nothing.

    That holds on file systems that refuse to create a file that exists, as HDFS does.
    """
    fs, target = _at(spark, path, number)
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if fs.exists(target):
            raise RuntimeError(f"another writer has taken number {number} of {path}") from error
        raise
    try:
        out.write(bytearray(json.dumps({"first": first, "next": first + count, "owner": owner}).encode()))
    finally:
        out.close()
