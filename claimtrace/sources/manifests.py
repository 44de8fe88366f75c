"""Tables whose content is named by numbered manifests, each put in place as a whole or not at all.

A manifest is a small JSON file, ``snapshots/<number>.json``. The next one is put there by a
rename that fails if the number is taken, so of several writers one wins and the others look again.
Only the driver reads and writes manifests, through the file system that Spark uses for the path.
"""

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

ATTEMPTS = 100


def latest(spark: SparkSession, path: str) -> dict:
    """The newest manifest; one with number 0 where there is none yet."""
    found = numbers(spark, path)
    return read(spark, path, found[-1]) if found else {"number": 0}


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests that are there, in order."""
    fs, folder = _files(spark, path)[0], _path(spark, f"{path}/snapshots")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def read(spark: SparkSession, path: str, number: int) -> dict:
    stream = _files(spark, path)[0].open(_path(spark, _name(path, number)))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, change: Callable[[dict], dict | None]) -> bool:
    """Puts ``change`` of the newest manifest in place as the next; False if it gives none.

    ``change`` is asked again whenever another writer was faster.
    """
    fs, context = _files(spark, path)
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    for _ in range(ATTEMPTS):
        now = latest(spark, path)
        after = change(now)
        if after is None:
            return False
        number = now["number"] + 1
        draft = _path(spark, f"{path}/snapshots/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(after | {"number": number}).encode()))
        out.close()
        try:
            context.rename(draft, _path(spark, _name(path, number)), none)
            return True
        except (Py4JJavaError, PySparkException):
            fs.delete(draft, False)
            if number not in numbers(spark, path):
                raise
    raise RuntimeError(f"{path}: {ATTEMPTS} other writers were faster")


def expire(spark: SparkSession, path: str, keep: int, folders: Callable[[dict], set[str]]) -> None:
    """Removes all but the last ``keep`` manifests, and the folders that only the removed ones name.

    Folders that no manifest has named yet belong to writes under way and stay.
    """
    found = numbers(spark, path)
    named = lambda some: {f for n in some for f in folders(read(spark, path, n))}
    old, kept = found[:-keep], found[-keep:]
    fs = _files(spark, path)[0]
    for folder in named(old) - named(kept):
        fs.delete(_path(spark, f"{path}/{folder}"), True)
    for n in old:
        fs.delete(_path(spark, _name(path, n)), False)


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, path: str):
    conf = spark._jsc.hadoopConfiguration()
    fs = _path(spark, path).getFileSystem(conf)
    return fs, spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)


def _name(path: str, number: int) -> str:
    return f"{path}/snapshots/{number:012d}.json"
