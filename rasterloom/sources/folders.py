"""Scans of file stores of any size: a bounded number of files is listed at a time.

Spark's file sources keep a status of every file of a scan in the driver. Here a scan runs over some folders of a root after the other,
and its rows go to a table of the shared folder, so the driver holds the listing of one round alone.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from ..session import fresh_path

#: Files whose status the driver holds at a time, with what plans are made of it a few kilobytes each.
LISTED_FILES = 32_000
#: Paths of the first round, and how much a round may grow over the one before.
FIRST_PATHS, GROWTH = 2, 4
#: While rounds run, Spark keeps no listings after their scan (250 MB of them else), and lists even few folders by tasks.
_OPTIONS = {
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "1",
}


def literal(path: str) -> str:
    """Spark takes a path for a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def hidden(name: str) -> bool:
    """Whether Spark's file sources pass over the name."""
    metadata = name.startswith(("_metadata", "_common_metadata"))
    return name[:1] == "." or name.endswith("._COPYING_") or name[:1] == "_" and "=" not in name and not metadata


def children(spark: SparkSession, root: str) -> list[str]:
    """Paths of what lies in the folders that a path or pattern names; a file stands for itself."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.spark.deploy.SparkHadoopUtil.get()

    def matched(pattern: str) -> list[str]:
        # One string for all, as a call for each of a million folders takes minutes; no name holds a NUL.
        text = hadoop.globPath(jvm.org.apache.hadoop.fs.Path(pattern)).mkString("\0")
        return [path for path in text.split("\0") if path]

    out = []
    for top in matched(root):
        place = jvm.org.apache.hadoop.fs.Path(top)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
            out += [path for path in matched(f"{literal(top)}/*") if not hidden(path.rpartition("/")[2])]
        else:
            out.append(top)
    return out


def load(reader: DataFrameReader, paths: Sequence[str]) -> DataFrame:
    """``reader.load(paths)``, with the paths handed over as one string."""
    split = reader._spark._jvm.org.apache.commons.lang3.StringUtils.split
    return reader._df(reader._jreader.load(split("\0".join(paths), "\0")))


def _listed(frame: DataFrame) -> int:
    """Statuses of files that the scans of the frame hold in the driver."""
    leaves = frame._jdf.queryExecution().analyzed().collectLeaves()
    return sum(leaves.apply(i).relation().location().leafFiles().size() for i in range(leaves.size()))


def rounds(paths: Sequence[str], files: int, listed: Callable[[], int]) -> Iterator[Sequence[str]]:
    """Neighbouring paths, so many that they hold about ``files`` files, judged by what ``listed`` says of the round before."""
    at, count = 0, FIRST_PATHS
    while at < len(paths):
        yield paths[at : at + count]
        at += count
        count = max(1, min(files, count * GROWTH, count * files // max(1, listed())))


def by_folders(
    spark: SparkSession,
    roots: Sequence[str],
    scan: Callable[[list[str]], DataFrame],
    name: str,
    files: int = LISTED_FILES,
) -> DataFrame:
    """What ``scan`` gives for the roots, as a table: it is called with some of the paths in them at a time, until all are read.

    ``scan`` takes in all files below its paths and nothing else, and a row of it depends on one file. What lies in a root is listed by
    name alone, a folder in it as a whole.
    """
    paths = [literal(path) for root in roots for path in children(spark, root)] or list(roots)
    target = fresh_path(spark, name)
    usual = {key: spark.conf.get(key) for key in _OPTIONS}
    seen = 0
    try:
        for key, value in _OPTIONS.items():
            spark.conf.set(key, value)
        for some in rounds(paths, files, lambda: seen):
            frame = scan(list(some))
            seen = _listed(frame)
            frame.write.mode("append").parquet(target)
            # Handles of the JVM's objects lie in cycles: until a collection, the listing of every round stays in the driver.
            gc.collect()
    finally:
        for key, value in usual.items():
            spark.conf.set(key, value)
    return spark.read.schema(frame.schema).parquet(target)
