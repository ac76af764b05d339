"""Small bounded files read on the driver: policies, seeds, constants, SQL steps. Local paths, or any URI that Hadoop opens."""

from __future__ import annotations

import posixpath

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import PolicyError

MAX_BYTES = 1 << 20


def inside(root: str | None, *names: str) -> str:
    """The path of a file below `root`; names that lead anywhere else are refused."""
    if not root:
        raise PolicyError("no folder is configured for this file")
    path = posixpath.join(root, *names)
    # A name is one path component: joined and normalised, the path must end in exactly the given names.
    if not all(names) or posixpath.normpath(path).split("/")[-len(names):] != list(names) or any("\0" in n or "\\" in n for n in names):
        raise PolicyError("a file name leads out of its folder")
    return path


def read_bounded(path: str, maximum: int = MAX_BYTES) -> bytes:
    """A whole file of at most `maximum` bytes. URIs are opened as Spark opens them, with the session's credentials."""
    try:
        data = _through_hadoop(path, maximum) if "://" in path else _local(path, maximum)
    except (OSError, ValueError, Py4JJavaError):
        raise PolicyError("an input file is missing or unreadable") from None
    if len(data) > maximum:
        raise PolicyError(f"an input file is larger than {maximum} bytes")
    return data


def _local(path: str, maximum: int) -> bytes:
    with open(path, "rb") as source:
        return source.read(maximum + 1)


def _through_hadoop(uri: str, maximum: int) -> bytes:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise OSError("a URI needs a Spark session")
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(path).getLen() > maximum:
        return bytes(maximum + 1)
    stream = files.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_seed(path: str) -> bytes:
    seed = read_bounded(path)
    if len(seed) < 32:
        raise PolicyError("the seed needs 32 bytes or more")
    return seed


def read_constant(column: dict, root: str | None) -> str | None:
    """Text behind a `valueFrom` reference; None where the rule has none."""
    ref = (column.get("params") or {}).get("valueFrom")
    if not ref:
        return None
    return read_bounded(inside(root, ref["name"], ref["key"])).decode()


def read_step(root: str | None, name: str) -> str:
    data = read_bounded(inside(root, name + ".sql"))
    if not data:
        raise PolicyError("an SQL step file is empty")
    return data.decode()
