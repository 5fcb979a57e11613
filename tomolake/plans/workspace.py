"""Where the registered queries keep the collections that they make of the driver's tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import SparkSession

from tomolake.errors import StorageError
from tomolake.storage import Store

_roots: dict[str, str] = {}
_made: dict[tuple[str, str, str], str] = {}


def root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; a temporary one where that is unset and executors are this machine's threads."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise StorageError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _roots[app] = f"{named or tempfile.mkdtemp(prefix='volumes-')}/volumes-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        Store(spark).delete(uri)
    except Exception:  # the session may be gone at exit
        pass


def fresh(spark: SparkSession, kind: str) -> str:
    """A place of its own for one run of a query."""
    return f"{root(spark)}/{kind}-{uuid.uuid4().hex[:12]}"


def once(spark: SparkSession, sf_dir: str, kind: str, make: Callable[[str], object]) -> str:
    """The place of what ``make`` writes from the tables in ``sf_dir``; written by the first query that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _made:
        uri = fresh(spark, kind)
        make(uri)
        _made[key] = uri
    return _made[key]


def local_path(uri: str) -> str:
    """The path of a shared folder that is mounted everywhere, for files that are no Spark tables."""
    u = urlparse(uri)
    if u.scheme not in ("", "file"):
        raise StorageError(f"image files need a mounted folder, not {uri}")
    return u.path
