"""Content-addressed cache of facts: only files whose content is new are parsed.

A cache is a folder of generations, each a whole table. A run writes a generation of its own and reads the newest complete
one, so nothing is lost if it dies and two runs at once don't disturb each other; generations but the last two are removed.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts as X

#: The folder below a scanned root that is used where none is named.
DEFAULT_NAME = ".gritsieve.cache"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def generations(spark: SparkSession, path: str) -> list[str]:
    """The complete generations of a cache, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory())
    return [f"{path}/{n}" for n in names if n.startswith("g-") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])]


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The cached facts, or None where there are none or they can't be read."""
    try:
        known = generations(spark, path)
        if not known:
            return None
        found = spark.read.parquet(known[-1])
        return found if {"path", "provider", "fingerprint", "functions"} <= set(found.columns) else None
    except Exception:  # a cache that can't be read counts as empty
        return None


def writable(spark: SparkSession, path: str) -> bool:
    try:
        fs, p = _fs(spark, path)
        return bool(fs.mkdirs(p))
    except Exception:  # where no cache can be kept, facts are found without
        return False


def facts(spark: SparkSession, files: DataFrame, path: str | None) -> DataFrame:
    """Facts of ``files``: hits from the cache, misses extracted; with them a new generation is written."""
    path = path and path.rstrip("/")
    if not path or not writable(spark, path):
        return X.extract(files)
    keyed = files.withColumn("fingerprint", X.fingerprint())
    cached = load(spark, path)
    if cached is None:
        misses = X.extract(keyed)
        fresh = misses
    else:
        own = cached.where(F.col("provider") == X.PROVIDER)
        hits = own.join(keyed.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi").drop("provider", "fingerprint")
        misses = X.extract(keyed.join(own.select("path", "fingerprint"), ["path", "fingerprint"], "left_anti"))
        fresh = hits.unionByName(misses)
    stamped = fresh.join(keyed.select("path", "fingerprint"), "path").withColumn("provider", F.lit(X.PROVIDER))
    if cached is not None:  # entries of files that are gone stay
        stamped = stamped.unionByName(cached.join(stamped.select("path"), "path", "left_anti"))
    old = generations(spark, path)
    side = f"{path}/g-{time.time_ns():020d}-{uuid.uuid4().hex}"
    stamped.write.parquet(side)
    for gone in old[:-1]:
        _fs(spark, gone)[0].delete(_fs(spark, gone)[1], True)
    return spark.read.parquet(side).join(keyed.select("path", "fingerprint"), ["path", "fingerprint"], "left_semi").drop("provider", "fingerprint")
