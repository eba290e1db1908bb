"""Results published in two phases: the rows of a run are written to a folder of its own, then one small file names what
was written. Readers go by these files only, so a run that fails shows nothing, and is repeated under the same name.

One run is published at a time. Rows of a run that never finished stay until the run is repeated or its folder cleared.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "run string, number long, parts array<string>, columns string"


def manifests(spark: SparkSession, root: str) -> list:
    """The published runs in their order: run, number, parts (folders), columns (their schema as JSON). One small row a run."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(os.path.join(root, "manifests")).orderBy("number").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def publish(df: DataFrame, root: str, run: str, bucket: str | None = None) -> bool:
    """Publish df as a run; false where a run of this name is published already, which changes nothing. With a bucket
    column (of few values) each bucket gets a folder of its own, and the column is not kept in the files."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
        raise ValueError(f"not a name of a run: {run!r}")
    spark = df.sparkSession
    done = manifests(spark, root)
    if any(m.run == run for m in done):
        return False
    folder = os.path.join(root, "data", run)
    if bucket is None:
        df.write.mode("overwrite").parquet(folder)
        parts = [run]
    else:
        df.write.mode("overwrite").partitionBy(bucket).parquet(folder)
        written = spark.read.schema(df.schema).parquet(folder).select(bucket).distinct().collect()
        parts = [f"{run}/{bucket}={r[0]}" for r in written]
        df = df.drop(bucket)
    commit(spark, root, run, 1 + max((m.number for m in done), default=0), parts, df.schema)
    return True


def commit(spark: SparkSession, root: str, run: str, number: int, parts: Iterable[str], columns: StructType) -> None:
    """The second phase: one file, which appears whole."""
    row = spark.createDataFrame([(run, number, sorted(parts), columns.json())], MANIFEST)
    row.coalesce(1).write.mode("overwrite").json(os.path.join(root, "manifests", run))


def published(spark: SparkSession, root: str, newest: bool = False) -> DataFrame | None:
    """The rows of all published runs, or of the newest run of each bucket only; null where nothing was published. Columns
    that an earlier run did not have are null in its rows."""
    done = manifests(spark, root)
    if not done:
        return None
    # part of a run -> the run's folder of it: a later run of a bucket takes the earlier one's place
    taken = {(p.partition("/")[2] if newest else p): p for m in done for p in m.parts}
    schema = StructType.fromJson(json.loads(done[-1].columns))
    if not taken:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(os.path.join(root, "data", p) for p in sorted(taken.values())))


def bucket_of(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
