"""Tables whose readers see whole writes only: files under a snapshot's number, named by a manifest.

A table's folder holds ``data/<write>/bucket=b`` and ``manifests/<number>.json``. A manifest names, per bucket of the key, the
write that holds the bucket's rows, so it is bounded by the number of buckets. It is written aside and moved in place by
one rename, which does not replace a manifest that is there: of two writers with one start the later is refused.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelake.session import stored
from pagelake.sources.tables import BUCKETS, bucket


class WriteConflict(RuntimeError):
    """Another writer has published the number this one was about to publish."""


def _folder(spark: SparkSession, path: str) -> tuple[Any, Any]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published snapshots, oldest first."""
    fs, folder = _folder(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith((".", "_")))


def _manifest(spark: SparkSession, path: str, number: int) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/manifests/{number}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, number: int, manifest: dict[str, Any]) -> None:
    aside = f"{path}/manifests/_{uuid.uuid4().hex}"
    fs, target = _folder(spark, f"{path}/manifests/{number}.json")
    _, source = _folder(spark, aside)
    out = fs.create(source, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    try:
        moved = not fs.exists(target) and fs.rename(source, target)
    except Py4JJavaError:
        moved = False
    if not moved:
        fs.delete(source, False)
        raise WriteConflict(f"snapshot {number} of {path} is there already")


def _rows(spark: SparkSession, path: str, manifest: dict[str, Any], buckets: list[int] | None = None) -> DataFrame:
    """Rows of the named buckets (all: None), with their bucket."""
    schema = StructType.fromJson(manifest["schema"])
    held = {int(b): write for b, write in manifest["buckets"].items() if buckets is None or int(b) in buckets}
    full = StructType([*schema.fields, *StructType.fromDDL("bucket int").fields])
    if not held:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(
        *[f"{path}/data/write={write}/bucket={b}" for b, write in sorted(held.items())]
    ).select(*full.names)


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """Rows of a snapshot, the last one by default. What a later write does is not seen."""
    numbers = snapshots(spark, path)
    if not numbers or (number is not None and number not in numbers):
        raise FileNotFoundError(f"no snapshot {'' if number is None else number} in {path}")
    return _rows(spark, path, _manifest(spark, path, numbers[-1] if number is None else number)).drop("bucket")


def merge_snapshot(df: DataFrame, path: str, key: str, start: int | None = None, buckets: int = BUCKETS) -> int:
    """Publishes a snapshot in which all rows of the keys in ``df`` are replaced by its rows; gives its number.

    Only the buckets of these keys are written again. ``start``: the snapshot that the rows were made from (default: the
    last); if another has been published since, WriteConflict is raised and the table stays. Columns of ``df`` that the table lacks are
    added, those it lacks itself are null. The table's first write fixes the number of buckets. Null keys are one key.
    """
    spark = df.sparkSession
    numbers = snapshots(spark, path)
    last = (numbers[-1] if numbers else 0) if start is None else start
    manifest = _manifest(spark, path, last) if last else {"n_buckets": buckets, "schema": StructType([]).jsonValue(), "buckets": {}}
    new = stored(df.withColumn("bucket", bucket(F.col(key), manifest["n_buckets"])), "snapshot-rows")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())
    rows = new
    if last and touched:
        old = _rows(spark, path, manifest, touched)
        keys = new.select(F.col(key).alias("_key")).distinct()
        others = old.join(keys, old[key].eqNullSafe(keys["_key"]), "left_anti")
        rows = others.unionByName(new, allowMissingColumns=True)
    write = uuid.uuid4().hex
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/write={write}")
    held = manifest["buckets"] | {str(b): write for b in touched}
    fields = {f.name: f for f in StructType.fromJson(manifest["schema"]).fields} | {f.name: f for f in rows.drop("bucket").schema.fields}
    _publish(spark, path, last + 1, {"n_buckets": manifest["n_buckets"], "schema": StructType(list(fields.values())).jsonValue(), "buckets": held})
    return last + 1


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Drops all but the last ``keep`` snapshots and the writes none of them names; for times when nothing writes."""
    numbers = snapshots(spark, path)
    stay, go = numbers[-keep:], numbers[:-keep]
    named = {write for n in stay for write in _manifest(spark, path, n)["buckets"].values()}
    for n in go:
        fs, target = _folder(spark, f"{path}/manifests/{n}.json")
        fs.delete(target, False)
    fs, data = _folder(spark, f"{path}/data")
    for status in fs.listStatus(data) if fs.exists(data) else []:
        if status.getPath().getName().removeprefix("write=") not in named:
            fs.delete(status.getPath(), True)
