"""Tables that change by commits: what a task that is lost or run again leaves behind is never read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .loading import prune_orphans, upsert

BUCKET = "_bucket"


def files_of(spark: SparkSession, path: str):
    """Hadoop's file system of a path and its class of paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path


def commits(spark: SparkSession, path: str) -> list[dict]:
    """All commits in order: batch, buckets (how many), schema, and the folder of each bucket that has rows."""
    fs, at = files_of(spark, path)
    log = at(f"{path}/log")
    if not fs.exists(log):
        return []
    names = sorted(str(x.getPath()) for x in fs.listStatus(log) if x.getPath().getName().endswith(".json"))
    return [json.loads("\n".join(r.value for r in spark.read.text(name, wholetext=True).collect())) for name in names]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last commit."""
    last = commits(spark, path)[-1]
    folders = sorted(last["folders"].values())
    return spark.read.schema(last["schema"]).parquet(*folders) if folders else spark.createDataFrame([], last["schema"])


def bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def published(spark: SparkSession, path: str, entry: dict, n: int) -> None:
    """The commit's entry appears under its number at once, by a rename; if another has taken the number, this one fails."""
    fs, at = files_of(spark, path)
    fs.mkdirs(at(f"{path}/log"))
    draft, final = at(f"{path}/log/.{uuid.uuid4().hex}"), at(f"{path}/log/{n:08d}.json")
    out = fs.create(draft, False)
    out.write(json.dumps(entry).encode())
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another commit has number {n} of {path}")


def replaced(spark: SparkSession, path: str, rows: DataFrame, batch: str, keys: list[str], touched: list[int], buckets: int, before: dict | None, number: int) -> None:
    """Commits rows as all rows of the touched buckets; the folders of the others stay."""
    folder = f"{path}/data/{number:08d}-{uuid.uuid4().hex}"
    rows.withColumn(BUCKET, bucket(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(folder)
    fs, at = files_of(spark, folder)
    there = [x.getPath().getName() for x in fs.listStatus(at(folder)) if x.getPath().getName().startswith(f"{BUCKET}=")]
    folders = {k: v for k, v in (before["folders"] if before else {}).items() if int(k) not in touched} | {name.split("=")[1]: f"{folder}/{name}" for name in there}
    schema = before["schema"] if before else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    published(spark, path, {"batch": batch, "buckets": buckets, "keys": keys, "schema": schema, "folders": folders}, number)


def commit_upsert(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], batch: str, mode: str = "replace", keep_cols: tuple[str, ...] = (), buckets: int = 64) -> bool:
    """Upserts into the table at path (made by the first commit); False if this batch has been committed before, and nothing is done.

    Only buckets of keys that the updates touch are written anew, to a folder of this attempt's own; readers see them once the commit's
    entry is in the log. An attempt that fails leaves a folder that no entry names. updates have unique keys; columns are the table's.
    """
    log = commits(spark, path)
    if any(c["batch"] == batch for c in log):
        return False
    before = log[-1] if log else None
    n = before["buckets"] if before else buckets
    touched = [r[0] for r in updates.select(bucket(keys, n)).distinct().collect()]
    rows = updates
    if before:
        some = [before["folders"][str(b)] for b in touched if str(b) in before["folders"]]
        held = spark.read.schema(before["schema"]).parquet(*some) if some else spark.createDataFrame([], before["schema"])
        rows = upsert(held, updates, keys, mode, keep_cols)
    replaced(spark, path, rows, batch, keys, touched, n, before, len(log) + 1)
    return True


def commit_prune(spark: SparkSession, path: str, selection: DataFrame, key: str, family_prefix: str, batch: str) -> bool:
    """Commits the table without the rows whose key begins with family_prefix and is not selected; only buckets that lose rows are written anew."""
    log = commits(spark, path)
    if any(c["batch"] == batch for c in log):
        return False
    before = log[-1]
    whole = read_table(spark, path)
    left = prune_orphans(whole, selection, key, family_prefix)
    n, keys = before["buckets"], before["keys"]
    count = lambda df, name: df.groupBy(bucket(keys, n).alias("b")).agg(F.count("*").alias(name))
    losing = count(whole, "was").join(count(left, "now"), "b", "left").filter("now is null or now < was").select("b").collect()
    touched = [r.b for r in losing]
    replaced(spark, path, left.filter(bucket(keys, n).isin(touched)) if touched else left.limit(0), batch, keys, touched, n, before, len(log) + 1)
    return True
