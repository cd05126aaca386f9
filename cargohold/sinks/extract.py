"""Extraction: where items go, what happens to what is there, and writing their contents."""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargohold.functions.text import READONLY
from cargohold.operators.tree import SEP, name_of, relative_path

POLICIES = ("overwrite", "skip", "rename", "error")


def target_path(path: Column, base: str, keep: str = "partial", current: str = "", sep: str = SEP) -> Column:
    """Base and the item's name (keep="none"), its path ("full"), or its path below the current directory ("partial")."""
    inner = {"none": name_of(path, sep), "full": relative_path(path, F.lit(""), sep), "partial": relative_path(path, F.lit(current), sep)}[keep]
    return F.concat(F.lit(base + sep), inner)


def planned(items: DataFrame, there: DataFrame, base: str, keep: str = "partial", current: str = "", on_conflict: str = "skip", sep: str = SEP) -> DataFrame:
    """Items with target and action ("write", or the policy where `there` (container_id, target) has the target).

    Renamed targets get a suffix of the item's index. Rows are dealt by ranges of
    (container, index) and sorted, so a container's rows follow each other in the
    order of their index, in one partition unless the container is larger than
    that; a solid stream is read once by each partition that has some of it.
    """
    if on_conflict not in POLICIES:
        raise ValueError(f"on_conflict is one of {POLICIES}")
    aimed = items.withColumn("target", target_path(F.col("path"), base, keep, current, sep)).filter("target IS NOT NULL")
    known = there.select("container_id", "target").distinct().withColumn("__there", F.lit(True))
    out = aimed.join(known, ["container_id", "target"], "left")
    clash = F.col("__there").isNotNull()
    if on_conflict == "rename":
        out = out.withColumn("target", F.when(clash, F.concat("target", F.lit("~"), F.col("item_index").cast("string"))).otherwise(F.col("target")))
    out = out.withColumn("action", F.when(clash, on_conflict).otherwise("write")).drop("__there")
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(n, "container_id", "item_index").sortWithinPartitions("container_id", "item_index")


def beside(container: Column, sep: str = "/") -> Column:
    """The folder that a container lies in, as the base of its targets; contents are put next to it."""
    return F.regexp_replace(container, r"[\\/]?[^\\/]*$", "")


def fits(plan: DataFrame, root: str) -> bool:
    """Whether what the plan writes is less than the free bytes under root; one number comes to the driver."""
    need = plan.filter("action <> 'skip'").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return need < shutil.disk_usage(root).free


def _put(root: str, target: str, content: bytes | None, attributes: int | None, mtime: float | None) -> str:
    """Writes one file and returns its status."""
    path = os.path.normpath(os.path.join(root, str(target).replace("\\", "/")))
    if content is None or os.path.commonpath([root, path]) != os.path.normpath(root):
        return "refused"
    part = f"{path}.{uuid.uuid4().hex}"
    try:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as f:
            f.write(content)
        if mtime:
            os.utime(part, (mtime, mtime))
        if attributes and attributes & READONLY:
            os.chmod(part, 0o444)
        os.replace(part, path)
        return "ok"
    except OSError as e:
        return f"write_error: {e.strerror}"
    finally:
        with contextlib.suppress(OSError):
            os.unlink(part)


def write_files(contents: DataFrame, root: str) -> DataFrame:
    """Writes (container_id, item_index, target, content) under root, a folder that all executors mount; one status row each.

    A file appears whole or not at all: it is written beside its place and
    renamed over what is there, read-only or not, so a retried task does no
    harm; what a failed write leaves is deleted. Targets that leave root are
    refused. Columns `mtime` (seconds) and `attributes` are restored where they
    are there and not zero or null; of attributes only read-only has a meaning
    here.
    """
    extra = [c for c in ("attributes", "mtime") if c in contents.columns]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            given = {c: [None if pd.isna(x) else x for x in pdf[c]] if c in extra else [None] * len(pdf) for c in ("attributes", "mtime")}
            status = [_put(root, t, c, None if a is None else int(a), m) for t, c, a, m in zip(pdf["target"], pdf["content"], given["attributes"], given["mtime"], strict=True)]
            yield pd.DataFrame({"container_id": pdf["container_id"], "item_index": pdf["item_index"], "target": pdf["target"], "status": status})

    return contents.select("container_id", "item_index", "target", "content", *extra).mapInPandas(of, "container_id string, item_index long, target string, status string")


def write_tables(items: DataFrame, path: str) -> None:
    """The primary sink: Parquet partitioned by module."""
    items.write.partitionBy("module").parquet(path)
