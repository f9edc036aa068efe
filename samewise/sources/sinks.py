"""Writing id lists, packages, model metadata and stage tables."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_lines(lists: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """``source1_entity_id, <column>``: the ids of each entity joined by commas, without repeats, empty for none."""
    return lists.select(F.col("s1").alias("source1_entity_id"), F.array_join(F.array_distinct("ids"), ",").alias(column))


def write_id_lists(lists: DataFrame, path: str, column: str = "matched_entity_ids", order: str | None = None, single: bool = True) -> None:
    """A tab-separated file with a header, nothing quoted; in the order of ``order`` if given.

    ``single`` gives one file, written by one task from sorted rows; without it a folder of sorted parts.
    """
    rows = lists.orderBy(order) if order else lists
    lines = list_lines(rows, column)
    (lines.coalesce(1) if single else lines).write.mode("overwrite").options(sep="\t", header="true", quote="", emptyValue="", nullValue="", escape="").csv(path)


def package(paths: list[str], target: str) -> None:
    """The files of some local output folders in one zip archive, each under its folder's name."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in map(Path, paths):
            parts = [p] if p.is_file() else sorted(p.glob("part-*"))
            for k, part in enumerate(parts):
                z.write(part, f"{p.stem}.tsv" if k == 0 else f"{p.stem}-{k}.tsv")


def write_metadata(meta: dict, path: str) -> None:
    Path(path).write_text(json.dumps(meta, indent=1, sort_keys=True))


def read_metadata(path: str) -> dict:
    return json.loads(Path(path).read_text())


def stage_path(root: str, name: str, **settings: object) -> str:
    """A folder for a stage's table; other settings give another folder, so no stale table is read."""
    text = json.dumps(settings, sort_keys=True, default=str)
    return f"{root}/{name}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def stage(spark: SparkSession, path: str, make) -> DataFrame:  # noqa: ANN001
    """The table at ``path`` if it was written to the end, else what ``make()`` gives, written first."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
