"""The review workspace: memberships of photos in clusters under a log of operations.

State is a fold of the log, so undo drops the last operation and folds again. The
log of one review is short: its operations come to the driver and are applied as
joins and expressions on the whole table, one after another.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import NOISE
from .numbering import cut


def apply_operations(members: DataFrame, log: list[dict], photo: str = "photo", cluster: str = "cluster") -> DataFrame:
    """(photo, cluster) after the operations.

    ``merge``: from, to; ``remove``: photos leave cluster ``from``; ``move``: photos go
    from ``from`` (noise is -1) to ``to``. Merging a cluster with itself does nothing.
    """
    c, p = F.col(cluster), F.col(photo)
    for op in log:
        if op["kind"] == "merge":
            if op["from"] == op["to"]:
                continue
            new = F.when(c == op["from"], op["to"]).otherwise(c)
        elif op["kind"] == "remove":
            new = F.when((c == op["from"]) & p.isin(op["photos"]), NOISE).otherwise(c)
        elif op["kind"] == "move":
            new = F.when((c == op["from"]) & p.isin(op["photos"]), op["to"]).otherwise(c)
        else:
            raise ValueError(f"unknown operation {op['kind']}")
        members = members.withColumn(cluster, new.cast("int"))
    return members.distinct()


def undo(log: list[dict], steps: int = 1) -> list[dict]:
    return log[: max(len(log) - steps, 0)]


def next_cluster_id(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    return members.agg(F.coalesce(F.max(cluster) + 1, F.lit(0)).alias("next_id"))


def noise_photos(images: DataFrame, members: DataFrame, photo: str = "photo", cluster: str = "cluster") -> DataFrame:
    """Photos in no cluster."""
    return images.select(photo).distinct().join(members.where(F.col(cluster) != NOISE), photo, "left_anti")


def organise(images: DataFrame, members: DataFrame, path: str, cluster: str, faces: str, error: str, skipped: str, prefix: str = "person_") -> DataFrame:
    """(folder, path): a folder for each person, one for photos of nobody known, one for photos without faces."""
    persons = members.where(F.col(cluster) != NOISE).select(F.concat(F.lit(prefix), F.format_string("%02d", cluster)).alias("folder"), path).distinct()
    sound = images.where(F.col(error).isNull() & ~F.col(skipped))
    rest = sound.join(persons.select(path), path, "left_anti")
    folder = F.when(F.col(faces) > 0, "_unclustered").otherwise("_no_faces")
    return persons.unionByName(rest.select(folder.alias("folder"), path))


def unique_destinations(plan: DataFrame, folder: str, path: str) -> DataFrame:
    """Adds ``dest``: the file's name in its folder, with _1, _2, ... before the extension where the name is taken.

    Files take names in order of their paths, so a later one also gives way to a number that an earlier one was given. Names
    can only meet if they are the same without numbers at their ends; of those, only sets in which a name repeats are
    gone through file by file, all others keep their names.
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"^.+?(\.[^.]*)?$", 1)
    stem = F.substr(name, F.lit(1), F.length(name) - F.length(ext))
    root = F.regexp_replace(stem, r"(_[0-9]+)+$", "")
    rows = plan.withColumn("_name", name).withColumn("_stem", stem).withColumn("_ext", ext).withColumn("_root", root)
    keys = [folder, "_root", "_ext"]
    meet = rows.groupBy(*keys, "_name").agg(F.count("*").alias("_n")).where("_n > 1").select(*keys).distinct()
    kept = rows.join(meet, keys, "left_anti").withColumn("dest", F.concat(folder, F.lit("/"), "_name"))

    def give(table: pa.Table) -> pa.Table:
        table = table.sort_by(path)
        taken, dest = set(), []
        nexts: dict[str, int] = {}
        for stem, ext in zip(table.column("_stem").to_pylist(), table.column("_ext").to_pylist(), strict=True):
            own, n = stem, nexts.get(stem, 0)
            while own in taken:
                n += 1
                own = f"{stem}_{n}"
            nexts[stem] = n
            taken.add(own)
            dest.append(own + ext)
        folders = table.column(folder).to_pylist()
        return table.append_column("dest", pa.array([f"{f}/{d}" for f, d in zip(folders, dest, strict=True)], pa.string()))

    columns = [*plan.columns, "dest"]
    schema = rows.join(meet, keys, "left_semi").withColumn("dest", F.lit("")).schema
    told = rows.join(meet, keys, "left_semi").groupBy(*keys).applyInArrow(give, schema)
    return kept.select(*columns).unionByName(told.select(*columns))


def _transfer(source: str, target: str, copy: bool) -> str | None:
    """Copies or moves a file under its final name in one step, so that a task may run again; an error as text."""
    try:
        if not copy and not os.path.exists(source) and os.path.exists(target):
            return None  # moved by an attempt that was lost
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = f"{target}.{uuid.uuid4().hex}.part"
        try:
            shutil.copy2(source, part)
            os.replace(part, target)
        finally:
            if os.path.exists(part):
                os.remove(part)
        if not copy:
            os.remove(source)
    except OSError as problem:
        return f"{type(problem).__name__}: {problem}"
    return None


def execute_plan(plan: DataFrame, path: str, root: str, copy: bool = True, dry_run: bool = False) -> DataFrame:
    """(path, dest, state, error): ``copy`` or ``move`` for each file of a plan with ``dest``, ``error`` where that failed.

    ``root`` and the files lie on a file system that all executors mount. A dry run
    touches nothing and every file is ``skipped``. A file goes to several folders of a plan; a plan that moves
    files has to name each once, which is checked. The states are stored, so reading them does no file work again.
    """
    rows = plan.select(F.col(path).alias("path"), "dest")
    if dry_run:
        return rows.select("path", "dest", F.lit("skipped").alias("state"), F.lit(None).cast("string").alias("error"))
    if not copy and rows.groupBy("path").count().where("count > 1").limit(1).count():
        raise ValueError("a plan that moves files names one of them more than once")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, dests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            errors = [_transfer(p.removeprefix("file:"), os.path.join(root, d), copy) for p, d in zip(paths, dests, strict=True)]
            states = ["error" if e else "copy" if copy else "move" for e in errors]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(states, pa.string()), pa.array(errors, pa.string())], names=["path", "dest", "state", "error"])

    return cut(rows.mapInArrow(run, "path string, dest string, state string, error string"))


def plan_counts(states: DataFrame) -> DataFrame:
    """(done, skipped, errors) of a plan that was carried out."""
    of = lambda *names: F.count(F.when(F.col("state").isin(*names), 1))
    return states.agg(of("copy", "move").alias("done"), of("skipped").alias("skipped"), of("error").alias("errors"))


def rename_operations(names: dict[int, str], cluster: int, name: str) -> tuple[dict[int, str], list[dict]]:
    """The names and the operations that a new name makes: another cluster of the same name takes this one in."""
    same = [c for c, n in names.items() if n == name and name and c != cluster]
    if not same:
        return names | {cluster: name}, []
    return {c: n for c, n in names.items() if c != cluster}, [{"kind": "merge", "from": cluster, "to": same[0]}]


def export_members(members: DataFrame, faces: DataFrame, strategy: str, clusters: list[int] | None = None, photo: str = "photo", cluster: str = "cluster") -> DataFrame:
    """(photo, cluster) to be written: all memberships, or with ``primary`` only that of a photo's primary face.

    ``faces`` has (photo, cluster, is_primary). Photos whose primary face is in no
    cluster go nowhere under ``primary``; a subset of clusters may be named.
    """
    rows = members.where(F.col(cluster) != NOISE)
    if clusters is not None:
        rows = rows.where(F.col(cluster).isin(clusters))
    if strategy == "primary":
        return rows.join(faces.where("is_primary").select(photo, cluster).distinct(), [photo, cluster], "left_semi")
    if strategy != "all":
        raise ValueError(f"unknown strategy {strategy}")
    return rows


def preview(members: DataFrame, shown: int = 5, photo: str = "photo", cluster: str = "cluster") -> DataFrame:
    """(cluster, first, more): the first photos of each cluster by name, and how many there are besides.

    Only the shown ones are gathered, by rank; the rest is counted.
    """
    w = Window.partitionBy(cluster).orderBy(photo)
    ranked = members.where(F.col(cluster) != NOISE).withColumn("_r", F.row_number().over(w))
    first = F.sort_array(F.collect_list(F.when(F.col("_r") <= shown, F.col(photo))))
    return ranked.groupBy(cluster).agg(first.alias("first"), F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))


def summary(members: DataFrame, confidences: DataFrame, photo: str = "photo", cluster: str = "cluster") -> DataFrame:
    """(json): a row for each cluster with its size, cover and confidence (3 decimals)."""
    sizes = members.where(F.col(cluster) != NOISE).groupBy(cluster).agg(F.count_distinct(photo).alias("photos"), F.min(photo).alias("cover"))
    rows = sizes.join(confidences, cluster, "left").select(cluster, "photos", "cover", F.round("confidence", 3).alias("confidence"))
    return rows.select(F.to_json(F.struct("*")).alias("json"))
