"""A store of revisions by content: what a file holds is kept once a project, however many revisions name it.

A store is three tables, and each step returns new ones. Steps are joins on project and key or hash; no file's content is
shuffled but by the step that needs it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFETY = "restore_safety"
P, FILE = "project", ["project", "key"]


@dataclass(frozen=True)
class Store:
    """contents (project, hash, size, content); entries (project, revision_id, key, hash, external); revisions (project,
    revision_id, sequence, automatic, purpose)."""

    contents: DataFrame
    entries: DataFrame
    revisions: DataFrame


def hashed(files: DataFrame) -> DataFrame:
    """files (project, key, content, external) with hash and size."""
    return files.withColumn("hash", F.sha2(F.col("content"), 256)).withColumn("size", F.length(F.col("content").cast("binary")).cast("long"))


def empty(files: DataFrame) -> Store:
    """A store without revisions, for such files."""
    f = hashed(files).where("false")
    entries = f.select(P, F.lit("").alias("revision_id"), "key", "hash", "external")
    revisions = f.select(P, F.lit("").alias("revision_id"), F.lit(0).cast("long").alias("sequence"), F.lit(False).alias("automatic"), F.lit("").alias("purpose"))
    return Store(f.select(P, "hash", "size", "content"), entries, revisions)


def new_content(store: Store, files: DataFrame) -> DataFrame:
    """What the files hold that the store hasn't got: one row for each project and hash."""
    once = hashed(files).groupBy(P, "hash").agg(F.first("size").alias("size"), F.first("content").alias("content"))
    return once.join(store.contents.select(P, "hash"), [P, "hash"], "left_anti")


def save(store: Store, files: DataFrame, revision_id: Column | str, automatic: bool = False, purpose: str = "manual", projects: DataFrame | None = None) -> Store:
    """The store with a revision of each project's files; only new content is added.

    projects: those that get a revision, an empty one where they have no files; by default all that have files.
    """
    name = revision_id if isinstance(revision_id, Column) else F.lit(revision_id)
    entries = hashed(files).select(P, name.alias("revision_id"), "key", "hash", "external")
    place = store.revisions.groupBy(P).agg(F.max("sequence").alias("_last"))
    named = (files if projects is None else projects).select(P, name.alias("revision_id")).distinct().join(place, P, "left")
    revisions = named.select(P, "revision_id", (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("sequence"), F.lit(automatic).alias("automatic"), F.lit(purpose).alias("purpose"))
    return Store(store.contents.unionByName(new_content(store, files)), store.entries.unionByName(entries), store.revisions.unionByName(revisions))


def files_of(store: Store, chosen: DataFrame) -> DataFrame:
    """project, key, content, external of one chosen revision (project, revision_id) a project. Content that the store
    has lost comes as null."""
    held = store.entries.join(chosen, [P, "revision_id"])
    return held.join(store.contents, [P, "hash"], "left").select(P, "key", "content", "external")


def restore(store: Store, files: DataFrame, chosen: DataFrame, safety: Column | str, external: bool = False) -> tuple[Store, DataFrame]:
    """The store with a safety revision of the files as they are, and the files of the projects after the restore.

    Files of the chosen revision replace those of now, and files that it hasn't got go. External files stay as they are
    unless they are asked for. Projects without a chosen revision keep their files and get no safety revision; those with
    one get it even if they have no files, so that an undo takes the restored files away again.
    """
    mine = files.join(chosen.select(P), P, "left_semi")
    kept = save(store, mine, safety, True, SAFETY, chosen.select(P))
    back = files_of(store, chosen)
    back = back if external else back.where(~F.col("external"))
    stay = files.join(chosen.select(P, F.lit(True).alias("_asked")), P, "left").where("_asked IS NULL OR external").drop("_asked")
    stay = stay.join(back.select(*FILE), FILE, "left_anti").select(P, "key", "content", "external")
    return kept, stay.unionByName(back)


def latest_safety(store: Store) -> DataFrame:
    """project, revision_id of the last safety revision of each project: what an undo restores."""
    return store.revisions.where(F.col("purpose") == SAFETY).groupBy(P).agg(F.max_by("revision_id", "sequence").alias("revision_id"))


def undo(store: Store, files: DataFrame, safety: Column | str) -> tuple[Store, DataFrame]:
    """Takes the last restore back; a safety revision is made again, so that an undo can be undone."""
    return restore(store, files, latest_safety(store), safety, external=True)


def forget(store: Store, gone: DataFrame) -> Store:
    """The store without these revisions (project, revision_id) and without content that no other revision names."""
    entries = store.entries.join(gone, [P, "revision_id"], "left_anti")
    return Store(store.contents.join(entries.select(P, "hash"), [P, "hash"], "left_semi"), entries, store.revisions.join(gone, [P, "revision_id"], "left_anti"))


def unreferenced(store: Store) -> DataFrame:
    """Content that no revision names."""
    return store.contents.join(store.entries.select(P, "hash"), [P, "hash"], "left_anti")
