"""Exact deduplication as a stateful stream whose keyed state lives on disk.

The texts' digests, stable identifiers and content locators are streamed into an aggregation by digest, in a
few triggers of equal numbers of files. Its state has no watermark and so never expires; it is kept by the
RocksDB state store on the executors' disks, with its changelog in the shared folder, and every trigger meets
what the earlier ones left. The state of a digest is the largest identifier, the locator of its content (file
and row) and the number of rows. Every trigger emits the digests that it changed; since the largest identifier
and the count only grow, the maximum over all triggers is the state itself.

Then the hits, digests seen more than once, are checked on full bytes: the content at the retained locator is
compared with each text under that digest. Texts without a hit stay where they are.

The state of a call lives as long as the call, unless a folder is named that keeps it: then the next table that is
streamed meets all that came before, and of earlier tables nothing is read but the content at the locators of hits.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, checked_small, matching, new_folder, scratch, stage

#: Triggers that a table is streamed in: each but the first meets state.
TRIGGERS = 4

#: The disk-backed state store. Each state partition takes only the disk that it fills, and ships changes
#: instead of whole snapshots, so that many small partitions stay small; all partitions of an executor share
#: one bound of memory, and a write buffer reserves an eighth of its size at once.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def stream_state(entries: DataFrame, files_per_trigger: int | None = None, kept: str | None = None) -> DataFrame:
    """entries (id, digest, file, row), a staged table, through the keyed state: digest, keep, file, row, n. Without
    files_per_trigger the table is streamed in TRIGGERS triggers. With `kept` the state goes on from what this folder
    holds, and all digests that ever came are returned."""
    spark = entries.sparkSession
    files = [] if entries.isEmpty() else entries.inputFiles()
    out, at = (f"{kept}/state", f"{kept}/checkpoint") if kept else (new_folder(spark, "dedup-state"), new_folder(spark, "dedup-checkpoint"))
    top = F.struct("id", "file", "row").alias("top")
    if files:
        old = {k: spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            spark.conf.set(k, v)
        try:
            reader = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", files_per_trigger or -(-len(files) // TRIGGERS))
            state = reader.parquet(f"{kept}/entries/*" if kept else files[0].rsplit("/", 1)[0]).groupBy("digest").agg(F.max(top).alias("top"), F.count(F.lit(1)).alias("n"))
            emit = lambda changed, trigger: changed.write.mode("overwrite").parquet(f"{out}/trigger={trigger}")
            state.writeStream.outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).foreachBatch(emit).start().awaitTermination()
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        emitted = spark.read.parquet(out).select("digest", "top", "n")
    elif kept:
        raise ValueError("a kept state takes no empty table")
    else:
        emitted = entries.select("digest", top, F.lit(1).cast("long").alias("n")).limit(0)
    last = emitted.groupBy("digest").agg(F.max("top").alias("top"), F.max("n").alias("n"))
    return stage(last.select("digest", F.col("top.id").alias("keep"), "top.file", "top.row", "n"), "dedup-groups")


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, normalised text and its digest, and the locator (file, row) of every row of docs. Rows that are
    not read from Parquet files, and so have no locator, are written to some first."""
    place = lambda df: (df.metadataColumn("_metadata")["file_path"].alias("file"), df.metadataColumn("_metadata")["row_index"].alias("row"))
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    try:
        rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *place(docs))
        rows.schema  # noqa: B018  whether it resolves
    except AnalysisException:
        plain = stage(plain, "dedup-content")
        rows = plain.select("id", "text", *place(plain))
    text = normalised(F.col("text"))
    return rows.select("id", text.alias("text"), "file", "row").withColumn("digest", F.sha2("text", 256))


def _kept_entries(rows: DataFrame, kept: str) -> DataFrame:
    """The entries of a table, written beside those of earlier ones."""
    path = f"{kept}/entries/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _earlier(hits: DataFrame, entries: DataFrame, text_col: str) -> DataFrame | None:
    """digest and text of the hits whose content is in files of earlier tables; of these only the rows at the locators."""
    others = [r.file for r in hits.select("file").distinct().join(entries.select("file").distinct(), "file", "left_anti").collect()]  # a row a file
    if not others:
        return None
    old = hits.sparkSession.read.parquet(*others)
    place = {c: old.metadataColumn("_metadata")[f] for c, f in (("file", "file_path"), ("row", "row_index"))}
    at = old.select(old[text_col].alias("text"), *(v.alias(c) for c, v in place.items()))
    return at.join(checked_small(hits), ["file", "row"]).select("digest", normalised(F.col("text")).alias("text"), "file", "row")


def _grouped(docs: DataFrame, id_col: str, text_col: str, files_per_trigger: int | None = None, kept: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The staged entries (id, digest, file, row), and the groups of exact_groups()."""
    rows = located(docs, id_col, text_col)
    narrow = rows.select("id", "digest", "file", "row")
    entries = _kept_entries(narrow, kept) if kept else stage(narrow, "dedup-entries")
    state = stream_state(entries, files_per_trigger, kept)
    if kept:
        state = stage(matching(state, {"digest": state["digest"]}, stage(entries.select("digest").distinct(), "dedup-here"), "left_semi"), "dedup-met")

    # Full bytes of the hits: those at the retained locator are the content of a digest, other bytes are unequal to it.
    # Copies meet in the task that reads them, so that a large group sends one row from each.
    hits = stage(state.where("n > 1").select("digest", "file", "row"), "dedup-hits")
    place = checked_small(hits).select("digest", F.struct("file", "row").alias("content"))
    texts = matching(rows.select("digest", "text", "file", "row"), {"digest": rows["digest"]}, hits, "left_semi")
    earlier = _earlier(hits, entries, text_col) if kept else None
    texts = (texts if earlier is None else texts.unionByName(earlier)).join(place, "digest").select("digest", F.encode("text", "utf-8").alias("bytes"), (F.struct("file", "row") == F.col("content")).alias("here"))
    unequal = stage(texts.groupBy("digest", "bytes").agg(F.max("here").alias("here")).where("not here").select("digest").distinct(), "dedup-unequal")
    groups = entries.select("id", "digest").join(state.select("digest", "keep", "n"), "digest")
    if unequal.isEmpty():
        return entries, groups
    # Digests that stand for several texts: group these rows by the bytes themselves.
    odd = stage(matching(rows, {"digest": rows["digest"]}, unequal, "left_semi").select("id", "digest", F.encode("text", "utf-8").alias("bytes")), "dedup-odd")
    by_text = odd.groupBy("digest", "bytes").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    split = odd.join(by_text, ["digest", "bytes"]).select("digest", "id", "keep", "n")
    return entries, groups.join(unequal, "digest", "left_anti").unionByName(split)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_trigger: int | None = None, kept: str | None = None) -> DataFrame:
    """A row per row of docs: id, digest (SHA-256 of the normalised text), keep, n (size of its group).

    A null text is an empty one; empty texts form a group like others. Texts are equal when they are
    so after lower-casing A-Z, whole and of any length. The largest identifier of a group stays, null counts as
    the smallest; of repeated rows with that identifier all carry it as `keep`. An empty table gives no rows.
    Only `id_col` and `text_col` are read; other columns may have any name.

    Without `kept` the state is that of this table alone and goes with the call. `kept` names a folder, shared by the
    driver and all executors, that holds the state of earlier tables, or is new: then keep and n are those of all
    tables so far, whose files must still be where they were and have the same column of texts. Tables are then read
    from Parquet and not empty; a table that is given twice counts twice. Digests that stand for several texts are
    told apart within the table that is given.
    """
    return _grouped(docs, id_col, text_col, files_per_trigger, kept)[1]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns of docs, whose names may be any. Of repeated rows all but one go."""
    keys = lambda df: {"id": df[id_col], "digest": F.sha2(normalised(df[text_col]), 256)}
    with scratch():
        entries, groups = _grouped(docs, id_col, text_col)
        gone = stage(groups.where(~F.col("id").eqNullSafe(F.col("keep"))).select("id", "digest"), "dedup-gone", keep=True)  # no grouping, so that the join can split a hot digest
        twice = stage(entries.groupBy("id", "digest").count().where("count > 1").select("id", "digest"), "dedup-twice", keep=True)
    held = matching(docs, keys(docs), gone, "left_anti")
    if twice.isEmpty():
        return held
    again = matching(held, keys(held), twice, "left_semi")
    again = again.select(F.struct(*docs.columns).alias("row"), *(v.alias(k) for k, v in keys(again).items())).dropDuplicates(["id", "digest"]).select("row.*")
    return matching(held, keys(held), twice, "left_anti").unionByName(again)
