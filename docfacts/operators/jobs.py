"""Jobs: uploads into a queue, results over its rows, what may be shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfacts.functions import ids

# States of a job, where its file stands in each, and what a summary shows.
QUEUED, STARTED, DONE, FAILED = "QUEUED", "PROCESSING", "DONE", "ERROR"
FOLDERS = {QUEUED: "pendientes", STARTED: "pendientes", DONE: "procesados", FAILED: "errores"}
SHOWN = ("job_id", "status", "original_filename", "sha256", "source_type", "extension", "force", "queued_at", "started_at", "finished_at", "error", "folder")


def enqueued(uploads: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A queued job for each upload (content, original_filename, mime, source_type, force, queued_at) that is new or forced.

    An upload is new if its hash is not in ``known`` (sha256) and no earlier upload of
    the table has it. Its name's suffix, else its type, gives the extension.

    Defined cases: a null ``force`` is false; a null content is no upload; of uploads
    of one moment the smaller name is the earlier; an empty table gives no jobs.
    """
    suffix = F.lower(F.regexp_extract("original_filename", r"\.([A-Za-z0-9]+)$", 1))
    rows = uploads.filter("content is not null").withColumns(
        {"sha256": F.sha2(F.col("content").cast("binary"), 256), "force": F.coalesce("force", F.lit(False)), "extension": F.coalesce(F.nullif(suffix, F.lit("")), ids.extension(F.col("mime")))}
    )
    if known is not None:
        seen = known.select("sha256", F.lit(True).alias("_known")).distinct()
        rows = rows.join(seen, "sha256", "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("boolean"))
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("queued_at", "original_filename")) == 1
    job = F.concat_ws("-", F.unix_timestamp("queued_at").cast("string"), F.substring("sha256", 1, 16))
    return rows.withColumn("_first", first).filter("force or (_first and _known is null)").select(
        job.alias("job_id"), F.lit(QUEUED).alias("status"), "sha256", "source_type", "original_filename", "mime", "extension", "force", "queued_at"
    )


def started(jobs: DataFrame, ids_: DataFrame, at: Column) -> DataFrame:
    """``jobs`` with those of ``ids_`` (job_id) in work since ``at``; only queued ones begin."""
    taken = ids_.select("job_id", F.lit(True).alias("_taken")).distinct()
    begins = F.coalesce(F.col("_taken"), F.lit(False)) & (F.col("status") == QUEUED)
    rows = jobs.join(taken, "job_id", "left")
    return rows.withColumns({"started_at": F.when(begins, at), "status": F.when(begins, STARTED).otherwise(F.col("status"))}).drop("_taken")


def settled(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """``jobs`` with the outcome of ``results`` (job_id, ok, error, finished_at): status, error, finished_at, and the folder of the job's file."""
    done = results.select("job_id", F.when(F.col("ok"), DONE).otherwise(FAILED).alias("_status"), F.when(~F.coalesce("ok", F.lit(False)), F.col("error")).alias("error"), "finished_at")
    rows = jobs.join(done, "job_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    folder = F
    for state, name in FOLDERS.items():
        folder = folder.when(F.col("status") == state, name)
    return rows.withColumn("folder", folder.otherwise(FOLDERS[QUEUED]))


def summaries(jobs: DataFrame) -> DataFrame:
    """What may be shown of jobs: nothing but the columns in SHOWN."""
    return jobs.select(*[c for c in SHOWN if c in jobs.columns])
