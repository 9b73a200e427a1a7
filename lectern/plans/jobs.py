"""The job table as an event log, and the queries of a service over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a job, in order (fixed values).
STATES = ("queued", "extracting", "mapping", "awaiting_review", "queued_check", "checking", "completed", "failed", "cancelled")
LEAST_TEXT = 100
UPLOADS = 30


def latest(events: DataFrame, key: str, order: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """The last row of each key: one partial aggregate of a struct, no sort of a hot key."""
    last = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_l")
    return events.groupBy(key).agg(last).select(key, *[F.col(f"_l.{v}").alias(v) for v in values])


def recovered(state: Column) -> tuple[Column, Column]:
    """(state, progress) after a restart: interrupted stages are queued again."""
    early, late = state.isin("extracting", "mapping"), state.isin("checking", "queued_check")
    return F.when(early, "queued").when(late, "queued_check").otherwise(state), F.when(early, 0).when(late, 32)


def next_job(jobs: DataFrame, by: str | None = None) -> DataFrame:
    """The job that a drain takes next, or that of each ``by``: newest batch first."""
    waiting = jobs.filter(F.col("status").isin("queued", "queued_check"))
    if by is None:
        return waiting.orderBy(F.desc("created_at"), "job_id").limit(1)
    order = Window.partitionBy(by).orderBy(F.desc("created_at"), "job_id")
    return waiting.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def without(jobs: DataFrame, deleted: DataFrame) -> DataFrame:
    return jobs.join(deleted.select("job_id"), "job_id", "left_anti")


def retry_target(confirmed: Column, cached: Column) -> Column:
    return F.when(confirmed & cached, "queued_check").otherwise("queued")


def may_confirm(maps: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, may_confirm): a map without sections or with invalid bounds may not be confirmed."""
    bad = issues.filter(F.col("code").isin("empty_structure", "invalid_boundaries")).select("doc_id").distinct().withColumn("_bad", F.lit(True))
    return maps.select("doc_id").distinct().join(bad, "doc_id", "left").select("doc_id", F.col("_bad").isNull().alias("may_confirm"))


def search(rows: DataFrame, text_cols: tuple[str, ...], query: str, **equal) -> DataFrame:
    """Rows whose columns equal the given values and that contain the query, case aside."""
    for c, v in equal.items():
        rows = rows.filter(F.col(c) == v)
    return rows.filter(F.lower(F.concat_ws(" ", *text_cols)).contains(query.lower()))


def facet(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def ordered_facet(rows: DataFrame, column: str, language: str = "ru") -> DataFrame:
    """(column, n, place): categories with their places (from 0) in the order of a language's alphabet: io behind e, capitals beside small letters, hyphens as they are written. Categories are a catalogue's, so one window orders them; what the alphabet doesn't tell apart goes bytewise."""
    counts = facet(rows, column)
    place = F.row_number().over(Window.orderBy(F.collate(F.col(column), language), F.col(column))) - 1
    return counts.withColumn("place", place)


def search_words(rows: DataFrame, text_cols: tuple[str, ...], query: str, language: str = "ru") -> DataFrame:
    """Rows that contain the query in any case, as the language folds it."""
    text = F.collate(F.concat_ws(" ", *text_cols), f"{language}_CI")
    return rows.filter(F.contains(text, F.collate(F.lit(query), f"{language}_CI")))


def status_facet(results: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """(status, place, n) in fixed order, with zeros."""
    dim = results.sparkSession.createDataFrame([(s, i) for i, s in enumerate(statuses)], "status string, place int")
    return F.broadcast(dim).join(results.groupBy("status").count(), "status", "left").select("status", "place", F.coalesce("count", F.lit(0)).alias("n"))


def preview(rows: DataFrame, by: tuple[str, ...], order: str, most: int = 5) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def accepted_uploads(files: DataFrame, most: int = UPLOADS, largest: int = 35 * 1024 * 1024) -> DataFrame:
    """(name, size) pairs once, of the right kind and size, the first ``most``. ``files`` has name, size and place."""
    rows = files.filter(F.lower("name").rlike(r"\.(pdf|docx)\z") & (F.col("size") <= largest)).groupBy("name", "size").agg(F.min("place").alias("place"))
    return rows.orderBy("place").limit(most)


def urgent(results: DataFrame) -> DataFrame:
    """Violations that a report opens by itself."""
    return results.filter((F.col("status") == "violation") & F.col("severity").isin("critical", "major"))


def active_jobs(jobs: DataFrame, by: str) -> DataFrame:
    """(by, n_active): jobs that neither ended nor wait for a person."""
    return jobs.groupBy(by).agg(F.count_if(~F.col("status").isin("completed", "failed", "cancelled", "awaiting_review")).alias("n_active"))


def ambiguous_sections(sections: DataFrame) -> DataFrame:
    """(doc_id, n_ambiguous) of every map."""
    return sections.groupBy("doc_id").agg(F.count_if(F.col("state") == "ambiguous").alias("n_ambiguous"))
