"""The operators as pipeline stages: the same decisions, with every column of the documents kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language_id, session
from .arrays import text_chunks
from .packing import pack_documents
from .quality import quality_verdicts
from .session import remove
from .shingle_join import one_of_each
from .suffix_dedup import without_repeats

#: A language told with less certainty is rejected.
LEAST_CERTAINTY = 0.3


def written(docs: DataFrame) -> DataFrame:
    """The rows, in files of the shared folder. ``forget`` deletes what is no longer read."""
    return session.written(docs, "pipeline")


def forget(docs: DataFrame) -> None:
    """Delete the files of a table that ``written`` made."""
    for path in {f.rsplit("/", 1)[0] for f in docs.inputFiles()}:
        if "/pipeline-" in path:
            remove(docs.sparkSession, path)


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that ``quality_verdicts`` keeps, in DataFrame functions alone and without a shuffle; a null or blank text goes.

    The partition's number is no deterministic column, so the filter stays above
    the verdicts; pushed below them it would repeat their expressions.
    """
    judged = quality_verdicts(docs, id_col, text_col, carry=True).withColumn("at", F.spark_partition_id())
    return judged.filter((F.col("at") >= 0) & F.col("kept")).select("row.*")


def _told(model: language_id.Model | None, text_col: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            keep = np.array([language_id.has_letter(t.as_py()) for t in texts], dtype=bool)
            if model is not None:
                zeros = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(texts), np.int64)), texts], ["id", "text"])
                for a, b, _, offs, data in text_chunks(zeros, "id", "text"):
                    keep[a:b] &= language_id.decide(model, language_id.scores(model, offs, data))[1] >= least
            yield batch.filter(pa.array(keep))

    return run


def keep_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST_CERTAINTY) -> DataFrame:
    """Rows whose language is told with at least ``least`` certainty; a null text or one without a letter goes. If nothing is labelled, all texts with a letter stay. The models learn from rows that aren't held out, as in ``languages``."""
    model = language_id.train(docs.filter(~language_id.held_out(F.col(id_col), 4, 2)), id_col, text_col, lang_col)
    return docs.mapInArrow(_told(model, text_col, least), docs.schema)


def keep_one_of_near(docs: DataFrame, words: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every group of near duplicates the row of the least id; repeated rows are near duplicates too, and rows of one id with different texts are judged apart. Rows without words stay. A null id is the least."""
    return one_of_each(docs, words, num, den, id_col, text_col)


def drop_repeats(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows, with texts without repeated ``size``-byte strings (and their number of characters, if there is such a column)."""
    return without_repeats(docs, size, id_col, text_col, chars_col)


def pack(docs: DataFrame, path: str, capacity: int = 1024) -> DataFrame:
    """Pieces of the documents in sequences of ``capacity`` tokens; see ``pack_documents`` for nulls, repeated rows and empty tables."""
    return pack_documents(docs, path, capacity)
