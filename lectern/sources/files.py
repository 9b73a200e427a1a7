"""Sources and sinks: documents, rules, answers, jobs, reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse
from lectern.sources.delimited import by_header, read_delimited
from lectern.sources.named_files import write_named

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PAGES = "path string, source_format string, page int, text string, warning string"


def docx_text(raw: bytes) -> str:
    """The paragraphs of a word-processor file, blank lines between them."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        parts = [{f"{_W}t": x.text or "", f"{_W}tab": "\t", f"{_W}br": "\n"}.get(x.tag, "") for x in p.iter()]
        out.append("".join(parts))
    return "\n\n".join(out)


def pdf_pages(raw: bytes) -> list[str]:
    """The text of each page, by a reader that may not be installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading pdf files needs the package that provides fitz") from e
    with fitz.open(stream=raw, filetype="pdf") as doc:
        if doc.needs_pass:
            raise RuntimeError("the file is encrypted")
        return [page_text(p.get_text("text", sort=True)) for p in doc]


def page_text(text: str) -> str:
    return re.sub("[​⁠]", "", text.replace("\r", "").replace(" ", " ")).strip()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            kind = path.rsplit(".", 1)[-1].lower()
            try:
                pages = [(None, docx_text(content))] if kind == "docx" else list(enumerate(pdf_pages(content), 1))
                rows += [(path, kind, n, t, None if t else "empty page") for n, t in pages]
            except Exception as e:  # one bad file is a row with a warning, not a failed job
                rows.append((path, kind, None, None, f"{type(e).__name__}: {e}"))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["path", "source_format", "page", "text", "warning"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source_format, page, text, warning) of the docx and pdf files under a folder: a row for each page, or one without a page. Other files aren't read; a file that can't be is a warning."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.lower("path").rlike(r"\.(docx|pdf)$"))
    return files.select("path", "content").mapInArrow(_extract, PAGES)


def empty_pages(pages: DataFrame) -> DataFrame:
    """(path, pages): numbers of pages without text, which want character recognition."""
    return pages.filter("page is not null and coalesce(text, '') = ''").groupBy("path").agg(F.array_sort(F.collect_list("page")).alias("pages"))


def joined_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): pages as one text with marks between them."""
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy(key).agg(F.array_join(F.transform(rows, lambda p: F.concat(F.lit("<<<PAGE "), p["page"].cast("string"), F.lit(">>>\n"), p["text"])), "\n\n").alias("text"))


#: Bytes on disk up to which a table is dealt out anew.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of up to SMALL bytes on disk, by the file sizes that the plan knows, over all slots of the cluster; larger ones as they are, as scans cut their files. What this shuffles is bounded, whatever the cluster."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def dealt(rows: DataFrame, by: str, each: int) -> DataFrame:
    """The rows by a key, about ``each`` of them in a partition: for small rows of which much is made that stays where they are, so that what a task holds doesn't grow with the table."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(width, -(-rows.count() // each)), by)


def blank_to_null(c):
    t = F.trim(c)
    return F.when((t == "") | (t == "–"), None).otherwise(t)


def _table(spark: SparkSession, path: str, sep: str, names: tuple[str, ...]) -> DataFrame:
    """The rows below a file's first one, their first fields under the given names."""
    rows = by_header(read_delimited(spark, path, sep))
    columns = [f"`{c}`" for c in rows.columns]
    return rows.toDF(*map(str, range(len(columns)))).select(*[F.trim(F.col(f"`{k}`") if k < len(columns) else F.lit(None).cast("string")).alias(name) for k, name in enumerate(names)])


def read_routing(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, strategy, selectors, exhaustive, allow_pass, reason) of a routing map: a JSON object whose ``rules`` are by rule id. A value of the wrong type is null, and spoils nothing else."""
    text = spark.read.option("wholetext", "true").text(path).select(F.try_parse_json("value").alias("v"))
    rules = text.select(F.explode(F.try_variant_get("v", "$.rules", "map<string,variant>")).alias("rule_id", "r"))
    field = lambda name, kind: F.try_variant_get("r", f"$.{name}", kind)
    return rules.select("rule_id", field("strategy", "string").alias("strategy"), field("selectors", "array<string>").alias("selectors"), field("exhaustive", "boolean").alias("exhaustive"), field("allowPass", "boolean").alias("allow_pass"), field("reason", "string").alias("reason"))


def read_core_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, key, layer, source_number, category, requirement, correct, incorrect) from a comma-separated file of five columns below a header; rows without a number go."""
    rows = _table(spark, path, ",", ("category", "number", "requirement", "correct", "incorrect"))
    n = F.trim("number")
    category = F.trim(F.regexp_replace("category", r"^Группа\s+\d+\.\s*", ""))
    return rows.filter(n != "").select(
        F.concat(F.lit("CORE-"), F.regexp_replace(n, r"[^\p{L}\p{N}]+", "-")).alias("rule_id"), F.concat(F.lit("core:"), n).alias("key"), F.lit("core").alias("layer"), n.alias("source_number"),
        category.alias("category"), collapse(F.col("requirement")).alias("requirement"), blank_to_null("correct").alias("correct"), blank_to_null("incorrect").alias("incorrect"),
    )


def read_soft_rules(spark: SparkSession, path: str) -> DataFrame:
    """The same from a semicolon-separated file of number, category, requirement and incorrect example."""
    rows = _table(spark, path, ";", ("number", "category", "requirement", "incorrect"))
    n = F.trim("number")
    return rows.filter(n != "").select(
        F.concat(F.lit("SOFT-"), F.lpad(n, 3, "0")).alias("rule_id"), F.concat(F.lit("soft:"), n).alias("key"), F.lit("soft").alias("layer"), n.alias("source_number"),
        F.trim("category").alias("category"), collapse(F.col("requirement")).alias("requirement"), F.lit(None).cast("string").alias("correct"), blank_to_null("incorrect").alias("incorrect"),
    )


def user_rules(texts: DataFrame, text_col: str = "text", least: int = 8, most: int = 30, by: str = "doc_id") -> DataFrame:
    """(by, rule_id, requirement): lines of at least ``least`` characters, the first ``most`` of them."""
    lines = texts.select(by, F.posexplode(F.split(text_col, r"\r?\n")).alias("_i", "requirement")).withColumn("requirement", F.trim("requirement")).filter(F.length("requirement") >= least)
    n = F.row_number().over(Window.partitionBy(by).orderBy("_i"))
    return lines.withColumn("_n", n).filter(F.col("_n") <= most).select(by, F.concat(F.lit("USR-"), F.lpad(F.col("_n").cast("string"), 2, "0")).alias("rule_id"), "requirement")


def make_title(requirement):
    """A rule's title: its first sentence, 92 characters at most."""
    t = F.regexp_extract(collapse(requirement), r"^(.*?[.!?])(?:\s|\z)", 1)
    t = F.when(t == "", collapse(requirement)).otherwise(t)
    return F.when(F.length(t) > 92, F.concat(F.substring(t, 1, 89), F.lit("…"))).otherwise(t)


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path).select(F.trim("value").alias("prompt"))


def read_jobs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Jobs from JSON lines or an array, and ``malformed``: the text of what doesn't parse, in a row of its own, null in all others."""
    return spark.read.schema(f"{schema}, malformed string").option("multiLine", "true").option("columnNameOfCorruptRecord", "malformed").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table of Parquet files as a whole."""
    df.write.mode("overwrite").parquet(path)


def write_reports(texts: DataFrame, path: str, key: str = "doc_id", column: str = "text", ending: str = "md") -> None:
    """One file for each report, named by its document: ``<key>.md``. Each is there exactly once, also after tasks were lost."""
    names = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("none")), F.lit(f".{ending}"))
    write_named(texts.select(names.alias("name"), F.col(column).alias("content")), path)


def append_events(events: DataFrame, path: str) -> None:
    """Job events are only ever appended; the latest state is a query over them."""
    events.write.mode("append").parquet(path)
