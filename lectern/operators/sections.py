"""Section maps: parsing and checking of a model's answer, ranges of blocks, trimming, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import loose as J
from lectern.functions.text import collapse, compact, norm_text, pattern
from lectern.operators.ranges import blocks_in_ranges

#: Section types in order (fixed values).
TYPES = ("title", "abstract", "introduction", "goal", "tasks", "defense_statements", "chapter", "chapter_conclusions", "conclusion", "bibliography", "appendices", "other")
EXPECTED = [("introduction", "missing_introduction", "warning"), ("chapter", "missing_chapters", "warning"), ("conclusion", "missing_conclusion", "warning"), ("goal", "missing_goal", "info"), ("tasks", "missing_tasks", "info"), ("defense_statements", "missing_defense_statements", "info")]


def json_body(raw: Column) -> Column:
    """The JSON of a model's answer: without a code fence, from the first bracket to the last one."""
    t = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?i)^\s*```(?:json)?\s*", ""), r"\s*```\s*\z", ""))
    body = F.regexp_extract(t, r"(?s)([\[{].*[\]}])", 1)
    return F.when(F.try_parse_json(t).isNotNull(), t).when(body != "", body)


def structure_message(b: DataFrame) -> DataFrame:
    """(doc_id, message, est_tokens): all blocks of a document in order, as a model reads them; a token is three characters."""
    line = F.concat_ws("\n", F.concat_ws(" | ", F.concat(F.lit("BLOCK "), "block_id"), "location", F.coalesce(F.col("page").cast("string"), F.lit("-")), "type"), "text")
    rows = F.array_sort(F.collect_list(F.struct("block_pos", line.alias("line"))))
    out = b.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n\n").alias("message"))
    return out.withColumn("est_tokens", token_estimate(F.col("message")))


def token_estimate(text: Column, chars: int = 3) -> Column:
    return F.ceil(F.length(text) / chars)


def size_guard(messages: DataFrame, context_tokens: int, most_chars: int = 2_500_000, share: float = 0.85) -> DataFrame:
    """Add fits: whether a message is within the limits of characters and of a share of the model's context."""
    return messages.withColumn("fits", (F.length("message") <= most_chars) & (F.col("est_tokens") <= share * context_tokens))


def prompt_hash(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 16)


def parse_answer(answers: DataFrame) -> DataFrame:
    """(doc_id, raw_idx, section fields..) of every section in ``answers(doc_id, raw)``. A field of the wrong type is null, a section that is no object has null fields; its place counts all the same."""
    rows = answers.select("doc_id", F.posexplode(J.items(J.parsed(json_body(F.col("raw"))), "$.sections")).alias("raw_idx", "s"))
    fields = [J.text(F.col("s"), f"$.{name}").alias(name) for name in ("type", "label", "startBlockId", "endBlockId")]
    return rows.select(
        "doc_id", "raw_idx", *fields, J.texts(F.col("s"), "$.anchorBlockIds").alias("anchorBlockIds"), J.text(F.col("s"), "$.quote").alias("quote"), J.value(F.col("s"), "$.confidence", "double").alias("confidence"),
        J.text(F.col("s"), "$.state").alias("state"), J.text(F.col("s"), "$.note").alias("note"),
    )


def place_sections(raw: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, warnings). A section needs a known type and bounds that exist, in order; the others are warnings. Sections are numbered by start."""
    ids = b.select("doc_id", F.col("block_id").alias("_id"), F.col("block_pos").alias("_pos"))
    rows = raw.join(ids.withColumnsRenamed({"_id": "startBlockId", "_pos": "start_pos"}), ["doc_id", "startBlockId"], "left").join(ids.withColumnsRenamed({"_id": "endBlockId", "_pos": "end_pos"}), ["doc_id", "endBlockId"], "left")
    known = F.col("type").isin(*TYPES)
    bounded = F.coalesce(F.col("start_pos") <= F.col("end_pos"), F.lit(False))
    good = rows.filter(known & bounded)
    order = Window.partitionBy("doc_id").orderBy("start_pos", "raw_idx")
    good = good.select(
        "doc_id", F.concat(F.lit("section-"), F.row_number().over(order)).alias("section_id"), "raw_idx", "type", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("type")).alias("label"), "start_pos", "end_pos", "startBlockId", "endBlockId", "anchorBlockIds", "quote",
        clamp(F.col("confidence")).alias("confidence"), F.when(F.col("state") == "ambiguous", "ambiguous").otherwise("confirmed").alias("state"), F.lit("llm").alias("source"), "note",
    )
    bad = rows.filter(~known | ~bounded | F.col("type").isNull()).select("doc_id", "raw_idx", F.when(known, "invalid_bounds").otherwise("unknown_type").alias("warning"))
    return good, bad


def model_issues(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, code, severity, message, section_ids): a model's own remarks; its indexes are those of the sections as they came. Each (code, message) once."""
    parsed = answers.select("doc_id", F.posexplode(J.items(J.parsed(json_body(F.col("raw"))), "$.issues")).alias("_i", "x"))
    x = F.col("x")
    indexes = F.array_compact(F.transform(J.items(x, "$.sectionIndexes"), lambda n: J.value(n, "$", "int")))
    rows = parsed.select("doc_id", "_i", F.coalesce(F.nullif(F.trim(J.text(x, "$.code")), F.lit("")), F.lit("model_issue")).alias("code"), F.when(J.text(x, "$.severity") == "info", "info").otherwise("warning").alias("severity"), F.trim(J.text(x, "$.message")).alias("message"), F.explode_outer(indexes).alias("raw_idx"))
    rows = rows.filter("message <> ''").join(sections.select("doc_id", "raw_idx", "section_id"), ["doc_id", "raw_idx"], "left")
    return rows.groupBy("doc_id", "code", "message").agg(F.min_by("severity", "_i").alias("severity"), F.array_sort(F.collect_set("section_id")).alias("section_ids"))


def hydrated(fields: DataFrame, sections: DataFrame, b: DataFrame) -> DataFrame:
    """Fields (doc_id, field, block_pos, text) after a confirmed map: what the map places goes before what phrases told; conclusions are both."""
    cut = trimmed(section_blocks(sections.filter(F.col("type").isin("tasks", "defense_statements", "bibliography")), b))
    told = cut.select("doc_id", F.col("type").alias("field"), "block_pos", "text")
    starts = sections.join(b.select("doc_id", F.col("block_pos").alias("start_pos"), F.col("text").alias("_t")), ["doc_id", "start_pos"])
    kind = F.when(F.col("type") == "chapter", "chapter_headings").when(F.col("type").isin("chapter_conclusions", "conclusion"), "conclusion_headings").when(F.col("type") == "goal", "goal")
    heads = starts.withColumn("field", kind).filter("field is not null").select("doc_id", "field", F.col("start_pos").alias("block_pos"), F.when(F.col("type") == "goal", F.coalesce(F.nullif(F.trim("quote"), F.lit("")), F.col("_t"))).otherwise(F.col("_t")).alias("text"))
    mapped = told.unionByName(heads)
    own = fields.join(mapped.filter("field <> 'conclusion_headings'").select("doc_id", "field").distinct(), ["doc_id", "field"], "left_anti")
    return mapped.unionByName(own.select("doc_id", "field", "block_pos", "text")).dropDuplicates(["doc_id", "field", "block_pos"])


def reusable(maps: DataFrame, version: int, provider: str, model: str, prompt: str) -> DataFrame:
    """Maps that were made by the same version, provider, model and prompt."""
    return maps.filter((F.col("version") == version) & (F.col("provider") == provider) & (F.col("model") == model) & (F.col("prompt_hash") == prompt_hash(F.lit(prompt))))


def clamp(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def materialize(sections: DataFrame, b: DataFrame) -> DataFrame:
    """Add text (900 characters), pages, anchors (up to five inside the range, else its first block) and the quote, verified in one block of the range."""
    own = b.select("doc_id", "block_pos", "block_id", F.col("page").alias("_page"), F.col("text").alias("_text"))
    rows = blocks_in_ranges(own, sections)
    keys = [c for c in sections.columns if c not in ("quote", "anchorBlockIds")]
    found = F.when((F.length(F.trim("quote")) >= 4) & F.contains(norm_text(F.col("_text")), norm_text(F.col("quote"))), F.struct("block_pos", F.trim("quote").alias("q")))
    listed = F.array_sort(F.collect_list(F.struct("block_pos", "block_id", "_page", "_text")))
    out = rows.groupBy(*keys).agg(listed.alias("_b"), F.min(found).alias("_q"), F.first("anchorBlockIds").alias("_a"))
    ids = F.transform("_b", lambda x: x["block_id"])
    anchors = F.slice(F.filter(F.coalesce("_a", F.array().cast("array<string>")), lambda a: F.array_contains(ids, a)), 1, 5)
    return out.select(
        *keys, compact(F.array_join(F.transform("_b", lambda x: x["_text"]), "\n"), 900).alias("text"), F.array_sort(F.array_distinct(F.filter(F.transform("_b", lambda x: x["_page"]), lambda p: p.isNotNull()))).alias("pages"),
        F.when(F.size(anchors) > 0, anchors).otherwise(F.slice(ids, 1, 1)).alias("block_ids"), F.substring("_q.q", 1, 500).alias("quote"),
    )


def map_issues(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, code, severity, section_id): expected types that are missing (an anti join), an empty map, sections whose blocks are gone (no start_pos or end_pos), ambiguous sections."""
    spark = docs.sparkSession
    expected = spark.createDataFrame(EXPECTED, "type string, code string, severity string")
    grid = docs.select("doc_id").crossJoin(F.broadcast(expected))  # six rows
    missing = grid.join(sections.select("doc_id", "type").distinct(), ["doc_id", "type"], "left_anti").select("doc_id", "code", "severity", F.lit(None).cast("string").alias("section_id"))
    empty = docs.select("doc_id").join(sections.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("empty_structure").alias("code"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("section_id"))
    unsure = sections.filter("state = 'ambiguous'").select("doc_id", F.lit("ambiguous_section").alias("code"), F.lit("info").alias("severity"), "section_id")
    bounds = sections.filter("start_pos is null or end_pos is null").select("doc_id", F.lit("invalid_boundaries").alias("code"), F.lit("warning").alias("severity"), "section_id")
    return empty.unionByName(missing).unionByName(bounds).unionByName(unsure).dropDuplicates(["doc_id", "code", "section_id"])


def map_status(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, status): partial with any warning, else ready."""
    bad = issues.groupBy("doc_id").agg(F.bool_or(F.col("severity") == "warning").alias("bad"))
    return docs.select("doc_id").join(bad, "doc_id", "left").select("doc_id", F.when(F.col("bad"), "partial").otherwise("ready").alias("status"))


GOAL_SENTENCE = r"(?iu)Цель(?:ю)?\s+(?:диссертационной\s+)?работы(?:\s+является|\s*[:.–-])?\s*[^.]{15,700}\."


def goal_sentence(text: Column) -> Column:
    """The sentence that states the goal, with its opening words; empty without one."""
    return F.trim(F.regexp_extract(collapse(text), pattern(GOAL_SENTENCE), 0))


def refreshed(docs: DataFrame, sections: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, issues, statuses) of maps after an edit: texts, pages, anchors and quotes are made again from the blocks, and so are issues and status."""
    made = materialize(sections, b)
    issues = map_issues(docs, made)
    return made, issues, map_status(docs, issues)


def checked_edits(edits: DataFrame, b: DataFrame) -> DataFrame:
    """edits (doc_id, section_id, edit_order, start_block_id, end_block_id, quote, ..) with start_pos, end_pos and error: missing_block, order, short_quote (below four characters), quote_outside (not in one block of the range), or null. A null or blank quote isn't checked. Two equi joins for the bounds, and one with a range for the quotes alone."""
    ids = b.select("doc_id", "block_id", F.col("block_pos").alias("_pos"))
    rows = edits
    for side in ("start", "end"):
        rows = rows.join(ids.withColumnsRenamed({"block_id": f"{side}_block_id", "_pos": f"{side}_pos"}), ["doc_id", f"{side}_block_id"], "left")
    rows = rows.withColumn("_quote", norm_text(F.coalesce("quote", F.lit(""))))
    asked = rows.filter("start_pos <= end_pos and length(_quote) >= 4").select("doc_id", "section_id", "edit_order", "start_pos", "end_pos", "_quote")
    held = asked.join(b.select("doc_id", "block_pos", "text"), "doc_id").filter("block_pos between start_pos and end_pos").filter(F.contains(norm_text(F.col("text")), F.col("_quote")))
    rows = rows.join(held.select("doc_id", "section_id", "edit_order", F.lit(True).alias("_held")).distinct(), ["doc_id", "section_id", "edit_order"], "left")
    said = F.trim(F.coalesce("quote", F.lit(""))) != ""
    error = (
        F.when(F.col("start_pos").isNull() | F.col("end_pos").isNull(), "missing_block")
        .when(F.col("start_pos") > F.col("end_pos"), "order")
        .when(said & (F.length("_quote") < 4), "short_quote")
        .when(said & F.col("_held").isNull(), "quote_outside")
    )
    return rows.withColumn("error", error).drop("_quote", "_held")


def edited(sections: DataFrame, edits: DataFrame) -> DataFrame:
    """Sections after edits(doc_id, section_id, op, start_pos, end_pos, label, quote, edit_order): the last edit of each section counts; edited ones are a person's and confirmed."""
    w = Window.partitionBy("doc_id", "section_id").orderBy(F.desc("edit_order"))
    last = edits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").select("doc_id", "section_id", *[F.col(c).alias(f"_{c}") for c in ("op", "type", "start_pos", "end_pos", "label", "quote")])
    rows = sections.join(last, ["doc_id", "section_id"], "full_outer").filter("_op is null or _op <> 'delete'")
    new = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("type", "start_pos", "end_pos")}
    new |= {"label": F.substring(F.coalesce("_label", "label"), 1, 180), "quote": F.substring(F.coalesce("_quote", "quote"), 1, 1200)}
    new |= {"state": F.when(F.col("_op").isNotNull(), "confirmed").otherwise(F.col("state")), "source": F.when(F.col("_op").isNotNull(), "user").otherwise(F.col("source"))}
    return rows.withColumns(new).select(*sections.columns)


# Trimming

#: Where the content of a section starts and ends (fixed values): type, start, end.
MARKERS = [
    ("tasks", r"(?iu)(?:^|\n|[.!?]\s+)Задачи\s+(?:диссертационной\s+)?работы\s*\.?", r"(?iu)(?:^|\n|[.!?]\s+)(?:Объект\s+и\s+предмет\s+исследования|Научная\s+новизна|Теоретическая\s+и\s+практическая\s+значимость|Положения,?\s+выносимые\s+на\s+защиту)\s*\.?"),
    ("defense_statements", r"(?iu)(?:^|\n|[.!?]\s+)Положения,?\s+выносимые\s+на\s+защиту\s*\.?", r"(?iu)(?:^|\n|[.!?]\s+)(?:Достоверность\s+научных\s+результатов|Апробация\s+работы|Личный\s+вклад\s+автора|Публикации|Структура\s+и\s+объ[её]м)\s*\.?"),
    ("goal", r"(?iu)(?:^|\n|[.!?]\s+)Цель\s+(?:диссертационной\s+)?работы\s*\.?", r"(?iu)(?:^|\n|[.!?]\s+)Задачи\s+(?:диссертационной\s+)?работы\s*\.?"),
    ("bibliography", r"(?iu)(?:^|\n)Список\s+(?:использованных\s+)?(?:источников|литературы)\s*\.?", r"(?iu)(?:^|\n)Приложение\b"),
]


def trimmed(blocks: DataFrame, markers: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Blocks of sections (doc_id, section_id, type, block_pos, text), cut to what stands from the first start mark to the first end mark behind it. Without a start mark, or of another type, they stay; blank blocks go."""
    markers = MARKERS if markers is None else markers
    start = end = F.lit(None).cast("int")
    for kind, a, z in markers:
        on = F.col("type") == kind
        start = F.when(on, F.nullif(F.regexp_instr("text", F.lit(pattern(a))), F.lit(0))).otherwise(start)
        end = F.when(on, F.nullif(F.regexp_instr("text", F.lit(pattern(z))), F.lit(0))).otherwise(end)
    w = Window.partitionBy("doc_id", "section_id")
    rows = blocks.withColumns({"_s": start, "_e": end}).withColumn("_start", F.min(F.when(F.col("_s").isNotNull(), F.struct("block_pos", F.col("_s").alias("at")))).over(w))
    behind = F.col("_e").isNotNull() & F.col("_start").isNotNull() & ((F.col("block_pos") > F.col("_start.block_pos")) | ((F.col("block_pos") == F.col("_start.block_pos")) & (F.col("_e") > F.col("_start.at"))))
    rows = rows.withColumn("_end", F.min(F.when(behind, F.struct("block_pos", F.col("_e").alias("at")))).over(w))
    rows = rows.filter("_start is null or (block_pos >= _start.block_pos and (_end is null or block_pos <= _end.block_pos))")
    a = F.when(F.col("block_pos") == F.col("_start.block_pos"), F.col("_start.at")).otherwise(1)
    z = F.when(F.col("block_pos") == F.col("_end.block_pos"), F.col("_end.at")).otherwise(F.length("text") + 1)
    return rows.withColumn("text", F.trim(F.substring(F.col("text"), a, z - a))).filter("text <> ''").drop("_s", "_e", "_start", "_end")


def section_blocks(sections: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, section_id, type, label, state, block_pos, block_id, text) of the blocks in each section's range."""
    rows = blocks_in_ranges(b.select("doc_id", "block_pos", "block_id", "text"), sections.select("doc_id", "section_id", "type", "label", "state", "start_pos", "end_pos"))
    return rows.select("doc_id", "section_id", "type", "label", "state", "block_pos", "block_id", "text")


def types_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(TYPES)], "type string, place int")
