"""From texts to ordered, typed blocks, and what is found among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse, pattern

#: Patterns of block types, headings and fields (fixed values).
CAPTION = r"(?iu)^(?:рис(?:унок)?|таблица|график)\s*\d*[.\-–—:]?"
NUMBERED_HEADING = r"(?iu)^(?:глава\s+\d+|\d+(?:\.\d+){1,3}\.?)\s+\p{L}"
NAMED_HEADING = r"(?iu)^(?:введение|заключение|выводы(?:\s+по\s+главе)?|список\s+(?:использованных\s+)?(?:источников|литературы)|оглавление|содержание|приложени[ея])"
LIST_ITEM = r"^(?:\d+[.)]|[-–—•])\s+"
ENTRY = r"^(?:\[?\d+\]?\.?\s+)[А-ЯA-ZЁ][^\n]{20,}\z"
ENTRY_SIGN = r"(?iu)(?:doi|isbn|https?:|pp?\.|№|vol\.)"
FORMULA = r"[=≈≤≥∑∫√]|\\(?:frac|sum|begin)"
SENTENCE_END = r"(?<=[.!?])\s+(?=[А-ЯA-ZЁ0-9])"
GOAL = r"(?iu)(?<![\p{L}\p{N}_])цель(?:ю)?\s+(?:работы|исследования)?\s*(?:является|состоит|заключается|–|-|:)"
TASKS = r"(?iu)задач(?:и|ами|ей)?\s+(?:работы|исследования)|для достижения.*цели"
DEFENSE = r"(?iu)положени[яй],?\s+выносимые\s+на\s+защиту"
LONG, PACKED = 2400, 1800


def all_caps(text: Column) -> Column:
    """Upper case throughout, with a letter, and at most 12 words."""
    return (text == F.upper(text)) & text.rlike(r"\p{L}") & (F.size(F.split(text, pattern(r"\s+"))) <= 12)


def is_named_heading(text: Column) -> Column:
    return (F.length(text) <= 190) & (text.rlike(pattern(NAMED_HEADING)) | all_caps(text))


def classify(text: Column, entries: bool = True, formula: str = FORMULA) -> Column:
    """The first type that fits: caption, heading, list, bibliography (if ``entries`` are looked for), formula, paragraph. The collapsed text is bound once, by a lambda."""

    def kind(t: Column) -> Column:
        entry = t.rlike(pattern(ENTRY)) & t.rlike(ENTRY_SIGN) if entries else F.lit(False)
        return (
            F.when(t.rlike(pattern(CAPTION)), "caption")
            .when(t.rlike(pattern(NUMBERED_HEADING)) | is_named_heading(t), "heading")
            .when(t.rlike(pattern(LIST_ITEM)), "list")
            .when(entry, "bibliography")
            .when((F.length(t) < 700) & t.rlike(formula), "formula")
            .otherwise("paragraph")
        )

    return F.get(F.transform(F.array(collapse(text)), kind), F.lit(0))


def packed_sentences(text: Column, long: int = LONG, most: int = PACKED) -> Column:
    """Texts above ``long`` characters as sentences packed in order, greedily, to pieces of at most ``most`` characters; others as they are."""
    sentences = F.split(text, pattern(SENTENCE_END))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        longer = (s["open"] != "") & (F.length(s["open"]) + 1 + F.length(x) > most)
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x))
        return F.struct(F.when(longer, F.array_append(s["done"], s["open"])).otherwise(s["done"]).alias("done"), F.when(longer, x).otherwise(joined).alias("open"))

    packed = F.aggregate(sentences, start, step, lambda s: F.when(s["open"] != "", F.array_append(s["done"], s["open"])).otherwise(s["done"]))
    return F.when(F.length(text) <= long, F.array(text)).otherwise(packed)


def blocks(docs: DataFrame, separator: str = r"\n\s*\n", keep: tuple[str, ...] = ("doc_id",), page_col: str | None = None, text_col: str = "text", long: int = LONG, entries: bool = True, formula: str = FORMULA) -> DataFrame:
    """(keep.., page, block_pos, block_id, location, type, text): the paragraphs of each text, or of each page, in order.

    block_pos counts within a document from 0, over its pages; block ids start
    again on every page, after short blocks are dropped. Narrow but for the
    positions, which need a document's pages together only if there are pages.
    Paragraphs above ``long`` characters are packed anew. ``entries`` and ``formula`` go to ``classify``.
    """
    page = F.col(page_col).cast("int") if page_col else F.lit(None).cast("int")
    pieces = F.flatten(F.transform(F.split(F.col(text_col), separator), lambda p: packed_sentences(F.trim(p), long)))
    clean = F.filter(F.transform(pieces, lambda x: F.trim(F.regexp_replace(x, r"\t[ \t]*| [ \t]+", " "))), lambda x: F.length(x) >= 2)
    rows = docs.select(*keep, page.alias("page"), F.posexplode(clean).alias("_n", "text"))
    rows = rows.withColumn("block_id", F.concat(F.when(F.col("page").isNull(), "doc").otherwise(F.concat(F.lit("p"), "page")), F.lit("-b"), F.col("_n") + 1))
    rows = rows.withColumn("location", F.when(F.col("page").isNull(), "Документ").otherwise(F.concat(F.lit("Страница "), "page")))
    pos = F.col("_n") if page_col is None else F.row_number().over(Window.partitionBy(*keep).orderBy("page", "_n")) - 1
    return rows.withColumn("block_pos", pos).select(*keep, "page", "block_pos", "block_id", "location", classify(F.col("text"), entries, formula).alias("type"), "text")


def page_index(b: DataFrame, by: str = "doc_id") -> Column:
    """The place of a block on its page, from 0."""
    return F.row_number().over(Window.partitionBy(by, "page").orderBy("block_pos")) - 1


def chapter_headings(b: DataFrame, by: str = "doc_id") -> DataFrame:
    """Blocks that open a chapter: named so, or numbered among the first three of their page."""
    t = F.col("text")
    rows = b.withColumn("_i", page_index(b, by))
    numbered = t.rlike(pattern(r"^\d+\.\s+\p{L}")) & F.col("page").isNotNull() & (F.col("_i") <= 2) & (F.length(t) <= 150)
    return rows.filter(t.rlike(pattern(r"(?iu)^глава\s+\d+")) | numbered).drop("_i")


def conclusion_headings(b: DataFrame) -> DataFrame:
    return b.filter((F.col("type") == "heading") & F.col("text").rlike(r"(?iu)^(?:выводы|заключение|итоги)"))


def first_block(b: DataFrame, condition: Column, by: str = "doc_id") -> DataFrame:
    """(by, block_pos) of each document's first block that fits."""
    return b.filter(condition).groupBy(by).agg(F.min("block_pos").alias("block_pos"))


def bibliography_blocks(b: DataFrame, by: str = "doc_id") -> DataFrame:
    """Entries behind the heading of the list of sources; without one, all blocks of that type."""
    heading = (F.col("type") == "heading") & F.col("text").rlike(r"(?iu)список.*(?:литератур|источник)")
    w = Window.partitionBy(by)
    rows = b.withColumn("_from", F.min(F.when(heading, F.col("block_pos"))).over(w))
    entry = (F.col("type") == "bibliography") | (F.col("_from").isNotNull() & F.col("text").rlike(pattern(r"^\s*\d+[.)]\s+")))
    return rows.filter(entry & (F.col("_from").isNull() | (F.col("block_pos") > F.col("_from")))).drop("_from")


def following(b: DataFrame, anchor: Column, limit: int, keep: Column, stop: Column, inclusive: bool, by: str = "doc_id") -> DataFrame:
    """Blocks in the window of ``limit`` behind each document's first ``anchor``, up to the first ``stop``, that fit ``keep``."""
    w = Window.partitionBy(by)
    rows = b.withColumn("_a", F.min(F.when(anchor, F.col("block_pos"))).over(w))
    first = F.col("_a") + (0 if inclusive else 1)
    rows = rows.filter((F.col("block_pos") >= first) & (F.col("block_pos") < first + limit))
    rows = rows.withColumn("_s", F.min(F.when(stop & (F.col("block_pos") > F.col("_a")), F.col("block_pos"))).over(w))
    return rows.filter((F.col("_s").isNull() | (F.col("block_pos") < F.col("_s"))) & keep).drop("_a", "_s")


def tasks(b: DataFrame, by: str = "doc_id") -> DataFrame:
    t = F.col("text")
    return following(b, t.rlike(pattern(TASKS)), 12, (F.col("type") == "list") | t.rlike(r"(?iu)(?<![\p{L}\p{N}_])задач"), F.col("type") == "heading", True, by)


def defense_statements(b: DataFrame, by: str = "doc_id") -> DataFrame:
    t = F.col("text")
    wanted = (F.col("type") == "list") | t.rlike(r"(?iu)(?:метод|алгоритм|модель|технолог|комплекс|система)")
    return following(b, t.rlike(pattern(DEFENSE)), 18, wanted, (F.col("type") == "heading") & ~t.rlike("(?iu)положени"), False, by)


def title_candidates(b: DataFrame, by: str = "doc_id", most: int = 30) -> DataFrame:
    rows = b.filter("page is null or page = 1")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("block_pos"))).filter(F.col("_n") <= most).drop("_n")


def fields(b: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, field, block_pos, text) of what is told by headings and phrases: goal, tasks, defense_statements, chapter_headings, conclusion_headings, bibliography."""
    goal = b.join(first_block(b, F.col("text").rlike(pattern(GOAL)), by), [by, "block_pos"], "left_semi")
    parts = {"goal": goal, "tasks": tasks(b, by), "defense_statements": defense_statements(b, by), "chapter_headings": chapter_headings(b, by), "conclusion_headings": conclusion_headings(b), "bibliography": bibliography_blocks(b, by)}
    out = None
    for name, rows in parts.items():
        rows = rows.select(by, F.lit(name).alias("field"), "block_pos", "text")
        out = rows if out is None else out.unionByName(rows)
    return out
