"""Which blocks a check reads: narrative text, headings, title, goal, bibliography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse, pattern
from lectern.operators.ranges import in_any_range

#: Patterns of what isn't narrative (fixed values).
PROMPT = r"(?ium)(?:Requirements:|Rules:|Generate ONLY|Return ONLY|No commentary|```|^\s*(?:def|class|import|from\s+\w+\s+import|SELECT\s+.+\s+FROM|INSERT\s+INTO|UPDATE\s+\w+\s+SET)\b)"
PROMPT_WIDE = r"(?ium)(?:Requirements:|Rules:|Generate ONLY|Return ONLY|No commentary|\{[a-z_][^}]*\}|```|^\s*(?:def|class|import|from|SELECT|INSERT|UPDATE)\b)"
#: Text in upper case that matches PROMPT, or of which a quote does, holds one of these (the last one may stand for an I).
PROMPT_SIGNS = ("REQUIREMENTS:", "RULES:", "GENERATE", "RETURN", "COMMENTARY", "```", "DEF", "CLASS", "IMPORT", "SELECT", "INSERT", "UPDATE", "İ")
CONTENTS = r"(?iu)оглавление|содержание"
CONTENTS_START = r"(?iu)(?:^|\n)\s*(?:\d+\s*)?(?:оглавление|содержание)"
CONTENTS_END = r"(?iu)(?:^|\n)\s*(?:\d+\s*)?(?:реферат|synopsis|введение)"
LEADERS = r"(?:\.{3,}|(?:\.\s*){5,})"
PUBLICATION = r"(?iu)(?:\bDOI\s*:|//|\bet\s+al\.|Подано\s+на\s+(?:конференцию|рецензирование)|Submitted\s+to|\b(?:AAAI|ACM|EMNLP|GECCO|ICML|NeurIPS)\b[^.!?\n]{0,80}(?:Conference|Workshop|Companion|20\d{2}))"
TABLE_A = r"(?iu)(?:Модель\s+Обслуживание|Precision\s+Recall)"
TABLE_B = r"(?iu)(?:Датасет|Конфигурация|Кодировщик|Шум\s+Поиск|Судья\s+Необходим)"
CAPTION_WITH_MARK = r"(?iu)^(?:рис(?:унок)?|таблица|график)\s*\d+(?:\.\d+)?\s*(?:[.–—-]{1,2}|:)"
CYRILLIC_SHARE = 0.28


def count(text: Column, regex: str) -> Column:
    """Characters that the class ``regex`` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, regex, ""))


def is_prompt(text: Column) -> Column:
    return text.rlike(pattern(PROMPT))


def may_be_prompt(text: Column) -> Column:
    """Whether ``is_prompt`` may hold for the text or a quote from it: false for nearly all, at a small part of its cost."""
    upper = lambda t: F.exists(F.array(*map(F.lit, PROMPT_SIGNS)), lambda s: F.contains(t, s))
    return F.get(F.transform(F.array(F.upper(text)), upper), F.lit(0))


def is_contents(text: Column) -> Column:
    t = collapse(text)
    return t.rlike(CONTENTS) | (t.rlike(pattern(LEADERS)) & t.rlike(pattern(r"(?iu)\b(?:глава|введение|заключение|раздел)\b")))


def is_formula_like(text: Column) -> Column:
    return (count(text, r"[←→∈∪{}=τ퐴-힣]") >= 4) | text.rlike(pattern(r"(?iu)(?:^|\n)\s*Алгоритм\s*:"))


def is_table(text: Column) -> Column:
    t = collapse(text)
    return t.rlike(pattern(TABLE_A)) | (t.rlike(pattern(TABLE_B)) & (F.regexp_count(t, F.lit(r"(?<!\p{L})\d+(?:[,.]\d+)?")) >= 2))


def is_caption(text: Column, kind: Column) -> Column:
    return (kind == "caption") & F.trim(text).rlike(pattern(CAPTION_WITH_MARK))


def script_share(text: Column, of: str = "[А-ЯЁа-яё]") -> Column:
    """The share of letters that are of the class ``of``; null without letters."""
    letters = count(text, r"\p{L}")
    return F.when(letters > 0, count(text, of) / letters)


def of_script(b: DataFrame, of: str = "[А-ЯЁа-яё]", least: float = CYRILLIC_SHARE) -> DataFrame:
    """Blocks with a letter, of whose letters a share of ``least`` is of the class ``of``."""
    return b.filter(F.coalesce(script_share(F.col("text"), of), F.lit(-1.0)) >= least)


def contents_pages(b: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, first, past): the pages from the first contents heading up to the first later page of the abstract or introduction, or that page alone."""
    w = Window.partitionBy(by)
    rows = b.filter("page is not null").withColumn("first", F.min_by(F.when(F.col("text").rlike(pattern(CONTENTS_START)), F.col("page")), F.when(F.col("text").rlike(pattern(CONTENTS_START)), F.col("block_pos"))).over(w))
    later = F.col("text").rlike(pattern(CONTENTS_END)) & (F.col("page") > F.col("first"))
    return rows.filter("first is not null").groupBy(by).agg(F.first("first").alias("first"), F.coalesce(F.min(F.when(later, F.col("page"))), F.first("first") + 1).alias("past"))


def within_sections(b: DataFrame, sections: DataFrame, types: tuple[str, ...], by: str = "doc_id") -> DataFrame:
    """(by, block_pos) of the blocks inside sections of the given types, each block once."""
    return in_any_range(b.select(by, "block_pos").distinct(), sections.filter(F.col("type").isin(*types)), by=by)


def narrative(b: DataFrame, sections: DataFrame | None = None, bibliography: DataFrame | None = None, of: str = "[А-ЯЁа-яё]", least: float = CYRILLIC_SHARE, wide: bool = False, by: str = "doc_id") -> DataFrame:
    """Blocks of running text: not of the bibliography, appendices or contents, no code or prompt, and with a share of ``least`` letters of the class ``of``. ``wide`` also leaves out publications and headings in capitals."""
    t = F.col("text")
    rows = of_script(b.filter((F.col("type") != "bibliography") & ~is_contents(t)), of, least)
    rows = rows.filter(~t.rlike(pattern(PROMPT_WIDE if wide else PROMPT)))
    if wide:
        plain = F.trim(F.regexp_replace(t, "[^А-ЯЁа-яёA-Za-z ]", ""))
        caps = F.length(plain).between(4, 120) & (plain == F.upper(plain)) & ~plain.rlike("[а-яё]")
        rows = rows.filter(~t.rlike(pattern(PUBLICATION)) & ~caps)
    if sections is not None:
        rows = in_any_range(rows, sections.filter(F.col("type").isin("bibliography", "appendices")), by=by, inside=False)
    if bibliography is not None:
        rows = rows.join(bibliography.select(by, "block_pos"), [by, "block_pos"], "left_anti")
    pages = contents_pages(b, by)
    rows = rows.join(pages, by, "left").filter("page is null or first is null or page < first or page >= past")
    return rows.drop("first", "past")


def running_scopes(b: DataFrame) -> DataFrame:
    """(scope, and all columns) of blocks that are all running text: each is of scope ``all``, headings and captions of ``headings`` too. One pass."""
    heading = (F.col("type") == "heading") | is_caption(F.col("text"), F.col("type"))
    both, one = F.array(F.lit("all"), F.lit("headings")), F.array(F.lit("all"))
    return b.select(F.explode(F.when(heading, both).otherwise(one)).alias("scope"), "*")


def scoped(b: DataFrame, fields: DataFrame, title: DataFrame | None = None, running: DataFrame | None = None, by: str = "doc_id", only: set[str] | None = None) -> DataFrame:
    """(scope, by, block_pos, block_id, page, type, text): the blocks of every scope, a block once for each scope that it is of. ``running`` is the narrative, if it is at hand. Of scopes, those in ``only``, or all."""
    bib = fields.filter("field = 'bibliography'")
    cols = [by, "block_pos", "block_id", "page", "type", "text"]
    parts = {
        "all": narrative(b, None, bib, by=by) if running is None else running,
        "headings": b.filter((F.col("type") == "heading") | is_caption(F.col("text"), F.col("type"))),
        "goal": b.join(fields.filter("field = 'goal'").select(by, "block_pos"), [by, "block_pos"], "left_semi"),
        "bibliography": b.join(bib.select(by, "block_pos"), [by, "block_pos"], "left_semi"),
    }
    if title is not None:
        parts["title"] = title
    out = None
    for name, rows in parts.items():
        if only is not None and name not in only:
            continue
        rows = rows.select(F.lit(name).alias("scope"), *cols)
        out = rows if out is None else out.unionByName(rows)
    return out
