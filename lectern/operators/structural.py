"""Checks of structure: references before objects, chapters and their conclusions, captions, formulas, citations, code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import explode_matches, pattern
from lectern.operators.blocks import page_index
from lectern.operators.scopes import is_caption

#: Patterns of objects, references and section starts (fixed values).
OBJECT = r"(?iu)^(рис(?:унок)?|табл(?:ица)?)\.?\s*(\d+(?:\.\d+)?)"
REFERENCE = r"(?iu)(?<![\p{L}\p{N}_])(?:рис\.?|рисунок|рисунк(?:е|а|у|ом)|табл\.?|таблиц(?:а|е|ы|у|ей)|figure|fig\.?|table)\s*(\d+(?:\.\d+)?)"
REFERENCES = r"(?iu)(?<![\p{L}\p{N}_])(рисунках|таблицах|figures|tables)\s+(\d+(?:\.\d+)?)(?:\s*(?:,|и|and|–|-)\s*(\d+(?:\.\d+)?))?"
SECTION_START = r"(?iu)^(?:Реферат|Synopsis|Введение|ГЛАВА\s+\d+|Заключение|Приложение\b)"
STATEMENT = r"^(?:def\s+\w+\s*\(|class\s+\w+|import\s+\w+|from\s+\w+\s+import|function\s+\w+\s*\(|(?:SELECT|INSERT|UPDATE|DELETE)\b)"
MARKUP = r"^</?[A-Za-z][^>]*>"
SYNTAX = r"[{};]|=>|:=|==|\b(?:const|let|var)\s+\w+"
EXPLAINED = r"(?iu)(?:фрагмент|код|листинг|реализ|выполня|алгоритм)"
WIDEST = 200


def counts_match(positions: DataFrame, chapters: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, n_positions, n_chapters, status): fewer chapters than positions is a violation; no position is uncertain."""
    out = docs.select("doc_id").join(positions.groupBy("doc_id").agg(F.countDistinct("number").alias("n_positions")), "doc_id", "left")
    out = out.join(chapters.groupBy("doc_id").agg(F.count("*").alias("n_chapters")), "doc_id", "left").fillna(0)
    status = F.when(F.col("n_positions") == 0, "uncertain").when(F.col("n_chapters") < F.col("n_positions"), "violation").otherwise("pass")
    return out.withColumn("status", status)


def chapters_below_top(b: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapter headings that are not among the first two blocks of their page."""
    at = b.withColumn("_i", page_index(b)).filter("page is not null").select("doc_id", "block_pos", "_i")
    return chapters.join(at, ["doc_id", "block_pos"]).filter("_i > 1").drop("_i")


def bad_headings(b: DataFrame) -> DataFrame:
    """Headings and captions with a wrong dot behind the number or one at the end."""
    t = F.trim("text")
    wrong = t.rlike(pattern(r"(?iu)^глава\s+\d+\s+(?![.–—-])")) | t.rlike(pattern(r"^\d+(?:\.\d+)+\s+(?=[А-ЯЁ])")) | t.rlike(r"\.\z")
    return b.filter(((F.col("type") == "heading") | is_caption(F.col("text"), F.col("type"))) & wrong)


def final_periods(b: DataFrame) -> DataFrame:
    return b.filter(((F.col("type") == "heading") | is_caption(F.col("text"), F.col("type"))) & F.trim("text").rlike(r"\.\z"))


def caption_periods(b: DataFrame) -> DataFrame:
    return b.filter(is_caption(F.col("text"), F.col("type")) & F.trim("text").rlike(r"\.\z"))


def _kind(word: Column) -> Column:
    return F.when(word.rlike("(?iu)рис|fig"), "рис").otherwise("табл")


def object_keys(b: DataFrame) -> DataFrame:
    """(doc_id, block_pos, key, text) of actual captions."""
    t = F.trim("text")
    kind, number = F.regexp_extract(t, pattern(OBJECT), 1), F.regexp_extract(t, pattern(OBJECT), 2)
    rows = b.filter(is_caption(F.col("text"), F.col("type")))
    return rows.select("doc_id", "block_pos", F.concat(_kind(kind), F.lit(":"), number).alias("key"), "text", number.alias("_n")).filter("_n <> ''").drop("_n")


def reference_keys(b: DataFrame) -> DataFrame:
    """(doc_id, block_pos, key), each once: objects that a block refers to, also by plural forms with two numbers."""
    joined = b.withColumn("text", F.regexp_replace("text", "([А-ЯЁа-яё])(?:-|\\x{00AD})\\s*\\n\\s*([А-ЯЁа-яё])", "$1$2"))
    one = explode_matches(joined, "text", pattern(REFERENCE), ("doc_id", "block_pos"))
    one = one.select("doc_id", "block_pos", F.concat(_kind(F.col("match")), F.lit(":"), F.regexp_extract("match", r"(\d+(?:\.\d+)?)\z", 1)).alias("key"))
    many = explode_matches(joined, "text", pattern(REFERENCES), ("doc_id", "block_pos"))
    many = many.select("doc_id", "block_pos", _kind(F.col("match")).alias("kind"), F.explode(F.regexp_extract_all("match", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))).alias("n"))
    return one.unionByName(many.select("doc_id", "block_pos", F.concat("kind", F.lit(":"), "n").alias("key"))).distinct()


def section_starts(b: DataFrame, start: Column | None = None) -> DataFrame:
    """b with section_start: the place of the nearest earlier block that opens a section, else 0. A running window, no join."""
    opens = start if start is not None else F.trim(F.regexp_replace("text", r"^\s*\d{1,3}\s*\n", "")).rlike(pattern(SECTION_START))
    before = Window.partitionBy("doc_id").orderBy("block_pos").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("section_start", F.coalesce(F.last(F.when(opens, F.col("block_pos")), ignorenulls=True).over(before), F.lit(0)))


def unreferenced_objects(b: DataFrame) -> DataFrame:
    """Captions whose object is not referred to earlier in their section: an equi join on (document, key) with a range, kept where nothing matches."""
    captions = object_keys(b).join(section_starts(b).select("doc_id", "block_pos", "section_start"), ["doc_id", "block_pos"])
    refs = reference_keys(b).select("doc_id", "key", F.col("block_pos").alias("ref_pos"))
    on = (captions.doc_id == refs.doc_id) & (captions.key == refs.key) & (refs.ref_pos >= captions.section_start) & (refs.ref_pos < captions.block_pos)
    return captions.join(refs, on, "left_anti")


def formula_numbering(b: DataFrame) -> DataFrame:
    """(doc_id, n_formulas, n_numbered, n_bad, status): a mark behind a formula's number is a violation; without formulas the check doesn't apply."""
    f = F.col("type") == "formula"
    numbered, bad = F.col("text").rlike(r"\(\d+(?:\.\d+)*\)"), F.col("text").rlike(r"\(\d+(?:\.\d+)*\)\s*[.,;:]")
    out = b.groupBy("doc_id").agg(F.count_if(f).alias("n_formulas"), F.count_if(f & numbered).alias("n_numbered"), F.count_if(f & bad).alias("n_bad"))
    return out.withColumn("status", F.when(F.col("n_formulas") == 0, "not_applicable").when(F.col("n_bad") > 0, "violation").otherwise("uncertain"))


def chapter_conclusions(b: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_id, chapter_pos, status): a chapter needs a block on conclusions and, in the seven blocks behind it, a first numbered item."""
    w = Window.partitionBy("doc_id").orderBy("block_pos")
    spans = chapters.select("doc_id", F.col("block_pos").alias("chapter_pos"), F.coalesce(F.lead("block_pos").over(w), F.lit(2**31 - 1)).alias("end_pos"))
    ahead = w.rowsBetween(1, 7)
    rows = b.select("doc_id", "block_pos", F.col("text").rlike(r"(?iu)выводы(?:\s+по\s+главе)?").alias("_concludes"), F.collect_list(F.struct("block_pos", "text")).over(ahead).alias("_next"))
    inside = spans.join(rows.filter("_concludes"), "doc_id").filter("block_pos > chapter_pos and block_pos < end_pos")
    first = inside.groupBy("doc_id", "chapter_pos", "end_pos").agg(F.min_by("_next", "block_pos").alias("_next"))
    text = F.array_join(F.transform(F.filter("_next", lambda x: x["block_pos"] < F.col("end_pos")), lambda x: x["text"]), " ")
    listed = first.select("doc_id", "chapter_pos", text.rlike(pattern(r"(?:^|\s)1\.\s+(?=[А-ЯЁA-Z])")).alias("_listed"))
    return spans.join(listed, ["doc_id", "chapter_pos"], "left").select("doc_id", "chapter_pos", F.when(F.col("_listed"), "pass").otherwise("violation").alias("status"))


def citation_numbers(bracket: Column) -> Column:
    """The numbers that ``1, 3–5`` stands for, in order; a range wider than 200 stands for nothing."""
    t = F.translate(bracket, "−—", "––")
    ranges = F.regexp_extract_all(t, F.lit(r"\d{1,3}\s*[–-]\s*\d{1,3}"), F.lit(0))

    def expand(r: Column) -> Column:
        ends = F.split(r, r"\s*[–-]\s*")
        a, b = F.get(ends, F.lit(0)).cast("int"), F.get(ends, F.lit(1)).cast("int")
        return F.when((b >= a) & (b - a <= WIDEST), F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    rest = F.regexp_replace(t, r"\d{1,3}\s*[–-]\s*\d{1,3}", " ")
    single = F.transform(F.regexp_extract_all(rest, F.lit(r"\d{1,3}"), F.lit(0)), lambda x: x.cast("int"))
    return F.sort_array(F.array_distinct(F.concat(F.flatten(F.transform(ranges, expand)), single)))


def uncited_entries(b: DataFrame, bibliography: DataFrame) -> DataFrame:
    """(doc_id, number) of numbered entries that no bracket outside the bibliography cites: an anti join."""
    entry = pattern(r"(?m)(?:^|\n|\s)(\d{1,3})[.)]\s+(?=[А-ЯЁA-Z])")
    numbers = bibliography.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(entry), F.lit(1))).alias("number"))
    numbers = numbers.select("doc_id", F.col("number").cast("int").alias("number")).distinct()
    outside = b.join(bibliography.select("doc_id", "block_pos"), ["doc_id", "block_pos"], "left_anti")
    brackets = outside.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[([^\]]+)\]"), F.lit(1))).alias("_b"))
    cited = brackets.select("doc_id", F.explode(citation_numbers(F.col("_b"))).alias("number"))
    return numbers.join(cited, ["doc_id", "number"], "left_anti")


def is_code(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\n+"), F.trim), lambda x: x != "")
    statements = F.size(F.filter(lines, lambda x: x.rlike(STATEMENT)))
    markup = F.size(F.filter(lines, lambda x: x.rlike(MARKUP)))
    return text.contains("```") | (statements >= 2) | (markup >= 3) | ((statements >= 1) & (F.regexp_count(text, F.lit(SYNTAX)) >= 3))


def unexplained_code(b: DataFrame) -> DataFrame:
    """Code blocks without a word of explanation in the three blocks before."""
    before = Window.partitionBy("doc_id").orderBy("block_pos").rowsBetween(-3, -1)
    rows = b.withColumn("_before", F.array_join(F.collect_list("text").over(before), " "))
    return rows.filter(is_code(F.col("text")) & ~F.col("_before").rlike(EXPLAINED)).drop("_before")


def heading_lines(b: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, block_pos, text) of lines that read as headings, without leaders, and of titles."""
    lines = b.select("doc_id", "block_pos", F.explode(F.split("text", r"\n+")).alias("text"))
    lines = lines.withColumn("text", F.trim(F.regexp_replace("text", r"(?:\.\s*){4,}.*\z", "")))
    lines = lines.filter(F.col("text").rlike(pattern(r"(?iu)^(?:ГЛАВА\s+\d+|\d+(?:\.\d+)+\.?\s+\p{L}|Введение|Заключение|Список\s+(?:литературы|сокращений)|Приложение\s+\d+)")))
    return lines if titles is None else lines.unionByName(titles.select("doc_id", "block_pos", "text"))


def reversed_chapter_headings(lines: DataFrame) -> DataFrame:
    """Headings that put the number before the word."""
    return lines.filter(F.col("text").rlike(pattern(r"(?iu)^\s*\d+\s+глава\b")))


def without_defense(docs: DataFrame, sections: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents without a section of defence statements, or without statements in it."""
    whole = sections.filter("type = 'defense_statements'").select("doc_id").join(fields.filter("field = 'defense_statements'").select("doc_id"), "doc_id", "left_semi")
    return docs.select("doc_id").join(whole, "doc_id", "left_anti")
