"""Rules, where they apply, and the packets in which they are asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import pattern

#: Rules on the title and on the goal, by their keys.
TITLE_KEYS = ("core:6.1", "core:6.2", "core:6.3", "soft:49", "soft:50", "soft:51", "soft:52")
GOAL_KEYS = ("core:6.4", "soft:53")
#: Scope by what category and requirement say, or by key, in order (fixed values).
SCOPES: list[tuple[str | tuple[str, ...], str | None, str]] = [
    (r"презентац|слайд", None, "presentation"),
    (r"доклад|вопрос|совет|защит[аеу]|одежд|паспорт|говорить|не читать", r"положени.*защит", "defense"),
    (r"процесс работы|вылежаться|руководител|word|pdf|llm|итерац", None, "process"),
    (TITLE_KEYS, None, "title"),
    (GOAL_KEYS, None, "goal"),
    (r"положени.*выносим", None, "defense_statements"),
    (r"список литератур|библиограф|источник", None, "bibliography"),
    (r"формул", None, "formula"),
    (r"рисунк|таблиц|график|подрисуноч|оси", None, "figure_table"),
    (r"нумерованн|ненумерованн|пункт.*списк", None, "list"),
    (r"глав", None, "chapter"),
]
SCOPE_OF = {
    "core:1.6": "defense_statements", "core:2.1": "document", "core:5.1": "document", "core:5.2": "document", "core:7.3": "figure_table",
    "core:8.3": "document", "core:14": "document", "core:15": "chapter", "core:16": "document",
}
MODE_OF = {
    "core:1.6": "structural", "core:2.1": "semantic", "core:5.1": "manual", "core:5.2": "manual", "core:7.3": "manual", "core:8.2": "semantic",
    "core:8.3": "semantic", "core:14": "semantic", "core:15": "semantic", "core:16": "manual",
}
STRUCTURAL = (
    "core:1.6", "core:4.1", "core:4.2", "core:4.3", "core:5.3", "core:5.4", "core:7.1", "core:7.2", "core:7.4", "core:7.5", "core:8.1", "core:8.3",
    "core:9.1", "core:9.4", "core:12", "core:13", "core:14", "core:15", "core:18", "core:19",
    *(f"soft:{n}" for n in (
        7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 23, 25, 26, 49, 52, 54, 55, 56, 57, 62, 64, 65, 66, 67, 68, 69, 70, 71, 72, 73, 77, 78, 79, 95, 96, 97, 98, 100,
        103, 105, 110, 120, 121, 123, 128, 129, 135, 139, 140, 141, 143, 152, 155, 160,
    )),
)
#: The detector of each rule that has one (fixed values).
DETECTOR_OF = {
    "core:3.1": "personal-pronouns", "core:3.2": "small-numerals", "core:3.3": "numbered-list-capitalization", "core:3.4": "numbered-list-ending",
    "core:3.5": "lexical-replacements", "core:3.6": "obvious-claims", "core:3.7": "praise-claims", "core:5.5": "dash-spacing", "core:5.6": "quote-consistency",
    "core:5.7": "spacing", "core:6.1": "title-process", "core:6.2": "title-vague-efficiency", "core:6.3": "title-length", "core:9.2": "bibliography-junk",
    "core:9.3": "bibliography-pages", "core:11.1": "yo-letter", "core:11.2": "forbidden-sentence-start", "core:11.3": "forbidden-abbreviations",
    "core:11.4": "colon-a-imenno", "core:11.5": "to-est", "core:11.6": "diminutives", "core:17": "see-figure", "core:20": "first-new",
    "soft:27": "personal-pronouns", "soft:28": "numbered-list-capitalization", "soft:29": "heading-final-period", "soft:30": "numbered-list-ending",
    "soft:31": "bullet-list-ending", "soft:32": "dash-spacing", "soft:34": "quote-consistency", "soft:35": "small-numerals", "soft:37": "yo-letter",
    "soft:38": "lexical-replacements", "soft:39": "praise-claims", "soft:40": "diminutives", "soft:42": "forbidden-sentence-start", "soft:44": "colon-and-to-est",
    "soft:45": "above-written", "soft:46": "lexical-cliches", "soft:47": "jargon", "soft:48": "first-new", "soft:50": "title-process", "soft:51": "title-length",
    "soft:53": "goal-infinitive", "soft:59": "python-capitalization", "soft:60": "initials-order", "soft:74": "decimal-comma", "soft:75": "thousands-spacing",
    "soft:76": "percent-spacing", "soft:121": "specialty-dot", "soft:124": "method-tuning", "soft:125": "method-behavior", "soft:126": "performance-verb",
    "soft:127": "model-shows", "soft:130": "tasks-solved", "soft:132": "analogovye", "soft:134": "roman-ending", "soft:137": "implemented-in-company",
    "soft:138": "yo-letter", "soft:144": "formula-wording", "soft:145": "next-respectively", "soft:146": "receiver-successor", "soft:147": "colloquial-errors",
    "soft:149": "present-work", "soft:152": "format-parent-word", "soft:155": "document-garbage", "soft:159": "transition-to-conclusions", "soft:161": "results-word",
}
SEVERITIES = [
    (r"положени.*защит|научн.*новизн|прототип|цель.*диссертац|диссертац.*научн", "critical"),
    (r"структур|глава|вывод|заключени|внедрен|названи|ссылка.*рис|список литератур", "major"),
    (r"пробел|кавыч|тире|дефис|буква ё|точк|числитель|жаргон|слово|инициал|процент|дроб", "minor"),
]
WEIGHTS = {"critical": 5.0, "major": 3.0, "minor": 1.0, "info": 0.25}
BY_HAND = ("presentation", "defense", "process")
SELECTORS = {"title": "title", "goal": "title_goal", "defense_statements": "defense_statements", "chapter": "chapter", "bibliography": "bibliography"}
MAJOR = ("introduction", "chapter", "conclusion")
VIRTUAL = ("title_goal", "scientific_core", "defense_chapters", "conclusion_global", "implementation_context")
RESULT_KINDS = [
    (r"^классификаци|систематизаци", "classification"),
    (r"^бенчмарк|^набор\s+данных|^датасет|протокол\s+оцен", "benchmark"),
    (r"^программ(?:ный|ная)\s+(?:комплекс|система)|^фреймворк", "software"),
    (r"^модел", "model"),
    (r"^метод|^алгоритм|^технолог", "method"),
]
SUMMARY = r"(?iu)предложен|разработан|прототип|аналог|эксперимент|результат|вывод|сравнен|превосход|отлича"
EVIDENCE = r"(?iu)аналог|прототип|базов(?:ый|ая|ое)|сравнен|недостат|отлича|предложен|результат|эксперимент"
CONCLUSIONS = r"(?iu)^(?:\d+(?:\.\d+)*\.?\s*)?выводы(?:\s+по\s+главе)?\.?\z"


def _case(pairs: dict[str, str], key: Column, default: Column) -> Column:
    """One lookup in a constant map, however many pairs there are."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[key], default) if pairs else default


def inferred_scope(category: Column, requirement: Column, key: Column) -> Column:
    """The scope that a rule's words and key ask for, whatever is set by hand."""
    text = F.lower(F.concat_ws(" ", category, requirement))
    out = F.lit("document")
    for regex, unless, name in reversed(SCOPES):
        on = key.isin(*regex) if isinstance(regex, tuple) else text.rlike(regex) & (~text.rlike(unless) if unless else F.lit(True))
        out = F.when(on, name).otherwise(out)
    return out


def scope(category: Column, requirement: Column, key: Column) -> Column:
    return _case(SCOPE_OF, key, inferred_scope(category, requirement, key))


def severity(category: Column, requirement: Column, scope_: Column) -> Column:
    """Severity by what a rule says; else by its inferred scope, which a scope set by hand doesn't change."""
    text = F.lower(F.concat_ws(" ", category, requirement))
    out = F.when(scope_.isin(*BY_HAND), "info").otherwise("major")
    for regex, name in reversed(SEVERITIES):
        out = F.when(text.rlike(regex), name).otherwise(out)
    return out


def weight(severity_: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in WEIGHTS.items():
        out = F.when(severity_ == name, w).otherwise(out)
    return out


def with_meta(rules: DataFrame, detectors: dict[str, str] | None = None) -> DataFrame:
    """Rules with scope, detector, mode, severity and weight; ``detectors`` maps keys to detectors."""
    rows = rules.withColumn("detector_id", _case(DETECTOR_OF if detectors is None else detectors, F.col("key"), F.lit(None).cast("string")))
    rows = rows.withColumn("scope", scope(F.col("category"), F.col("requirement"), F.col("key")))
    mode = F.when(F.col("detector_id").isNotNull(), "deterministic").when(F.col("key").isin(*STRUCTURAL), "structural").when(F.col("scope").isin(*BY_HAND), "manual").otherwise("semantic")
    rows = rows.withColumn("mode", _case(MODE_OF, F.col("key"), mode)).withColumn("severity", severity(F.col("category"), F.col("requirement"), inferred_scope(F.col("category"), F.col("requirement"), F.col("key"))))
    return rows.withColumn("weight", weight(F.col("severity")))


def profile(core: DataFrame, soft: DataFrame | None, user: DataFrame | None, full: bool) -> DataFrame:
    """Core rules, with all soft ones in a full profile, and a user's own."""
    out = core
    if full and soft is not None:
        out = out.unionByName(soft, allowMissingColumns=True)
    return out if user is None else out.unionByName(user, allowMissingColumns=True)


def result_kind(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"^\s*\d+\.\s*", ""))
    out = F.lit("other")
    for regex, kind in reversed(RESULT_KINDS):
        out = F.when(t.rlike(pattern(regex)), kind).otherwise(out)
    return out


def chosen(keywords: str, first: int, last: int, most: int) -> tuple[Column, Callable[[Column], Column]]:
    """(arm, and what makes of a column of it whether a block is chosen) of a chapter's blocks: of its section's blocks the ``first`` ones (arm 0), those with a keyword (1) and the ``last`` ones (2), each once in that order, ``most`` at most. ``_place`` and ``_many`` say where a block stands in its section. How many of an arm have come is counted in the order of the blocks, so all of it is one sort."""
    arm = F.when(F.col("_place") <= first, 0).when(F.col("text").rlike(keywords), 1).when(F.col("_many") - F.col("_place") < last, 2)
    w = Window.partitionBy("doc_id", "section_id")
    so_far = w.orderBy("block_pos").rowsBetween(Window.unboundedPreceding, 0)

    def place(arm: Column) -> Column:
        before, out = F.lit(0), F.lit(None).cast("long")
        for k in range(3):
            out = F.when(arm == k, before + F.count_if(arm == k).over(so_far)).otherwise(out)
            before = before + F.count_if(arm == k).over(w)
        return out

    return arm, lambda c: F.coalesce(place(c) <= most, F.lit(False))


def fragments(rows: DataFrame) -> DataFrame:
    """(doc_id, fragment_id, selector, complete, block_pos, block_id, text) from section blocks: every section, derived conclusions (of chapters in documents without explicit ones, the blocks from the heading of conclusions on), and the virtual fragments that join several.

    One pass over each document's blocks: all windows are of a document or of parts
    of it, so rows that are dealt by document are not exchanged again.
    """
    of = lambda *types: F.col("type").isin(*types)
    whole = Window.partitionBy("doc_id").orderBy("section_id", "block_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    section = Window.partitionBy("doc_id", "section_id")
    last = ("title", "goal", "tasks", "defense_statements", "chapter_conclusions", "conclusion")
    # of each virtual fragment: the types that must be whole, the types of which it takes all blocks, and which blocks of chapters it takes
    plans = {
        "title_goal": (("title", "goal", "introduction"), ("title", "goal"), None),
        "scientific_core": (("title", "introduction", "goal", "tasks", "defense_statements", "chapter", "conclusion"), ("title", "introduction", "conclusion"), "_s"),
        "defense_chapters": (("defense_statements", "chapter", "chapter_conclusions"), ("defense_statements", "chapter_conclusions"), "_e"),
        "conclusion_global": (last, last, None),
    }
    # a document is a null one's neighbour in no join: it has its sections, and nothing that joins them
    explicit = F.col("doc_id").isNotNull() & F.coalesce(F.max(of("chapter_conclusions")).over(whole), F.lit(False))
    at = rows.withColumns({"complete": F.col("state") == "confirmed", "_own": of("chapter") & ~explicit})
    heading = F.col("_own") & F.trim("text").rlike(pattern(CONCLUSIONS))
    at = at.withColumns({"_place": F.row_number().over(section.orderBy("block_pos")), "_many": F.count("*").over(section), "_from": F.min(F.when(heading, F.col("block_pos"))).over(section)})
    at = at.withColumn("_ends", F.coalesce(F.col("_own") & (F.col("block_pos") >= F.col("_from")), F.lit(False)))
    arms = {"_s": chosen(SUMMARY, 4, 10, 45), "_e": chosen(EVIDENCE, 3, 12, 55)}
    at = at.withColumns({name: arm for name, (arm, _) in arms.items()})
    at = at.withColumns({name: of("chapter") & place(F.col(name)) for name, (_, place) in arms.items()})
    takes, states = {}, {}
    for name, (source, types, some) in plans.items():
        own = of(*types) if some is None else of(*types) | F.col(some)
        takes[f"_t_{name}"] = F.coalesce(own, F.lit(False)) | (F.col("_ends") if "chapter_conclusions" in types else F.lit(False))
        states[f"_{name}"] = F.bool_and(F.when(of(*source) | (F.col("_ends") if "chapter_conclusions" in source else F.lit(False)), F.col("complete"))).over(whole)
    at = at.withColumns(takes).withColumns(states)
    # a block that several sections hold is in a virtual fragment once
    before = Window.partitionBy("doc_id", "block_id").orderBy("block_pos", "section_id").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumns({t: F.col(t) & ~F.coalesce(F.max(t).over(before), F.lit(False)) for t in takes})
    entry = lambda fragment, selector, complete: F.struct(fragment.alias("fragment_id"), selector.alias("selector"), complete.alias("complete"))
    entries = [entry(F.col("section_id"), F.col("type"), F.col("complete")), F.when(F.col("_ends"), entry(F.concat("section_id", F.lit("-conclusions")), F.lit("chapter_conclusions"), F.col("complete")))]
    for name in plans:
        held = F.col(f"_t_{name}") & F.col(f"_{name}").isNotNull() & F.col("doc_id").isNotNull()
        entries.append(F.when(held, entry(F.lit(f"virtual-{name}"), F.lit(name), F.col(f"_{name}"))))
    out = at.select("doc_id", "block_pos", "block_id", "text", F.inline(F.array_compact(F.array(*entries))))
    return out.select("doc_id", "fragment_id", "selector", "complete", "block_pos", "block_id", "text")


IMPLEMENTED = r"(?iu)внедрен|использовани[ея]\s+результат|акт(?:а|ы|ов)?\s+внедрен|репозитор|github|gitlab|открыт(?:ое|ый)\s+по|программ(?:ное|ный)\s+средств"


def implementation_context(b: DataFrame, rows: DataFrame) -> DataFrame:
    """The virtual fragment on practical use: blocks that speak of it, the first two of each chapter, and the conclusion."""
    first = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("block_pos"))
    chapters = rows.filter("type = 'chapter'").withColumn("_n", first).filter("_n <= 2")
    cols = ["doc_id", "block_pos", "block_id", "text"]
    blocks = b.filter(F.col("text").rlike(pattern(IMPLEMENTED))).select(*cols).unionByName(chapters.select(*cols)).unionByName(rows.filter("type = 'conclusion'").select(*cols)).dropDuplicates(["doc_id", "block_id"])
    return blocks.select("doc_id", F.lit("virtual-implementation_context").alias("fragment_id"), F.lit("implementation_context").alias("selector"), F.lit(True).alias("complete"), "block_pos", "block_id", "text")


def defense_matrix(pairs: DataFrame, statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Fragments of one statement and its chapter each, with the kind of result that the statement claims."""
    one = pairs.join(statements.select("doc_id", "number", "block_pos", "text"), ["doc_id", "number"])
    name = F.concat(F.lit("virtual-defense-chapter-"), "pair")
    head = one.select("doc_id", name.alias("fragment_id"), F.lit(None).cast("string").alias("state"), "block_pos", F.concat(F.lit("statement-"), "number").alias("block_id"), "text", result_kind(F.col("text")).alias("result_kind"))
    body = one.select("doc_id", "pair", "section_id", result_kind(F.col("text")).alias("result_kind")).join(rows.select("doc_id", "section_id", "state", "block_pos", "block_id", "text"), ["doc_id", "section_id"])
    body = body.select("doc_id", name.alias("fragment_id"), "state", "block_pos", "block_id", "text", "result_kind")
    both = head.unionByName(body)
    whole = F.coalesce(F.bool_and(F.col("state") == "confirmed").over(Window.partitionBy("doc_id", "fragment_id")), F.lit(False))
    return both.select("doc_id", "fragment_id", F.lit("defense_chapter_matrix").alias("selector"), whole.alias("complete"), "block_pos", "block_id", "text", "result_kind")


def paired_chapters(statements: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_id, pair, number, section_id): statements and chapters by position; of more chapters than statements the last ones."""
    s = statements.select("doc_id", "number", F.row_number().over(Window.partitionBy("doc_id").orderBy("number")).alias("pair"), F.count("*").over(Window.partitionBy("doc_id")).alias("_n"))
    c = chapters.select("doc_id", "section_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_pos")).alias("_place"), F.count("*").over(Window.partitionBy("doc_id")).alias("_all"))
    at = F.col("_place") == F.col("pair") + F.greatest(F.lit(0), F.col("_all") - F.col("_n"))
    return s.join(c, "doc_id").filter(at).select("doc_id", "pair", "number", "section_id")


def strategies(rules: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """Rules with strategy, selectors, exhaustive, allow_pass and explicit. ``specs`` (rule_id, strategy, selectors, exhaustive, allow_pass) goes before the fallback."""
    fallback = F.when(F.col("detector_id").isNotNull() | (F.col("mode") == "deterministic"), "deterministic").when(F.col("mode") == "structural", "structural").when((F.col("mode") == "manual") | F.col("scope").isin(*BY_HAND), "manual").otherwise("llm")
    selector = F.array(_case(SELECTORS, F.col("scope"), F.lit("major_sections")))
    rows = rules
    if specs is None:
        specs = rules.sparkSession.createDataFrame([], "rule_id string, strategy string, selectors array<string>, exhaustive boolean, allow_pass boolean")
    rows = rows.join(F.broadcast(specs.withColumnsRenamed({c: f"_{c}" for c in specs.columns if c != "rule_id"})), "rule_id", "left")
    return rows.select(
        *rules.columns, F.coalesce("_strategy", fallback).alias("strategy"), F.coalesce("_selectors", selector).alias("selectors"), F.coalesce("_exhaustive", F.when(F.col("_strategy").isNull(), (F.col("scope") != "document") & (fallback == "llm")), F.lit(False)).alias("exhaustive"),
        F.coalesce("_allow_pass", F.lit(True)).alias("allow_pass"), F.col("_strategy").isNotNull().alias("explicit"),
    )


def routed(rules: DataFrame, frags: DataFrame) -> DataFrame:
    """(doc_id, rule_id, fragment_id, exhaustive, allow_pass): the fragments of each rule that a model answers. Major sections are introduction, chapters and conclusion; a rule is exhaustive only over complete fragments."""
    heads = frags.groupBy("doc_id", "fragment_id", "selector").agg(F.bool_and("complete").alias("complete"))
    wide = heads.withColumn("_s", F.when(F.col("selector").isin(*MAJOR), F.array("selector", F.lit("major_sections"))).otherwise(F.array("selector"))).withColumn("_s", F.explode("_s"))
    asked = rules.filter("strategy = 'llm'").select("rule_id", "exhaustive", "allow_pass", F.explode("selectors").alias("_s"))
    rows = wide.join(F.broadcast(asked), "_s").select("doc_id", "rule_id", "fragment_id", "complete", "exhaustive", "allow_pass").distinct()
    w = Window.partitionBy("doc_id", "rule_id")
    return rows.select("doc_id", "rule_id", "fragment_id", "complete", (F.col("exhaustive") & F.bool_and("complete").over(w)).alias("exhaustive"), "allow_pass")


def routing_stats(rules: DataFrame) -> DataFrame:
    out = rules.agg(F.count_if("explicit").alias("explicit_rules"), F.count_if(~F.col("explicit")).alias("fallback_rules"))
    return out.withColumn("strategy", F.when(F.col("fallback_rules") == 0, "explicit-map").when(F.col("explicit_rules") == 0, "scope-fallback").otherwise("mixed"))


def packets(assigned: DataFrame, size: int = 12, by: tuple[str, ...] = ("doc_id", "fragment_id"), order: str = "rule_id", stretch: int | None = None) -> DataFrame:
    """Add packet (from 0): rules of a fragment in order, ``size`` at a time.

    A group that may hold much of a table is numbered in stretches: where ``order``
    is a whole number, ``stretch`` of its values stand together, so no window is longer
    than the rows of one stretch, and what earlier stretches hold is added. Rows of
    one place have any order among themselves.
    """
    if stretch is None:
        return assigned.withColumn("packet", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size).cast("int"))
    rows = assigned.withColumn("_stretch", F.coalesce(F.floor(F.col(order) / stretch), F.lit(-(2**62))))
    counts = rows.groupBy(*by, "_stretch").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_stretch").alias("_own"), before.alias("_before"))
    own = F.col("_stretch") == F.col("_own")
    for c in by:
        own = own & F.col(c).eqNullSafe(F.col(f"_{c}"))
    number = F.row_number().over(Window.partitionBy(*by, "_stretch").orderBy(order)) - 1 + F.col("_before")
    return rows.join(counts, own).withColumn("packet", F.floor(number / size).cast("int")).select(*assigned.columns, "packet")


def scopes_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SELECTORS.items()), "scope string, selector string")
