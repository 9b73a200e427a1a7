"""From rules to results: every rule's detector or structural check over all documents.

A *check* is what a rule asks for: a detector of the pattern pack, a detector with
rules of its own, or a check of structure. Each runs once over the corpus,
whatever the number of rules that share it, and gives outcomes (doc_id, check_id,
status, confidence, explanation, fix, evidence). Rules then take the outcomes of
their check by an equi join with the catalogue, which is small.
"""

from __future__ import annotations

from collections.abc import Callable, Container

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse, context_quote, explode_matches, pattern
from lectern.operators import blocks as B
from lectern.operators import detectors as D
from lectern.operators import scopes as S
from lectern.operators import structural as X
from lectern.operators import terms as T

#: What to do about a pattern's matches, by detector and number (fixed values).
FIXES = {
    ("lexical-replacements", 0): "Заменить «нужно» на «необходимо».",
    ("lexical-replacements", 1): "Заменить «значит» на «следовательно» или перестроить предложение.",
    ("lexical-replacements", 2): "Проверить замену на «состоит в».",
    ("obvious-claims", 0): "Убрать оценочное слово и привести обоснование или ссылку.",
    ("title-process", 0): "Начать название с существительного, обозначающего результат: «Метод…», «Алгоритм…», «Система…».",
    ("title-vague-efficiency", 0): "Указать конкретный измеримый результат вместо общей формулы «повышение эффективности/качества».",
    ("forbidden-sentence-start", 0): "Перестроить начало предложения: например, использовать «Поскольку» или «Следовательно».",
    ("forbidden-abbreviations", 0): "Раскрыть сокращение или перестроить фразу. Допустимые формы «т. д.» и «т. п.» пишутся с пробелами.",
    ("forbidden-abbreviations", 1): "Добавить пробел: «т. д.», «т. п.».",
    ("colon-a-imenno", 0): "Убрать «а именно»: двоеточие уже выполняет эту функцию.",
    ("to-est", 0): "В пояснении заменить «то есть» на тире; в выводе — на «таким образом», если это соответствует смыслу.",
    ("diminutives", 0): "Использовать нейтральную форму без уменьшительного суффикса.",
    ("see-figure", 0): "Убрать «см.» и сослаться непосредственно: «на рис. 5» или «рис. 5».",
    ("first-new", 0): "Убрать «впервые»/«новый» либо обосновать действительно пионерский характер результата.",
    ("heading-final-period", 0): "Убрать точку в конце названия главы, раздела, таблицы или подрисуночной подписи.",
    ("above-written", 0): "Заменить на «изложенное выше» или «перечисленное выше».",
    ("lexical-cliches", 0): "Заменить на точный глагол, например «является».",
    ("lexical-cliches", 1): "Использовать «имеет ... значение».",
    ("lexical-cliches", 2): "Использовать «представляет собой», если это соответствует смыслу.",
    ("jargon", 0): "Заменить профессиональный жаргон русским термином или дать пояснение при первом употреблении.",
    ("goal-infinitive", 0): "Сформулировать цель как внешний результат существительным, а не как перечень действий.",
    ("python-capitalization", 0): "Название языка программирования писать как Python.",
    ("initials-order", 0): "В библиографии ставить инициалы после фамилии.",
    ("decimal-comma", 0): "В русскоязычном тексте использовать запятую как десятичный разделитель, если это не версия ПО, IP-адрес или код.",
    ("thousands-spacing", 0): "Разбить многозначное число пробелами, если это не год, номер документа или идентификатор.",
    ("percent-spacing", 0): "Поставить неразрывный пробел перед знаком процента.",
    ("specialty-dot", 0): "После номера научной специальности поставить точку.",
    ("method-tuning", 0): "Указать, что настраиваются параметры метода или программный модуль.",
    ("method-behavior", 0): "Переформулировать через свойства, результаты или работу метода.",
    ("performance-verb", 0): "Использовать «повышение производительности».",
    ("model-shows", 0): "Использовать точный глагол: «обеспечивает», «даёт результат», «демонстрирует на графике».",
    ("tasks-solved", 0): "Задачу решают, а не выполняют.",
    ("analogovye", 0): "Заменить «аналоговые решения» на «аналогичные решения», если речь не об аналоговой технике.",
    ("roman-ending", 0): "Не присоединять русское окончание к римской цифре через дефис.",
    ("implemented-in-company", 0): "Проверить предлог: обычно результаты внедрены «в компании», а не «в компанию».",
    ("formula-wording", 0): "Сократить до «по формуле».",
    ("next-respectively", 0): "Убрать повтор слова «следующий» и назвать объект прямо.",
    ("receiver-successor", 0): "Использовать «преемник», если речь о продолжателе должности.",
    ("colloquial-errors", 0): "Заменить просторечную или неправильную форму нормативной.",
    ("present-work", 0): "Сократить до «работа».",
    ("format-parent-word", 0): "Добавить родовое слово: «форматы SVG и PNG».",
    ("document-garbage", 0): "Удалить технический мусор, ошибки полей и сломанные идентификаторы перед отправкой работы.",
    ("transition-to-conclusions", 0): "Убрать фразу-переход и сразу изложить выводы.",
    ("results-word", 0): "Использовать «выводы».",
}
DEFAULT_FIX = "Исправить найденные фрагменты в соответствии с требованием."
#: What a check says by its status, and what to do about a violation (fixed values). Patterns say their rule's requirement.
SAID = {
    ("title-length", "uncertain"): "Название работы не удалось надёжно извлечь.",
    ("personal-pronouns", "pass"): "В русскоязычном основном тексте не обнаружены отдельные формы «я», «мы», «наш». Составные слова и переносы PDF исключены.",
    ("praise-claims", "pass"): "Необоснованные восторженные оценки не обнаружены; статистические сочетания вроде «число уникальных запросов» исключены.",
    ("yo-letter", "violation"): "Найдены конкретные слова, в которых нормативно требуется буква «ё».",
    ("yo-letter", "pass"): "Конкретные словарные формы с пропущенной буквой «ё» не обнаружены.",
    ("quote-consistency", "pass"): "В русскоязычном основном тексте не обнаружено смешения нескольких типов кавычек.",
    ("numbered-list-capitalization", "violation"): "Нумерованный пункт начинается со строчной буквы.",
    ("numbered-list-capitalization", "pass"): "Высокоуверенные случаи начала нумерованного пункта со строчной буквы не обнаружены.",
    ("numbered-list-ending", "violation"): "Пункт нумерованного списка заканчивается точкой с запятой.",
    ("numbered-list-ending", "pass"): "Явных нарушений окончания пунктов не обнаружено.",
    ("bullet-list-ending", "violation"): "Пункт списка не имеет требуемого завершающего знака.",
    ("bullet-list-ending", "pass"): "Явных нарушений окончания пунктов не обнаружено.",
    ("small-numerals", "violation"): "В связном тексте обнаружено числительное от нуля до девяти, записанное цифрой в высокоуверенном языковом контексте.",
    ("small-numerals", "pass"): "Высокоуверенные случаи записи числительных от нуля до девяти цифрами не обнаружены.",
    ("defense-punctuation", "uncertain"): "Положения на защиту не удалось выделить как целые нумерованные пункты.",
    ("defense-punctuation", "violation"): "Найдено положение с неверной прописной буквой или завершающим знаком.",
    ("defense-symbols", "uncertain"): "Положения на защиту не удалось выделить как целые нумерованные пункты.",
    ("defense-symbols", "violation"): "В положениях обнаружены аббревиатуры, метрики или математические обозначения.",
    ("defense-symbols", "pass"): "В распознанных положениях аббревиатуры и математические обозначения не обнаружены.",
    ("dash-spacing", "pass"): "Высокоуверенные нарушения различия тире и дефиса не обнаружены.",
    ("dash-spacing", "uncertain"): "В текстовом слое PDF найдены возможные нарушения оформления тире, но PDF может терять пробелы и переносить слова. Требуется визуальная проверка или исходный DOCX.",
    ("dash-spacing", "violation"): "В DOCX обнаружено тире без требуемых пробелов либо дефис, использованный вместо тире.",
    ("spacing", "uncertain"): "В текстовом слое PDF знак процента местами прилегает к числу, но извлечение PDF может терять пробелы. Требуется визуальная проверка или DOCX.",
    ("spacing", "pass"): "Высокоуверенные нарушения пробелов после инициалов и перед знаком процента не обнаружены.",
    ("terms:headings", "violation"): "В названии, оглавлении или заголовке обнаружены аббревиатуры.",
    ("terms:headings", "pass"): "В распознанных названиях, оглавлении и заголовках аббревиатуры не обнаружены.",
    ("defense-section", "violation"): "Отдельный раздел с положениями, выносимыми на защиту, не распознан.",
    ("chapter-heading-order", "violation"): "Обнаружен заголовок вида «1 Глава».",
    ("chapter-heading-order", "pass"): "Заголовки вида «1 Глава» не обнаружены.",
    ("reference-order-no-see", "violation"): "Обнаружена ссылка «см. рис.» либо рисунок без предшествующей ссылки.",
    ("reference-order-no-see", "uncertain"): "Явные конструкции «см. рис.» и нарушения порядка в распознанном текстовом слое не обнаружены; визуальное положение рисунка требует просмотра PDF.",
    ("chapters-new-page", "violation"): "Заголовок главы расположен не в начале страницы.",
    ("chapters-new-page", "pass"): "Распознанные заголовки глав находятся в начале страниц.",
    ("heading-format", "violation"): "Обнаружен заголовок или подпись с неверной точкой после номера либо лишней точкой в конце.",
    ("heading-format", "pass"): "Явных нарушений формата распознанных заголовков и подписей не обнаружено.",
    ("reference-order", "violation"): "Для объекта не найдена предшествующая ссылка в пределах текущего раздела документа.",
    ("reference-order", "pass"): "Для распознанных подписей найдены предшествующие ссылки в соответствующих разделах.",
    ("caption-format", "violation"): "Подпись рисунка или название таблицы заканчивается точкой.",
    ("caption-format", "uncertain"): "Точки в конце подписей не обнаружены, но положение подписи относительно объекта по текстовому слою не проверяется.",
    ("formula-numbering", "violation"): "В том же извлечённом блоке знак препинания расположен после номера формулы.",
    ("chapter-conclusions", "violation"): "Для главы не найдены выводы, оформленные нумерованным списком.",
    ("chapter-conclusions", "pass"): "Для распознанных глав найдены выводы с нумерованными пунктами.",
    ("uncited", "pass"): "Для всех распознанных источников найдены ссылки в основном тексте, включая номера внутри диапазонов.",
    ("code-explanation", "violation"): "Для фрагмента кода не найдено предшествующее описание.",
    ("code-explanation", "pass"): "Для распознанных фрагментов кода найдено описание.",
    ("initials", "violation"): "В библиографии обнаружены инициалы перед фамилией.",
    ("initials", "pass"): "Инициалы перед фамилиями не обнаружены.",
    ("final-periods", "violation"): "В конце заголовка или подписи стоит точка.",
    ("final-periods", "pass"): "В распознанных заголовках и подписях лишние точки не обнаружены.",
}
PATTERN_PASSES = "Детерминированный поиск не обнаружил высокоуверенных совпадений с запрещённым шаблоном."
FIX_OF = {
    "title-length": "Сократить название, сохранив объект и результат работы.",
    "personal-pronouns": "Переформулировать безлично: «в работе предложено», «автором разработано» — если это не искажает смысл.",
    "praise-claims": "Заменить оценку измеримым сравнением с прототипом или нейтральным утверждением.",
    "yo-letter": "Заменить указанную форму на вариант с буквой «ё».",
    "quote-consistency": "Выбрать один тип кавычек и применить его к русскоязычному основному тексту.",
    "numbered-list-capitalization": "Начать пункт с прописной буквы.",
    "numbered-list-ending": "Исправить окончания пунктов.",
    "bullet-list-ending": "Исправить окончания пунктов.",
    "small-numerals": "Записать числительное словом либо подтвердить, что это специальное обозначение.",
    "defense-punctuation": "Начать положение с прописной буквы и завершить точкой.",
    "defense-symbols": "Раскрыть обозначения словами.",
    "dash-spacing": "Использовать среднее тире «–» с пробелами; дефис оставлять только внутри составных слов.",
    "terms:headings": "Раскрыть термин в заголовке или заменить аббревиатуру полным названием.",
    "defense-section": "Добавить отдельный раздел с положениями на защиту.",
    "chapter-heading-order": "Использовать порядок «Глава 1».",
    "reference-order-no-see": "Сослаться на рисунок до его размещения и убрать «см.».",
    "chapters-new-page": "Перенести начало главы на новую страницу.",
    "heading-format": "Исправить нумерацию и убрать точку в конце названия.",
    "reference-order": "Добавить ссылку на рисунок или таблицу до объекта.",
    "caption-format": "Убрать точку в конце подписи или названия.",
    "formula-numbering": "Перенести знак перед номером формулы.",
    "chapter-conclusions": "Представить выводы по каждой главе нумерованным списком.",
    "uncited": "Добавить ссылки либо удалить неиспользованные записи.",
    "code-explanation": "Перед кодом объяснить его назначение.",
    "initials": "Переставить инициалы после фамилии.",
    "final-periods": "Убрать точку.",
}
#: Names of quotation styles (fixed values).
STYLE_NAMES = {"guillemets": "ёлочки", "english": "английские двойные", "low": "лапки", "straight": "прямые двойные"}
#: Checks of structure by rule (fixed values); abbreviations come in variants.
STRUCTURAL_OF = {
    "CORE-4-1": "terms:expansion", "SOFT-056": "terms:expansion", "SOFT-151": "terms:expansion", "CORE-4-2": "terms:headings", "SOFT-077": "terms:headings",
    "CORE-4-3": "terms:translation", "CORE-12": "terms:any-or-headings", "SOFT-055": "terms:expansion-or-headings", "CORE-1-6": "positions-and-chapters",
    "SOFT-026": "defense-section", "CORE-5-3": "chapters-new-page", "SOFT-062": "chapters-new-page", "CORE-5-4": "heading-format", "SOFT-120": "chapter-heading-order",
    "CORE-7-1": "reference-order", "SOFT-065": "reference-order", "SOFT-064": "reference-order-no-see", "CORE-7-2": "caption-format", "SOFT-066": "caption-format",
    "CORE-7-4": "formula-numbering", "SOFT-070": "formula-numbering", "CORE-7-5": "formula-explanation", "SOFT-072": "formula-explanation",
    "CORE-8-1": "chapter-conclusions", "SOFT-160": "chapter-conclusions", "CORE-9-1": "author-formats", "CORE-9-4": "uncited", "CORE-13": "code-explanation",
    "CORE-18": "initials", "CORE-19": "final-periods", "SOFT-139": "unresolved",
}
#: Rules without a check of their own, by what they say, in order (fixed values).
STRUCTURAL_BY_TEXT = [(r"аббревиатур|сокращени", "terms:any"), (r"вывод.*глав", "chapter-conclusions"), (r"ссылк.*источник|все источники", "uncited")]
DETECTOR_BY_ID = {"CORE-1-4": "defense-punctuation", "CORE-1-5": "defense-symbols", "SOFT-023": "defense-punctuation", "SOFT-024": "defense-symbols"}
BIBLIOGRAPHY_BY_ID = {"CORE-9-2": "bibliography:junk", "CORE-9-3": "bibliography:pages"}
DEFENCE = ("defense-punctuation", "defense-symbols")
SPECIAL = ("title-length", "personal-pronouns", "praise-claims", "yo-letter", "quote-consistency", "numbered-list-ending", "bullet-list-ending", "numbered-list-capitalization", "small-numerals", "defense-punctuation", "defense-symbols", "spacing", "dash-spacing")
#: Detectors whose evidence has full confidence.
CERTAIN = ("numbered-list-ending", "bullet-list-ending", "numbered-list-capitalization", "small-numerals", "defense-punctuation", "defense-symbols", "spacing", "dash-spacing")
MOST = 15

_EVIDENCE = "array<struct<hit_order:int,block_pos:int,block_id:string,quote:string>>"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[key]


def check_of(rule_id: Column, mode: Column, detector_id: Column, category: Column, requirement: Column) -> Column:
    """The check that a rule asks for: by its detector, by its id, or by what it says; null for rules that no detector answers."""
    detector = F.coalesce(_lookup(BIBLIOGRAPHY_BY_ID, rule_id), detector_id, _lookup(DETECTOR_BY_ID, rule_id), F.lit("none"))
    text = F.lower(F.concat_ws(" ", category, requirement))
    by_text = F.lit("unresolved")
    for regex, check in reversed(STRUCTURAL_BY_TEXT):
        by_text = F.when(text.rlike(regex), check).otherwise(by_text)
    return F.when(mode == "deterministic", detector).when(mode == "structural", F.coalesce(_lookup(STRUCTURAL_OF, rule_id), by_text))


def evidence_rows(found: DataFrame, check: str | None = None) -> DataFrame:
    """(check_id, doc_id, spec_idx, block_pos, block_id, match_idx, quote) from a detector's hits, or from rows that are a check's evidence."""
    have = set(found.columns)
    zero = lambda c: F.col(c).cast("int").alias(c) if c in have else F.lit(0).alias(c)
    name = F.col("detector_id") if check is None else F.lit(check)
    return found.select(name.alias("check_id"), "doc_id", zero("spec_idx"), F.col("block_pos").cast("int").alias("block_pos"), "block_id", zero("match_idx"), collapse(F.col("quote")).alias("quote"))


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def gathered(rows: DataFrame, most: int = D.CAP) -> DataFrame:
    """(doc_id, check_id, n_found, last_spec, evidence): the first ``most`` of each document's hits, in order of spec, block and place; then each block and quote once."""
    order = Window.partitionBy("check_id", "doc_id").orderBy("spec_idx", "block_pos", "match_idx")
    rows = rows.withColumn("hit_order", F.row_number().over(order)).filter(F.col("hit_order") <= most)
    same = F.struct(F.coalesce("block_id", F.lit("")), F.lower("quote"))
    first = rows.groupBy("check_id", "doc_id", same.alias("_same")).agg(F.min(F.struct("hit_order", "block_pos", "block_id", "quote")).alias("e"), F.count("*").alias("_n"), F.max("spec_idx").alias("_spec"))
    return first.groupBy("doc_id", "check_id").agg(F.sum("_n").cast("int").alias("n_found"), F.max("_spec").alias("last_spec"), F.array_sort(F.collect_list("e")).cast(_EVIDENCE).alias("evidence"))


def gathered_by_block(rows: DataFrame, stop: tuple[str, ...] = ("small-numerals",), most: int = D.CAP) -> DataFrame:
    """The same for detectors that go block by block and count all their hits: each block and quote once, then the first ``most`` of those, in order of block, spec and place. Those in ``stop`` read on only until ``most`` hits are found, and finish the pattern and block that they are in."""
    w = Window.partitionBy("check_id", "doc_id").orderBy("block_pos", "spec_idx", "match_idx")
    rows = rows.withColumn("hit_order", F.row_number().over(w))
    begun = F.min("hit_order").over(Window.partitionBy("check_id", "doc_id", "block_pos", "spec_idx"))
    rows = rows.withColumn("_begun", begun).filter(~F.col("check_id").isin(*stop) | (F.col("_begun") <= most))
    same = F.struct(F.coalesce("block_id", F.lit("")), F.lower("quote"))
    first = rows.groupBy("check_id", "doc_id", same.alias("_same")).agg(F.min(F.struct("hit_order", "block_pos", "block_id", "quote")).alias("e"), F.count("*").alias("_n"), F.max("spec_idx").alias("_spec"))
    place = F.row_number().over(Window.partitionBy("check_id", "doc_id").orderBy("e.hit_order"))
    kept = F.when((place <= most) | F.col("check_id").isin(*stop), F.col("e"))
    first = first.withColumn("e", kept)
    return first.groupBy("doc_id", "check_id").agg(F.sum("_n").cast("int").alias("n_found"), F.max("_spec").alias("last_spec"), F.array_sort(F.collect_list("e")).cast(_EVIDENCE).alias("evidence"))


def outcomes(docs: DataFrame, evidence: DataFrame, checks: list[str], confidence: Column, passed: Column | float, fix: Column | None = None) -> DataFrame:
    """(doc_id, check_id, status, confidence, fix, evidence) for every document and check: a violation where there is evidence, else a pass."""
    grid = docs.select("doc_id", F.explode(F.array(*[F.lit(c) for c in checks])).alias("check_id"))
    out = grid.join(evidence, ["doc_id", "check_id"], "left")
    bad = F.col("n_found").isNotNull()
    fixed = F.when(bad, F.lit(DEFAULT_FIX) if fix is None else fix)
    return out.select("doc_id", "check_id", F.when(bad, "violation").otherwise("pass").alias("status"), F.when(bad, confidence).otherwise(passed).cast("double").alias("confidence"), fixed.alias("fix"), "evidence")


def pattern_outcomes(docs: DataFrame, scoped: DataFrame, specs=D.PACK) -> DataFrame:
    """Outcomes of the pattern pack. The fix of the last pattern with a hit counts; a pattern without a fix leaves the one before it."""
    fix = F.lit(None).cast("string")
    carried: dict[str, str] = {}
    for detector, idx, _, _ in specs:
        carried[detector] = FIXES.get((detector, idx), carried.get(detector, DEFAULT_FIX))
        fix = F.when((F.col("check_id") == detector) & (F.col("last_spec") == idx), carried[detector]).otherwise(fix)
    found = gathered(evidence_rows(D.hits(scoped, specs)))
    return outcomes(docs, found, sorted({s[0] for s in specs}), D.confidence(F.col("n_found")), 0.98, fix)


def special_outcomes(docs: DataFrame, narrative: DataFrame, items: Callable[[], DataFrame], titles: Callable[[], DataFrame], paged: DataFrame, needed: Container[str] = SPECIAL) -> DataFrame | None:
    """Outcomes of those detectors with rules of their own that are ``needed``; None where none is. ``items`` gives the unique numbered defence statements, ``titles`` (doc_id, block_pos, block_id, text), both where a detector reads them; ``paged`` is (doc_id, has_pages)."""
    item = lambda rows: rows.withColumnRenamed("item", "quote")
    at = F.concat(F.lit("doc-b"), F.col("block_pos") + 1)
    hits = {"personal-pronouns": D.personal_pronouns, "praise-claims": D.praise_claims, "yo-letter": D.yo_letter, "numbered-list-capitalization": D.list_capitalization, "small-numerals": D.small_numerals, "dash-spacing": D.dash_spacing}
    parts = [evidence_rows(f(narrative)) for check, f in hits.items() if check in needed]
    parts += [evidence_rows(item(D.list_ending(narrative, numbered)), check) for check, numbered in (("numbered-list-ending", True), ("bullet-list-ending", False)) if check in needed]
    if "quote-consistency" in needed:
        parts.append(evidence_rows(D.quote_styles(narrative).filter("n_styles > 1").withColumns({"quote": F.col("match"), "block_id": at}), "quote-consistency"))
    defence = [c for c in DEFENCE if c in needed]
    if defence:
        checked = items().withColumns({"quote": F.concat(F.col("number").cast("string"), F.lit(". "), "text"), "block_id": at}).join(D.defense_checks(items()), ["doc_id", "number"])
        parts += [evidence_rows(checked.filter(bad), check) for check, bad in (("defense-punctuation", "bad_form"), ("defense-symbols", "has_symbols")) if check in defence]
    out = []
    if parts:
        found = gathered_by_block(together(parts))
        sure = F.when(F.col("check_id").isin(*CERTAIN), 1.0).when(F.col("check_id").isin("personal-pronouns", "praise-claims"), D.confidence(F.col("n_found"))).otherwise(0.99)
        clean = F.when(F.col("check_id").isin("dash-spacing", "quote-consistency"), 0.98).when(F.col("check_id").isin(*CERTAIN), 1.0).otherwise(0.99)
        rows = outcomes(docs, found, [c for c in SPECIAL if c in needed and c not in ("title-length", "spacing")], sure, clean)
        # pages lose spaces, so dashes are uncertain there; without items there is nothing to judge
        unsure = F.lit(False)
        if "dash-spacing" in needed:
            rows = rows.join(paged, "doc_id", "left")
            unsure = unsure | ((F.col("check_id") == "dash-spacing") & (F.col("status") == "violation") & F.col("has_pages"))
        if defence:
            rows = rows.join(items().select("doc_id").distinct().withColumn("_some", F.lit(True)), "doc_id", "left")
            unsure = unsure | (F.col("check_id").isin(*defence) & F.col("_some").isNull())
        out.append(rows.select("doc_id", "check_id", F.when(unsure, "uncertain").otherwise(F.col("status")).alias("status"), F.when(unsure, 0.0).otherwise(F.col("confidence")).alias("confidence"), F.when(~unsure, F.col("fix")).alias("fix"), "evidence"))
    if "title-length" in needed:
        length = D.title_length(docs.select("doc_id").join(titles().select("doc_id", "text"), "doc_id", "left"))
        out.append(stated(length, "title-length", F.when(F.col("status") == "uncertain", 0.2).when(F.col("status") == "pass", 0.98).otherwise(0.99)))
    if "spacing" in needed:
        out.append(stated(D.spacing(narrative, paged), "spacing", F.when(F.col("status") == "uncertain", 0.0).otherwise(1.0)))
    return together(out) if out else None


def stated(rows: DataFrame, check: str, confidence: Column | None = None) -> DataFrame:
    """Outcomes from (doc_id, status)."""
    sure = F.when(F.col("status").isin("uncertain", "not_applicable"), 0.0).otherwise(1.0) if confidence is None else confidence
    fix = F.when(F.col("status") == "violation", DEFAULT_FIX)
    return rows.select("doc_id", F.lit(check).alias("check_id"), "status", sure.cast("double").alias("confidence"), fix.alias("fix"), F.lit(None).cast(_EVIDENCE).alias("evidence"))


def judged(docs: DataFrame, checks: dict[str, tuple[DataFrame | None, DataFrame | None, str, str]]) -> DataFrame:
    """Outcomes of checks of structure, given for each (its evidence: doc_id, block_pos, block_id, quote; the documents that hold what it reads, or None for all; the status of the others; the status without evidence). All checks share the joins."""
    held = [evidence_rows(rows, name) for name, (rows, *_) in checks.items() if rows is not None]
    read = [rows.select("doc_id").distinct().withColumn("check_id", F.lit(name)) for name, (_, rows, *_) in checks.items() if rows is not None]
    out = docs.select("doc_id", F.explode(F.array(*[F.lit(c) for c in checks])).alias("check_id"))
    out = out.join(gathered(together(held), 10**6), ["doc_id", "check_id"], "left") if held else out.withColumns({"n_found": F.lit(None).cast("int"), "evidence": F.lit(None).cast(_EVIDENCE)})
    out = out.join(together(read).withColumn("_some", F.lit(True)), ["doc_id", "check_id"], "left") if read else out.withColumn("_some", F.lit(None).cast("boolean"))
    reads = F.col("_some").isNotNull() | F.col("check_id").isin(*[name for name, (_, rows, *_) in checks.items() if rows is None])
    missing = _lookup({name: c[2] for name, c in checks.items()}, F.col("check_id"))
    otherwise = _lookup({name: c[3] for name, c in checks.items()}, F.col("check_id"))
    status = F.when(~reads, missing).when(F.col("n_found").isNotNull(), "violation").otherwise(otherwise)
    out = out.withColumn("status", status)
    bad = F.col("status") == "violation"
    return out.select("doc_id", "check_id", "status", F.when(F.col("status").isin("uncertain", "not_applicable"), 0.0).otherwise(1.0).alias("confidence"), F.when(bad, DEFAULT_FIX).alias("fix"), F.when(bad, F.slice("evidence", 1, MOST)).alias("evidence"))


def structural_outcomes(docs: DataFrame, b: DataFrame, fields: DataFrame, items: Callable[[], DataFrame], titles: Callable[[], DataFrame], sections: DataFrame, wide: DataFrame, paged: DataFrame, known: DataFrame, needed: Container[str]) -> DataFrame | None:
    """Outcomes of those checks of structure that are ``needed``; None where none is. ``wide`` is the narrative of the term checks; ``known`` the known terms."""
    whole = b.select("doc_id", "block_pos", "block_id", "page", "type", "text")
    quoted = lambda rows: rows.withColumn("quote", F.col("text"))
    at = whole.select("doc_id", "block_pos", "block_id")
    field = lambda name: whole.join(fields.filter(F.col("field") == name).select("doc_id", "block_pos"), ["doc_id", "block_pos"], "left_semi")
    chapters, entries_ = field("chapter_headings"), field("bibliography")
    captions = whole.filter(S.is_caption(F.col("text"), F.col("type")))
    formulas = whole.filter("type = 'formula'")
    headings_read = {"chapter-heading-order", "terms:headings", "terms:any-or-headings", "terms:expansion-or-headings"}
    lines = X.heading_lines(whole, titles()) if any(c in needed for c in headings_read) else None
    unreferenced = quoted(X.unreferenced_objects(whole).join(at, ["doc_id", "block_pos"]))
    see = explode_matches(whole, "text", pattern(r"(?iu)\bсм\.\s*(?:рис|рисунок)\.?\s*\d+"), ("doc_id", "block_pos", "block_id", "text"))
    see = see.withColumn("quote", context_quote(F.col("text"), F.col("match_at"), F.length("match"), 80, 140))
    names = ["doc_id", "block_pos", "block_id", "quote"]
    conclusions = X.chapter_conclusions(whole, chapters).filter("status = 'violation'").select("doc_id", F.col("chapter_pos").alias("block_pos"))
    numbered = entries_.filter(F.col("text").rlike(pattern(r"(?m)(?:^|\n|\s)(\d{1,3})[.)]\s+(?=[А-ЯЁA-Z])")))
    missing = X.uncited_entries(whole, entries_).select("doc_id", F.col("number").alias("block_pos"), F.lit("bibliography").alias("block_id"), F.concat(F.lit("№ "), F.col("number").cast("string")).alias("quote"))
    each = {
        "chapters-new-page": lambda: (quoted(X.chapters_below_top(whole, chapters)), paged.filter("has_pages"), "uncertain", "pass"),
        "heading-format": lambda: (quoted(X.bad_headings(whole)), None, "", "pass"),
        "chapter-heading-order": lambda: (quoted(X.reversed_chapter_headings(lines).join(at, ["doc_id", "block_pos"])), None, "", "pass"),
        "caption-format": lambda: (quoted(X.caption_periods(whole)), captions, "uncertain", "uncertain"),
        "final-periods": lambda: (quoted(X.final_periods(whole)), None, "", "pass"),
        "formula-explanation": lambda: (None, formulas, "not_applicable", "uncertain"),
        "code-explanation": lambda: (quoted(X.unexplained_code(whole)), whole.filter(X.is_code(F.col("text"))), "not_applicable", "pass"),
        "reference-order": lambda: (unreferenced, X.object_keys(whole), "uncertain", "pass"),
        "reference-order-no-see": lambda: (see.select(*names).unionByName(unreferenced.select(*names)), None, "", "uncertain"),
        "chapter-conclusions": lambda: (quoted(whole.join(conclusions, ["doc_id", "block_pos"])), chapters, "uncertain", "pass"),
        "uncited": lambda: (missing, numbered, "uncertain", "pass"),
    }
    asked = {name: made() for name, made in each.items() if name in needed}
    parts = [judged(docs, asked)] if asked else []
    no_defense = X.without_defense(docs, sections, fields).withColumn("status", F.lit("violation"))
    e = T.entries(entries_)
    empty = docs.select("doc_id").join(e.select("doc_id").distinct().withColumn("_some", F.lit(True)), "doc_id", "left")

    def of_entries(rows: DataFrame) -> DataFrame:
        """Without an entry a check of the bibliography is uncertain."""
        return empty.join(rows.select("doc_id", "status"), "doc_id", "left").withColumn("status", F.when(F.col("_some").isNull(), "uncertain").otherwise(F.coalesce("status", F.lit("pass"))))

    def headings() -> DataFrame:
        in_headings = T.heading_terms(lines, known).select("doc_id").distinct().withColumn("_heading", F.lit(True))
        return docs.select("doc_id").join(in_headings, "doc_id", "left")

    findings = T.term_findings(wide, known)
    terms = lambda name: T.abbreviation_status(docs, findings, name)
    # the terms that want review are evidence of the first check, so they count here too
    either = F.when(F.col("_heading") | F.col("status").isin("violation", "uncertain"), "violation").otherwise("pass")
    single = {
        "positions-and-chapters": lambda: X.counts_match(items(), chapters, docs),
        "formula-numbering": lambda: X.formula_numbering(whole),
        "defense-section": lambda: docs.select("doc_id").join(no_defense, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("uncertain"))),
        "author-formats": lambda: of_entries(T.format_consistency(e)),
        "bibliography:junk": lambda: of_entries(T.entry_junk(e).select("doc_id", F.lit("violation").alias("status")).distinct()),
        "bibliography:pages": lambda: of_entries(T.page_ranges(e)),
        "initials": lambda: of_entries(T.initials_order(e)),
        "terms:expansion": lambda: terms("expansion"),
        "terms:translation": lambda: terms("translation"),
        "terms:any": lambda: terms("any"),
        "terms:headings": lambda: headings().withColumn("status", F.when(F.col("_heading"), "violation").otherwise("pass")),
        "terms:any-or-headings": lambda: terms("any").join(headings(), "doc_id").withColumn("status", F.when(F.col("_heading"), "violation").otherwise(F.col("status"))),
        "terms:expansion-or-headings": lambda: terms("expansion").join(headings(), "doc_id").withColumn("status", either),
        "unresolved": lambda: docs.select("doc_id", F.lit("uncertain").alias("status")),
        "none": lambda: docs.select("doc_id", F.lit("not_checked").alias("status")),
    }
    parts += [stated(made(), name, F.lit(0.0) if name == "none" else None) for name, made in single.items() if name in needed]
    return together(parts) if parts else None


def counted_texts(docs: DataFrame, narrative: DataFrame, items: Callable[[], DataFrame], titles: Callable[[], DataFrame], needed: Container[str]) -> DataFrame | None:
    """(doc_id, check_id, status, said): explanations that name what was counted or found, of the checks that are ``needed``; None where none is."""
    return together(made) if (made := [f(docs, narrative, items, titles) for check, f in COUNTED.items() if check in needed]) else None


def _title_counts(docs: DataFrame, narrative: DataFrame, items: Callable[[], DataFrame], titles: Callable[[], DataFrame]) -> DataFrame:
    n = D.title_length(docs.select("doc_id").join(titles().select("doc_id", "text"), "doc_id", "left")).filter("n_words is not null")
    words = F.col("n_words").cast("string")
    return n.select("doc_id", F.lit("title-length").alias("check_id"), "status", F.when(F.col("status") == "violation", F.concat(F.lit("В названии "), words, F.lit(" слов, что превышает рекомендуемый предел 13."))).otherwise(F.concat(F.lit("В названии "), words, F.lit(" слов — не более 13."))).alias("said"))


def _style_names(docs: DataFrame, narrative: DataFrame, items: Callable[[], DataFrame], titles: Callable[[], DataFrame]) -> DataFrame:
    place = F.create_map(*(x for k, (name, _) in enumerate(D.QUOTES) for x in (F.lit(name), F.lit(k))))[F.col("style")]
    styles = D.quote_styles(narrative).filter("n_styles > 1").withColumn("_s", F.struct("block_pos", place.alias("place"), _lookup(STYLE_NAMES, F.col("style")).alias("name")))
    named = F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["name"]), ", ")
    return styles.groupBy("doc_id").agg(named.alias("_n")).select("doc_id", F.lit("quote-consistency").alias("check_id"), F.lit("violation").alias("status"), F.concat(F.lit("В русскоязычном основном тексте обнаружено несколько типов кавычек: "), "_n", F.lit(".")).alias("said"))


def _item_counts(docs: DataFrame, narrative: DataFrame, items: Callable[[], DataFrame], titles: Callable[[], DataFrame]) -> DataFrame:
    return items().groupBy("doc_id").agg(F.count("*").cast("string").alias("_n")).select("doc_id", F.lit("defense-punctuation").alias("check_id"), F.lit("pass").alias("status"), F.concat(F.lit("Все "), "_n", F.lit(" распознанных положений начинаются с прописной буквы и заканчиваются точкой.")).alias("said"))


COUNTED = {"title-length": _title_counts, "quote-consistency": _style_names, "defense-punctuation": _item_counts}


def explained(found: DataFrame, said: DataFrame | None, asked: DataFrame) -> DataFrame:
    """Outcomes of rules with explanation and fix: what was counted, what the check says by its status, or, of patterns, the rule's requirement."""
    says = F.create_map(*(F.lit(x) for (check, status), text in SAID.items() for x in (f"{check}|{status}", text)))[F.concat_ws("|", "check_id", "status")]
    bad, pack = F.col("status") == "violation", F.col("check_id").isin(*FIXES_CHECKS)
    named = found.withColumn("said", F.lit(None).cast("string")) if said is None else found.join(said.hint("merge"), ["doc_id", "check_id", "status"], "left")
    text = F.coalesce("said", says, F.when(bad, F.col("requirement")), F.when(pack & (F.col("status") == "pass"), F.lit(PATTERN_PASSES)))
    rows = named.join(F.broadcast(asked.select("rule_id", "check_id", "requirement")), "check_id")
    fix = F.when(bad, F.coalesce(_lookup(FIX_OF, F.col("check_id")), F.col("fix")))
    return rows.select("doc_id", "rule_id", "check_id", "status", "confidence", text.alias("explanation"), fix.alias("fix"), "evidence")


def once(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """What ``make`` gives, made when it is first asked for."""
    held: list[DataFrame] = []

    def get() -> DataFrame:
        if not held:
            held.append(make())
        return held[0]

    return get


def check_catalogue(docs: DataFrame, b: DataFrame, rules: DataFrame, titles: DataFrame | Callable[[], DataFrame], sections: DataFrame, known: DataFrame, keep=lambda rows: rows, structural: bool = True) -> DataFrame:
    """(doc_id, rule_id, check_id, status, confidence, explanation, fix, evidence) of every document and every rule that a detector or a check of structure answers.

    ``b`` are blocks (see ``blocks.blocks``), best a written table, as the checks
    read them one by one, and ``keep`` does the same for what is derived from them
    (a table that is written, or ``DataFrame.persist``); ``rules`` have rule_id, mode,
    detector_id, category and requirement (see ``routing.with_meta``); ``titles`` are (doc_id, block_pos,
    block_id, page, type, text), or a function that finds them if a check reads them. Without ``structural`` only detectors are run.

    The checks that the rules ask for are collected first (a catalogue is small), and no other is run.
    """
    asked = rules.withColumn("check_id", check_of(F.col("rule_id"), F.col("mode"), F.col("detector_id"), F.col("category"), F.col("requirement"))).filter("check_id is not null")
    ids = [c for c in sorted({*FIXES_CHECKS, *SPECIAL, *STRUCTURAL_OF.values(), *BIBLIOGRAPHY_BY_ID.values(), "terms:any", "unresolved", "none"})]
    asked = asked.withColumn("check_id", F.when(F.col("check_id").isin(*ids), F.col("check_id")).otherwise("none"))
    needed = {r.check_id for r in asked.select("check_id").distinct().collect()}
    titles = once(titles if callable(titles) else lambda rows=titles: rows)
    fields = keep(B.fields(b))
    bib = fields.filter("field = 'bibliography'")
    narrative = keep(S.narrative(b, sections, bib))
    wide = S.narrative(b, sections, None, wide=True)

    def statements() -> DataFrame:
        return b.join(fields.filter("field = 'defense_statements'").select("doc_id", "block_pos"), ["doc_id", "block_pos"], "left_semi")

    items = once(lambda: keep(T.unique_items(T.numbered_items(statements()))))
    paged = docs.select("doc_id").join(b.groupBy("doc_id").agg(F.bool_or(F.col("page").isNotNull()).alias("has_pages")), "doc_id", "left").fillna(False)
    # three plans and not one: the optimizer looks at a whole plan again after each of its stages
    found = []
    specs = [s for s in D.PACK if s[0] in needed]
    if specs:
        scopes = {scope for *_, scope in specs}
        found.append(pattern_outcomes(docs, S.scoped(b, fields, titles() if "title" in scopes else None, narrative, only=scopes), specs))
    found.append(special_outcomes(docs, narrative, items, titles, paged, needed))
    if structural:
        found.append(structural_outcomes(docs, b, fields, items, titles, sections, wide, paged, known, needed))
    found = [keep(rows) for rows in found if rows is not None]
    said = counted_texts(docs, narrative, items, titles, needed)
    none = docs.select("doc_id", F.lit("").alias("check_id"), F.lit("").alias("status"), F.lit(0.0).alias("confidence"), F.lit("").alias("fix"), F.lit(None).cast(_EVIDENCE).alias("evidence")).limit(0)
    return explained(together(found) if found else none, None if said is None else keep(said), asked)


FIXES_CHECKS = tuple(sorted({s[0] for s in D.PACK}))
