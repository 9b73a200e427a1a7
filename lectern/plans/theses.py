"""A corpus of theses in Russian, made from ``customer``, and the queries that run the whole catalogue over it.

The test tables hold no Cyrillic, so each customer becomes a short thesis whose
faults follow from its key: what a rule must find is known by arithmetic, and the
SQL beside a query says it so. Customer k has a fault of number p where k % p is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.folders import shared_folder
from lectern.operators import blocks as B
from lectern.operators import detectors as D
from lectern.operators import terms as T
from lectern.plans import checking as C
from lectern.plans import routing as P
from lectern.sources.files import dealt

#: Paragraphs in order: text, or (divisor, text with the fault, text without it).
PARTS: list[str | tuple[int, str, str]] = [
    (3, "Разработка и исследование повышения качества систем управления", "Метод анализа данных в системах управления"),
    (4, "Цель работы состоит в разработать метод анализа", "Цель работы состоит в повышении точности прогноза"),
    (5, "Мы предлагаем решение поставленной проблемы.", "Предложено решение поставленной проблемы."),
    (7, "Рассмотрено 5 методов обработки сигналов.", "Рассмотрено пять методов обработки сигналов."),
    (6, "Для этого нужно выполнить расчёт. Это значит, что он верен.", "Для этого необходимо выполнить расчёт."),
    (8, "1. Собрать данные; 2. Обучить сеть.", "1. Собрать данные. 2. Обучить сеть."),
    (9, "1. обучить сеть на данных.", "Сеть обучена на данных."),
    (10, "– обучить сеть", "– обучить сеть;"),
    (11, "Слово «сеть» и слово “выборка” различны.", "Слово «сеть» и слово «выборка» различны."),
    (12, "Сеть - это описание объекта.", "Сеть – это описание объекта."),
    (13, "Доля составила 45% от общего числа.", "Доля составила 45 % от общего числа."),
    (14, "Получен уникальный итог наблюдений.", "Получен обычный итог наблюдений."),
    (15, "Это еще не всё, что известно.", "Это ещё не всё, что известно."),
    (16, "Устройство дано на см. рис. 7 ниже.", "Устройство дано ниже."),
    (17, "Очевидно, что сеть работает.", "Сеть работает."),
    "Глава 1. Обзор подходов",
    (18, "Схема приведена ниже.", "Схема приведена на рисунке 1 и ниже."),
    (19, "Рисунок 1 – Схема сети.", "Рисунок 1 – Схема сети"),
    (20, "y = a + b (1).", "y = a + b (1)"),
    (21, "Применяется LLM для анализа.", "Применяется большая языковая сеть (LLM) для анализа."),
    (22, "Получено следующее.", "Выводы по главе"),
    "1. Подход выбран верно.",
    (23, "```\nx = 1\n```", "Ход вычислений описан."),
    (25, "Подход известен давно.", "Подход известен давно [1, 2]."),
    (26, "Он был создан впервые.", "Он был создан давно."),
    (28, "Положения к защите не даны.", "Положения, выносимые на защиту:"),
    (27, "1. метод обработки данных по шагам", "1. Метод обработки данных по шагам."),
    "Список литературы",
    (29, "1. Иванов И.И. Обзор сетей и их свойств. 2020. Isbn 5. pp. 3-9.", "1. Иванов И.И. Обзор сетей и их свойств. 2020. pp. 3-9."),
    (31, "2. Анализ данных и сетей / П. Петров. 2021. P. 12-25.", "2. Петров П.П. Анализ данных и сетей. 2021. pp. 12-25."),
]

_BAD = "CASE WHEN k % {} = 0 THEN 'violation' ELSE 'pass' END"
#: Rules (id, key, category, requirement) and what each must give, in SQL over k.
RULES: list[tuple[str, str, str, str, str]] = [
    ("CORE-3-1", "core:3.1", "Стиль", "Безличное изложение", _BAD.format(5)),
    ("CORE-3-2", "core:3.2", "Стиль", "Числительные словами", _BAD.format(7)),
    ("CORE-3-3", "core:3.3", "Стиль", "Прописная буква в пункте", _BAD.format(9)),
    ("CORE-3-4", "core:3.4", "Стиль", "Окончание пункта", _BAD.format(8)),
    ("CORE-3-5", "core:3.5", "Стиль", "Замены", _BAD.format(6)),
    ("CORE-3-6", "core:3.6", "Стиль", "Очевидность", _BAD.format(17)),
    ("CORE-3-7", "core:3.7", "Стиль", "Оценки", _BAD.format(14)),
    ("CORE-5-5", "core:5.5", "Оформление", "Знаки", _BAD.format(12)),
    ("CORE-5-6", "core:5.6", "Оформление", "Знаки цитат", _BAD.format(11)),
    ("CORE-5-7", "core:5.7", "Оформление", "Отбивка", _BAD.format(13)),
    ("CORE-6-1", "core:6.1", "Имя", "Имя работы", _BAD.format(3)),
    ("CORE-6-2", "core:6.2", "Имя", "Имя работы", _BAD.format(3)),
    ("CORE-6-3", "core:6.3", "Имя", "Имя работы", "'pass'"),
    ("CORE-11-1", "core:11.1", "Язык", "Буквы", _BAD.format(15)),
    ("CORE-11-4", "core:11.4", "Язык", "Именно", "'pass'"),
    ("CORE-17", "core:17", "Язык", "Смотри", _BAD.format(16)),
    ("CORE-20", "core:20", "Язык", "Новое", _BAD.format(26)),
    ("SOFT-031", "soft:31", "Оформление", "Окончание строки", _BAD.format(10)),
    ("SOFT-053", "soft:53", "Имя", "Задание", _BAD.format(4)),
    ("SOFT-029", "soft:29", "Оформление", "Окончание заглавия", _BAD.format(19)),
    ("CORE-1-4", "x:1", "Прочее", "Текст", "CASE WHEN k % 28 = 0 THEN 'uncertain' WHEN k % 27 = 0 THEN 'uncertain' ELSE 'pass' END"),
    ("CORE-9-2", "core:9.2", "Прочее", "Записи", _BAD.format(29)),
    ("CORE-9-3", "core:9.3", "Прочее", "Записи", _BAD.format(31)),
    ("CORE-1-6", "core:1.6", "Прочее", "Текст", "CASE WHEN k % 28 = 0 OR k % 27 = 0 THEN 'uncertain' ELSE 'pass' END"),
    ("CORE-4-1", "core:4.1", "Прочее", "Обозначения", "CASE WHEN k % 21 = 0 THEN 'violation' ELSE 'pass' END"),
    ("CORE-4-2", "core:4.2", "Прочее", "Обозначения", "'pass'"),
    ("CORE-4-3", "core:4.3", "Прочее", "Обозначения", "CASE WHEN k % 21 = 0 THEN 'violation' ELSE 'pass' END"),
    ("CORE-12", "core:12", "Прочее", "Обозначения", "CASE WHEN k % 21 = 0 THEN 'violation' ELSE 'pass' END"),
    ("CORE-5-3", "core:5.3", "Прочее", "Страницы", "'uncertain'"),
    ("CORE-5-4", "core:5.4", "Прочее", "Заглавия", _BAD.format(19)),
    ("SOFT-120", "soft:120", "Прочее", "Заглавия", "'pass'"),
    ("CORE-7-1", "core:7.1", "Прочее", "Отсылки", _BAD.format(18)),
    ("SOFT-064", "soft:64", "Прочее", "Отсылки", "CASE WHEN k % 18 = 0 OR k % 16 = 0 THEN 'violation' ELSE 'uncertain' END"),
    ("CORE-7-2", "core:7.2", "Прочее", "Подписи", "CASE WHEN k % 19 = 0 THEN 'violation' ELSE 'uncertain' END"),
    ("CORE-7-4", "core:7.4", "Прочее", "Номера", "CASE WHEN k % 20 = 0 THEN 'violation' ELSE 'uncertain' END"),
    ("CORE-7-5", "core:7.5", "Прочее", "Пояснения", "'uncertain'"),
    ("CORE-8-1", "core:8.1", "Прочее", "Итоги", _BAD.format(22)),
    ("CORE-9-1", "core:9.1", "Прочее", "Записи", _BAD.format(31)),
    ("CORE-9-4", "core:9.4", "Прочее", "Записи", _BAD.format(25)),
    ("CORE-13", "core:13", "Прочее", "Вставки", "CASE WHEN k % 23 = 0 THEN 'violation' ELSE 'not_applicable' END"),
    ("CORE-18", "core:18", "Прочее", "Записи", _BAD.format(31)),
    ("CORE-19", "core:19", "Прочее", "Точки", _BAD.format(19)),
    ("SOFT-139", "soft:139", "Прочее", "Обозначения", "'uncertain'"),
    ("CORE-14", "core:14", "Прочее", "Смысл", "NULL"),
]


def part(text: str | tuple[int, str, str], k: Column) -> Column:
    return F.lit(text) if isinstance(text, str) else F.when(k % text[0] == 0, text[1]).otherwise(text[2])


def theses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text)"""
    k = F.col("doc_id")
    rows = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id")), "doc_id", 2000)
    return rows.select("doc_id", F.concat_ws("\n\n", *[part(t, k) for t in PARTS]).alias("text"))


def rule_table(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([r[:4] for r in RULES], "rule_id string, key string, category string, requirement string")
    # a routing map may send a rule without a detector of its own to one
    return P.with_meta(rows).withColumn("mode", F.when(F.col("rule_id") == "CORE-1-4", "deterministic").otherwise(F.col("mode")))


def expected_sql(columns: str) -> str:
    """The results that arithmetic asks for, as rows (doc_id, rule_id, status)."""
    rules = " UNION ALL ".join(f"SELECT k AS doc_id, '{r[0]}' AS rule_id, {r[4]} AS status FROM theses" for r in RULES if r[4] != "NULL")
    return f"WITH theses AS (SELECT c_custkey AS k FROM customer), results AS ({rules}) {columns}"


#: Settings by which Spark picks tables to send to all tasks.
_BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, as many plans read them; a lost executor costs nothing.

    Nothing but what is marked for it is broadcast on the way: texts of theses are
    alike, so files are small and Spark would take tables that grow with the
    theses for small ones, and gather many at once in the driver.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark, 'catalogue')}/rows"
    before = {k: spark.conf.get(k, None) for k in _BROADCASTS}
    try:
        for k in _BROADCASTS:
            spark.conf.set(k, "-1")
        rows.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(rows.schema).parquet(path)


def catalogue(spark: SparkSession, sf_dir: str, structural: bool = True, only: list[str] | None = None) -> DataFrame:
    """Results of all rules over the theses, or of those in ``only``, their titles found by score."""
    docs = theses(spark, sf_dir)
    b = kept(B.blocks(docs))

    def titles() -> DataFrame:
        best = T.best_titles(b, T.document_lexicons(b)).select("doc_id", "block_pos", "text")
        return kept(best.join(b.drop("text"), ["doc_id", "block_pos"]))

    none = spark.createDataFrame([], "doc_id long, section_id string, type string, label string, state string, start_pos int, end_pos int")
    rules = rule_table(spark)
    rules = rules if only is None else rules.filter(F.col("rule_id").isin(*only))
    return C.check_catalogue(docs.select("doc_id"), b, rules, titles, none, T.known_terms(spark), kept, structural)


def catalogue_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).select("doc_id", "rule_id", "status")


#: Rules whose evidence is one block whole, found once: (rule, the part of PARTS, confidence of a violation, of a pass, what is added to the quote).
ONCE = [
    ("CORE-3-1", 2, 0.95, 0.99, ""), ("CORE-3-2", 3, 1.0, 1.0, ""), ("CORE-3-3", 6, 1.0, 1.0, ""), ("CORE-3-5", 4, 0.99, 0.98, ""), ("CORE-3-6", 14, 0.95, 0.98, ""), ("CORE-3-7", 11, 0.95, 0.99, ""), ("CORE-5-5", 9, 1.0, 0.98, ""),
    ("CORE-11-1", 12, 0.99, 0.99, " [найдено: «еще»; ожидается: «ещё»]"), ("CORE-17", 13, 0.95, 0.98, ""), ("CORE-20", 24, 0.95, 0.98, ""), ("SOFT-031", 7, 1.0, 1.0, ""),
]


def catalogue_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands beside the status: confidence, explanation, fix, and each piece of evidence, of the detectors' rules whose evidence is known by arithmetic."""
    rows = catalogue(spark, sf_dir, structural=False, only=[r[0] for r in ONCE])
    return rows.select("doc_id", "rule_id", "status", "confidence", "explanation", "fix", F.posexplode_outer("evidence").alias("place", "e")).select("doc_id", "rule_id", "status", "confidence", "explanation", "fix", "place", "e.block_pos", "e.block_id", "e.quote")


def evidence_sql() -> str:
    rule = {r[0]: r for r in RULES}
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    each = []
    for rule_id, n, sure, clean, more in ONCE:
        p, text, _ = PARTS[n]
        check = P.DETECTOR_OF[rule[rule_id][1]]
        last = max((i for d, i, *_ in D.PACK if d == check), default=0)
        fix = C.FIX_OF.get(check) or C.FIXES.get((check, 1 if rule_id == "CORE-3-5" else last), C.DEFAULT_FIX)
        bad = C.SAID.get((check, "violation"), rule[rule_id][3])
        good = C.SAID.get((check, "pass"), C.PATTERN_PASSES)
        each.append(
            f"SELECT k AS doc_id, '{rule_id}' AS rule_id, CASE WHEN bad THEN 'violation' ELSE 'pass' END AS status, CASE WHEN bad THEN {sure} ELSE {clean} END::DOUBLE AS confidence, CASE WHEN bad THEN {quote(bad)} ELSE {quote(good)} END AS explanation, "
            f"CASE WHEN bad THEN {quote(fix)} END AS fix, CASE WHEN bad THEN 0 END::INTEGER AS place, CASE WHEN bad THEN {n} END::INTEGER AS block_pos, CASE WHEN bad THEN 'doc-b{n + 1}' END AS block_id, CASE WHEN bad THEN {quote(text + more)} END AS quote FROM (SELECT k, k % {p} = 0 AS bad FROM theses)"
        )
    # a second item of the list in small letters stands among the statements
    each.append(f"SELECT k, 'CORE-3-3', 'violation', 1.0::DOUBLE, {quote(C.SAID['numbered-list-capitalization', 'violation'])}, {quote(C.FIX_OF['numbered-list-capitalization'])}, 1, 26, 'doc-b27', {quote(PARTS[26][1])} FROM theses WHERE k % 27 = 0")
    return "WITH theses AS (SELECT c_custkey AS k FROM customer) " + " UNION ALL ".join(each)


QUERIES = {"catalogue_results": catalogue_results, "catalogue_evidence": catalogue_evidence}
ORACLES = {"catalogue_results": expected_sql("SELECT doc_id, rule_id, status FROM results"), "catalogue_evidence": evidence_sql()}
