"""Micro-fixtures of the engine's operators, in Russian as the patterns are; expected values follow from the definitions."""

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import compact, context_quote, explode_matches, norm_text, normalize, pattern, tokens
from lectern.operators import blocks as B
from lectern.operators import detectors as D
from lectern.operators import scopes as S
from lectern.operators import sections as M
from lectern.operators import structural as X
from lectern.operators import terms as T
from lectern.plans import jobs as J
from lectern.plans import results as R
from lectern.plans import provider as V
from lectern.plans import routing as P
from lectern.sources import files as files_


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def block_rows(spark, texts, doc=1, pages=None):
    rows = [(doc, i, f"doc-b{i + 1}", (pages or [None] * len(texts))[i], t) for i, t in enumerate(texts)]
    b = spark.createDataFrame(rows, "doc_id long, block_pos int, block_id string, page int, text string")
    return b.withColumn("type", B.classify(F.col("text"))).withColumn("location", F.lit("Документ"))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Таблица 3.1 – Параметры", "caption"),
        ("1.2 Методы анализа", "heading"),
        ("- пункт списка", "list"),
        ("y = a + b (3.1)", "formula"),
        ("A = B + C (3.1)", "heading"),
        ("12. Иванов И.И. Название статьи длинное. pp. 12-25", "list"),
        ("[12] Иванов И.И. Название статьи длинное. pp. 12-25", "bibliography"),
        ("Рисовать схемы просто", "caption"),
        ("Обычный абзац.", "paragraph"),
        ("ВВЕДЕНИЕ", "heading"),
    ],
)
def test_classify(spark, text, kind):
    assert one(spark, B.classify(F.col("t")), t=text) == kind


def test_blocks_number_short_ones_away_and_pack_long_ones(spark):
    long = " ".join(["Это предложение номер такой-то, оно довольно длинное и кончается точкой."] * 60)
    df = spark.createDataFrame([(1, f"Первый.\n\nx\n\nВторой   абзац\n\n{long}"), (2, None), (3, "")], "doc_id long, text string")
    rows = B.blocks(df).orderBy("doc_id", "block_pos").collect()
    assert [r.block_id for r in rows[:2]] == ["doc-b1", "doc-b2"] and rows[1].text == "Второй абзац"
    packed = [r.text for r in rows[2:]]
    assert len(packed) > 1 and all(len(t) <= 1800 for t in packed) and " ".join(packed) == long
    assert {r.doc_id for r in rows} == {1}


def test_text_forms(spark):
    assert one(spark, norm_text(F.col("t")), t="  «Ещё»\n раз ") == '"еще" раз'
    assert one(spark, compact(F.col("t"), 6), t="abc defgh") == "abc d…"
    assert one(spark, normalize(F.col("t")), t="a \r\n\n\n\n b​ ") == "a\n\n b"
    assert one(spark, F.array_join(tokens(F.col("t")), " "), t="Ёлка и ёлка для метода") == "елка метода"
    assert one(spark, context_quote(F.col("t"), F.lit(3), F.lit(2), 2, 2), t="abcdefgh") == "bcdefg"


def test_matches_keep_places_and_boundaries_know_letters(spark):
    df = spark.createDataFrame([(1, "мы и мыло, мы")], "id int, text string")
    rows = explode_matches(df, "text", pattern(r"(?iu)\bмы\b"), ("id",)).orderBy("match_idx").collect()
    assert [(r.match_idx, r.match, r.match_at) for r in rows] == [(0, "мы", 0), (1, "мы", 11)]
    assert explode_matches(df, "text", pattern(r"\bмы\b", "ascii"), ("id",)).count() == 0


def test_detectors(spark):
    rows = block_rows(spark, ["Мы разработали алгоритм.", "Использовано 5 методов.", "Это еще раз за счет метода.", "Здесь нужно то есть.", 'Он сказал «да нет» и "no".'])
    assert D.personal_pronouns(rows).count() == 1
    assert D.small_numerals(rows).select("match").first()["match"] == "5 методов"
    assert {r.match for r in D.yo_letter(rows).collect()} == {"еще", "за счет"}
    styles = {r.style: r.n_styles for r in D.quote_styles(rows).collect()}
    assert styles == {"guillemets": 2, "straight": 2}
    scoped = rows.withColumn("scope", F.lit("all"))
    got = {r.detector_id for r in D.first_hits(D.hits(scoped, D.PACK)).collect()}
    assert {"lexical-replacements", "to-est", "colon-and-to-est"} <= got
    v = D.verdicts(rows.select("doc_id").distinct(), D.first_hits(D.hits(scoped, D.PACK)), ["to-est", "jargon"])
    assert {(r.detector_id, r.status) for r in v.collect()} == {("to-est", "violation"), ("jargon", "pass")}


def test_pack_compiles_and_titles(spark):
    text = block_rows(spark, ["просто текст"]).withColumn("scope", F.explode(F.array(*[F.lit(s) for s in ("all", "title", "goal", "headings", "bibliography")])))
    assert D.hits(text, D.PACK).count() == 0
    t = spark.createDataFrame([(1, "слово " * 14), (2, "слово " * 13), (3, None)], "doc_id long, text string")
    assert [r.status for r in D.title_length(t).orderBy("doc_id").collect()] == ["violation", "pass", "uncertain"]


def test_list_endings_dashes_spacing(spark):
    rows = block_rows(spark, ["1. Метод; 2. Алгоритм;", "- пункт без точки", "слово - слово", "И.И.Иванов и 5%"])
    assert D.list_ending(rows, True).count() == 2 and D.list_ending(rows, False).count() == 1
    assert D.dash_spacing(rows).count() == 1
    paged = spark.createDataFrame([(1, False)], "doc_id long, has_pages boolean")
    assert D.spacing(rows, paged).first()["status"] == "violation"


def test_captions_and_references(spark):
    assert one(spark, S.is_caption(F.col("t"), F.lit("caption")), t="Рис. 5 – Схема") is False
    assert one(spark, S.is_caption(F.col("t"), F.lit("caption")), t="Рисунок 5 – Схема") is True
    b = block_rows(spark, ["Введение", "На рисунке 1 показано.", "Рисунок 1 – Схема", "Рисунок 2 – Другая", "Заключение", "Рисунок 1 – Повтор"])
    assert sorted((r.block_pos, r.key) for r in X.unreferenced_objects(b).collect()) == [(3, "рис:2"), (5, "рис:1")]


@pytest.mark.parametrize(("bracket", "numbers"), [("1, 3–5", [1, 3, 4, 5]), ("1–500", []), ("7", [7])])
def test_citation_numbers(spark, bracket, numbers):
    assert one(spark, X.citation_numbers(F.col("t")), t=bracket) == numbers


def test_citations_code_conclusions(spark):
    b = block_rows(spark, ["Текст [1, 3].", "1. Иванов И. Статья", "2. Петров П. Книга"])
    bib = b.filter("block_pos > 0")
    assert [r.number for r in X.uncited_entries(b, bib).collect()] == [2]
    code = block_rows(spark, ["Просто", "import a\nimport b", "Ниже листинг", "import a\nimport b"])
    assert [r.block_pos for r in X.unexplained_code(code).collect()] == [1]
    c = block_rows(spark, ["Глава 1. А", "Выводы", "1. Первый вывод", "Глава 2. Б", "текст"])
    got = X.chapter_conclusions(c, c.filter("text like 'Глава%'")).orderBy("chapter_pos").collect()
    assert [r.status for r in got] == ["pass", "violation"]


def test_terms(spark):
    b = block_rows(spark, ["большая языковая модель (LLM) и API", "снова LLM и XYZ, РФ, IV"])
    got = {r.term: r.status for r in T.term_findings(b, T.known_terms(spark)).collect()}
    assert got == {"LLM": "ok", "API": "missing_expansion", "XYZ": "review"}
    docs = b.select("doc_id").distinct()
    assert T.abbreviation_status(docs, T.term_findings(b, T.known_terms(spark)), "expansion").first()["status"] == "violation"


@pytest.mark.parametrize(("authors", "kind"), [("Иванов И.И.", "surname_initials"), ("И. Иванов", "initials_surname"), ("И.И. Иванов", "unknown"), ("", "unknown")])
def test_author_format(spark, authors, kind):
    assert one(spark, T.author_format(F.col("t")), t=authors) == kind


def test_entries_and_items(spark):
    b = block_rows(spark, ["1. Иванов И.И. Статья / Иванов И.И. // Журнал. ISBN 5. 2. Петров П. Книга. P. 4-5", "Без номера, но длинная запись тут"])
    e = T.entries(b)
    assert [(r.number, r.raw[:9]) for r in e.orderBy("block_pos", "entry_idx").collect()] == [(1, "1. Иванов"), (2, "2. Петров"), (None, "Без номер")]
    assert {r.junk_id for r in T.entry_junk(e).collect()} == {"isbn"}
    assert T.page_ranges(e).first()["status"] == "violation"
    items = T.numbered_items(block_rows(spark, ["Положения\n1. Первое положение.", "2. Второе.", "1. Первое положение, длиннее прежнего."]))
    got = T.unique_items(items).orderBy("number").collect()
    assert [(r.number, r.block_pos) for r in got] == [(1, 2), (2, 1)]


def test_segment():
    counts = {"метод": 5, "анализа": 7, "данных": 9}
    assert T.segment("Методанализаданных", counts) == "Метод анализа данных"
    assert T.segment("неизвестное", counts) is None


def test_sections(spark):
    b = block_rows(spark, ["Введение", "текст введения", "Глава 1", "текст главы"])
    raw = '```json\n{"sections":[{"type":"chapter","startBlockId":"doc-b3","endBlockId":"doc-b4","quote":"Текст  главы","confidence":2},{"type":"x","startBlockId":"doc-b1","endBlockId":"doc-b2"},{"type":"introduction","startBlockId":"doc-b1","endBlockId":"doc-b2","state":"ambiguous"},{"type":"goal","startBlockId":"doc-b2","endBlockId":"doc-b1"}],"issues":[]}\n```'
    sections, bad = M.place_sections(M.parse_answer(spark.createDataFrame([(1, raw)], "doc_id long, raw string")), b)
    got = sections.orderBy("section_id").collect()
    assert [(r.section_id, r.type, r.confidence, r.state) for r in got] == [("section-1", "introduction", 0.5, "ambiguous"), ("section-2", "chapter", 1.0, "confirmed")]
    assert {r.warning for r in bad.collect()} == {"unknown_type", "invalid_bounds"}
    quotes = {r.section_id: r.quote for r in M.materialize(sections, b).collect()}
    assert quotes["section-2"] == "Текст  главы" and quotes["section-1"] is None
    issues = M.map_issues(b.select("doc_id").distinct(), sections)
    assert {r.code for r in issues.collect()} == {"missing_conclusion", "missing_goal", "missing_tasks", "missing_defense_statements", "ambiguous_section"}
    assert M.map_status(b.select("doc_id").distinct(), issues).first()["status"] == "partial"


def test_trimming(spark):
    rows = [(1, "s", "goal", 0, "Преамбула. Цель работы. Создать метод."), (1, "s", "goal", 1, "И ещё. Задачи работы. Раз"), (1, "t", "goal", 2, "нет метки")]
    got = M.trimmed(spark.createDataFrame(rows, "doc_id long, section_id string, type string, block_pos int, text string")).orderBy("block_pos").collect()
    assert got[2].text == "нет метки" and got[0].text.endswith("Создать метод.") and "Преамбула" not in got[0].text and "Задачи" not in got[1].text


def test_routing(spark):
    rules = spark.createDataFrame([("a", "title", "semantic", None), ("b", "document", "semantic", None), ("c", "document", "structural", None), ("d", "document", "semantic", "x"), ("e", "defense", "manual", None)], "rule_id string, scope string, mode string, detector_id string")
    got = {r.rule_id: (r.strategy, r.exhaustive) for r in P.strategies(rules).collect()}
    assert got == {"a": ("llm", True), "b": ("llm", False), "c": ("structural", False), "d": ("deterministic", False), "e": ("manual", False)}
    blocks = spark.createDataFrame([(1, "s1", "title", "confirmed", 0, "b1", "Название"), (1, "s2", "introduction", "confirmed", 1, "b2", "Введение"), (1, "s3", "chapter", "ambiguous", 2, "b3", "Выводы")], "doc_id long, section_id string, type string, state string, block_pos int, block_id string, text string")
    frags = P.fragments(blocks)
    ids = {r.fragment_id for r in frags.select("fragment_id").distinct().collect()}
    assert {"s1", "s2", "s3", "s3-conclusions", "virtual-title_goal", "virtual-scientific_core"} <= ids
    routed = {(r.rule_id, r.fragment_id): r.exhaustive for r in P.routed(P.strategies(rules), frags).collect()}
    assert routed == {("a", "s1"): True, ("b", "s2"): False, ("b", "s3"): False}
    assert one(spark, P.result_kind(F.col("t")), t="1. Метод анализа") == "method"
    assert one(spark, P.scope(F.lit("Положения"), F.col("t"), F.lit("core:1.1")), t="Положения, выносимые на защиту") == "defense_statements"


def test_fragment_results_and_aggregate(spark):
    asked = spark.createDataFrame([(1, f, "r", c) for f, c in (("f1", True), ("f2", False), ("f3", True))], "doc_id long, fragment_id string, rule_id string, complete boolean")
    answers = spark.createDataFrame([(1, "f1", "r", 0, "violation"), (1, "f2", "r", 0, "pass"), (1, "f3", "r", 0, "pass"), (1, "f3", "r", 1, "odd")], "doc_id long, fragment_id string, rule_id string, answer_idx int, status string")
    claims = spark.createDataFrame([(1, "f1", "r", 0, "b1", "abc"), (1, "f1", "r", 1, "b1", "нет такого")], "doc_id long, fragment_id string, rule_id string, evidence_idx int, block_id string, quote string")
    blocks = spark.createDataFrame([(1, "b1", "abcdef")], "doc_id long, block_id string, text string")
    ev = R.verified_evidence(claims, blocks)
    assert ev.count() == 0
    got = R.fragment_results(asked, answers, ev)
    assert [(r.status, r.evidence_status) for r in got.orderBy("fragment_id").collect()] == [("uncertain", "rejected"), ("uncertain", "not_required"), ("uncertain", "not_required")]
    routed = asked.select("doc_id", "rule_id", "fragment_id", F.lit(True).alias("exhaustive"), F.lit(True).alias("allow_pass"))
    assert R.aggregate_rules(routed, got).first()["status"] == "uncertain"
    every = got.withColumn("status", F.lit("pass"))
    assert R.aggregate_rules(routed, every).first()["status"] == "pass"
    na = got.withColumn("status", F.lit("not_applicable"))
    assert R.aggregate_rules(routed, na).first()["status"] == "uncertain"


def test_consistency_scores_report(spark):
    rows = [(1, "CORE-18", "pass"), (1, "CORE-9-1", "uncertain"), (1, "CORE-4-1", "pass"), (1, "CORE-4-3", "violation"), (2, "x", "not_checked")]
    r = spark.createDataFrame([(*x, i, "major", 3.0, "core", None) for i, x in enumerate(rows)], "doc_id long, rule_id string, status string, rule_order int, severity string, weight double, layer string, detector_id string")
    fixed = R.consistent(r)
    assert {x.rule_id: x.status for x in fixed.filter("doc_id = 1").collect()}["CORE-18"] == "uncertain"
    assert {(x.rule_id, x.status) for x in R.consistent(fixed.drop("conflicts")).collect()} == {(x.rule_id, x.status) for x in fixed.collect()}
    s = {x.doc_id: x for x in R.scores(r).collect()}
    assert s[1].coverage == 0.75 and s[1].score == 50 and s[1].provisional and s[2].score is None
    groups = {x.group_key: (x.status, x.weight) for x in R.score_groups(r).filter("doc_id = 1").collect()}
    assert groups["family:CORE-4-1|CORE-4-3|CORE-12"] == ("violation", 3.0)
    rules = spark.createDataFrame([(x[1], "t|x") for x in rows], "rule_id string, title string")
    text = R.markdown(R.report_lines(r, rules, R.scores(r))).filter("doc_id = 1").first()["text"]
    assert text.index("violation") < text.index("## pass") and "t\\|x" in text


def test_jobs_and_user_rules(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, s string")
    assert {r.k: r.s for r in J.latest(e, "k", ("at",), ("s",)).collect()} == {1: "b", 2: "c"}
    state, progress = J.recovered(F.col("t"))
    assert one(spark, state, t="checking") == "queued_check" and one(spark, progress, t="mapping") == 0
    u = spark.createDataFrame([(1, "коротко\nДостаточно длинное правило\r\nЕщё одно правило")], "doc_id long, text string")
    assert [r.rule_id for r in files_.user_rules(u).orderBy("rule_id").collect()] == ["USR-01", "USR-02"]
    assert one(spark, R.retry_class(F.lit(429), F.col("t")), t="daily limit") == "fail"


def test_rule_files_and_docx(spark, tmp_path):
    (tmp_path / "core.csv").write_text('Group,Number,Requirement,Correct,Incorrect\n"Группа 1. Стиль",1.1,"Писать ""так"", а не иначе.",–,плохо\nx,,y,,\n', encoding="utf-8")
    r = files_.read_core_rules(spark, str(tmp_path / "core.csv")).collect()
    assert len(r) == 1 and (r[0].rule_id, r[0].category, r[0].correct, r[0].incorrect) == ("CORE-1-1", "Стиль", None, "плохо") and '"так"' in r[0].requirement
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Раз</w:t></w:r></w:p><w:p><w:r><w:t>Два</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(b"not a zip file")
    got = {x.path[-6:]: x for x in files_.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "Раз\n\nДва" and got["b.docx"].warning


def test_messages_and_answers(spark):
    frags = spark.createDataFrame([(1, "f", True, 0, "b1", "первый блок"), (1, "f", True, 1, "b2", "второй блок")], "doc_id long, fragment_id string, complete boolean, block_pos int, block_id string, text string")
    rules = spark.createDataFrame([("CORE-2-3", "Наука", "Назвать аналоги"), ("x", "Стиль", "Писать ясно")], "rule_id string, category string, requirement string")
    assigned = P.packets(spark.createDataFrame([(1, "f", "CORE-2-3"), (1, "f", "x")], "doc_id long, fragment_id string, rule_id string"), 12)
    asked = V.check_messages(assigned, frags, rules, R.required_items(spark))
    text = asked.first()["message"]
    assert text.index("BLOCK b1") < text.index("BLOCK b2") < text.index("RULE CORE-2-3") and "analogs, prototype" in text

    def call(message):
        if "BLOCK b1" not in message:
            raise ValueError("no block")
        return '{"results":[{"ruleId":"x","status":"violation","evidence":[{"blockId":"b2","quote":"Второй  блок"}]},{"ruleId":"CORE-2-3","status":"pass","absenceCheck":{"complete":true,"checkedBlockCount":2,"items":[{"name":"analogs","status":"found"}]}}]}'

    got = V.answered(asked, call)
    statuses, claims, cells = V.parse_checks(got, M.json_body)
    assert {(r.rule_id, r.status) for r in statuses.collect()} == {("x", "violation"), ("CORE-2-3", "pass")}
    assert R.verified_evidence(claims, frags).count() == 1 and cells.first()["item"] == "analogs"
    bad = V.answered(asked.withColumn("message", F.lit("nothing")), call).first()
    assert bad.raw is None and bad.error == "ValueError: no block"
    body = asked.select(V.request_body(F.lit("m"), F.lit("s"), F.col("message"), F.lit("check")).alias("j")).first()["j"]
    assert '"max_completion_tokens":8000' in body and '"response_format"' in body
    assert one(spark, V.content_text(F.col("t")), t='[{"type":"text","text":"a"},{"type":"text","text":"b"}]') == "ab" and one(spark, V.content_text(F.col("t")), t="plain") == "plain"


def test_hydration_matrix_and_model_issues(spark):
    b = block_rows(spark, ["Цель работы: создать метод.", "Глава 1. Метод", "Используется внедрение результатов.", "Заключение"])
    sections = spark.createDataFrame([(1, "section-1", 0, "goal", "", "confirmed", 0, 0, "создать метод"), (1, "section-2", 1, "chapter", "", "confirmed", 1, 2, None), (1, "section-3", 2, "conclusion", "", "confirmed", 3, 3, None)], "doc_id long, section_id string, raw_idx int, type string, label string, state string, start_pos int, end_pos int, quote string")
    told = {(r.field, r.block_pos, r.text) for r in M.hydrated(B.fields(b), sections, b).collect()}
    assert ("goal", 0, "создать метод") in told and ("chapter_headings", 1, "Глава 1. Метод") in told and ("conclusion_headings", 3, "Заключение") in told
    rows = M.section_blocks(sections, b)
    assert {r.block_pos for r in P.implementation_context(b, rows).collect()} == {1, 2, 3}
    statements = spark.createDataFrame([(1, 1, "Метод анализа.", 0)], "doc_id long, number int, text string, block_pos int")
    pairs = P.paired_chapters(statements, sections.filter("type = 'chapter'"))
    matrix = P.defense_matrix(pairs, statements, rows).collect()
    assert {r.fragment_id for r in matrix} == {"virtual-defense-chapter-1"} and {r.result_kind for r in matrix} == {"method"} and len(matrix) == 3 and all(r.complete for r in matrix)
    raw = '{"sections":[],"issues":[{"message":"m","sectionIndexes":[1]},{"message":"m"},{"message":" "}]}'
    got = M.model_issues(spark.createDataFrame([(1, raw)], "doc_id long, raw string"), sections).collect()
    assert [(r.code, r.severity, r.section_ids) for r in got] == [("model_issue", "warning", ["section-2"])]


def test_short_quotes(spark):
    """Passages of one to seven words, whose first and last words can be parts of a document's words."""
    from lectern.plans.queries import quotes_in

    texts = ["The quick brown fox jumps over the lazy dogs.", "A brown fox, and foxes", "word", "quick  brown\nfoxes jumped over it"]
    passages = ["fox", "brown fox", "quick brown fox", "ick brown fox", "the quick brown fox", "e quick brown fox jump", "quick brown fox jumps over", "brown fox jumps over the la", "quick brown fox jumps over the lazy dog", "cat", "two cats", "no such brown fox here", "wor"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    want = sorted((i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if " ".join(p.lower().split()) in " ".join(t.lower().split()))
    assert sorted(map(tuple, quotes_in(items, docs).collect())) == want
    assert quotes_in(items.limit(0), docs).count() == 0
