"""Examples of author formats, and ids of findings that rules share."""


from lectern.operators import terms as T
from lectern.plans import results as R


def test_two_examples_of_each_format(spark):
    texts = [
        "1. Анализ сетей / П. Петров. 2021.", "2. Иванов И.И. Обзор сетей. 2020.", "3. Сидоров С.С. Метод. 2020.", "4. Обзор / А. Орлов. 2019.", "5. Козлов К.К. Модель. 2018.", "6. Без авторов вовсе",
    ]
    blocks = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, 0, None)], "doc_id long, block_pos int, text string")
    got = sorted((r.place, r.label, r.block_pos, r.quote) for r in T.format_examples(T.entries(blocks)).collect())
    assert [(p, label, at) for p, label, at, _ in got] == [(0, "инициалы + фамилия", 0), (0, "инициалы + фамилия", 3), (1, "фамилия + инициалы", 1), (1, "фамилия + инициалы", 2)]
    assert "П. Петров" in got[0][3] and "Иванов И.И" in got[2][3]


def test_findings_link_rules(spark):
    findings = spark.createDataFrame([(1, "LLM", True, True, "missing_expansion"), (1, "API", True, False, "ok"), (1, "BERT", False, True, "missing_russian_explanation"), (2, "x", False, False, "review")], "doc_id long, term string, requires_expansion boolean, requires_russian boolean, status string")
    headings = spark.createDataFrame([(1, "LLM"), (1, "LLM")], "doc_id long, term string")
    ids = {rule: sorted(r.finding_id for r in T.finding_ids(findings, headings, rule).collect()) for rule in ("expansion", "translation", "any")}
    assert ids == {"expansion": ["term:LLM:expansion"], "translation": ["term:BERT:translation", "term:LLM:translation"], "any": ["term:BERT:expansion", "term:LLM:expansion", "term:LLM:heading"]}
    rows = [(1, rule, k) for rule, own in ids.items() for k in own]
    related = {r.rule_id: r.related for r in R.related_rules(spark.createDataFrame(rows, "doc_id long, rule_id string, key string")).collect()}
    assert related == {"expansion": "any", "any": "expansion"}
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert {r.doc_id: r.status for r in T.abbreviation_status(docs, findings, "any").collect()} == {1: "violation", 2: "uncertain", 3: "pass"}
