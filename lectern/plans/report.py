"""The whole report of each document as Markdown: heads, map, every result with its evidence and matrices, load, warnings.

Each part gives rows of lines with their places; the lines of a document then come
together once. All counts of a report, by status and by severity, come from one
aggregate over grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapse
from lectern.plans import results as R

#: Words of a report (fixed values).
HEADINGS = {"violation": "Нарушено", "pass": "Выполнено", "uncertain": "Неопределённо", "not_checked": "Не обработано", "not_applicable": "Неприменимо"}
EVIDENCE_LABELS = {
    "verified": "цитаты подтверждены по исходным блокам", "coverage_verified": "отсутствие подтверждено полным просмотром назначенной области",
    "rejected": "заявленное нарушение не подтверждено допустимой цитатой или полной матрицей",
}
NO_EVIDENCE = "доказательство не требовалось"
MATRIX_LABELS = {"found": "найдено", "not_found": "не найдено", "ambiguous": "неоднозначно"}
SHOWN = ("title", "introduction", "goal", "tasks", "defense_statements", "chapter", "chapter_conclusions", "conclusion", "bibliography")
COUNTERS = ("requests", "retries", "packets", "candidates", "estimated_input_tokens", "rate_limit_wait_ms", "request_duration_ms")

EVIDENCE = "array<struct<location:string,page:int,quote:string>>"
FINDINGS = "array<struct<term:string,kind:string,status:string>>"
MATRIX = "array<struct<label:string,checked:int,total:int,complete:boolean,items:array<struct<name:string,status:string>>>>"
#: Columns of results that may be missing, and their types.
OPTIONAL = {
    "explanation": "string", "checked_by": "string", "evidence_status": "string", "related_rule_ids": "array<string>", "consistency_notes": "array<string>",
    "candidate_count": "int", "checked_count": "int", "exhaustive": "boolean", "evidence": EVIDENCE, "findings": FINDINGS, "matrix": MATRIX, "fix": "string",
}


def _said(pairs: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))[key], default)


def _text(*parts: Column | str) -> Column:
    """One line; a null part is an empty one."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _lines(*lines: Column | str | None) -> Column:
    """An array of lines; those that are null are left out."""
    return F.array_compact(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]))


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def complete(results: DataFrame) -> DataFrame:
    """Results with all columns that a report reads; the missing ones are null."""
    return results.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in results.columns})


def report_counts(results: DataFrame) -> DataFrame:
    """(doc_id, n, n_<status>.., n_<severity>..) from one aggregate over the levels (document), (document, status) and (document, status, severity); severities are those of violations."""
    sets = results.groupingSets([["doc_id"], ["doc_id", "status"], ["doc_id", "status", "severity"]], "doc_id", "status", "severity")
    levels = sets.agg(F.grouping_id().alias("_level"), F.count("*").alias("_n"))
    of = lambda cond: F.coalesce(F.max(F.when(cond, F.col("_n"))), F.lit(0))
    cols = [of(F.col("_level") == 3).alias("n")]
    cols += [of((F.col("_level") == 1) & (F.col("status") == s)).alias(f"n_{s}") for s in R.STATUSES]
    cols += [of((F.col("_level") == 0) & (F.col("status") == "violation") & (F.col("severity") == s)).alias(f"n_{s}") for s in R.SEVERITIES]
    return levels.groupBy("doc_id").agg(*cols)


def summary(score: Column) -> Column:
    """The sentence that sums a report up, from the counts of ``report_counts``."""
    checked, applicable = F.col("n_pass") + F.col("n_violation"), F.col("n") - F.col("n_not_applicable")
    start = ("Проверено ", checked, " из ", applicable, " применимых правил. ")
    poor = _text(*start, "Покрытие недостаточно для итоговой оценки.")
    return F.when(score.isNull(), poor).otherwise(_text(*start, "Нарушено: ", F.col("n_violation"), "; неопределённо: ", F.col("n_uncertain"), "; не обработано: ", F.col("n_not_checked"), "."))


def head_lines(results: DataFrame, meta: DataFrame) -> DataFrame:
    """(doc_id, p, o, lines): title, score, coverages and summary."""
    results = complete(results)
    rows = report_counts(results).join(R.scores(results), "doc_id").join(R.candidate_coverage(results), "doc_id").join(meta.select("doc_id", "name"), "doc_id", "left")
    score = F.when(F.col("score").isNull(), "не рассчитана").otherwise(_text(F.col("score"), "/100", F.when(F.col("provisional"), " (предварительно)")))
    n = lambda s: F.col(f"n_{s}")
    lines = _lines(
        _text("# Протокол нормоконтроля — ", F.col("name")), "",
        _text("**Оценка по проверенным правилам:** ", score),
        _text("**Покрытие правил:** ", _round(100 * F.col("coverage")), " % (", n("pass") + n("violation"), " проверенных из ", F.col("n"), " правил профиля)"),
        _text("**Отправлено назначенных фрагментов:** ", _round(100 * F.col("candidate_coverage")), " %"), "",
        _text("Нарушено: ", n("violation"), "; выполнено: ", n("pass"), "; неопределённо: ", n("uncertain"), "; не обработано: ", n("not_checked"), "; неприменимо: ", n("not_applicable"), "."), "",
        "> Оценка не является решением о допуске к защите. Смысловые замечания и исправления необходимо проверить вручную.", "", "## Краткий итог", summary(F.col("score")), "",
    )
    return rows.select("doc_id", F.lit(0).alias("p"), F.lit(0).cast("long").alias("o"), lines.alias("lines"))


def map_lines(maps: DataFrame, sections: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, p, o, lines) of the map: ``maps`` has status, confirmed, processed_blocks and total_blocks; ``sections`` type, label, state, start_block_id, end_block_id, pages and place; ``issues`` message and place."""
    shown = F.col("type").isin(*SHOWN)
    ends = _text(F.col("start_block_id"), "…", F.col("end_block_id"))
    pages = F.when(F.size("pages") > 0, _text(" (стр. ", F.get("pages", F.lit(0)), "–", F.element_at("pages", -1), ")"))
    line = _text("- **", F.col("type"), " · ", F.col("label"), ":** ", ends, pages, F.when(F.col("state") == "ambiguous", " — требует проверки"))
    listed = lambda c, at: F.transform(F.array_sort(F.collect_list(F.struct(at, c.alias("x")))), lambda s: s["x"])
    counted = sections.groupBy("doc_id").agg(F.count("*").alias("_all"), F.count_if(shown).alias("_shown"), F.count_if(F.col("state") == "ambiguous").alias("_unsure"), listed(F.when(shown, line), "place").alias("_lines"))
    noted = issues.groupBy("doc_id").agg(listed(_text("- ", F.col("message")), "place").alias("_notes"))
    rows = maps.join(counted, "doc_id", "left").join(noted, "doc_id", "left").fillna(0, ["_all", "_shown", "_unsure"])
    head = _lines(
        "## Структурная карта", "", _text("- Статус: ", F.when(F.col("status") == "ready", "готова").otherwise("частичная")), _text("- Подтверждена пользователем: ", F.when(F.col("confirmed"), "да").otherwise("нет")),
        _text("- Обработано блоков одним запросом: ", F.col("processed_blocks"), " из ", F.col("total_blocks")), _text("- Всего смысловых диапазонов: ", F.col("_all"), "; показано основных: ", F.col("_shown")), _text("- Неоднозначных элементов: ", F.col("_unsure")), "",
    )
    none = F.array().cast("array<string>")
    notes = F.when(F.size("_notes") > 0, F.concat(_lines("", "### Замечания к карте", ""), F.col("_notes"), _lines(""))).otherwise(_lines(""))
    return rows.select("doc_id", F.lit(1).alias("p"), F.lit(0).cast("long").alias("o"), F.concat(head, F.coalesce(F.array_compact("_lines"), none), notes).alias("lines"))


def result_lines(results: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, p, o, lines): a heading for each status, also where no rule has it, and the results below it in catalogue order."""
    place = R.place(F.col("status"))
    grid = results.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in R.STATUSES])
    stacked = F.array(*[F.struct(F.lit(2 + k).alias("p"), F.lit(-1).cast("long").alias("o"), _lines(_text(f"## {HEADINGS[s]} (", F.col(s), ")"), "").alias("lines")) for k, s in enumerate(R.STATUSES)])
    heads = grid.select("doc_id", F.inline(stacked))
    rows = complete(results).join(F.broadcast(rules.select("rule_id", "title", "requirement", "source_label", "source_line", F.lit(True).alias("_known"))), "rule_id", "left")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    some = lambda c: F.size(c) > 0
    first = _lines(
        _text("### ", F.col("rule_id"), F.when(F.col("_known"), _text(" — ", F.col("title")))), "",
        F.when(F.col("_known"), _text("- **Требование:** ", F.col("requirement"))), F.when(F.col("_known"), _text("- **Источник:** ", F.col("source_label"), ", строка ", F.col("source_line"))),
        _text("- **Результат:** ", F.col("explanation")), _text("- **Проверено:** ", F.col("checked_by")),
        _text("- **Проверка доказательств:** ", _said(EVIDENCE_LABELS, F.col("evidence_status"), F.lit(NO_EVIDENCE))),
        F.when(some("related_rule_ids"), _text("- **Связанные правила:** ", F.array_join("related_rule_ids", ", "))), F.when(some("consistency_notes"), _text("- **Проверка согласованности:** ", F.array_join("consistency_notes", " "))),
        F.when(F.col("candidate_count").isNotNull(), _text("- **Фрагменты:** ", F.col("checked_count"), " из ", F.col("candidate_count"), "; полная область: ", F.when(F.col("exhaustive"), "да").otherwise("нет"))),
    )
    terms = F.when(some("findings"), F.concat(_lines("- **Разбор обозначений:**"), F.transform("findings", lambda t: _text("  - ", t["term"], ": ", t["kind"], "; ", t["status"]))))
    cell = lambda m: F.array_join(F.transform(m["items"], lambda i: _text(i["name"], ": ", _said(MATRIX_LABELS, i["status"], F.lit(MATRIX_LABELS["ambiguous"])))), "; ")
    row = lambda m: _text("| ", F.replace(collapse(m["label"]), F.lit("|"), F.lit("\\|")), " | ", m["checked"], "/", m["total"], " | ", F.when(m["complete"], "полная").otherwise("неполная"), " | ", cell(m), " |")
    matrix = F.when(some("matrix"), F.concat(_lines("", "#### Матрица полного покрытия", "", "| Фрагмент | Проверено блоков | Полнота | Элементы |", "|---|---:|---|---|"), F.transform("matrix", row), _lines("")))
    quotes = F.when(some("evidence"), F.concat(_lines("- **Доказательства:**"), F.transform("evidence", lambda e: _text("  - ", e["location"], F.when(e["page"].isNotNull(), _text(", стр. ", e["page"])), ": «", e["quote"], "»"))))
    last = _lines(F.when(F.col("fix") != "", _text("- **Исправление:** ", F.col("fix"))), "")
    return heads.unionByName(rows.select("doc_id", (place + 1).alias("p"), F.col("rule_order").cast("long").alias("o"), F.concat(first, listed(terms), listed(matrix), listed(quotes), last).alias("lines")))


def tail_lines(meta: DataFrame, usage: DataFrame, routing: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, p, o, lines): technical facts, load and warnings. ``usage`` has the seven counters, ``routing`` strategy, explicit_rules, fallback_rules, fragments and check_requests."""
    rows = meta.select("doc_id", "app_version", "provider", "model", "prompt_hash", "map_prompt_hash")
    rows = rows.join(usage.select("doc_id", *COUNTERS), "doc_id", "left").join(routing.select("doc_id", "strategy", "explicit_rules", "fallback_rules", "fragments", "check_requests"), "doc_id", "left").join(warnings.select("doc_id", "warnings"), "doc_id", "left")
    rows = rows.fillna(0, [*COUNTERS, "explicit_rules", "fallback_rules", "fragments", "check_requests"])
    lines = _lines(
        "## Технические сведения", "", _text("- Версия приложения: ", F.col("app_version")), _text("- Провайдер API: ", F.col("provider")), _text("- Model ID: ", F.coalesce("model", F.lit("unknown"))),
        _text("- Хеш промпта проверки: ", F.coalesce("prompt_hash", F.lit("unknown"))), _text("- Хеш промпта структуры: ", F.coalesce("map_prompt_hash", F.lit("—"))), "", "## Нагрузка LLM", "",
        _text("- Физических запросов: ", F.col("requests")), _text("- Повторных попыток: ", F.col("retries")), _text("- Проверено пакетов: ", F.col("packets")), _text("- Передано правил/объектов: ", F.col("candidates")),
        _text("- Маршрутизация: ", F.col("strategy"), "; явно задано: ", F.col("explicit_rules"), "; fallback: ", F.col("fallback_rules"), "; фрагментов: ", F.col("fragments"), "; запросов проверки: ", F.col("check_requests")),
        _text("- Оценочно входных токенов: ", F.col("estimated_input_tokens")), _text("- Ожидание rate limiter: ", _round(F.col("rate_limit_wait_ms") / 1000), " с"), _text("- Время запросов к модели: ", _round(F.col("request_duration_ms") / 1000), " с"), "",
    )
    noted = F.when(F.size("warnings") > 0, F.concat(_lines("## Ограничения проверки", ""), F.transform("warnings", lambda w: _text("- ", w)), _lines("")))
    return rows.select("doc_id", F.lit(9).alias("p"), F.lit(0).cast("long").alias("o"), F.concat(lines, F.coalesce(noted, F.array().cast("array<string>"))).alias("lines"))


def report_texts(*parts: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, p, o, lines): the lines of each document in the order of (p, o). A report is as long as its own results, which are a catalogue's."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    ordered = F.array_sort(F.collect_list(F.struct("p", "o", "lines")))
    return rows.groupBy("doc_id").agg(F.array_join(F.flatten(F.transform(ordered, lambda x: x["lines"])), "\n").alias("text"))


def call_usage(calls: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, the seven counters) from one row per attempt: operation, attempt, est_tokens, wait_ms, duration_ms, and packet and candidates of those that check. A packet counts once, however often it is tried; so do its candidates."""
    retried = F.count_if(F.col("attempt") > 1)
    each = calls.groupBy(by).agg(F.count("*").alias("requests"), retried.alias("retries"), F.sum("est_tokens").alias("estimated_input_tokens"), F.sum("wait_ms").alias("rate_limit_wait_ms"), F.sum("duration_ms").alias("request_duration_ms"))
    packets = calls.filter("packet is not null").groupBy(by, "packet").agg(F.max("candidates").alias("_c")).groupBy(by).agg(F.count("*").alias("packets"), F.sum("_c").alias("candidates"))
    return each.join(packets, by, "left").fillna(0, ["packets", "candidates"]).select(by, *COUNTERS)
