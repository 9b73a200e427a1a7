"""From answers and findings to statuses, consistency, scores and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import collapse, norm_text

#: Statuses from the strongest, and the order of a report (fixed values).
RANK = {"violation": 5, "pass": 4, "uncertain": 3, "not_checked": 2, "not_applicable": 1}
STATUSES = ("violation", "pass", "uncertain", "not_checked", "not_applicable")
SEVERITIES = ("critical", "major", "minor", "info")
#: Rules that pass only while others do, rules that score as one, and what an absence check must name (fixed values).
DEPENDS = [("CORE-2-1", "CORE-2-3"), ("CORE-2-1", "CORE-15"), ("CORE-18", "CORE-9-1"), ("CORE-8-2", "CORE-8-1")]
FAMILIES = [("CORE-5-4", "CORE-7-2", "CORE-19"), ("CORE-4-1", "CORE-4-3", "CORE-12")]
REQUIRED = [
    ("CORE-2-3", "analogs"), ("CORE-2-3", "prototype"), ("CORE-2-3", "prototype_disadvantages"),
    ("CORE-15", "analogs_inside_chapter"), ("CORE-15", "prototype_inside_chapter"), ("CORE-15", "prototype_disadvantages_inside_chapter"),
    ("CORE-8-2", "comparison_with_prototype_in_chapter_conclusions"),
]
LEAST_COVERAGE, FULL_COVERAGE = 0.6, 0.9


def rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, r in RANK.items():
        out = F.when(status == name, r).otherwise(out)
    return out


def verified_evidence(claims: DataFrame, blocks: DataFrame, by: tuple[str, ...] = ("doc_id", "fragment_id", "rule_id"), most: int = 20) -> DataFrame:
    """Claims (by.., evidence_idx, block_id, quote) whose quote of 4 to 600 characters stands in its block, case and white space aside; each once. ``blocks`` has doc_id, block_id, text."""
    quote = collapse(F.col("quote"))
    rows = claims.filter(F.col("evidence_idx") < most).withColumn("quote", quote).filter(F.length("quote").between(4, 600))
    rows = rows.join(blocks.select("doc_id", "block_id", "text"), ["doc_id", "block_id"]).filter(F.contains(norm_text(F.col("text")), norm_text(F.col("quote")))).drop("text")
    w = Window.partitionBy(*by, "block_id", norm_text(F.col("quote"))).orderBy("evidence_idx")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def absence_matrix(requested: DataFrame, cells: DataFrame, required: DataFrame) -> DataFrame:
    """(doc_id, fragment_id, rule_id, complete, n_found, n_not_found): every required item, ambiguous where no cell names it. ``requested`` has complete_fragment, claims_complete, checked_blocks and total_blocks."""
    want = requested.join(F.broadcast(required), "rule_id")
    rows = want.join(cells.select("doc_id", "fragment_id", "rule_id", "item", "status"), ["doc_id", "fragment_id", "rule_id", "item"], "left")
    status = F.when(F.col("status").isin("found", "not_found"), F.col("status")).otherwise("ambiguous")
    out = rows.groupBy("doc_id", "fragment_id", "rule_id", "complete_fragment", "claims_complete", "checked_blocks", "total_blocks").agg(
        F.bool_and(F.col("status").isNotNull()).alias("_named"), F.count_if(status == "found").alias("n_found"), F.count_if(status == "not_found").alias("n_not_found"), F.count("*").alias("n_items")
    )
    complete = F.col("claims_complete") & F.col("complete_fragment") & F.col("_named") & (F.col("checked_blocks") >= F.col("total_blocks"))
    checked = F.greatest(F.lit(0), F.least("checked_blocks", "total_blocks"))
    return out.select("doc_id", "fragment_id", "rule_id", F.coalesce(complete, F.lit(False)).alias("complete"), checked.alias("checked_blocks"), "total_blocks", "n_items", "n_found", "n_not_found")


def fragment_results(requested: DataFrame, answers: DataFrame, evidence: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """A row for each requested (doc_id, fragment_id, rule_id, complete): the last answer's status, kept to what is verified. No answer is not_checked; a violation needs evidence or a complete matrix with something not found; a pass needs a complete fragment and matrix."""
    key = ["doc_id", "fragment_id", "rule_id"]
    w = Window.partitionBy(*key).orderBy(F.desc("answer_idx"))
    last = answers.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*key, F.when(F.col("status").isin("pass", "violation", "uncertain", "not_applicable"), F.col("status")).otherwise("uncertain").alias("said"))
    rows = requested.join(last, key, "left").join(evidence.groupBy(*key).agg(F.count("*").alias("n_evidence")), key, "left")
    if matrix is None:
        rows = rows.withColumns({"_complete": F.lit(None).cast("boolean"), "n_not_found": F.lit(None).cast("long"), "n_found": F.lit(None).cast("long"), "n_items": F.lit(None).cast("long")})
    else:
        rows = rows.join(matrix.select(*key, F.col("complete").alias("_complete"), "n_not_found", "n_found", "n_items"), key, "left")
    n = F.coalesce("n_evidence", F.lit(0))
    absence = F.coalesce(F.col("_complete") & (F.col("n_not_found") > 0), F.lit(False))
    rejected = (F.col("said") == "violation") & (n == 0) & ~absence
    status = F.when(F.col("said").isNull(), "not_checked").when(rejected, "uncertain").when((F.col("said") == "pass") & (~F.col("complete") | ~F.coalesce("_complete", F.lit(True))), "uncertain").otherwise(F.col("said"))
    return rows.select(
        *key, status.alias("status"), n.alias("n_evidence"), F.when(rejected, "rejected").when(n > 0, "verified").when(absence, "coverage_verified").otherwise("not_required").alias("evidence_status"),
        F.coalesce(~F.col("_complete") | (F.col("n_found") < F.col("n_items")), F.lit(False)).alias("matrix_open"), absence.alias("absence"),
    )


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """(doc_id, rule_id, n_evidence): pieces of evidence of a rule's fragments, each block and quote once (case and white space aside)."""
    said = F.struct(F.coalesce("block_id", F.lit("")), F.lower(collapse(F.col("quote"))))
    return evidence.groupBy("doc_id", "rule_id").agg(F.count_distinct(said).alias("n_evidence"))


def aggregate_rules(routed: DataFrame, results: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(doc_id, rule_id, status, coverage..): a validated violation, else not_checked if nothing was, else a pass if all passed and the rule is exhaustive and may pass, else uncertain. Two levels: fragments by rule, partial sums first. With ``evidence`` (doc_id, rule_id, block_id, quote) what several fragments share counts once."""
    rows = routed.join(results, ["doc_id", "rule_id", "fragment_id"], "left")
    checked = F.coalesce(F.col("status") != "not_checked", F.lit(False))
    real = (F.col("status") == "violation") & ((F.col("n_evidence") > 0) | F.col("absence"))
    out = rows.groupBy("doc_id", "rule_id").agg(
        F.count("*").alias("candidate_count"), F.count_if(checked).alias("checked_count"), F.count_if(real).alias("_violations"), F.bool_and(F.when(checked, F.col("status") == "pass")).alias("_all_pass"),
        F.bool_or(F.when(checked, F.col("matrix_open"))).alias("_open"), F.first("exhaustive").alias("_exhaustive"), F.first("allow_pass").alias("_allow"), F.sum(F.coalesce("n_evidence", F.lit(0))).alias("n_evidence"),
    )
    if evidence is not None:
        out = out.drop("n_evidence").join(distinct_evidence(evidence), ["doc_id", "rule_id"], "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    exhaustive = F.col("_exhaustive") & (F.col("checked_count") == F.col("candidate_count"))
    status = F.when(F.col("_violations") > 0, "violation").when(F.col("checked_count") == 0, "not_checked").when(F.col("_all_pass") & exhaustive & F.col("_allow") & ~F.coalesce("_open", F.lit(False)), "pass").otherwise("uncertain")
    return out.select("doc_id", "rule_id", status.alias("status"), "candidate_count", "checked_count", (F.col("checked_count") / F.col("candidate_count")).alias("fraction"), exhaustive.alias("exhaustive"), "n_evidence")


def local_result(status: Column, allow_pass: Column) -> Column:
    """A detector's status, where a pass that isn't allowed is uncertain."""
    return F.when((status == "pass") & ~allow_pass, "uncertain").otherwise(status)


def assembled(rules: DataFrame, docs: DataFrame, local: DataFrame, asked: DataFrame) -> DataFrame:
    """A row for every document and rule, in rule order: the local result, else the aggregated one, else not_checked."""
    grid = docs.select("doc_id").crossJoin(F.broadcast(rules.select("rule_id", "rule_order", "severity", "weight", "detector_id", "layer")))  # a catalogue of rules, tens to hundreds of rows
    rows = grid.join(local.select("doc_id", "rule_id", F.col("status").alias("_l")), ["doc_id", "rule_id"], "left").join(asked.select("doc_id", "rule_id", F.col("status").alias("_a")), ["doc_id", "rule_id"], "left")
    return rows.select(*grid.columns, F.coalesce("_l", "_a", F.lit("not_checked")).alias("status"))


def consistent(results: DataFrame, depends: list[tuple[str, str]] | None = None) -> DataFrame:
    """Results in which a pass whose dependency is violated or uncertain becomes uncertain; ``conflicts`` names them."""
    spark = results.sparkSession
    dim = F.broadcast(spark.createDataFrame(depends or DEPENDS, "rule_id string, needs string"))
    bad = results.filter(F.col("status").isin("violation", "uncertain")).select("doc_id", F.col("rule_id").alias("needs")).join(dim, "needs")
    bad = bad.groupBy("doc_id", "rule_id").agg(F.array_join(F.array_sort(F.collect_set("needs")), ", ").alias("_c"))
    rows = results.join(bad, ["doc_id", "rule_id"], "left")
    hit = (F.col("status") == "pass") & F.col("_c").isNotNull()
    return rows.select(*[c for c in results.columns if c != "status"], F.when(hit, "uncertain").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("_c")).alias("conflicts"))


def related_rules(evidence: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, rule_id, related): rules that share a piece of evidence, in order. ``evidence`` has by, rule_id and key. Rules of a key are gathered as a set, of which there are as many as rules, and then exploded once: no self-join on a hot key."""
    sets = evidence.groupBy(by, "key").agg(F.collect_set("rule_id").alias("_r")).filter(F.size("_r") > 1)
    each = sets.select(by, F.explode("_r").alias("rule_id"), "_r")
    pairs = each.select(by, "rule_id", F.explode(F.array_except("_r", F.array("rule_id"))).alias("_o")).distinct()
    return pairs.groupBy(by, "rule_id").agg(F.array_join(F.array_sort(F.collect_set("_o")), ", ").alias("related"))


def score_key(rule_id: Column, layer: Column, detector_id: Column) -> Column:
    out = F.when(layer == "user", F.concat(F.lit("rule:"), rule_id)).when(detector_id.isNotNull(), F.concat(F.lit("detector:"), detector_id)).otherwise(F.concat(F.lit("rule:"), rule_id))
    for ids in FAMILIES:
        out = F.when(rule_id.isin(*ids), "family:" + "|".join(ids)).otherwise(out)
    return out


def score_groups(results: DataFrame) -> DataFrame:
    """(doc_id, group_key, status, weight): the strongest status and the greatest weight of each group."""
    rows = results.withColumn("group_key", score_key(F.col("rule_id"), F.col("layer"), F.col("detector_id")))
    return rows.groupBy("doc_id", "group_key").agg(F.max_by("status", rank(F.col("status"))).alias("status"), F.max("weight").alias("weight"))


def scores(results: DataFrame) -> DataFrame:
    """(doc_id, coverage, score, provisional): score is the pass weight's share in percent; null below a coverage of 0.6 or without weight."""
    applicable, checked = F.col("status") != "not_applicable", F.col("status").isin("pass", "violation")
    cover = results.groupBy("doc_id").agg(F.count_if(applicable).alias("_a"), F.count_if(checked).alias("_c"))
    groups = score_groups(results).groupBy("doc_id").agg(F.sum(F.when(F.col("status") == "pass", F.col("weight")).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col("status") == "violation", F.col("weight")).otherwise(0.0)).alias("_v"))
    coverage = F.when(F.col("_a") > 0, F.col("_c") / F.col("_a")).otherwise(0.0)
    total = F.col("_p") + F.col("_v")
    score = F.when((coverage >= LEAST_COVERAGE) & (total > 0), F.floor(100 * F.col("_p") / F.when(total > 0, total).otherwise(1.0) + 0.5).cast("int"))
    return cover.join(groups, "doc_id").select("doc_id", coverage.alias("coverage"), score.alias("score"), (coverage < FULL_COVERAGE).alias("provisional"))


def candidate_coverage(results: DataFrame) -> DataFrame:
    total = F.sum("candidate_count")
    return results.groupBy("doc_id").agg(F.when(total > 0, F.least(F.lit(1.0), F.sum("checked_count") / F.when(total > 0, total).otherwise(1))).otherwise(1.0).alias("candidate_coverage"))


def status_counts(results: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, n_<status>.., n_<severity>..): statuses with zeros, and severities of violations."""
    cols = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    cols += [F.count_if((F.col("status") == "violation") & (F.col("severity") == s)).alias(f"n_{s}") for s in SEVERITIES]
    return results.groupBy(by).agg(*cols)


def merged(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """Previous results with fresh ones in their place; rules that weren't there before aren't added."""
    new = fresh.select("doc_id", "rule_id", *[F.col(c).alias(f"_{c}") for c in previous.columns if c not in ("doc_id", "rule_id")], F.lit(True).alias("_new"))
    rows = previous.join(new, ["doc_id", "rule_id"], "left")
    return rows.select("doc_id", "rule_id", *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in previous.columns if c not in ("doc_id", "rule_id")])


def failure_rows(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, rule_id, status) for rules that nobody answers: those checked by hand don't apply, the others are not checked. Rules are a catalogue."""
    status = F.when(F.col("mode") == "manual", "not_applicable").otherwise("not_checked")
    return docs.select("doc_id").crossJoin(F.broadcast(rules.select("rule_id", status.alias("status"))))


def merged_warnings(*sources: DataFrame) -> DataFrame:
    """(doc_id, warnings) from (doc_id, place, warning) of the document, its map and its check: all that aren't blank, each once, where it is seen first."""
    rows = None
    for i, source in enumerate(sources):
        part = source.select("doc_id", F.struct(F.lit(i).alias("source"), F.col("place").cast("long").alias("place")).alias("at"), F.trim("warning").alias("warning")).filter("warning <> ''")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("doc_id", "warning").agg(F.min("at").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "warning")))
    return first.groupBy("doc_id").agg(F.transform(listed, lambda x: x["warning"]).alias("warnings"))


def merged_routing(*runs: DataFrame) -> DataFrame:
    """(doc_id, check_requests): requests of all runs of a document."""
    rows = runs[0].select("doc_id", "check_requests")
    for more in runs[1:]:
        rows = rows.unionByName(more.select("doc_id", "check_requests"))
    return rows.groupBy("doc_id").agg(F.sum("check_requests").alias("check_requests"))


def normalized_errors(calls: DataFrame) -> DataFrame:
    """calls (http_status, body, ..) with code and message: an error embedded in an answer, as an object or a text, else the status; network failures have no status."""
    embedded = F.coalesce(F.get_json_object("body", "$.error.message"), F.get_json_object("body", "$.error"), F.get_json_object("body", "$.message"))
    code = F.coalesce(F.get_json_object("body", "$.error.code").cast("int"), F.when(F.col("http_status") >= 400, F.col("http_status")))
    failed = F.col("http_status").isNull() | (F.col("http_status") >= 400) | F.get_json_object("body", "$.error").isNotNull()
    message = F.when(failed, F.coalesce(embedded, F.when(F.col("http_status").isNull(), F.lit("network")).otherwise(F.concat(F.lit("HTTP "), F.col("http_status").cast("string")))))
    return calls.withColumns({"code": F.when(failed, code), "message": message})


def retryable(results: DataFrame) -> DataFrame:
    open_ = (F.col("status") == "not_checked") | ((F.col("status") == "uncertain") & ((F.col("evidence_status") == "rejected") | (F.col("checked_count") < F.col("candidate_count"))))
    return results.filter((F.col("checked_by") == "llm") & open_)


def usage(calls: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Calls and tokens of each group, from one row per attempt (est_tokens)."""
    return calls.groupBy(*by).agg(F.count("*").alias("n_calls"), F.sum("est_tokens").alias("est_tokens"), F.max("est_tokens").alias("largest_call"))


def rate_load(calls: DataFrame, by: str, at: str = "ts", tokens: str = "tokens", seconds: int = 60) -> DataFrame:
    """Add window_requests and window_tokens: the load of the ``seconds`` up to each call, itself included."""
    micros = F.unix_micros(F.to_timestamp(F.col(at).cast("string")))
    w = Window.partitionBy(by).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumns({"window_requests": F.count("*").over(w), "window_tokens": F.sum(tokens).over(w)})


def cooldowns(calls: DataFrame, by: str, at: str, until: str, order: str) -> DataFrame:
    """Add cooldown_until: the greatest time asked for so far."""
    return calls.withColumn("cooldown_until", F.max(until).over(Window.partitionBy(by).orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)))


def retry_class(status: Column, message: Column) -> Column:
    """fatal, retry or fail for a provider's answer."""
    quota = message.rlike(r"(?i)per\s*day|daily|billing|quota exceeded for quota metric.*day")
    return F.when(status.isin(401, 402, 403), "fatal").when(status.isin(408, 409, 425) | (status >= 500) | status.isNull(), "retry").when((status == 429) & ~quota, "retry").otherwise("fail")


def backoff_ms(attempt: Column, jitter: Column) -> Column:
    return (1800 * F.pow(F.lit(2), attempt - 1) + jitter).cast("long")


# Reports


def place(status: Column) -> Column:
    """Where a report has a status, from 1."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(STATUSES):
        out = F.when(status == s, i + 1).otherwise(out)
    return out


def report_lines(results: DataFrame, rules: DataFrame, score: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): a Markdown report, its statuses in fixed order and rules in catalogue order."""
    at = place(F.col("status"))
    head = score.select("doc_id", F.lit(0).alias("_p"), F.lit(0).alias("_o"), F.concat(F.lit("# Document "), "doc_id", F.lit(": score "), F.coalesce(F.col("score").cast("string"), F.lit("–")), F.lit(", coverage "), F.round("coverage", 2)).alias("line"))
    counted = results.groupBy("doc_id", "status").count().select("doc_id", at.alias("_p"), F.lit(0).alias("_o"), F.concat(F.lit("## "), "status", F.lit(": "), "count").alias("line"))
    titles = results.join(F.broadcast(rules.select("rule_id", "title")), "rule_id").select("doc_id", at.alias("_p"), (F.col("rule_order") + 1).alias("_o"), F.concat(F.lit("- **"), "rule_id", F.lit("** "), F.replace(collapse(F.col("title")), F.lit("|"), F.lit("\\|")), F.lit(" ("), "severity", F.lit(")")).alias("line"))
    rows = head.unionByName(counted).unionByName(titles)
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_p", "_o", "line")) - 1).alias("line_no"), "line")


def markdown(lines: DataFrame) -> DataFrame:
    """(doc_id, text): a document's lines in order."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def report_json(results: DataFrame, score: DataFrame) -> DataFrame:
    """(doc_id, json): score and results of each document."""
    rows = results.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_order", "rule_id", "status", "severity"))).alias("results"))
    return score.join(rows, "doc_id").select("doc_id", F.to_json(F.struct("doc_id", "score", "coverage", "provisional", "results")).alias("json"))


def required_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIRED, "rule_id string, item string")
