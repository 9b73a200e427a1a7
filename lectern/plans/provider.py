"""Requests to a model and what comes back, as tables: prompts go out, answers come in, and the calls are rows.

No network is used here. A caller hands over a function that turns one request
into an answer; it runs in Arrow batches, ``concurrency`` partitions at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import loose as J

#: Completion limits by operation (fixed values).
COMPLETION = {"structure": 16_000, "check": 8_000}
TEMPERATURE = 0.05


def check_messages(assigned: DataFrame, fragments: DataFrame, rules: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """(doc_id, fragment_id, packet, message): the blocks of a fragment and the rules of one packet, with the items that an absence check must name."""
    block = F.concat(F.lit("BLOCK "), "block_id", F.lit("\n"), "text")
    body = fragments.groupBy("doc_id", "fragment_id").agg(F.array_sort(F.collect_list(F.struct("block_pos", block.alias("b")))).alias("_b"), F.bool_and("complete").alias("complete"))
    text = rules.select("rule_id", F.concat_ws("\n", F.concat(F.lit("RULE "), "rule_id"), F.concat(F.lit("Category: "), "category"), F.concat(F.lit("Requirement: "), "requirement")).alias("_t"))
    if required is not None:
        items = required.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("_i"))
        text = text.join(items, "rule_id", "left").withColumn("_t", F.concat("_t", F.coalesce(F.concat(F.lit("\nABSENCE CHECK: "), "_i"), F.lit("")))).drop("_i")
    asked = assigned.join(F.broadcast(text), "rule_id").groupBy("doc_id", "fragment_id", "packet").agg(F.array_sort(F.collect_list(F.struct("rule_id", "_t"))).alias("_r"))
    rows = asked.join(body, ["doc_id", "fragment_id"])
    head = F.concat(F.lit("FRAGMENT "), "fragment_id", F.lit(" complete="), F.col("complete").cast("string"), F.lit(" blocks="), F.size("_b").cast("string"))
    return rows.select("doc_id", "fragment_id", "packet", F.concat_ws("\n\n", head, F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n"), F.lit("RULES"), F.array_join(F.transform("_r", lambda x: x["_t"]), "\n\n")).alias("message"))


def request_body(model: Column, system: Column, message: Column, operation: Column, plain: bool = False) -> Column:
    """The JSON of a chat request; ``plain`` leaves out the response format, for endpoints that don't know it."""
    limit = F.when(operation == "structure", COMPLETION["structure"]).otherwise(COMPLETION["check"])
    messages = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), message.alias("content")))
    fields = [model.alias("model"), messages.alias("messages"), F.lit(TEMPERATURE).alias("temperature"), limit.alias("max_completion_tokens")]
    if not plain:
        fields.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    return F.to_json(F.struct(*fields))


def content_text(content: Column) -> Column:
    """A message's content: a string, or the texts of its parts, one after the other. What looks like parts but isn't JSON is a string."""
    v = J.parsed(content)
    parts = F.array_join(F.transform(J.items(v), lambda p: F.coalesce(J.text(p, "$.text"), F.lit(""))), "")
    return F.when(content.rlike(r"^\s*\[") & v.isNotNull(), parts).otherwise(content)


def wants_plain(status: Column, message: Column) -> Column:
    """Whether a request should be tried again without the response format."""
    return (status == 404) & message.rlike(r"(?i)no endpoints found.*handle the requested parameters")


class Fatal(Exception):
    """An answer after which asking again makes no sense: no access, no money, an unknown model."""


def answered(requests: DataFrame, call: Callable[[str], str], concurrency: int = 1, attempts: int = 2) -> DataFrame:
    """Requests (key columns.., message) with raw and error: each is tried ``attempts`` times; one that fails is a row with its error. After a ``Fatal`` one a partition's other requests aren't sent, and say so."""
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended = None
        for b in batches:
            raw, error = [], []
            for m in b.column(names.index("message")).to_pylist():
                got, why = None, ended and f"not sent after {ended}"
                for _ in range(0 if ended else attempts):
                    try:
                        got, why = call(m), None
                        break
                    except Fatal as e:
                        ended = why = f"{type(e).__name__}: {e}"
                        break
                    except Exception as e:
                        why = f"{type(e).__name__}: {e}"
                raw.append(got)
                error.append(why)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.string()), pa.array(error, pa.string())], [*names, "raw", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.repartition(concurrency).mapInArrow(run, f"{schema}, raw string, error string")


def _rule_id(r: Column) -> Column:
    return F.trim(J.text(r, "$.ruleId")).alias("rule_id")


def _said(r: Column) -> list[Column]:
    return [J.text(r, f"$.{name}").alias(name) for name in ("status", "explanation", "fix")]


def _claim(e: Column) -> list[Column]:
    return [F.trim(J.text(e, "$.blockId")).alias("block_id"), J.text(e, "$.quote").alias("quote")]


def _coverage(r: Column) -> list[Column]:
    return [J.value(r, "$.absenceCheck.complete", "boolean").alias("claims_complete"), J.value(r, "$.absenceCheck.checkedBlockCount", "int").alias("checked_blocks")]


def _cell(i: Column) -> list[Column]:
    return [F.trim(J.text(i, "$.name")).alias("item"), J.text(i, "$.status").alias("status")]


def nested_checks(answers: DataFrame, body: Callable[[Column], Column]) -> DataFrame:
    """The answers with ``results``, an array in their order: what ``parse_checks`` gives as rows, kept where the answer lies, for what is asked of each answer alone. Results hold rule_id, status, explanation, fix, ``claims``, claims_complete, checked_blocks and ``cells``."""
    kept = [c for c in answers.columns if c != "raw"]
    # each step is a column of its own, as an expression that is read twice would run twice
    rows = answers.select(*kept, body(F.col("raw")).alias("_body")).select(*kept, J.parsed(F.col("_body")).alias("_v")).select(*kept, J.objects(F.col("_v"), "$.results").alias("_r"))

    def result(r: Column) -> Column:
        claims = F.transform(J.objects(r, "$.evidence"), lambda e: F.struct(*_claim(e)))
        cells = F.transform(J.objects(r, "$.absenceCheck.items"), lambda i: F.struct(*_cell(i)))
        return F.struct(_rule_id(r), *_said(r), claims.alias("claims"), *_coverage(r), cells.alias("cells"))

    return rows.select(*kept, F.transform("_r", result).alias("results"))


def parse_checks(answers: DataFrame, body: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statuses, claims, cells) of answers (doc_id, fragment_id, raw), in the forms that the result plans take.

    Answers come in odd forms: a field of the wrong type is null, what isn't an
    object among results, evidence or items is left out, and neither spoils what
    stands beside it. An answer that isn't JSON gives no rows.
    """
    rows = answers.select("doc_id", "fragment_id", F.posexplode(J.objects(J.parsed(body(F.col("raw"))), "$.results")).alias("answer_idx", "r"))
    r = F.col("r")
    key = ["doc_id", "fragment_id", _rule_id(r)]
    statuses = rows.select(*key, "answer_idx", *_said(r))
    claims = rows.select(*key, F.posexplode(J.objects(r, "$.evidence")).alias("evidence_idx", "e")).select("doc_id", "fragment_id", "rule_id", "evidence_idx", *_claim(F.col("e")))
    cells = rows.select(*key, *_coverage(r), F.explode(J.objects(r, "$.absenceCheck.items")).alias("i"))
    return statuses, claims, cells.select("doc_id", "fragment_id", "rule_id", "claims_complete", "checked_blocks", *_cell(F.col("i")))
