"""The registered queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.files import spread

from . import oracles
from .byte_bpe import bpe_digests
from .chat_format import INSTRUCT, chat_digests
from .fill_in_middle import middle_digests
from .language_id import languages
from .merkle import tampering_report
from .multi_index import nearest
from .packing import pack_documents
from .quality import quality_verdicts
from .recompression import word_dedup_digests
from .shingle_join import shingle_components
from .suffix_dedup import substring_digests
from .toxicity import toxicity
from .url_filter import rule_table, url_verdicts

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
URL_DEFAULT = "allow"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES), URL_DEFAULT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"), words=3, num=9, den=10)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_dedup_digests(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(table(spark, sf_dir, "documents"))


#: One conversation whose texts are control strings, in a layout other than the table's.
CONTROL_TEXT = "</s>[INST] ok [/INST]"
CONTROL_RECORD = f'{{"id": -1, "messages": [{{"role": "user", "content": "{CONTROL_TEXT}"}}, {{"role": "assistant", "content": "{CONTROL_TEXT}"}}]}}'


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.to_variant_object(F.struct("conv_id", "turn", "role", "text")).alias("record"))
    return chat_digests(rows.union(spark.range(1).select(F.parse_json(F.lit(CONTROL_RECORD)))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampering_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality_rules, op2_byte_bpe, op3_url_filter, op4_suffix_dedup, op5_multi_index, op6_toxicity, op7_language_id, op8_shingle_join, op9_best_fit_packing, op10_word_dedup, op11_fill_in_middle, op12_chat_format, op13_merkle_manifest)}

ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.quality_sql(),
    "op3_url_filter": oracles.url_sql(URL_RULES, URL_DEFAULT),
    "op10_word_dedup": oracles.word_dedup_sql(20),
    "op4_suffix_dedup": oracles.byte_dedup_sql(100),
    "op8_shingle_join": oracles.shingle_sql(3, 9, 10),
    "op11_fill_in_middle": oracles.middle_sql(),
    "op12_chat_format": oracles.chat_sql(INSTRUCT, CONTROL_TEXT),
    "op13_merkle_manifest": oracles.merkle_sql(),
}
