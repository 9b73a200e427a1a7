"""Abbreviations and terms at their first use; bibliography entries and their authors; titles and numbered items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.cutting import Trie, cut_tokens
from lectern.functions.text import collapse, context_quote, explode_matches, pattern

#: Known terms: kind, whether they need an expansion and a Russian explanation (fixed values).
KNOWN = [
    ("LLM", "abbreviation", True, True),
    ("API", "abbreviation", True, True),
    ("MCP", "protocol", True, True),
    ("RAG", "method_name", True, True),
    ("RPS", "method_name", True, True),
    ("NDCG", "metric", True, True),
    ("AC1", "metric", False, False),
    ("GPT", "model_name", False, False),
    ("BERT", "model_name", False, False),
    ("BGE", "model_name", False, False),
    ("GTE", "model_name", False, False),
    ("ORAG", "method_name", False, False),
    ("BM25", "method_name", False, False),
    ("TF–IDF", "compound_term", False, False),
    ("TF-IDF", "compound_term", False, False),
    ("RECALL@10", "metric", False, False),
    ("NDCG@K", "metric", False, False),
]
IGNORED = ("РФ", "СССР", "ИИ", "ГОСТ", "ВКР", "ГЛАВА", "ВВЕДЕНИЕ", "ЗАКЛЮЧЕНИЕ", "СПИСОК", "РЕФЕРАТ", "SYNOPSIS")
TOKEN = r"(?<![\p{L}\p{N}_])(?:TF[–-]IDF|Recall@\d+|NDCG@[A-Z\d]+|GPT(?:-[\w.]+)?|Qwen\d[\w.-]*|MiniLM|[A-ZА-ЯЁ]{2,10}(?:\d+)?)(?![\p{L}\p{N}_])"
ROMAN = r"^(?:I|II|III|IV|V|VI|VII|VIII|IX|X)\z"


def known_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "known string, kind string, requires_expansion boolean, requires_russian boolean")


def term_uses(b: DataFrame, token: str = TOKEN, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(doc_id, block_pos, term, match_at, text) of every use of a term."""
    found = explode_matches(b, "text", pattern(token), ("doc_id", "block_pos", "text"))
    return found.withColumn("term", F.replace("match", F.lit("TF-IDF"), F.lit("TF–IDF"))).filter(~F.col("term").isin(*ignored) & ~F.col("term").rlike(ROMAN))


def first_uses(uses: DataFrame) -> DataFrame:
    """Each document's first use of each term (case aside)."""
    w = Window.partitionBy("doc_id", F.upper("term")).orderBy("block_pos", "match_at")
    return uses.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_policy(uses: DataFrame, known: DataFrame) -> DataFrame:
    """Add kind, requires_expansion and requires_russian: the known term as it stands, else in capitals, else by family."""
    exact = F.broadcast(known.select(F.col("known").alias("_k"), F.struct("kind", "requires_expansion", "requires_russian").alias("_a")))
    upper = F.broadcast(known.select(F.col("known").alias("_k2"), F.struct("kind", "requires_expansion", "requires_russian").alias("_b")))
    rows = uses.join(exact, F.col("term") == F.col("_k"), "left").join(upper, F.upper("term") == F.col("_k2"), "left")
    p = F.coalesce("_a", "_b")
    family = F.when(F.col("term").rlike("(?iu)^(?:Recall|NDCG|F1)@"), "metric").when(F.col("term").rlike("^(?:GPT|Qwen|MiniLM|BERT|BGE|GTE)"), "model_name").otherwise("unknown")
    return rows.select(*uses.columns, F.coalesce(p["kind"], family).alias("kind"), F.coalesce(p["requires_expansion"], F.lit(False)).alias("requires_expansion"), F.coalesce(p["requires_russian"], F.lit(False)).alias("requires_russian"))


def expansion(text: Column, at: Column, length: Column) -> tuple[Column, Column]:
    """(phrase, whether it is Russian): the words before ``(TERM)``, or ``(words, TERM)``; null without two words and a closing bracket."""
    before = F.substring(text, F.greatest(F.lit(1), at - 359), F.least(F.lit(360), at))
    after = F.substring(text, at + length + 1, F.lit(50))
    comma = F.regexp_extract(before, pattern(r"\(\s*([^()]{2,220}),\s*\z"), 1)
    direct = F.regexp_extract(before, pattern(r"([^.!?;:\n()]{2,220})\(\s*\z"), 1)
    phrase = F.trim(F.when(comma != "", comma).otherwise(direct))
    words = F.filter(F.split(phrase, pattern(r"[\s–—-]+")), lambda w: w != "")
    whole = after.rlike(pattern(r"^\s*\)")) & (F.size(words) >= 2)
    russian = whole & phrase.rlike("(?iu)[а-яё]") & ~phrase.rlike(pattern(r"(?:[A-Za-z][A-Za-z-]*\s+){1,}[A-Za-z][A-Za-z-]*\z"))
    return F.when(whole, phrase), russian


def term_findings(b: DataFrame, known: DataFrame, token: str = TOKEN, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(doc_id, term, kind, block_pos, match_at, quote, expansion, requires_expansion, requires_russian, status) at first use: ok, missing_expansion, missing_russian_explanation or review."""
    rows = with_policy(first_uses(term_uses(b, token, ignored)), known)
    phrase, russian = expansion(F.col("text"), F.col("match_at"), F.length("match"))
    rows = rows.withColumns({"expansion": phrase, "_russian": F.coalesce(russian, F.lit(False)), "quote": context_quote(F.col("text"), F.col("match_at"), F.length("match"), 80, 160)})
    status = F.when(F.col("kind") == "unknown", "review").when(F.col("requires_expansion") & F.col("expansion").isNull(), "missing_expansion").when(F.col("requires_russian") & ~F.col("_russian"), "missing_russian_explanation").otherwise("ok")
    return rows.select("doc_id", "term", "kind", "block_pos", "match_at", "quote", "expansion", "requires_expansion", "requires_russian", status.alias("status"))


def problem(rule: str):
    """Whether a finding is a problem of the rules on ``expansion``, ``translation`` or ``any``."""
    return {
        "expansion": F.col("requires_expansion") & (F.col("status") == "missing_expansion"),
        "translation": F.col("requires_russian") & F.col("status").isin("missing_expansion", "missing_russian_explanation"),
        "any": F.col("status").isin("missing_expansion", "missing_russian_explanation"),
    }[rule]


def abbreviation_status(docs: DataFrame, findings: DataFrame, rule: str) -> DataFrame:
    """(doc_id, status): for ``expansion``, ``translation`` or ``any`` problems a violation, else uncertain where a term wants review, else pass."""
    found = findings.groupBy("doc_id").agg(F.bool_or(problem(rule)).alias("bad"), F.bool_or(F.col("status") == "review").alias("review"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.when(F.col("bad"), "violation").when(F.col("review"), "uncertain").otherwise("pass").alias("status"))


def finding_ids(findings: DataFrame, headings: DataFrame, rule: str) -> DataFrame:
    """(doc_id, finding_id) of a rule's problems: ``term:<term>:expansion`` or ``:translation``, and for ``any`` also ``:heading`` of terms in headings. Rules that share one are about the same thing."""
    kind = "translation" if rule == "translation" else "expansion"
    term = lambda end: F.concat(F.lit("term:"), F.upper("term"), F.lit(f":{end}")).alias("finding_id")
    out = findings.filter(problem(rule)).select("doc_id", term(kind))
    return (out.unionByName(headings.select("doc_id", term("heading"))) if rule == "any" else out).distinct()


def heading_terms(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Terms in heading lines, but for names of models."""
    return with_policy(term_uses(lines), known).filter("kind <> 'model_name'").select("doc_id", "block_pos", "term", "text")


# Bibliography

NAME = r"[A-ZА-ЯЁ][\p{L}'’-]+"
#: Forbidden elements of entries (fixed values).
JUNK = [
    ("isbn", r"(?iu)\bISBN\b"),
    ("editor", r"(?iu)\b(?:ed\.\s+by|edited\s+by|под\s+ред\.)\b"),
    ("ampersand", r"\s&\s"),
    ("surname-comma", r"\b[A-ZА-ЯЁ][\p{L}-]+,\s+[A-ZА-ЯЁ]\."),
    ("dash-separator", r"(?iu)\s[—–]\s(?:(?:19|20)\d{2}\.|(?:Vol\.|Т\.|№|URL\s*:))"),
]


def entries(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_pos, entry_idx, number, raw): blocks cut at their numbers; an unnumbered block of more than 20 characters is one entry."""
    marked = F.regexp_replace("text", pattern(r"(?m)(?:^|\n|\s)(?=\d{1,3}\.\s+[A-ZА-ЯЁ])"), "\x01")
    parts = blocks.select("doc_id", "block_pos", F.posexplode(F.split(marked, "\x01")).alias("entry_idx", "raw")).withColumn("raw", F.trim("raw"))
    number = F.regexp_extract("raw", pattern(r"^(\d{1,3})\.\s+[A-ZА-ЯЁ]"), 1)
    parts = parts.withColumn("number", F.when(number != "", number.cast("int")))
    any_number = F.max("number").over(Window.partitionBy("doc_id", "block_pos"))
    return parts.withColumn("_any", any_number).filter(F.col("number").isNotNull() | (F.col("_any").isNull() & (F.length("raw") > 20))).drop("_any")


def author_part(raw: Column) -> Column:
    """The authors of an entry: behind a slash, before the title with initials, or a list of full names; else empty."""
    t = F.regexp_replace(raw, r"^\d+\.\s*", "")
    options = [
        F.regexp_extract(t, pattern(r"/\s*([^/]{3,260}?)(?://|\.(?:\s|\z))"), 1),
        F.regexp_extract(t, pattern(r"^([^.!?]{3,220}?\b(?:et\s+al\.|[A-ZА-ЯЁ]\.)[^.!?]*?)\.\s"), 1),
        F.regexp_extract(t, pattern(rf"^((?:{NAME}\s+{NAME})(?:,\s*(?:{NAME}\s+{NAME}))*)\."), 1),
    ]
    return F.trim(F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit("")))


def author_format(authors: Column) -> Column:
    return (
        F.when(authors == "", "unknown")
        .when(authors.rlike(pattern(rf"(?:^|,\s*)[A-ZА-ЯЁ](?:\.\s*){{1,2}}{NAME}")), "initials_surname")
        .when(authors.rlike(pattern(rf"(?:^|,\s*){NAME}\s+[A-ZА-ЯЁ]\.(?:\s*[A-ZА-ЯЁ]\.)?")), "surname_initials")
        .when(authors.rlike(pattern(rf"(?:^|,\s*){NAME}\s+{NAME}(?:,|\z)")), "full_name")
        .otherwise("unknown")
    )


def format_consistency(e: DataFrame) -> DataFrame:
    """(doc_id, n_formats, status): one known format passes if it is surname and initials; more are a violation; none is uncertain."""
    known = e.withColumn("format", author_format(author_part(F.col("raw"))))
    out = known.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("format") != "unknown", F.col("format"))).alias("n_formats"), F.bool_or(F.col("format") == "surname_initials").alias("_target"))
    return out.select("doc_id", "n_formats", F.when(F.col("n_formats") >= 2, "violation").when((F.col("n_formats") == 1) & F.col("_target"), "pass").otherwise("uncertain").alias("status"))


#: Names of formats of authors (fixed values).
FORMAT_LABELS = {"surname_initials": "фамилия + инициалы", "initials_surname": "инициалы + фамилия", "full_name": "полные имена"}


def format_examples(e: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, format, label, place, block_pos, entry_idx, quote): the first ``most`` entries of each known format of a document, with the authors and what stands around them; ``place`` counts formats by their first entry."""
    authors = author_part(F.col("raw"))
    rows = e.withColumn("_a", authors).withColumn("format", author_format(F.col("_a"))).filter("format <> 'unknown'")
    at = F.greatest(F.position(F.col("_a"), F.col("raw")) - 1, F.lit(0))
    own = Window.partitionBy("doc_id", "format").orderBy("block_pos", "entry_idx")
    rows = rows.withColumns({"quote": context_quote(F.col("raw"), at, F.length("_a"), 40, 100), "_n": F.row_number().over(own), "_first": F.first(F.struct("block_pos", "entry_idx")).over(own)}).filter(F.col("_n") <= most)
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_first")) - 1
    labels = F.create_map(*(F.lit(x) for kv in FORMAT_LABELS.items() for x in kv))
    return rows.select("doc_id", "format", labels[F.col("format")].alias("label"), place.alias("place"), "block_pos", "entry_idx", "quote")


def entry_junk(e: DataFrame) -> DataFrame:
    """(doc_id, block_pos, entry_idx, junk_id, match): the first match of every forbidden element in every entry."""
    found = F.array(*[F.struct(F.lit(name).alias("junk_id"), F.regexp_extract("raw", pattern(regex), 0).alias("match")) for name, regex in JUNK])
    return e.select("doc_id", "block_pos", "entry_idx", F.explode(found).alias("f")).select("doc_id", "block_pos", "entry_idx", "f.*").filter("match <> ''")


def page_ranges(e: DataFrame) -> DataFrame:
    """(doc_id, status): ``P. a-b`` is a violation, ``P. n`` uncertain."""
    definite, single = F.col("raw").rlike(pattern(r"(?iu)\bP\.\s*(\d+)\s*[-–—]\s*(\d+)\b")), F.col("raw").rlike(pattern(r"(?iu)\bP\.\s*(\d{1,9})(?!\s*[-–—])"))
    out = e.groupBy("doc_id").agg(F.bool_or(definite).alias("d"), F.bool_or(single).alias("s"))
    return out.select("doc_id", F.when(F.col("d"), "violation").when(F.col("s"), "uncertain").otherwise("pass").alias("status"))


def initials_order(e: DataFrame) -> DataFrame:
    """(doc_id, status): initials before the surname are a violation, full names uncertain, initials behind it a pass."""
    f = author_format(author_part(F.col("raw")))
    out = e.groupBy("doc_id").agg(F.count_if(f == "initials_surname").alias("bad"), F.count_if(f == "full_name").alias("full"), F.count_if(f == "surname_initials").alias("good"))
    return out.select("doc_id", F.when(F.col("bad") > 0, "violation").when(F.col("full") > 0, "uncertain").when(F.col("good") > 0, "pass").otherwise("uncertain").alias("status"))


# Titles and numbered items

#: Patterns of titles and words that count as known (fixed values).
TITLE_HINT = r"(?iu)(?:^|[^\p{L}])(?:модел(?:ь|и|ей)|алгоритм(?:ы|ов)?|метод(?:ы|ов)?|систем(?:а|ы)|технолог(?:ия|ии)|анализ|синтез|управлен(?:ие|ия)|генераци(?:я|и)|сегментаци(?:я|и)|разработк(?:а|и))(?!\p{L})"
TITLE_EXCLUDED = r"(?iu)(?:министерств|университет|институт|факультет|кафедр|на\s+правах\s+рукописи|диссертац(?:ия|ии)|на\s+соискание|научн(?:ый|ая)\s+руководител|специальност|санкт-петербург|москва|\b20\d{2}\b)"
TITLE_QUOTES = r'^[«"]|[»"]\z'
COMMON = ("и", "в", "на", "с", "по", "для", "из", "к", "о", "об", "от", "до", "при", "без", "под", "над", "между", "основе")


def title_windows(b: DataFrame, most: int = 3, lexicons: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """(doc_id, block_pos, line_idx, n_lines, text): every run of 1 to ``most`` lines of a block, and the whole block (line_idx -1). A line without a Cyrillic letter or with a Latin one is in no run, and a whole block with a Latin one is none, unless the lines are taken as they are (``plain``). With ``lexicons`` joined words of lines are cut."""
    cleaned = lambda x: collapse(F.translate(x, "­", ""))
    whole = cleaned(F.regexp_replace("text", r"\n+", " "))
    lines = b.select("doc_id", "block_pos", whole.alias("_w"), F.posexplode(F.split("text", r"\n+")).alias("_i", "_t")).withColumn("_t", cleaned(F.col("_t")))
    if lexicons is not None:
        lines = restored(lines, lexicons, ("_t", "_w"))
    lines = lines.filter("_t <> ''").groupBy("doc_id", "block_pos", "_w").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"]).alias("_l"))
    good = lambda x: F.lit(True) if plain else x.rlike("[А-ЯЁа-яё]") & ~x.rlike("[A-Za-z]")

    def run_of(n: Column) -> Column:
        made = F.transform("_l", lambda _, i: F.struct(i.alias("line_idx"), n.alias("n_lines"), F.when((i + n <= F.size("_l")) & F.forall(F.slice("_l", i + 1, n), good), F.array_join(F.slice("_l", i + 1, n), " ")).alias("text")))
        return F.filter(made, lambda x: x["text"].isNotNull())

    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), run_of))
    block = F.array(F.struct(F.lit(-1).alias("line_idx"), F.size("_l").alias("n_lines"), F.when(F.lit(plain) | ~F.col("_w").rlike("[A-Za-z]"), F.col("_w")).alias("text")))
    return lines.select("doc_id", "block_pos", F.explode(F.concat(runs, F.filter(block, lambda x: x["text"].isNotNull()))).alias("w")).select("doc_id", "block_pos", "w.*")


def title_score(text: Column, hint: str | None = TITLE_HINT, excluded: str | None = TITLE_EXCLUDED, leading: str = r"(?iu)^(?:модел|алгоритм|метод|систем|технолог|анализ|синтез|управлен|генераци|сегментаци|разработк)", quoted: str | None = TITLE_QUOTES) -> Column:
    """-1 for what can't be a title; else by length, words, a leading noun, and a final period, without the quotation marks ``quoted`` around it."""
    t = F.trim(F.regexp_replace(text, quoted, "")) if quoted else text
    n = F.size(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), F.lit(0)))
    bad = ~F.length(t).between(25, 240) | ~n.between(4, 24)
    if hint:
        bad = bad | ~t.rlike(pattern(hint))
    if excluded:
        bad = bad | t.rlike(pattern(excluded))
    phrase = r"(?iu)(?:^|[^\p{L}])(?:больших\s+языковых\s+моделей|искусственного\s+интеллекта|машинного\s+обучения)(?!\p{L})"
    score = F.least(F.length(t), F.lit(150)) + n * 4 + F.when(t.rlike(leading), 55).otherwise(0) + F.when(t.rlike(phrase), 15).otherwise(0) - F.when(t.endswith("."), 20).otherwise(0)
    return F.when(bad, -1).otherwise(score)


def best_titles(b: DataFrame, lexicons: DataFrame | None = None, plain: bool = False, **patterns) -> DataFrame:
    """(doc_id, block_pos, text, score): the window of the greatest score, then length, then place. With ``lexicons`` joined words are cut before they are scored."""
    rows = title_windows(b, lexicons=lexicons, plain=plain).withColumn("score", title_score(F.col("text"), **patterns)).filter("score >= 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.desc(F.length("text")), "block_pos", "line_idx", "n_lines")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("doc_id", "block_pos", "text", "score")


def lexicon(b: DataFrame, word: str = "[А-ЯЁа-яё]{2,30}", common: tuple[str, ...] = COMMON) -> DataFrame:
    """(word, n): words of all blocks, hyphenated line ends joined; each common word counts 20 at least, even where it is absent."""
    joined = F.regexp_replace("text", "([А-ЯЁа-яё])\\x{00AD}?\\s*\\n\\s*([А-ЯЁа-яё])", "$1$2")
    words = b.select(F.explode(F.regexp_extract_all(joined, F.lit(word), F.lit(0))).alias("w")).select(F.lower("w").alias("word"), F.lit(1).alias("n"))
    counts = words.groupBy("word").agg(F.sum("n").alias("n"))
    if not common:
        return counts
    floor = b.sparkSession.createDataFrame([(w,) for w in common], "word string").select("word", F.lit(20).cast("long").alias("n"))
    return counts.unionByName(floor).groupBy("word").agg(F.max("n").alias("n"))


def segment(token: str, counts: dict[str, int], common: frozenset[str] = frozenset()) -> str | None:
    """The best cut of a long token into known words: each adds 1.2 log2(count + 1) + 0.72 min(length, 14) - 5; None unless two words or more cover it."""
    from math import log2

    low, best = token.lower(), {0: (0.0, [])}
    for end in range(1, len(low) + 1):
        for start in range(max(0, end - 30), end):
            word = low[start:end]
            n = counts.get(word, 0)
            if start in best and n and (len(word) >= 4 or word in common):
                score = best[start][0] + 1.2 * log2(n + 1) + 0.72 * min(len(word), 14) - 5
                if end not in best or score > best[end][0]:
                    best[end] = score, [*best[start][1], word]
    words = best.get(len(low), (0, []))[1]
    if len(words) < 2:
        return None
    joined = " ".join(words)
    return joined[0].upper() + joined[1:] if token[0].isupper() else joined


LONG_TOKEN = r"(?<!\S)[А-ЯЁа-яё]{12,}(?!\S)"
_WORDS = "array<struct<word:string,n:bigint>>"


def document_lexicons(b: DataFrame, by: str = "doc_id", word: str = "[А-ЯЁа-яё]{2,30}") -> DataFrame:
    """(by, words): the words of each document that a cut may use, with their counts, in an array of (word, n): those of four letters and more, and common ones, which count 20 at least, even where they are absent. A document's lexicon is no longer than its text."""
    joined = F.regexp_replace("text", "([А-ЯЁа-яё])\\x{00AD}?\\s*\\n\\s*([А-ЯЁа-яё])", "$1$2")
    words = b.select(by, F.explode(F.regexp_extract_all(joined, F.lit(word), F.lit(0))).alias("w")).select(by, F.lower("w").alias("word"))
    counts = words.filter(F.length("word") >= 4).groupBy(by, "word").agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.collect_list(F.struct("word", "n")).cast(_WORDS).alias("words"))


#: Bytes of texts and lexicons that are cut together; a longer text is cut alone. Words as Python has them take ten times that and more.
CUT_BYTES = 2 << 20


def _few(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about CUT_BYTES of texts and lexicons, or of one row."""
    size = 16 * pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for c in columns:
        size = size + pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def _cut_texts(columns: tuple[str, ...], regex: str, common: tuple[str, ...]):
    """Rows whose last columns are the document and its words: the long tokens of a slice of a batch are cut together, by one trie with a root for each document."""
    import re

    long_token = re.compile(regex)

    def cut_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, lexicons = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)
        roots: dict[object, int] = {}
        words: list[tuple[int, str, int, bool]] = []
        for k, doc in enumerate(docs):
            if doc in roots:
                continue
            root = roots.setdefault(doc, len(roots))
            counts = {w["word"]: w["n"] for w in lexicons[k].as_py() or ()}
            words += [(root, w, max(n, 20) if w in common else n, w in common) for w, n in counts.items()]
            words += [(root, w, 20, True) for w in common if w not in counts]
        texts = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns}
        asked = sorted({(roots[d], t) for c in columns for d, text in zip(docs, texts[c], strict=True) if text for t in long_token.findall(text)})
        cut = dict(zip(asked, cut_tokens(Trie(words, len(roots)), [t for _, t in asked], [g for g, _ in asked]), strict=True))
        cols = list(batch.columns[:-2])
        for c in columns:
            made = [None if t is None else long_token.sub(lambda m, g=roots[d]: cut[g, m[0]] or m[0], t) for d, t in zip(docs, texts[c], strict=True)]
            cols[batch.schema.get_field_index(c)] = pa.array(made, pa.string())
        return pa.RecordBatch.from_arrays(cols, batch.schema.names[:-2])

    def run(batches):
        for batch in batches:
            for some in _few(batch, columns):
                yield cut_batch(some)

    return run


def restored(rows: DataFrame, lexicons: DataFrame, columns: tuple[str, ...] = ("text",), by: str = "doc_id", regex: str = LONG_TOKEN, common: tuple[str, ...] = COMMON) -> DataFrame:
    """The rows, with joined words in ``columns`` cut by their document's lexicon (see ``document_lexicons``).

    Only whole tokens that ``regex`` finds are cut. Rows without one stay as they
    are, and never meet a lexicon; rows of a document without words are cut by the
    common ones. Nulls stay.
    """
    wants = F.lit(False)
    for c in columns:
        wants = wants | F.coalesce(F.col(c).rlike(regex), F.lit(False))
    some = rows.filter(wants).join(lexicons.select(F.col(by).alias("_by"), F.col("words").alias("_words")), F.col(by) == F.col("_by"), "left")
    some = some.select(*[F.col(f"`{c}`") for c in rows.columns], F.col(by).alias("_doc"), F.col("_words").cast(_WORDS).alias("_lexicon"))
    return rows.filter(~wants).unionByName(some.mapInArrow(_cut_texts(columns, regex, common), rows.schema))


def numbered_items(b: DataFrame) -> DataFrame:
    """(doc_id, number, text, block_pos): items ``n. Text`` of each document's blocks, read as one text in order; an item's source is the block in which it starts."""
    ordered = F.array_sort(F.collect_list(F.struct("block_pos", "text")))
    whole = b.groupBy("doc_id").agg(F.transform(ordered, lambda x: F.concat(F.lit("\x02"), x["block_pos"].cast("string"), F.lit("\x03"), x["text"])).alias("_b"))
    text = F.regexp_replace(F.array_join("_b", "\n"), "([А-ЯЁа-яё])-\\n\\s*([А-ЯЁа-яё])", "$1$2")
    parts = F.split(F.regexp_replace(text, pattern(r"(?:^|\n|(?<=\x03))\s*(?=\d{1,3}\.\s+\p{Lu})"), "\x01"), "\x01")
    rows = whole.select("doc_id", parts.alias("_p")).select("doc_id", "_p", F.posexplode("_p").alias("_i", "_t"))
    ahead = F.array_join(F.slice("_p", 1, F.col("_i")), "")
    marks = F.regexp_extract_all(ahead, F.lit("\x02(\\d+)\x03"), F.lit(1))
    clean = collapse(F.regexp_replace("_t", "\x02\\d+\x03", " "))
    rows = rows.select("doc_id", clean.alias("_t"), F.get(marks, F.size(marks) - 1).cast("int").alias("block_pos")).filter(F.col("_t").rlike(r"^\d{1,3}\. \p{Lu}"))
    return rows.select("doc_id", F.regexp_extract("_t", r"^(\d{1,3})", 1).cast("int").alias("number"), F.regexp_replace("_t", r"^\d{1,3}\.\s+", "").alias("text"), "block_pos")


def item_quality(text: Column) -> Column:
    words = F.regexp_count(text, F.lit("[А-ЯЁа-яёA-Za-z]{2,}"))
    return words * 4 + F.least(F.length(text), F.lit(1200)) / 20 - F.regexp_count(text, F.lit("(?iu)[а-яё]{18,}")) * 12


def unique_items(items: DataFrame) -> DataFrame:
    """Of items with one number the best, the first of equals."""
    w = Window.partitionBy("doc_id", "number").orderBy(F.desc(item_quality(F.col("text"))), "block_pos")
    return items.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
