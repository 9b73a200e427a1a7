"""Chat formatting: records of many layouts become canonical turns, and turns become text with a loss mask.

A record's layout is told by its fingerprint, a hash of the nested paths of its
fields; each layout that is known has a declarative mapping from paths to turns.
All of it is DataFrame functions over VARIANT values, but for the digests of
whole conversations, which are one pass over ordered rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import ready, width

TURN = "array<struct<turn: bigint, role: string, text: string>>"
#: Names of roles in other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: How deep paths go; what lies deeper counts as one field.
DEPTH = 5


@dataclass(frozen=True)
class Layout:
    """How records of one layout become turns.

    ``conv`` is the path of the conversation's id. A record of many turns has
    ``items``, the path of their array, and ``role`` and ``text`` inside an item;
    one of a single turn has ``role``, ``text`` and ``turn`` beside the id; one
    of fixed fields has ``fields``: (role, paths whose texts are joined by a blank
    line). ``text`` may be an array of parts, whose texts are at ``part``. Paths
    in ``optional`` may be missing.
    """

    name: str
    conv: str
    items: str | None = None
    role: str | None = None
    text: str | None = None
    turn: str | None = None
    part: str | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        """The nested paths that the mapping reads, as ``fingerprint`` names them."""
        if self.fields:
            inner = {p for _, ps in self.fields for p in ps}
        else:
            text = f"{self.text}[].{self.part}" if self.part else self.text
            inner = {f"{self.items}[].{p}" if self.items else p for p in (self.role, text)} | ({self.turn} if self.turn else set())
        return {self.conv} | inner

    def prints(self) -> set[str]:
        """The fingerprints of the layout, with and without each optional path."""
        must = self.paths() - set(self.optional)
        few = [set(c) for k in range(len(self.optional) + 1) for c in itertools.combinations(self.optional, k)]
        return {path_hash(must | more) for more in few}


LAYOUTS = (
    Layout("turn", "conv_id", role="role", text="text", turn="turn"),
    Layout("messages", "id", items="messages", role="role", text="content"),
    Layout("parts", "id", items="messages", role="role", text="content", part="text"),
    Layout("shared", "id", items="conversations", role="from", text="value"),
    Layout("instruction", "id", fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt", "id", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", "id", fields=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",))), optional=("system",)),
)


def path_hash(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths, key=str.encode)).encode()).hexdigest()


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, "$" + "".join(f'["{p}"]' for p in path.split(".")), kind)


def nested_paths(v: Column, prefix: Column | None = None, depth: int = DEPTH) -> Column:
    """The paths of a VARIANT's fields, ``a.b`` inside objects and ``a[]`` inside arrays, each once. An empty object or array is a field; a null value is one too, whatever its type would be."""
    here = F.array(F.lit("") if prefix is None else prefix)
    if not depth:
        return here
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    at = (lambda k: k) if prefix is None else (lambda k: F.concat(prefix, F.lit("."), k))
    inside = F.flatten(F.transform(entries, lambda e: nested_paths(e["value"], at(e["key"]), depth - 1)))
    if prefix is None:
        return F.when(F.size(entries) > 0, inside).otherwise(here)
    items = F.try_variant_get(v, "$", "array<variant>")
    each = F.array_distinct(F.flatten(F.transform(items, lambda x: nested_paths(x, F.concat(prefix, F.lit("[]")), depth - 1))))
    return F.when(F.size(entries) > 0, inside).when(F.size(items) > 0, each).otherwise(here)


def fingerprint(v: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The hash of a record's nested paths. Paths that no layout has (notes, sources, ratings) don't count, so that further fields of a record don't hide its layout."""
    known = sorted({p for x in layouts for p in x.paths()})
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(nested_paths(v), F.array(*map(F.lit, known)))), "\n").cast("binary"), 256)


def _role(c: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(names[c], c, F.lit(""))


def _turns(v: Column, layout: Layout) -> Column:
    text = lambda x, path: F.coalesce(F.concat_ws("", F.transform(_get(x, path, "array<variant>"), lambda p: _get(p, layout.part, "string"))) if layout.part else _get(x, path, "string"), F.lit(""))
    row = lambda k, role, t: F.struct(k.cast("long").alias("turn"), role.alias("role"), t.alias("text"))
    if layout.fields:
        found = [F.concat_ws("\n\n", *(F.when(_get(v, p, "string") != "", _get(v, p, "string")) for p in paths)) for _, paths in layout.fields]
        has = [F.lit(True) if set(paths) - set(layout.optional) else F.concat_ws("", *(_get(v, p, "string") for p in paths)) != "" for _, paths in layout.fields]
        rows = F.array(*(F.when(h, row(F.lit(k), F.lit(role), t)) for k, ((role, _), t, h) in enumerate(zip(layout.fields, found, has, strict=True))))
        return F.array_compact(rows).cast(TURN)
    if layout.items:
        items = _get(v, layout.items, "array<variant>")
        return F.transform(items, lambda x, k: row(k, _role(_get(x, layout.role, "string")), text(x, layout.text))).cast(TURN)
    return F.array(row(_get(v, layout.turn, "bigint"), _role(_get(v, layout.role, "string")), text(v, layout.text))).cast(TURN)


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(layout, conv_id, turn, role, text) of each turn of each record.

    ``record_col`` is a VARIANT, or JSON text. The fingerprint picks the layout;
    layouts whose fingerprints meet are refused. A record of no known layout, or
    one that isn't JSON, is one row with a null ``layout`` and its JSON as
    ``text``, so nothing is lost. Texts that are null or missing are empty,
    a role that is null is an empty one, and other names of roles become the
    canonical ones. A list of no turns gives no rows. Other columns are not read.
    No shuffle.
    """
    ready(records.sparkSession)
    prints = [(p, x) for x in layouts for p in sorted(x.prints())]
    if len({p for p, _ in prints}) < len(prints):
        raise ValueError("two layouts have a fingerprint in common")
    raw = F.col(record_col)
    if isinstance(records.schema[record_col].dataType, type(records.select(F.lit("").alias("x")).schema["x"].dataType)):
        rows = records.select(F.try_parse_json(raw).alias("v"), raw.alias("json"))
    else:
        rows = records.select(raw.alias("v"), F.lit(None).cast("string").alias("json"))
    names = F.create_map(*(F.lit(x) for p, layout in prints for x in (p, layout.name)))
    rows = rows.withColumn("layout", names[fingerprint(F.col("v"), layouts)])
    whole = F.array(F.struct(F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.coalesce(F.col("json"), F.to_json(F.col("v"))).alias("text"))).cast(TURN)
    turns, conv = whole, F.lit(None).cast("long")
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, _turns(F.col("v"), x)).otherwise(turns)
        conv = F.when(F.col("layout") == x.name, _get(F.col("v"), x.conv, "bigint")).otherwise(conv)
    return rows.select("layout", conv.alias("conv_id"), F.inline(turns))


@dataclass(frozen=True)
class Template:
    """What stands before and behind the text of each role, and of any other role, which it names.

    ``controls`` are all control strings of the template and of the model. A text
    or role name never holds one after escaping: the first character of each is
    followed by a backslash, and backslashes are doubled.
    """

    name: str
    roles: tuple[tuple[str, str, str], ...]
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    loss: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        heads = [before for _, before, _ in self.roles] + [self.other[0]]
        if any(a is not b and a.startswith(b) for a in heads for b in heads):
            raise ValueError("the beginning of one role is that of another too")
        if any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings have two characters or more and no backslash")
        if not all(any(c in x for c in self.controls) for _, a, b in self.roles for x in (a, b)) or not all(any(c in x for c in self.controls) for x in self.other):
            raise ValueError("each mark must hold a control string, or a text could hold the mark")


INSTRUCT = Template(
    "instruct",
    (("user", "[INST] ", " [/INST]"), ("assistant", "<s>", "</s>"), ("system", "<<SYS>>\n", "\n<</SYS>>")),
    ("[ROLE]", "[/ROLE]", "[END]"),
    ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]"),
)
CHAT_MARKS = Template(
    "chat_marks",
    (("user", "<|start|>user\n", "<|end|>\n"), ("assistant", "<|start|>assistant\n", "<|end|>\n"), ("system", "<|start|>system\n", "<|end|>\n")),
    ("<|role|>", "<|start|>", "<|end|>\n"),
    ("<|start|>", "<|end|>", "<|role|>"),
)


def escape(c: Column, template: Template) -> Column:
    """The text with backslashes doubled and one behind the first character of each control string."""
    firsts = "|".join(f"{re.escape(k[0])}(?={re.escape(k[1:])})" for k in template.controls)
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), f"({firsts})", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(\\?)", "$1")


def formatted_turns(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, turn, tie, segment, loss_start, loss_end) of each row of (conv_id, turn, role, text).

    A conversation's text is its segments in the order of (turn, tie), one behind
    the other; ``tie`` orders rows of one turn by role and text. A conversation
    may be longer than a value can be, so it stays in pieces. The loss mask is
    the code points from ``loss_start`` to ``loss_end`` of a segment, null outside
    the roles that are learnt. A null role or text is an empty one. No shuffle.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    before, after = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1])), F.lit(template.other[2])
    for name, a, b in template.roles:
        before, after = F.when(role == name, F.lit(a)).otherwise(before), F.when(role == name, F.lit(b)).otherwise(after)
    rows = turns.select("conv_id", "turn", F.struct(role.alias("role"), text.alias("text")).alias("tie"), before.alias("before"), escape(text, template).alias("body"), after.alias("after"))
    learnt = F.col("tie.role").isin(*template.loss)
    start = F.when(learnt, F.length("before").cast("long"))
    return rows.select("conv_id", "turn", "tie", F.concat("before", "body", "after").alias("segment"), start.alias("loss_start"), (start + F.length("body")).alias("loss_end"))


def read_segments(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """All columns of ``formatted_turns``, and (role, text, loss_text) as the segment and its mask give them back, by the marks alone; null where a segment isn't one of the template."""
    seg = F.col("segment")
    quoted = [(name, re.escape(a), re.escape(b)) for name, a, b in template.roles]
    role, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    a, b, c = map(re.escape, template.other)
    fits = seg.rlike(rf"(?s)\A{a}.*?{b}.*{c}\z")
    role, body = F.when(fits, unescape(F.regexp_extract(seg, rf"(?s)\A{a}(.*?){b}", 1))).otherwise(role), F.when(fits, F.regexp_extract(seg, rf"(?s)\A{a}.*?{b}(.*){c}\z", 1)).otherwise(body)
    for name, a, b in quoted:
        fits = seg.rlike(rf"(?s)\A{a}.*{b}\z")
        role, body = F.when(fits, F.lit(name)).otherwise(role), F.when(fits, F.regexp_extract(seg, rf"(?s)\A{a}(.*){b}\z", 1)).otherwise(body)
    loss = F.substring(seg, F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return segments.select("*", role.alias("role"), unescape(body).alias("text"), unescape(loss).alias("loss_text"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows ordered by conversation: digests take a piece at a time, so a conversation of any length needs no more room than a batch."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    conv, state, done = object(), None, []

    def close():
        if state is not None:
            done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def out():
        cols = list(zip(*done, strict=True)) or [[]] * 6
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    for batch in batches:
        for key, role, text, loss, loss_chars, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or key != conv:
                close()
                conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                state[2] += loss_chars
                state[3].update(loss.encode())
            state[4] += chars
        yield out()
        done = []
    close()
    yield out()


def chat_digests(records: DataFrame, record_col: str = "record", template: Template = INSTRUCT, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation of the records, read back from what ``formatted_turns`` gives.

    Turns go in the order of (turn, role, text), so ties and repeated rows have
    a defined place; a null turn comes first; rows of a null id, records of no
    known layout among them, are one conversation. An empty table gives no rows.
    One shuffle by the conversation; its digests need its turns in order, so one
    task streams them, without holding more than a batch.
    """
    segments = formatted_turns(canonical_turns(records, record_col, layouts), template)
    rows = read_segments(segments.repartition(width(segments), "conv_id").sortWithinPartitions("conv_id", "turn", "tie"), template)
    return rows.select("conv_id", "role", "text", "loss_text", F.length("loss_text").cast("long"), F.length("segment").cast("long")).mapInArrow(_digested, DIGESTS)
