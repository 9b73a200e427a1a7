"""The queries' results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import quality
from .chat_format import ROLES, Template

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _distance(shares: list[str], reference: tuple[float, ...]) -> str:
    parts = []
    for p, q in zip(shares, reference, strict=True):
        m = f"(({p} + {q!r}) / 2)"
        parts.append(f"CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0.0 END + " + (f"{q!r} * log2({q!r} / {m})" if q > 0 else "0.0"))
    return f"sqrt(greatest(({' + '.join(parts)}) / 2, 0.0))"


def quality_sql() -> str:
    lefts = ["t"]
    for pattern in quality.CLASSES:
        quoted = pattern.replace("'", "''")
        lefts.append(f"regexp_replace({lefts[-1]}, '{quoted}', '', 'g')")
    named = ", ".join(f"length({x}) AS c{k}" for k, x in enumerate(lefts))
    by_word = {lang: quality.word_shares(lang) for lang in quality.COMMON_WORDS}
    every = sorted({w for words in by_word.values() for w in words})
    quoted_ = lambda w: w.replace("'", "''")
    at = {w: k for k, w in enumerate(every)}
    listed = ", ".join(f"'{quoted_(w)}'" for w in every)
    counts = ", ".join(f"len(list_filter(common, lambda w: w = '{quoted_(w)}')) AS w_{k}" for w, k in at.items())
    each = []
    for lang, own in by_word.items():
        of_class = _distance([f"((c{k} - c{k + 1}) / greatest(c0, 1)::DOUBLE)" if k < len(quality.CLASSES) else f"(c{k} / greatest(c0, 1)::DOUBLE)" for k in range(len(quality.CLASSES) + 1)], quality.CLASS_SHARES[lang])
        shares = [f"(w_{at[w]} / greatest(n_words, 1)::DOUBLE)" for w in own]
        rest = "greatest(1.0::DOUBLE - " + " - ".join(shares) + ", 0.0)"
        of_words = _distance([*shares, rest], (*own.values(), 1.0 - sum(own.values())))
        each.append(f"({of_class} + {of_words}) / 2")
    return rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
repeats AS (
  SELECT doc_id, count(*) AS n_repeat_words FROM (
    SELECT DISTINCT doc_id, pos + k AS word FROM (
      SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, array_to_string(words[pos : pos + 7], ' ')) AS n
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS pos FROM base)
    ), unnest(range(0, 8)) AS u(k) WHERE n > 1
  ) GROUP BY doc_id
),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: translate(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS lines,
    list_filter(list_transform(words, lambda w: lower(rtrim(w, '.,;:!?'))), lambda w: w IN ({listed})) AS common, {named}
  FROM base
),
binned AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, {counts} FROM counted),
judged AS (
  SELECT b.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(r.n_repeat_words, 0) > 30 * n_words AS base_failed,
    least({", ".join(each)}) AS distance
  FROM binned b LEFT JOIN repeats r USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (c0 < {quality.MIN_CHARS} OR n_words < {quality.MIN_WORDS} OR distance <= {quality.MOST_DISTANCE}) AS kept
FROM judged"""


def url_sql(rules: list[tuple[str, str, str]], default: str) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES {values}),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST) AS place
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, '{default}') AS verdict FROM hits WHERE place = 1"""


def shingle_sql(words: int, num: int, den: int) -> str:
    return rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[pos : pos + {words - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) AS pos FROM base WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c * {den} >= {num} * (p.n + q.n - c)
),
arcs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN arcs b ON b.x = r.other
)
SELECT d.doc_id, coalesce(max(s.n), 0)::BIGINT AS n_shingles, coalesce(min(r.other), d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id"""


def word_dedup_sql(size: int) -> str:
    return rf"""
WITH base AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, pos, array_to_string(w[pos : pos + {size - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS pos FROM base)
),
firsts AS (SELECT s, min((doc_id, pos)) AS first FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS word
  FROM (SELECT doc_id, pos FROM windows JOIN firsts USING (s) WHERE (doc_id, pos) <> first), unnest(range(0, {size})) AS u(k)
),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM base),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.pos) AS text, count(*) AS n
  FROM words x ANTI JOIN gone g ON g.doc_id = x.doc_id AND g.word = x.pos GROUP BY x.doc_id
)
SELECT b.doc_id, len(b.w)::BIGINT AS n_words, (len(b.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM base b LEFT JOIN kept k USING (doc_id)"""


def byte_dedup_sql(size: int) -> str:
    return rf"""
WITH base AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, pos, substr(h, 2 * pos - 1, {2 * size}) AS s
  FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - {size - 2})) AS pos FROM base)
),
firsts AS (SELECT s, min((doc_id, pos)) AS first FROM windows GROUP BY s HAVING count(*) > 1),
again AS (SELECT doc_id, pos FROM windows JOIN firsts USING (s) WHERE (doc_id, pos) <> first),
runs AS (
  SELECT doc_id, min(pos) AS a, max(pos) + {size} AS b FROM (
    SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
      SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= {size} THEN 0 ELSE 1 END AS fresh FROM again
    )
  ) GROUP BY doc_id, run
),
pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS since FROM runs
),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * since - 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) - 1) AS h, count(*) AS n, sum(b - a) AS gone
  FROM pieces JOIN base USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, (length(b.h) // 2)::BIGINT AS n_bytes, coalesce(k.gone, 0)::BIGINT AS n_removed, coalesce(k.n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.h, b.h))) AS kept_sha256
FROM base b LEFT JOIN kept k USING (doc_id)"""


def middle_sql() -> str:
    return """
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
rolled AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS y,
    ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4
  FROM hashed
),
formed AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM rolled
),
cut AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut"""


def chat_sql(template: Template, control: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    def escaped(c: str) -> str:
        c = f"replace({c}, '\\', '\\\\')"
        for k in template.controls:
            c = f"replace({c}, {quote(k)}, {quote(k[0] + chr(92) + k[1:])})"
        return c

    names = " ".join(f"WHEN {quote(r)} THEN {len(a) + len(b)} + length(body)" for r, a, b in template.roles)
    roles = " ".join(f"WHEN {quote(old)} THEN {quote(new)}" for old, new in ROLES.items())
    return f"""
WITH every AS (
  SELECT conv_id, turn, CASE role {roles} ELSE coalesce(role, '') END AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {quote(control)}), (-1, 1, 'assistant', {quote(control)})
),
bodies AS (SELECT *, {escaped("text")} AS body, {escaped("role")} AS other FROM every),
sized AS (SELECT *, CASE role {names} ELSE {sum(map(len, template.other))} + length(other) + length(body) END AS chars FROM bodies)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


def merkle_sql() -> str:
    framed = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    digest = lambda n: "sha256(" + " || ".join(framed(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    bits = "list_reduce(list_prepend(k, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    return f"""
WITH RECURSIVE crc AS (SELECT list({bits} ORDER BY k) AS steps FROM (SELECT unnest(range(256)) AS k)),
hashed AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {digest("n_chars")} AS leaf, CASE WHEN {crc} % 7 = 0 THEN {digest("(n_chars + 1)")} ELSE {digest("n_chars")} END AS seen FROM documents, crc
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed
),
inner_nodes(g, level, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM leaves
  UNION ALL SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM inner_nodes WHERE n > 1 GROUP BY g, level, i // 2, n
),
subroots AS (SELECT g, h, level, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
outer_nodes(level, i, n, h) AS (
  SELECT 0, i, n, h FROM subroots
  UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM outer_nodes WHERE n > 1 GROUP BY level, i // 2, n
),
walk(id, g, level, i, n, folded, proof) AS (
  SELECT g || ' ' || i, g, 0, i, n, seen, '' FROM leaves
  UNION ALL
  SELECT w.id, w.g, w.level + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN w.i % 2 = 1 THEN s.h || w.folded ELSE w.folded || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN inner_nodes s ON s.g = w.g AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1
),
up(id, level, i, n, folded, proof) AS (
  SELECT w.id, 0, s.i, s.n, w.folded, w.proof FROM walk w JOIN subroots s USING (g) WHERE w.n = 1
  UNION ALL
  SELECT u.id, u.level + 1, u.i // 2, (u.n + 1) // 2, sha256(CASE WHEN u.i % 2 = 1 THEN s.h || u.folded ELSE u.folded || coalesce(s.h, '') END), u.proof || coalesce(s.h, '')
  FROM up u LEFT JOIN outer_nodes s ON s.level = u.level AND s.i = xor(u.i, 1) WHERE u.n > 1
),
root AS (SELECT h AS root FROM outer_nodes WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = root AS verified
FROM leaves l JOIN subroots s USING (g) JOIN up u ON u.id = l.g || ' ' || l.i, root WHERE u.n = 1"""
