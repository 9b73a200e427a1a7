"""Operators on single texts: quality rules, BPE, URL filter, toxicity, languages."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import language_id
from lectern.llm import toxicity as toxicity_module
from lectern.llm.arrays import text_chunks
from lectern.llm.byte_bpe import bpe_decode, bpe_digests, bpe_encode, codec
from lectern.llm.language_id import languages
from lectern.llm.pretokens import pretokens
from lectern.llm.quality import quality_verdicts
from lectern.llm.toxicity import likelihood_ratio, toxicity, words_of
from lectern.llm.url_filter import rule_table, url_verdicts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, h8 string, row int"
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "  a", "it's we're'll 's\n's don'ts ''s \t\t x\r\n y  ", "a" * 3000 + " " + "ab" * 700, "日本語 テスト　x  　 y", "1.5€ 3²½ ", "\n\n\nfoo", "'re", "l'l'll'lla", "é's ñ're '́s", "<|endoftext|> a"]


def documents(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i if ids is None else ids[i], t, None, "s", None, True, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_quality_counts(spark):
    words = "the cat sat on a mat and looked at the dog in the yard of the house with great care".split()
    prose = " ".join(words) + ".\n"
    texts = [None, "", " \n\t ", "two words", prose * 1 + "x # * $\nx # * $\n\n\n", " ".join(["a b c d e f g h"] * 12), prose + prose, "### $$$ %%% " * 200]
    got = {r.doc_id: r for r in quality_verdicts(documents(spark, texts)).collect()}
    assert [got[i].n_words for i in range(4)] == [0, 0, 0, 2] and all(got[i].base_failed and not got[i].kept for i in range(4))
    assert got[4].n_symbols == 6 and got[4].n_dup_lines == 1
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        seen, cover = {}, set()
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for at in seen.values():
            if len(at) > 1:
                cover |= {x + j for x in at for j in range(8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(cover)), i
    assert not got[7].kept


def test_quality_keeps_prose_and_rejects_junk(spark):
    prose = "The river was wide and the bridge over it was old, but it is still used for the trade of the town. " * 3
    unlike = " ".join(f"{w}{m}" for w, m in zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(), ["###", "$$$", "%%%", "&&&"] * 6, strict=True)) + " " + " ".join(f"{i}%%%$$$###" for i in range(40))
    got = {r.doc_id: r.kept for r in quality_verdicts(documents(spark, [re.sub("old", f"old {' '.join(map(str, range(3)))}", prose.split(".")[0]) + ". It was in a good state, and people of the region went to it with a smile.", unlike])).collect()}
    assert got == {0: True, 1: False}


def test_empty_tables(spark):
    none = documents(spark, [])
    assert quality_verdicts(none).count() == 0 and bpe_digests(none, RANKS).count() == 0
    assert languages(none).count() == 0
    assert toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def reference():
    bpe, _ = codec(RANKS)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_digests_and_round_trip(spark):
    texts = [*ODD, None, "repeated", "repeated"]
    enc = reference()
    df = documents(spark, texts, [*range(len(ODD)), None, 7, 7])
    want = sorted((str(i), len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in zip([*range(len(ODD)), None, 7, 7], texts, strict=True))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(df, RANKS).collect()) == want
    back = bpe_decode(bpe_encode(df, RANKS), RANKS)
    assert sorted(bytes(r.bytes).decode() for r in back.collect()) == sorted(t or "" for t in texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab's tmdrevl1\n\t é日 ²'!")), max_size=30), max_size=4))
def test_pretokens_cut_as_the_pattern_does(texts):
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    starts, ends, bounds = pretokens(data, offs)
    for k, t in enumerate(texts):
        own = [data[a:b].tobytes().decode() for a, b in zip(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]], strict=True)]
        assert own == regex.findall(P.PATTERN, t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abcdeionrst")), min_size=1, max_size=40), min_size=1, max_size=8))
def test_matrix_merges_as_the_library_does(words):
    bpe, _ = codec(RANKS)
    enc = reference()
    ids, sizes = bpe.encode([w.encode() for w in words])
    cuts = np.cumsum(sizes)
    assert [x.tolist() for x in np.split(ids, cuts[:-1])] == [enc.encode_ordinary(w) for w in words]
    for w in words:
        assert bpe._merge_row(bpe.single[np.frombuffer(w.encode(), np.uint8)]).tolist() == enc.encode_ordinary(w)


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.com", "/en/"), ("block", "net", "/de/")]


def test_url_verdicts(spark):
    urls = [
        ("http://A.Example.COM/en/71?x", "allow", "example.com/en/7"),
        ("https://example.com/en/8", "block", "example.com/en/"),
        ("x://notexample.com/en/7", "block", "com/en/"),
        ("http://example.com", "allow", None),
        ("http://net/de/", "block", "net/de/"),
        ("http://a.b.net?/de/", "allow", None),
        ("no scheme example.com/en/", "allow", None),
        (None, "allow", None),
        ("", "allow", None),
        ("http://comx/en/", "allow", None),
        ("http://a.com/en/", "block", "com/en/"),
        ("http://a.com/en/", "block", "com/en/"),
    ]
    df = spark.createDataFrame([(i, u[0], "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    for rows in (1, 10**6):  # groups in several salts, and in one
        got = {r.page_id: (r.verdict, r.rule) for r in url_verdicts(df, rule_table(spark, RULES), salt_rows=rows).collect()}
        assert got == {i: (v, r) for i, (_, v, r) in enumerate(urls)}
    assert url_verdicts(df.limit(0), rule_table(spark, RULES)).count() == 0


def test_nested_url_rules(spark):
    """Against a plain scan over all rules, with rules of one to four labels, paths, and rules without a host."""
    rng = np.random.default_rng(2)
    names = ["a", "b", "a.b", "b.a", "c.a.b", "a.a.b", "d.c.a.b", "x.c.a.b", "ab"]
    rules = [(str(rng.choice(["allow", "block"])), str(h), str(p)) for h in names for p in rng.choice(["/", "/x", "/x/y", ""], 2, replace=False)] + [("block", "", "/"), ("block", None, "/")]
    urls = [f"s://{h}{p}" for h in [*names, "z.d.c.a.b", "q", "y.ab", "ca.b"] for p in ("", "/", "/x", "/x/y/z", "/y")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_verdicts(df, rule_table(spark, rules), salt_rows=3).collect():
        fit = [(len(h) + len(p), h, p, v) for v, h, p in rules if h and (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == ((max(fit)[1] + max(fit)[2], max(fit)[3]) if fit else (None, "allow")), urls[r.page_id]


def test_url_parts(spark):
    df = spark.createDataFrame([(1, "HTTP://User@Ho.ST:80/A/b?c#d"), (2, "a://b#c/d")], "page_id long, url string")
    assert [(r.host, r.path) for r in url_verdicts(df, rule_table(spark, RULES)).orderBy("page_id").collect()] == [("user@ho.st:80", "/A/b"), ("b", "")]


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_languages_hold_out(spark):
    rng = np.random.default_rng(3)
    words = {"en": "the of and to in is that with was for house water people great".split(), "de": "der die und das ist nicht mit von ein zu haus wasser leute gross".split(), "fr": "le la les des et en une que dans pour maison eau gens grand".split(), "es": "el la los de y en una que con para casa agua gente grande".split()}
    rows = [(i, " ".join(rng.choice(words[lang := ("en", "de", "fr", "es")[i % 4]], 30)), lang) for i in range(400)]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "en"), (1002, "das ist das haus und das wasser", None), (None, "the house of the people", "en")]
    got = {r.doc_id: r for r in languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].held_out == (crc(i, 4) == 2) for i in got if i is not None) and not got[None].held_out
    tested = [i for i in range(400) if got[i].held_out]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in tested]) > 0.97
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())


def test_toxicity_learns_and_folds(spark):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("aeiourstln"), 7)) for _ in range(3000)]
    bad = "grumblewort slimeface trash".split()
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        if i % 5 == 0:
            for _ in range(4):
                w[rng.integers(40)] = str(rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(9001, "you gr0mblewort no"), (9002, "such a sl1meface and slimefасe here"), (9003, None), (9004, "put it in the trash can please")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, lab).collect()}
    tested = [i for i in range(600) if got[i].held_out and sum(w in bad for w in rows[i][1].split())]
    assert tested and all(got[i].predicted == 1 for i in tested)
    assert all(got[i].predicted == 0 for i in range(600) if labels[i][1] == 0)
    assert got[9002].predicted == 1 and got[9003].predicted == 0 and got[9004].predicted == 0
    assert all(got[i].held_out == (crc(i, 5) == 0) for i in got)
    assert words_of("M0r0n ІDІОТ x1 12") == ["moron", "idiot", "xi"] or words_of("M0r0n")[0] == "moron"
    assert likelihood_ratio(10, 10, 0, 90) > 50


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_chunks_cover_all_rows(limit):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 3, 4]), pa.array(["ab", None, "", "défg"])], ["doc_id", "text"])
    got = [(int(i), data[offs[k] : offs[k + 1]].tobytes().decode()) for _, _, ids, offs, data in text_chunks(batch, limit=limit) for k, i in enumerate(ids)]
    assert [t for _, t in got] == ["ab", "", "", "défg"] and got[1][0] < 0


def test_language_decisions_against_a_plain_reading(spark):
    """The scores of texts from n-gram counts, one by one, and the family and votes from plain loops."""
    rng = np.random.default_rng(4)
    langs = ["en", "de", "nl", "fr", "es"]
    words = {lang: ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 7))) for _ in range(25)] for lang in langs}
    texts = [" ".join(rng.choice(words[langs[i % 5]], 25)) for i in range(100)]
    raw = [t.encode() for t in texts]
    model = language_id.fit(language_id.features(np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)), [langs[i % 5] for i in range(100)])
    tried = [*texts[:10], "Ä", "", "ab", "The Quick éß 12 brown"]
    raw = [t.encode() for t in tried]
    got, _ = language_id.decide(model, language_id.scores(model, np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)))

    def plain(text):
        x = [c if c >= 128 or 97 <= c <= 122 else (c + 32 if 65 <= c <= 90 else 32) for c in text.encode()]
        out = dict.fromkeys(model.names, 0.0)
        for k in range(3):
            grams = [x[i : i + k + 1] for i in range(len(x) - k)]
            for j, name in enumerate(model.names):
                total = 0.0
                for g in grams:
                    code = g[0] + (g[1] * 257 + 7919 if k > 0 else 0) + (g[2] * 66049 + 104729 if k > 1 else 0)
                    total += model.weights[j, (k << language_id.BITS) + ((code * 2654435761 % 2**32) >> (32 - language_id.BITS))]
                out[name] += total / len(grams) if grams else 0.0
        for j, name in enumerate(model.names):
            out[name] += model.bias[j]
        family = max(model.families, key=lambda f: out["family", f])
        votes = dict.fromkeys(model.members[family], 0)
        margin = dict.fromkeys(model.members[family], 0.0)
        for name in model.names:
            if name[:2] == ("pair", family):
                a, b, v = name[2], name[3], out[name]
                votes[a if v > 0 else b] += 1
                margin[a] += v
                margin[b] -= v
        return max(model.members[family], key=lambda m: (votes[m], margin[m]))

    assert got == [plain(t) for t in tried]


def test_toxicity_against_a_plain_matcher():
    """Folding, words, entries and exceptions by plain loops over characters."""
    lexicon = toxicity_module.Lexicon({"moron": 3.0, "idio": 2.0, "scum": 1.5, "trash": 1.0}, ["pond scum", "trash can", "idiom"], np.zeros(3))
    automaton = lexicon.automaton()
    looks = toxicity_module.LOOKALIKES

    def fold(text):
        return "".join(looks.get(c.lower(), c.lower()) if c.isalpha() else " " for c in text)

    def weigh(text):
        words = text.split()
        joined = " " + " ".join(words) + " "
        total = 0.0
        at = 0
        for w in words:
            start = joined.index(f" {w} ", at)
            at = start + 1
            silent = any(s <= start < s + len(p) + 1 for p in lexicon.exceptions for s in [m.start() for m in re.finditer(f"(?= {p} )", joined)])
            total += 0.0 if silent else max((v for k, v in lexicon.weights.items() if w.startswith(k)), default=0.0)
        return total

    for text in ["You MORON", "pond scum and scum", "an idiom, an idiot", "the trash can; trash", "сосумorоn scum", "", "mоrоn mоron scumbag"]:
        data = np.frombuffer(text.encode(), np.uint8)
        plain, other = next(toxicity_module.folded(np.array([0, len(data)]), data))
        assert other is None and plain == f" {fold(text)} "
        assert toxicity_module.matched_weight(automaton, re.sub(" +", " ", plain)) == weigh(fold(text)), text
    for text, read in [("m0r0n", "moron"), ("1d10t x", "idiot x"), ("12 34", None), ("a1", "ai")]:
        data = np.frombuffer(text.encode(), np.uint8)
        _, other = next(toxicity_module.folded(np.array([0, len(data)]), data))
        assert (other.strip() if other else None) == read
