"""Operators 1, 4, 6, 8 and 9: per text."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import catalogue, language_id, lm_scoring, quality_rules, token_counts, url_filters

from .conftest import DOCS, with_extra

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TABLES = token_counts.PretokenLengths(open(PATH, encoding="utf-8").read(), {})


def library_count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\u00a0\u2003'#1a<|>é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_equal_the_library(text):
    assert TABLES.count([text]) == [library_count(text) if text else 0]


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "a  b", " a", "a ", "a\n b", "it's don't", "  \n\n  x", "\u0558 x", "x" * 5000, " \u2028 y"])
def test_odd_counts(text):
    assert TABLES.count([text, None, ""]) == [library_count(text), 0, 0]


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    tables = token_counts.PretokenLengths(open(PATH, encoding="utf-8").read(), {"of": 1})
    texts = ["a quick brown fox of the woods jumps " * 3, "of the"]
    assert tables.count(texts) == [library_count(t) for t in texts] and "of" in tables.known


def test_token_counts(spark, rows, folder):
    found = {r.doc_id: r for r in catalogue.QUERIES["op4_token_counts"](spark, folder).collect()}
    assert len(found) == len(rows)
    for doc_id, text, *_ in rows:
        n = library_count(text or "")
        assert (found[doc_id].n_bytes, found[doc_id].n_tokens, found[doc_id].over_limit) == (len((text or "").encode()), n, n > 1024)
    df = with_extra(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id int, text string"))
    assert sorted(map(str, token_counts.count_tokens(df, PATH).select("doc_id", "n_tokens").collect())) == ["Row(doc_id=1, n_tokens=2)", "Row(doc_id=1, n_tokens=2)", "Row(doc_id=None, n_tokens=0)"]
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


def table_sent(spark, monkeypatch, df, **named):
    """The broadcast table of frequent words."""
    sent, broadcast = [], spark.sparkContext.broadcast
    with monkeypatch.context() as patched:
        patched.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or broadcast(value))
        token_counts.count_tokens(df, PATH, **named)
    (table,) = (value for value in sent if isinstance(value, dict))
    return table


def test_frequent_words_are_those_of_all_rows(spark, monkeypatch):
    texts = ["x early early first<|endoftext|>"] * 600 + ["x late later late<|endoftext|> special", "x late later" + " y" * 200, "x once"] * 1000 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    assert table_sent(spark, monkeypatch, df, frequent_entries=4) == {w: library_count(" " + w) for w in ("y", "late", "later", "early")}
    assert table_sent(spark, monkeypatch, df).keys() == {"y", "late", "later", "early", "special", "once", "first"}
    tied = table_sent(spark, monkeypatch, df, frequent_entries=5).keys()
    assert len(tied) == 5 and {"y", "late", "later", "early"} < tied < {"y", "late", "later", "early", "special", "once"}
    assert table_sent(spark, monkeypatch, df.limit(1)).keys() == {"early"} and table_sent(spark, monkeypatch, df, frequent_entries=0) == {}


def test_words_are_counted_as_looked_up(rows):
    texts = [t for _, t, *_ in rows] + ["a b<|endoftext|> b  c \n d ", "a " + "long" * 20]
    looked = Counter()

    class Known(dict):
        def get(self, word):
            looked[word] += 1
            return 0

    tables = token_counts.PretokenLengths(open(PATH, encoding="utf-8").read(), {})
    tables.known = Known()
    tables.count(texts)
    assert looked.pop("long" * 20) == 1 and all(len(w) <= 64 for w in looked)
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7], pa.string())], ["text"]) for i in range(0, len(texts), 7)]
    for most in (1, 300, 10**6):
        found = [Counter(dict(zip(*b.to_pydict().values(), strict=True))) for b in token_counts.word_counts(iter(batches), tables.special, most)]
        assert sum(found, Counter()) == looked and (len(found) == 1) == (most == 10**6)


def test_quality_rules(spark, folder, agrees, duck, rows, monkeypatch):
    agrees(catalogue.QUERIES["op6_quality_rules"](spark, folder), catalogue.ORACLE["op6_quality_rules"])
    low, low_text = (sql.replace("c.n > 20", "c.n > 3") for sql in (catalogue.ORACLE["op6_quality_rules"], catalogue.LEFT_TEXT))
    assert low != catalogue.ORACLE["op6_quality_rules"]
    df = spark.read.parquet(f"{folder}/documents.parquet")
    left = {i: t for i, t, *_ in rows} | dict(duck.execute(low_text).fetchall())
    for bound in (quality_rules.BROADCAST_LINES, 0):
        monkeypatch.setattr(quality_rules, "BROADCAST_LINES", bound)
        judged = quality_rules.judge_documents(with_extra(df), line_documents=3)
        assert any("False" in r for r in agrees(judged, low))
        kept = {r.doc_id for r in judged.filter("kept").collect()}
        cleaned = quality_rules.cleaned_documents(with_extra(df), line_documents=3)
        found = {r.doc_id: r for r in cleaned.collect()}
        assert found.keys() == kept and cleaned.columns == with_extra(df).columns
        assert all(r.text == left[i] and r.n_chars == len(left[i]) and r.text_row == "clash" for i, r in found.items())
        assert sum(r.text != t for i, t, *_ in rows if (r := found.get(i))) > 20


def test_lines_of_copies_count_by_document(spark, monkeypatch):
    """Copies under ids of their own count each; rows that repeat count once; a large host has a fixed limit too."""
    line = "a line that all of them have"
    body = " ".join(f"w{i}" for i in range(30))
    copies = spark.createDataFrame([(i, f"{line}\n{body}\nend", "h") for i in range(200)], "doc_id long, text string, source string")
    assert quality_rules.judge_documents(copies).filter("n_removed_words = n_words and not kept").count() == 200
    own = spark.createDataFrame([(i, f"{line}\n{body} {i}", "h") for i in range(25)] + [(1000 + i, f"{body} {i} x", "h") for i in range(300)], "doc_id long, text string, source string")
    assert quality_rules.judge_documents(own).filter("n_removed_words > 0").count() == 0
    found = {r.doc_id: r.text for r in quality_rules.cleaned_documents(own, line_most=22).collect()}
    assert found == {i: f"{body} {i}" for i in range(25)} | {1000 + i: f"{body} {i} x" for i in range(300)}
    repeated = copies.limit(1).unionAll(copies.limit(1)).crossJoin(spark.range(15).drop("id"))
    assert quality_rules.judge_documents(repeated).filter("n_removed_words > 0").count() == 0


def test_quality_edges(spark):
    common = "this line is on every page of it\nanother line that all pages of it have\nand a third one that is on all pages\n"
    text = common + " ".join(f"w{i}" for i in range(30))
    only_line = common + "short tail"
    df = spark.createDataFrame([(i, text + f" {i}", None) for i in range(30)] + [(99, only_line, None), (None, None, "s"), (None, "", "s"), (5, text, "t"), (5, text, "t")], "doc_id long, text string, source string")
    kept = {(r.doc_id, r.n_removed_words): r.kept for r in quality_rules.judge_documents(df).collect()}
    assert kept[(3, 25)] is True and kept[(99, 25)] is False and kept[(None, 0)] is False and kept[(5, 0)] is True
    cleaned = quality_rules.cleaned_documents(with_extra(df))
    assert sorted(r.doc_id for r in cleaned.filter("text_row = 'clash'").collect()) == sorted([*range(30), 5, 5])
    assert cleaned.filter("source is null and text like '%this line%'").count() == 0 and cleaned.filter("source = 't' and text like '%this line%'").count() == 2
    assert quality_rules.judge_documents(df.limit(0)).count() == 0 and quality_rules.cleaned_documents(df.limit(0)).count() == 0


def test_repeated_words():
    texts = ["a b c d e f g h " * 2, "a b c d e f g h i", "x " * 9, "x " * 8, "", "p q r s t u v w x p q r s t u v w"]
    documents = [t.encode().split() for t in texts]
    for words in documents:
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality_rules.repeated_words(words) == len(covered)
    assert [bool(f) for f in quality_rules.may_repeat(documents)] == [quality_rules.repeated_words(w) > 0 for w in documents]


URLS = [
    None, "", "no scheme", "http://example.org/es/1", "https://Sub.EXAMPLE.org/en/1?x", "http://example.org/en/2#y", "http://example.org", "http://example.org?/es/", "http://badexample.org/es/",
    "http://a.com/fr/", "http://a.com/de/x", "http://com/de/", "http://a.net/de/", "http:///es/", "x://org/://b.com/de/", "http://user@example.org:80/es/", "http://example.org./es/", "http://a.example.org/es/",
]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i, c in enumerate(tail) if c in "?#"], default=len(tail))]
    fits = [(len(h + p), h + p, a) for a, h, p in catalogue.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_url_filters(spark, monkeypatch):
    df = with_extra(spark.createDataFrame([*enumerate(URLS), (3, URLS[3]), (None, URLS[4])], "page_id int, url string").drop("host"))
    rules = url_filters.rule_table(spark, catalogue.URL_RULES)
    expected = sorted(str((i, *brute_verdict(u))) for i, u in [*enumerate(URLS), (3, URLS[3]), (None, URLS[4])])
    for bound in (url_filters.BROADCAST_RULES, 0):
        monkeypatch.setattr(url_filters, "BROADCAST_RULES", bound)
        found = url_filters.judge_urls(df, rules)
        assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in found.collect()) == expected
    odd = spark.createDataFrame([(1, "http://orgx/a"), (2, "http://org" + "/x" * 3), (3, "http://" + "a." * 200_000 + "org/x"), (4, "http://a.org/" + "p" * 3_000_000)], "page_id int, url string")
    pathless = url_filters.rule_table(spark, [("block", "org", "x"), ("block", "org", "/x"), ("allow", "a.org", "")])
    assert sorted((r.page_id, r.verdict) for r in url_filters.judge_urls(odd, pathless).collect()) == [(1, "allow"), (2, "block"), (3, "allow"), (4, "allow")]
    assert url_filters.judge_urls(df, rules.limit(0)).filter("verdict = 'allow' and rule is null").count() == len(expected)
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0


# Language identification.

SAMPLES = {"en": "the house of this river and those mountains were green when they walked over there", "fr": "la maison de cette rivière était très verte quand nous avons marché jusqu'à là-bas", "de": "das haus an diesem fluss war sehr grün als wir über die berge dorthin gegangen sind"}


def speech(lang, seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(SAMPLES[lang].split(), n))


@pytest.fixture(scope="module")
def field():
    return language_id.train([(speech(lang, s), lang) for lang in SAMPLES for s in range(12)])


def test_code_switching(field):
    text = f"{speech('en', 100, 12)} 42 {speech('fr', 101, 12)} -- {speech('de', 102, 12)}"
    labeller = language_id.Labeller(field)
    documents = [text.encode().split(), [], b"12 34".split()]
    chances, sizes, lettered = labeller.chances(documents)
    spans = language_id.word_spans(documents, chances, lettered, field.languages)
    assert [s["lang"] for s in spans[0]] == ["en", "fr", "de"] and spans[1:] == [[], []] and sizes.tolist() == [36, 0, 0]


def test_long_words_are_linear(field):
    """Words of millions of letters or other signs."""
    import time

    began = time.perf_counter()
    assert language_id.letters_of(b"1" * 10_000_000) == "" and language_id.letters_of("1é2b-".encode()) == "é2b" and language_id.letters_of(b"--a" + b"!" * 1_000_000) == "a"
    word = "maison" * 3000
    assert np.allclose(field.long_scores(word[:4000]), field.scores([word[:4000]])[0])
    assert field.scores(["house", word, "x" * 2_000_000]).shape == (3, 3) and time.perf_counter() - began < 30


def test_held_out_accuracy(spark):
    """The share of held-out documents of the tables whose language is predicted."""
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("the tables aren't there")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify_languages(docs, spans=False).filter("held_out and lang_pred != 'und'").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.98


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, move, first = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    sizes = np.array([2, 0, 4, 1])
    got, expected = language_id.forward_backward(scores, sizes, move, first, pairs=True)
    total, pairs, at = np.zeros((7, 3)), np.zeros((3, 3)), 0
    for size in sizes:
        weights = {}
        for path in np.ndindex(*[3] * size):
            if size:
                s = first[path[0]] + sum(scores[at + i, t] for i, t in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))
                weights[path] = math.exp(s)
        for path, w in weights.items():
            for i, t in enumerate(path):
                total[at + i, t] += w / sum(weights.values())
            for a, b in zip(path, path[1:], strict=False):
                pairs[a, b] += w / sum(weights.values())
        at += size
    assert np.allclose(got, total) and np.allclose(expected, pairs)


def test_language_id(spark):
    rows = [(i, speech(lang, i), lang if i % 10 else None) for i, lang in enumerate([*SAMPLES] * 30)]
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !!", "de"), (None, speech("fr", 7), "fr"), (3, speech("en", 3), "en"), (2000, speech("de", 9, 30_000), None)]
    df = with_extra(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    found = language_id.identify_languages(df).collect()
    truth = {(i, t) for i, t, _ in rows}
    assert len(found) == len(rows) and len({r.doc_id for r in found}) == len({i for i, _ in truth})
    import zlib

    for r in found:
        assert r.held_out is (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    named = {r.doc_id: r.lang_pred for r in found}
    assert {named[i] for i in (1000, 1001, 1002)} == {"und"} and named[2000] == "de" and named[None] == "fr"
    assert all(named[i] == lang for i, lang in enumerate([*SAMPLES] * 30) if i != 3)
    assert language_id.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred != 'und' or score != 0").count() == 0
    assert language_id.identify_languages(df.limit(0)).count() == 0


def test_prediction_ignores_held_out_labels(spark):
    rows = [(i, speech(lang, i), lang) for i, lang in enumerate([*SAMPLES] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = df.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    key = lambda d: sorted(map(str, language_id.identify_languages(d, spans=False).collect()))
    assert key(df) == key(wrong)


# LM scoring.


def brute_scores(texts, targets):
    """Losses by plain counting: {id: (tokens, target loss, background loss)}."""
    split = {i: (t or "").lower().split() if (t or "").isascii() else (t or "").encode().lower().decode().split() for i, t in texts.items()}
    grams, unis = ({True: Counter(), False: Counter()} for _ in range(2))
    for i, words in split.items():
        mine = i in targets
        grams[mine].update(zip([None, *words], words, strict=False))
        unis[mine].update([None, *words] if words else [])
    n = {k: sum(c for w, c in u.items() if w is not None) for k, u in unis.items()}
    size = min(n.values()) or max(n.values())
    out = {}
    for i, words in split.items():
        found = []
        for k in (True, False):
            scale = size / n[k] if n[k] else 0
            loss = 0.0
            for v, w in zip([None, *words], words, strict=False):
                share = (unis[True][w] + unis[False][w]) / sum(n.values())
                chance = (unis[k][w] * scale + 10 * share) / ((size if scale else 0) + 10)
                loss -= math.log((grams[k][v, w] * scale + 10 * chance) / (unis[k][v] * scale + 10))
            found.append(loss / len(words) if words else None)
        out[i] = (len(words), *found)
    return out


def test_lm_scoring(spark, rows, folder, monkeypatch):
    texts = {r[0]: r[1] for r in rows}
    targets = {r[0] for r in rows if r[0] % 2 and r[0] % 5 > 0 and r[0] % 7}
    truth = brute_scores(texts, targets)
    for size, bound in ((lm_scoring.BATCH_BYTES, 10), (5000, 0)):
        monkeypatch.setattr(lm_scoring, "BATCH_BYTES", size)
        monkeypatch.setattr(lm_scoring, "BROADCAST_TARGETS", bound)
        found = {r.doc_id: r for r in catalogue.QUERIES["op9_lm_scoring"](spark, folder).collect()}
        assert found.keys() == truth.keys()
        for i, (n, target, background) in truth.items():
            r = found[i]
            assert r.n_tokens == n and (n > 0 or r.score is None)
            assert n == 0 or (math.isclose(r.target_loss, target, rel_tol=1e-9) and math.isclose(r.background_loss, background, rel_tol=1e-9) and math.isclose(r.score, target - background, rel_tol=1e-6, abs_tol=1e-9))


def test_large_counts_are_packed():
    values = np.array([0, 1, 65_534, 65_535, 65_536, 10**12, 3])
    assert lm_scoring.unpack_counts(lm_scoring.pack_counts(values), 7).tolist() == values.tolist()


def test_lm_edges(spark):
    df = with_extra(spark.createDataFrame([(1, "a b a b"), (1, "a b a b"), (None, "c c"), (2, None)], "doc_id long, text string"))
    ids = spark.createDataFrame([(1,), (1,), (None,), (77,)], "doc_id long")
    found = lm_scoring.score_documents(df, ids).collect()
    assert len(found) == 4 and sum(r.score is None for r in found) == 1 and len({r.score for r in found if r.doc_id == 1}) == 1
    assert next(r.score for r in found if r.doc_id == 1) < next(r.score for r in found if r.doc_id is None)
    assert lm_scoring.score_documents(df, ids.limit(0)).count() == 4 and lm_scoring.score_documents(df.limit(0), ids).count() == 0
