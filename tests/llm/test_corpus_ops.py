"""Operators 2, 3, 5, 7 and 10, components and the pipeline: over the corpus."""

import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import catalogue, components, decontamination, html_extraction, ngram_join, source_mixing, substring_dedup

from .conftest import DOCS, with_extra


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(8, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 8), (300, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# N-gram join.


def shingles(text):
    words = ngram_join.lowered_words(text)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_groups(rows):
    sets = {}
    for i, t, *_ in rows:
        sets.setdefault(i, shingles(t))
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(spark, folder, agrees, rows):
    agrees(catalogue.QUERIES["op2_ngram_join"](spark, folder), catalogue.ORACLE["op2_ngram_join"])
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in catalogue.QUERIES["op2_ngram_join"](spark, folder).collect()}
    assert found == brute_groups(rows) and len({c for _, c in found.values()}) < len(found) - 20


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with their own edits, many of them unlike each other, and chains; all frequencies are capped."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(50, " ".join(base))]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3, 6])):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(copy)))
    chain = [f"c{rng.randrange(10**6)}" for _ in range(200)]
    rows += [(900 - i, " ".join(chain[i * 7 : i * 7 + 90])) for i in range(12)]
    df = with_extra(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()}
    assert found == brute_groups(rows)


def test_all_links_of_classes(spark, folder, agrees, monkeypatch):
    """Every pair of similar texts is a link, not only those that connect their group."""
    agrees(catalogue.QUERIES["op2_ngram_links"](spark, folder), catalogue.ORACLE["op2_ngram_links"])
    monkeypatch.setattr(ngram_join, "CELL_CLASSES", 4)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(100)]
    rows = [(0, " ".join(base)), (1, " ".join(base).upper())]
    for i in range(2, 40):
        copy = base[: rng.randrange(70, 101)]
        copy[rng.randrange(len(copy))] = f"e{i}"
        rows.append((i, " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows if i != 1}
    truth = {(x, y, len(sets[x] & sets[y]), len(sets[x] | sets[y])) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])}
    df = with_extra(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    pairs, members = ngram_join.class_pairs(df)
    of = {}
    for r in members.collect():
        of[r["class"]] = min(r.doc_id, of.get(r["class"], r.doc_id))
    found = [(*sorted((of[r.a], of[r.b])), r.shared, r.total) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == truth and len(truth) > 90
    links = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.document_links(df).collect()}
    assert links == {i: (0 if i == 1 else i, sum((0 if i == 1 else i) in t[:2] for t in truth)) for i, _ in rows}


def test_marks_of_frequent_shingles_reach_all_partitions(spark, monkeypatch):
    """A batch of near copies with fewer rare shingles than partitions, and a copy in a batch of its own."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{base} tail{i}") for i in range(8)] + [(100, f"{base} other")]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 8)
    try:
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    finally:
        spark.conf.set(batch, before)
    assert found == brute_groups(rows) and found[100][1] == 0


def test_ngram_edges(spark):
    df = with_extra(spark.createDataFrame([(None, "a b c d e f"), (4, "A b c d  e f"), (4, "A b c d  e f"), (2, None), (3, ""), (9, "x y"), (8, "X\ty"), (None, "lonely text")], "doc_id long, text string"))
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()), key=str)
    assert found == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (2, 0, 2), (3, 0, 3), (9, 1, 8), (8, 1, 8), (None, 1, None)], key=str)
    chosen = ngram_join.one_of_each_group(df)
    assert chosen.columns == df.columns and chosen.filter("text_row != 'clash'").count() == 0
    kept = sorted(((r.doc_id, r.text) for r in chosen.collect()), key=str)
    assert kept == sorted([(None, "a b c d e f"), (None, "lonely text"), (2, None), (3, ""), (4, "A b c d  e f"), (8, "X\ty")], key=str)
    assert ngram_join.similar_groups(df.limit(0)).count() == 0 and ngram_join.one_of_each_group(df.limit(0)).count() == 0


# Substring dedup.


def brute_kept(rows):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 49):
            window = tuple(w[k : k + 50])
            if i is not None and first.get(window, i) >= i:
                first[window] = i
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=str)


def test_substring_dedup(spark, folder, agrees, rows):
    agrees(catalogue.QUERIES["op5_substring_dedup"](spark, folder), catalogue.ORACLE["op5_substring_dedup"])
    df = spark.read.parquet(f"{folder}/documents.parquet")
    found = sorted((tuple(r) for r in substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)
    assert found == brute_kept([r[:2] for r in rows]) and sum(r[2] > 0 for r in found) > 20


def test_substring_edges(spark):
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(200)]
    rows = [(i, " ".join([f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(60))] + shared[rng.randrange(60) : rng.randrange(90, 200)] + [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(60))])) for i in range(40)]
    rows += [(None, " ".join(shared)), (None, " ".join(shared)), (70, "x " * 300), (60, "x " * 120), (60, "x " * 120), (71, " ".join(shared[:49])), (72, " ".join(shared[:50] * 3)), (80, None), (81, "")]
    df = with_extra(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = sorted((tuple(r) for r in substring_dedup.remove_repeats(df, keep=["row", "spans"]).select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)
    assert found == brute_kept(rows)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_substring_sources_are_verified():
    words = [b"w%d" % i for i in range(120)]
    right = {"start": 10, "windows": 21, "offset": 3, "words": b" ".join([b"x"] * 3 + words[10:80] + [b"y"])}
    assert substring_dedup.kept_words(words, [right]) == words[:10] + words[80:]
    for wrong in (right | {"offset": 4}, right | {"windows": 23}, right | {"words": right["words"].replace(b"w50", b"w5O")}):
        assert substring_dedup.kept_words(words, [wrong]) == words


def test_substring_paths(spark, monkeypatch):
    """Copies compact into paths of whole passages; a branch ends a path; pieces of any length give the same result."""
    rng = random.Random(8)
    long = [f"s{i}" for i in range(3000)]
    rows = [(1, " ".join(long)), (2, " ".join(long)), (3, " ".join(long[500:900] + ["other"] + long[901:1500])), (4, " ".join(long[rng.randrange(2000) :])), (4, "x " * 900), (5, "x " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["vertex", "edge", "first_row", "first_start", "windows", "one_before", "one_after"]
    runs = spark.createDataFrame([(i, i, 7, i * 10, 10, i not in (0, 50), i not in (70, 99)) for i in range(100)], names).repartition(3)
    paths = {r.vertex: r.pv for r in substring_dedup.compacted(runs).collect()}
    heads = [0, 16, 32, 48, 50, 66, 71, 87]
    assert paths == {i: max(h for h in heads if h <= i) for i in range(100)}
    for size in (16, 1, 3):
        monkeypatch.setattr(substring_dedup, "PATH_RUNS", size)
        found = sorted((tuple(r) for r in substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)
        assert found == brute_kept(rows) and sum(r[2] for r in found) > 3000


# Decontamination.


def test_decontamination(spark, folder, agrees, monkeypatch):
    found = agrees(catalogue.QUERIES["op10_decontamination"](spark, folder), catalogue.ORACLE["op10_decontamination"])
    assert len(found) >= 5
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    agrees(catalogue.QUERIES["op10_decontamination"](spark, folder), catalogue.ORACLE["op10_decontamination"])


def test_decontamination_recall(spark):
    """Passages with edits near the limit of the similarity: none above it is lost."""
    rng = random.Random(8)
    items = [(i, " ".join(f"i{i}w{rng.randrange(30)}" for _ in range(rng.randrange(5, 60)))) for i in range(40)]
    docs, truth = [], set()
    for d in range(300):
        item, text = items[d % 40]
        words = text.split()
        at = rng.choice([0, 0, 1, 2, 3, len(words) - 1])
        if rng.random() < 0.7:
            words = words[at:] if rng.random() < 0.5 else words[: len(words) - at]
        if rng.random() < 0.3 and words:
            words[rng.choice([0, len(words) - 1])] = "edited"
        body = [f"n{rng.randrange(10**6)}" for _ in range(80)]
        body[40:40] = words
        docs.append((d, " ".join(body)))
    bag = lambda w: __import__("collections").Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    for d, text in docs:
        w = text.split()
        for item, other in items:
            o = other.split()
            if any(100 * sum((a & bag(o)).values()) >= 80 * sum((a | bag(o)).values()) for a in (bag(w[s : s + len(o)]) for s in range(len(w) - len(o) + 1))):
                truth.add((d, item))
    df, benchmark = with_extra(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, benchmark).collect()}
    assert found == truth and len(truth) > 100


def test_short_texts_and_other_orders_are_found(spark):
    """A text that is an item less a few words, and items whose parts stand in another order."""
    item = [f"i{k}" for k in range(59)]
    body = [f"n{k}" for k in range(90)]
    texts = [item[:58], item[3:], item[:48], item[30:] + item[:30], body[:40] + item[29:] + item[:29] + body[40:], body[:9] + item + body[9:], item[:30]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: tuple(r)[2:] for r in decontamination.find_leaks(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert found == {0: (0, 58, 54, 55), 1: (0, 56, 52, 55), 2: (0, 48, 44, 55), 3: (0, 59, 51, 59), 4: (40, 59, 51, 59), 5: (9, 59, 55, 55)}


def test_decontamination_edges(spark):
    df = with_extra(spark.createDataFrame([(1, "One, two! THREE four five six."), (1, "One, two! THREE four five six."), (None, "one two three four five six"), (2, None), (3, "")], "doc_id long, text string"))
    benchmark = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "two three four five six"), (4, None), (5, "--")], "item_id long, text string")
    found = sorted(((r.doc_id, r.item_id, r.start_word) for r in decontamination.find_leaks(df, benchmark).collect()), key=str)
    assert found == [(1, 1, 0), (1, None, 1), (None, 1, 0), (None, None, 1)]
    kept = decontamination.without_leaks(df, benchmark)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, None), (3, "")] and kept.columns == df.columns
    assert decontamination.find_leaks(df, benchmark.limit(0)).count() == 0 and decontamination.find_leaks(df.limit(0), benchmark).count() == 0


def test_repeated_words_are_linear(spark):
    """A text of one repeated word against an item of it, and a window that starts where a long text ends."""
    item = "again " * 200
    df = spark.createDataFrame([(1, "again " * 20_000), (2, "x " * 3000 + item), (3, "again " * 150)], "doc_id long, text string")
    found = {r.doc_id: tuple(r)[2:] for r in decontamination.find_leaks(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert found == {1: (0, 200, 196, 196), 2: (3000, 200, 196, 196)}


def test_radius_loses_nothing(spark):
    """Thousands of passages at the limit of the similarity, each against the exact similarity of its windows."""
    rng = random.Random(12)
    items = {i: [f"i{i}w{rng.randrange(10**6)}" for _ in range(rng.randrange(30, 60))] for i in range(60)}
    docs, truth = [], set()
    for d in range(4000):
        i = d % 60
        m = len(items[i]) - 4
        words = list(items[i])
        lost = m - -(-80 * 2 * m // 180)
        cut = lost - 4 if lost > 6 and d % 2 else 0  # an edit costs up to five shingles, one at the edge fewer
        at = 0 if cut == 0 else cut - 1
        for k in range(at + 1 if cut else lost):
            words[k] = f"e{d}x{k}"
        docs.append((d, " ".join([f"n{d}y{k}" for k in range(20)] + words + [f"n{d}z{k}" for k in range(20)])))
        bags = [Counter(tuple(words[k : k + 5]) for k in range(m)), Counter(tuple(items[i][k : k + 5]) for k in range(m))]
        if 100 * sum((bags[0] & bags[1]).values()) >= 80 * sum((bags[0] | bags[1]).values()):
            truth.add((d, i))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert len(truth) > 3000 and found == truth


@pytest.mark.parametrize("lane", [16, 32])
def test_simhash(spark, lane):
    rng = random.Random(1)
    hashes = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 40)]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in hashes], "h array<bigint>").select(decontamination.simhash(F.col("h"), lane)).collect()]
    for h, g in zip(hashes, got, strict=True):
        expected = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) // 2)
        assert g & ((1 << 64) - 1) == expected


# Mixing.


def test_source_mixing(spark, folder, agrees, monkeypatch):
    agrees(catalogue.QUERIES["op7_source_mixing"](spark, folder), catalogue.ORACLE["op7_source_mixing"])
    monkeypatch.setattr(source_mixing, "BROADCAST_PLAN", 0)
    agrees(catalogue.QUERIES["op7_source_mixing"](spark, folder), catalogue.ORACLE["op7_source_mixing"])


def test_mixture_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, "w " * int(rng.paretovariate(1.1) * 20 % 3000), rng.choice("aaaaaaabcdef")) for i in range(1500)] + [(9000, "w " * 7, None), (9001, None, "g"), (9002, "", "g")]
    df = with_extra(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6))
    found = source_mixing.mix_documents(df).collect()
    again = source_mixing.mix_documents(df.repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    sizes, taken, target = {}, {}, {}
    source = {i: s for i, _, s in rows}
    for r in found:
        s = source[r.doc_id]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
        assert r.taken <= 3 * r.size and len(r.draws) <= 3 and len({d["pass"] for d in r.draws}) == len(r.draws)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    for s in sizes:
        assert target[s] <= 3 * sizes[s] + 1e-9 and abs(taken[s] - target[s]) <= max(1, 0.01 * sizes[s])
    uncapped = [(s, w) for s, w in zip([*"abcdefg", None], [1, 2, 3, 1, 2, 3, 1, 2], strict=True) if target[s] < 3 * sizes[s] - 1e-6]
    assert len({round(target[s] / w, 6) for s, w in uncapped}) == 1
    shards = {}
    for r in found:
        for d in r.draws:
            shards[d["shard"]] = shards.get(d["shard"], 0) + 1
    assert set(shards) == set(range(source_mixing.LEAST_SHARDS)) and max(shards.values()) < 2 * min(shards.values())
    rows = source_mixing.shuffled_rows(df).select("doc_id", "pass", "shard", F.spark_partition_id().alias("part")).collect()
    assert sorted(str((r.doc_id, r["pass"], r.shard)) for r in rows) == sorted(str((r.doc_id, d["pass"], d["shard"])) for r in found for d in r.draws)
    assert len({(r.shard, r.part) for r in rows}) == source_mixing.LEAST_SHARDS
    order = [r.doc_id for r in rows if r.shard == 3]
    assert order != sorted(order) and len(order) > 20
    assert source_mixing.mix_documents(df.limit(0)).count() == 0


def test_the_tree_decides(spark, monkeypatch):
    """Documents are taken as the leaves say: without some leaves their draws are gone; with other quotas shards differ."""
    df = spark.createDataFrame([(i, "w " * (i % 50 + 1), "ab"[i % 2]) for i in range(400)] + [(None, "x y z", "a"), (None, "x y", "a")], "doc_id long, text string, source string")
    tree, plain = source_mixing.splitting_tree, source_mixing.mix_documents(df).collect()
    monkeypatch.setattr(source_mixing, "splitting_tree", lambda *a: tree(*a).filter("shard > 7"))
    few = source_mixing.mix_documents(df).collect()
    assert 0 < sum(r.taken for r in few) < 0.7 * sum(r.taken for r in plain)
    assert {d["shard"] for r in plain for d in r.draws} == set(range(16)) and not {d["shard"] for r in few for d in r.draws} & set(range(8))


def test_tree_over_groups_of_sources(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "GROUP_SOURCES", 3)
    quotas = spark.createDataFrame([(f"0s{i}", 10 * i) for i in range(11)], "key string, n bigint")
    leaves = source_mixing.splitting_tree(quotas, 8, 1).collect()
    assert {f"0s{i}": 10 * i for i in range(11)} == {k: sum(r.n for r in leaves if r.key == k) for k in {r.key for r in leaves}}
    per_shard = [sum(r.n for r in leaves if r.shard == s) for s in range(8)]
    assert max(per_shard) - min(per_shard) <= 3 and min(r.n for r in leaves) >= 0 and len({r.n for r in leaves if r.key == "0s10"}) > 1


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([("0a", 1000), ("0b", 10), ("0c", 0), ("1", 333)], "key string, n bigint")
    leaves = source_mixing.splitting_tree(quotas, 8, 1).collect()
    assert {k: sum(r.n for r in leaves if r.key == k) for k in ("0a", "0b", "0c", "1")} == {"0a": 1000, "0b": 10, "0c": 0, "1": 333}
    per_shard = [sum(r.n for r in leaves if r.shard == s) for s in range(8)]
    assert max(per_shard) - min(per_shard) <= 3 and min(r.n for r in leaves) >= 0


def test_hypergeometric_distribution(spark):
    n = 4000
    draws = spark.range(n).select(source_mixing.hypergeometric(F.lit(30).cast("bigint"), F.lit(12).cast("bigint"), F.lit(10).cast("bigint"), (F.col("id") + 0.5) / n).alias("x")).groupBy("x").count().collect()
    from math import comb

    for r in draws:
        assert abs(r["count"] / n - comb(12, r.x) * comb(18, 10 - r.x) / comb(30, 10)) < 2 / n


# HTML.


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


CASES = [
    (page("<nav>Menu</nav><article><h1>Head</h1><p>One<br>two  <b>three</b>four.</p><p>A &amp; B &lt;c&gt; &eacute; &#x41;</p></article><footer>Foot</footer>"), "Head One two threefour. A & B <c> é A"),
    (page("<article><p><b>open <p>next<!-- no --> end<aside>ad</aside><form>x</form><div class='ad banner'>buy</div></article><div id=comments>me too</div>"), "open next end"),
    (page("<header>Site</header><main><div><p>Only main</p></div></main><div class=sidebar>side</div>"), "Only main"),
    (page("<div class='top-nav'>x</div><div><p>Plain</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></div><script>if (a<b) {}</script>"), "Plain a b c d"),
    (page("<article><p>kept</p><div class='cookie-notice'>c</div><section class='comments'><article class='comment'>reader</article></section></article>"), "kept"),
    ("<article><p>cut off <i>he", "cut off he"),
    ("no markup &copy; at  all", "no markup © at all"),
    ("<p>a<script>x<p>never closed", "a"),
    ("<p title='a>b'>q</p> 1 < 2 <3", "q 1 < 2 <3"),
    ("", ""),
    (None, ""),
    ("<div><div><div>" * 300 + "deep", "deep"),
]


def test_html_cases(spark):
    df = with_extra(spark.createDataFrame([(i, f"http://h{i}.org/x" if i % 2 else None, h) for i, (h, _) in enumerate(CASES)] + [(0, None, CASES[0][0])], "page_id int, url string, html string").drop("host"))
    found = html_extraction.extract_texts(df).collect()
    assert len(found) == len(CASES) + 1
    for r in found:
        assert r.text == CASES[r.page_id][1] and r.n_chars == len(r.text)
    assert html_extraction.extract_texts(df.limit(0)).count() == 0


def test_style_tree(spark, monkeypatch):
    """Containers that read alike on a host's pages go, also where nothing names them as boilerplate."""
    rows = [(i, f"http://host.org/{i}", page(f"<div class=x1><div>Welcome to our site</div></div><div class=x2><p>story {i} of many words</p><p>more {i * 7}</p></div><div class=x3><ul><li>about us<li>imprint</ul></div>")) for i in range(12)]
    rows += [(100 + i, f"http://article.org/{i}", page(f"<article><p>text {i}</p><div class=y>read our terms</div></article>")) for i in range(12)]
    rows += [(200 + i, f"http://few{i}.org/", page("<div class=x1>Welcome to our site</div>")) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    for bound in (html_extraction.BROADCAST_BRANCHES, -1):
        monkeypatch.setattr(html_extraction, "BROADCAST_BRANCHES", bound)
        found = {r.page_id: r.text for r in html_extraction.extract_texts(df).collect()}
        assert found == {i: f"story {i} of many words more {i * 7}" for i in range(12)} | {100 + i: f"text {i}" for i in range(12)} | {200 + i: "Welcome to our site" for i in range(3)}


def test_style_tree_keeps_containers_of_content(spark):
    """A fixed layout of many children isn't low where what stands under it differs, whatever the number of levels."""

    def layout(i):
        blocks = "".join(f"<section class=s{k}><div><p>part {k} of page {i}</p></div></section>" for k in range(4))
        return page(f"<a class=s9>go</a><header>h</header><nav>n</nav><div class=adv>a</div><main>{blocks}<div class=z>terms of use</div></main><aside>s</aside><footer>f</footer><div class=n1>all alike</div>")

    rows = [(i, f"http://wide.org/{i}", layout(i)) for i in range(10)]
    rows += [(100 + i, f"http://plain.org/{i}", page("".join(f"<div class=b{k}>{k} fixed</div>" for k in range(9)) + f"own text {i}")) for i in range(10)]
    rows += [(200 + i, f"http://same.org/{i}", page("<p>x</p>" * 8 + "<article><h1>One</h1><p>story</p></article>")) for i in range(10)]
    found = {r.page_id: r.text for r in html_extraction.extract_texts(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    expected = {i: " ".join(f"part {k} of page {i}" for k in range(4)) for i in range(10)}
    assert found == expected | {100 + i: f"own text {i}" for i in range(10)} | {200 + i: "One story" for i in range(10)}


def test_the_tree_alone(spark):
    """Without hints the tree finds the article of pages whose other parts recur, and takes branches out of articles."""

    def layout(i):
        terms = "<div class='t1'><p>these are the terms of our site</p></div><p class='t2'>all rights are ours</p>"
        return page(f"<nav><ul><li>home</li><li>news</li></ul></nav><div class='ad'>buy this thing {i % 3}</div><article><h1>Title {i}</h1><p>story {i}</p>{terms}<p>more of {i}</p></article><footer>all of us</footer>")

    rows = [(i, f"http://one.org/{i}", layout(i)) for i in range(40)] + [(100, "http://other.org/", layout(100))]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    expected = {i: f"Title {i} story {i} more of {i}" for i in range(40)}
    for hints in (False, True):
        found = {r.page_id: r.text for r in html_extraction.extract_texts(df, hints=hints).collect()}
        alone = found.pop(100)
        assert found == expected
        assert alone == "Title 100 story 100 these are the terms of our site all rights are ours more of 100" if hints else "buy this thing" in alone


def brute_importance(hosts):
    """(host, path): pages, composite importance and the highest of the branch (None where one of it can't be low)."""
    from math import log

    out = {}
    for host, markups in hosts.items():
        pages = [html_extraction.Page(m, tree=True).elements for m in markups]
        paths = {p for e in pages for p in e}
        parent = {p: e[p].parent for e in pages for p in e}

        def rated(path):
            nodes = [(e, e[path]) for e in pages if path in e]
            m = len(nodes)
            looks = Counter(n.presentation for _, n in nodes)
            shown = -sum(c / m * log(c / m) for c in looks.values()) / log(m) if m > 1 else 1.0
            contents = Counter(n.content for _, n in nodes if n.content or not n.children)
            t = sum(contents.values())
            own = (1 - sum(log(c) for c in contents.values()) / len(contents) / log(t) if t > 1 else 1.0) if t else None
            below = sum(own / (n.children + 1) for _, n in nodes if n.content or not n.children) if t else 0.0
            high, kept = own or 0.0, any(n.article for _, n in nodes) or m < html_extraction.LEAST_PAGES or (t and t < html_extraction.LEAST_PAGES)
            for child in (c for c in paths if parent[c] == path):
                rating, above, fixed = rated(child)
                below += sum(e[child].times / (n.children + (n.content != 0)) for e, n in nodes if child in e) * rating
                high, kept = max(high, above), kept or fixed
            share = html_extraction.DECAY ** (sum(n.children for _, n in nodes) / m)
            rating = (1 - share) * shown + share * below / m
            out[host, path] = (m, rating, None if kept else max(high, rating))
            return rating, max(high, rating), kept

        for top in (p for p in paths if parent[p] == 0):
            rated(top)
    return out


def test_importance_against_brute_force(spark):
    rng = random.Random(3)

    def branch(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["same", "other", f"own {rng.randrange(100)}", ""])
        return "".join(f"<{t} class=k{k}>{branch(depth - 1)}</{t}>" for k in range(rng.randrange(1, 4)) for t in [rng.choice(["div", "section", "p"])])

    hosts = {f"h{h}.org": [f"<body>{branch(3)}{'<article>a</article>' if h == 2 and i == 4 else ''}</body>" for i in range(n)] for h, n in enumerate((12, 20, 9, 3))}
    df = spark.createDataFrame([(h, m) for h, markups in hosts.items() for m in markups], "host string, html string").repartition(3)
    elements = df.mapInArrow(html_extraction.emit_elements, html_extraction.ELEMENT)
    found = {(r.host, r.path): (r.pages, r.importance, r.highest) for r in html_extraction.element_importance(elements).collect()}
    truth = brute_importance(hosts)
    assert found.keys() == truth.keys() and len(truth) > 60 and any(v[2] is not None and v[2] < 0.9 for v in truth.values())
    for k, (m, rating, high) in truth.items():
        assert found[k][0] == m and abs(found[k][1] - rating) < 1e-9 and (found[k][2] is None if high is None else abs(found[k][2] - high) < 1e-9), k


@pytest.mark.parametrize(
    "markup, text",
    [("</b></div>" * 200_000 + "x", "x"), ("<a " * 300_000 + '"', ""), ("<b>" * 200_000 + "y" + "<p>" * 100_000, "y"), ("<p title=it's>q</p>" * 50_000, " ".join(["q"] * 50_000)), ("<p don't>q</p>", "q"), ('<p title="cut <b>off', "")],
)
def test_odd_markup_is_linear(markup, text):
    import time

    began = time.perf_counter()
    assert html_extraction.Page(markup, tree=True).text() == text and time.perf_counter() - began < 20


# Pipeline.


def test_pipeline(spark, folder, agrees):
    agrees(corpus_pipeline.run(spark, folder), corpus_pipeline.ORACLE_SQL)


def test_pipeline_edges(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long, None, None, None), (1, None, "en", "a", None), (2, long + " more", "en", None, 5), (2, long + " more", "en", None, 5), (3, "", None, "a", 0)]
    for name, kept in (("some", rows), ("none", [])):
        spark.createDataFrame(kept, DOCS).withColumn("label", F.lit("x")).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name))
        assert {r.doc_id for r in found.collect()} == ({None, 2} if kept else set()) and found.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "pass", "shard"]


def test_rest_needs_no_llm():
    """Nothing outside imports this package: the entry loads without it."""
    code = "import sys; sys.modules['loomwork.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True).returncode == 0
