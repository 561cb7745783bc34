"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, natively.

A source's documents are dealt into blocks by a hash of their id, which also permutes them. The quota of a source is a
number of block draws: every block once for each whole time the target holds the source, then blocks in permuted order
while they fit the rest. The block that doesn't fit gives its documents in permuted order while they fit, and one more
document of the source is drawn if it brings the sum nearer to the target. The splitting tree then halves the output
shards: at each node the draws of every source are split by hypergeometric draws, one source after the other, so that
the leaves hold exact disjoint quotas distributed as a uniform shuffle would. Each leaf takes its quota from the source's
permuted list of draws; a document is taken as often as leaves draw it. ``shuffled_rows`` moves the rows to their shards
and orders each by a hash.

All random choices are hashes of the seed, so reruns agree. The number of shards grows with the words (SHARD_WORDS) and
the number of blocks with the shards, so that neither grows beyond what a task holds. The place in the source where the
last, partial pass ends is found digit by digit of the hash, by sums over at most 256 parts, never by a window over a
whole block. Sources stand in groups of at most GROUP_SOURCES; a node first splits its draws among groups, then each
group's among its sources, group by group in parallel. The list of sources itself, a row of few bytes each, is sorted in one task.

Defined cases: a null text has size 0; texts of size 0 are never drawn; a null source is a source of its own, ordered
last; a null id hashes by its text; rows that repeat share a hash and are drawn together; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.llm.common import WORD, columns_of
from loomwork.session import checkpointed

#: Weights that sources take in turn.
WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source's size.
MOST_TIMES = 3
#: Output shards at least, a power of two, as the tree halves them; and words that a shard holds at most, about.
LEAST_SHARDS = 16
SHARD_WORDS = 1 << 26
#: Blocks of a source for each shard, so that quotas can be split evenly.
SHARD_BLOCKS = 16
#: Hex digits of the hash after which the documents where a partial pass ends are few enough for a window.
CUT_DIGITS = 6
#: Sources that one row of the tree holds.
GROUP_SOURCES = 1000
#: Rows of the plan (one per source and block) up to which it is broadcast, about 20 MB.
BROADCAST_PLAN = 150_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hashed(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def uniform(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts alone."""
    return F.conv(F.substring(hashed(seed, *parts), 1, 12), 16, 10).cast("double") / float(16**12)


def targets(sizes: DataFrame) -> DataFrame:
    """Sources (key, source_size) with target: shares by weight, none above its cap, the excess reshared.

    The shares are min(level * weight, cap) for the one level at which they use up everything. In the order of
    cap / weight the capped sources come first, so the level follows from sums before and after each source.
    """
    turn = F.row_number().over(W.orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int"))
    weighted = sizes.withColumn("weight", weight).withColumn("cap", MOST_TIMES * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = left / F.sum("weight").over(after)
    fits = F.when(level <= F.col("cap") / F.col("weight"), level)
    first = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return weighted.withColumn("level", first).select("key", "source_size", F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")).alias("target"))


def bound(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(items: Column, good: Column, taken: Column, u: Column) -> Column:
    """How many of the good among all items are among those taken, by the inverse distribution function at u.

    Neighbouring probabilities have a simple ratio: one pass over the support sums them by logarithms, relative to the
    largest, a second pass finds where the sum reaches u.
    """

    def step(v, x):
        ratio = (v["good"] - x).cast("double") * (v["taken"] - x) / ((x + 1).cast("double") * (v["items"] - v["good"] - v["taken"] + x + 1))
        return F.when(x < v["hi"], F.ln(ratio)).otherwise(0.0)

    def add(v):
        def merge(s, x):
            peak = F.greatest(s["peak"], s["log"])
            total = s["total"] * F.exp(s["peak"] - peak) + F.exp(s["log"] - peak)
            return F.struct((s["log"] + step(v, x)).alias("log"), peak.alias("peak"), total.alias("total"))

        zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("total"))
        return F.aggregate(F.sequence(v["lo"], v["hi"]), zero, merge)

    def find(v):
        def merge(s, x):
            below = s["below"] + F.exp(s["log"] - v["sums"]["peak"])
            here = ~s["found"] & (below >= v["u"] * v["sums"]["total"])
            return F.struct(
                (s["log"] + step(v, x)).alias("log"), below.alias("below"), F.when(here, x).otherwise(s["x"]).alias("x"), (s["found"] | here).alias("found")
            )

        zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("below"), v["hi"].alias("x"), F.lit(False).alias("found"))
        return F.aggregate(F.sequence(v["lo"], v["hi"]), zero, merge, lambda s: s["x"])

    # Beyond twelve deviations the chances are below the precision of the sum: the support is cut there.
    share = good / F.greatest(items, F.lit(1).cast("bigint"))
    middle = taken * share
    spread = 12 * F.sqrt(F.greatest(middle * (1 - share) * (items - taken) / F.greatest(items - 1, F.lit(1).cast("bigint")), F.lit(0.0))) + 10
    given = F.struct(
        items.alias("items"), good.alias("good"), taken.alias("taken"), u.alias("u"),
        F.greatest(F.lit(0).cast("bigint"), good + taken - items, F.floor(middle - spread)).alias("lo"), F.least(good, taken, F.ceil(middle + spread)).alias("hi"),
    )

    def draw(v):
        known = {k: v[k].alias(k) for k in ("items", "good", "taken", "u", "lo", "hi")}
        return F.when(v["lo"] >= v["hi"], v["hi"]).otherwise(bound(F.struct(*known.values(), add(v).alias("sums")), find))

    return bound(given, draw)


def split(seed: int, node: Column, parts: Column, items: Column, taken: Column) -> Column:
    """How many of ``taken`` out of ``items`` fall to each of the parts (structs of key and n), as an array in their order."""

    def merge(s, x):
        drawn = hypergeometric(s["items"], x["n"], s["taken"], uniform(seed, F.lit("tree"), node, x["key"]))
        return bound(
            drawn,
            lambda d: F.struct((s["items"] - x["n"]).alias("items"), (s["taken"] - d).alias("taken"), F.concat(s["drawn"], F.array(d)).alias("drawn")),
        )

    zero = F.struct(items.alias("items"), taken.alias("taken"), F.array().cast("array<bigint>").alias("drawn"))
    return F.aggregate(parts, zero, merge, lambda s: s["drawn"])


def total_of(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Quotas (key, n) as (key, shard, n): halved from node to node, the sources of a node one after the other.

    A row holds a node's part of one group of sources. With several groups the node's draws are first split among them.
    """
    several = quotas.count() > GROUP_SOURCES
    group = F.floor((F.row_number().over(W.orderBy("key")) - 1) / GROUP_SOURCES).cast("string") if several else F.lit("0")
    nodes = quotas.withColumn("group", group).groupBy("group").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("sources"))
    nodes = nodes.select(F.lit("").alias("node"), "group", "sources")
    for _ in range(shards.bit_length() - 1):
        if several:
            nodes = checkpointed(nodes)
            tops = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.col("group").alias("key"), total_of(F.col("sources")).alias("n")))).alias("groups"))
            tops = tops.withColumn("items", total_of(F.col("groups")))
            taken = split(seed, F.concat("node", F.lit("/")), F.col("groups"), F.col("items"), F.ceil(F.col("items") / 2).cast("bigint"))
            tops = tops.select("node", F.explode(F.arrays_zip("groups", taken.alias("taken"))).alias("at")).select("node", F.col("at.groups.key").alias("group"), F.col("at.taken").alias("taken"))
            nodes = nodes.join(tops, ["node", "group"]).withColumn("items", total_of(F.col("sources")))
        else:
            nodes = nodes.withColumn("items", total_of(F.col("sources"))).withColumn("taken", F.ceil(F.col("items") / 2).cast("bigint"))
        halved = nodes.select("node", "group", "sources", split(seed, F.col("node"), F.col("sources"), F.col("items"), F.col("taken")).alias("left"))
        at = F.arrays_zip("sources", "left")
        lefts = F.transform(at, lambda v: F.struct(v["sources"]["key"].alias("key"), v["left"].alias("n")))
        rights = F.transform(at, lambda v: F.struct(v["sources"]["key"].alias("key"), (v["sources"]["n"] - v["left"]).alias("n")))
        halves = F.array(
            F.struct(F.concat("node", F.lit("0")).alias("node"), "group", lefts.alias("sources")),
            F.struct(F.concat("node", F.lit("1")).alias("node"), "group", rights.alias("sources")),
        )
        nodes = halved.select(F.explode(halves).alias("half")).select("half.*")
    shard = F.coalesce(F.conv("node", 2, 10), F.lit("0")).cast("int")
    return nodes.select(shard.alias("shard"), F.explode("sources").alias("at")).select("at.key", "shard", "at.n")


def last_place(base: DataFrame, cut: DataFrame, hint, digits: int) -> DataFrame:
    """(key, cut_hash, used): the last document in permuted order that fits what is left of the cut block, and the sum up to it.

    ``cut`` has (key, prefix, left). Each round sums the documents of the prefix by two more digits and goes on in the
    part where the sum passes what is left.
    """
    cut = cut.withColumn("before", F.lit(0).cast("bigint"))
    while True:
        inside = base.join(hint(cut), "key").filter(F.substring("hash", 1, digits) == F.col("prefix"))
        if digits >= CUT_DIGITS:
            break
        digits += 2
        parts = inside.groupBy("key", F.substring("hash", 1, digits).alias("part"), "left", "before").agg(F.sum("size").alias("words"))
        parts = parts.withColumn("until", F.sum("words").over(W.partitionBy("key").orderBy("part")) + F.col("before"))
        found = parts.filter("until > left and until - words <= left")
        cut = checkpointed(found.select("key", F.col("part").alias("prefix"), "left", (F.col("until") - F.col("words")).alias("before")))
    placed = inside.withColumn("until", F.sum("size").over(W.partitionBy("key").orderBy("hash")) + F.col("before"))
    fitting = placed.filter("until <= left").groupBy("key").agg(F.max("hash").alias("last"), F.max("until").alias("used"))
    return cut.join(fitting, "key", "left").select("key", F.coalesce("last", "prefix").alias("cut_hash"), F.coalesce("used", "before").alias("used"))


def shards_for(words: int) -> int:
    """The number of shards for so many words: a power of two."""
    return max(LEAST_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, words) / SHARD_WORDS))))


def mix_documents(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    shards: int | None = None,
    seed: int = 7,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row: its id, size, source_size, target, taken and draws (structs of pass, shard and place, a hash to order by).

    ``keep`` names further columns of ``df`` to return. Without ``shards``, a power of two, their number follows from the words.
    """
    given = columns_of(df, id=id_column, text=text_column, source=source_column, **{f"kept_{c}": c for c in keep or []})
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    name = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rows = given.withColumns({"key": key, "hash": hashed(seed, name), "size": word_count(F.col("text"))})
    base = checkpointed(rows.select("key", "hash", "size"))

    sizes = checkpointed(base.groupBy("key").agg(F.sum("size").alias("source_size")))
    shards = shards or shards_for(sizes.agg(F.sum("source_size")).first()[0] or 0)
    digits = max(2, math.ceil(math.log(SHARD_BLOCKS * shards, 16) - 1e-9))
    block = F.substring("hash", 1, digits)
    blocks = checkpointed(base.groupBy("key", block.alias("block")).agg(F.sum("size").alias("words")))
    sources = targets(sizes)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = F.floor(F.col("target") - whole * F.col("source_size") + 0.5).cast("bigint")
    sources = checkpointed(sources.withColumns({"whole": whole, "rest": rest}))
    hint = F.broadcast if sources.count() <= BROADCAST_PLAN else (lambda x: x)

    # The last, partial pass: blocks in permuted order while they fit the rest, then one block in part, then one document.
    until = F.sum("words").over(W.partitionBy("key").orderBy("block"))
    partial = blocks.withColumn("until", until).join(hint(sources), "key")
    fitting = partial.filter("until <= rest").select("key", "block")
    cut = checkpointed(partial.filter("until > rest and until - words <= rest").select("key", F.col("block").alias("cut_block"), (F.col("rest") - F.col("until") + F.col("words")).alias("left")))
    place = last_place(base, cut.withColumnRenamed("cut_block", "prefix"), hint, digits)
    cut = checkpointed(cut.join(place, "key").select("key", "cut_block", "cut_hash", (F.col("left") - F.col("used")).alias("gap")))
    nearer = base.join(hint(cut.filter("gap > 0")), "key").filter("hash >= cut_block and hash > cut_hash and abs(gap - size) < gap")
    nearer = nearer.groupBy("key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), F.col("hash"))).alias("best"))
    nearer = checkpointed(nearer.select("key", F.col("best.hash").alias("fit_hash")))

    # Units of a draw: (key, pass, block, kind); each source has as many as its quota.
    passes = blocks.join(hint(sources.filter("whole > 0")), "key").select("key", F.explode(F.sequence(F.lit(1).cast("bigint"), "whole")).alias("pass"), "block", F.lit("all").alias("kind"))
    last = (F.col("whole") + 1).alias("pass")
    units = passes.unionByName(fitting.join(hint(sources), "key").select("key", last, "block", F.lit("all").alias("kind")))
    units = units.unionByName(cut.join(hint(sources), "key").select("key", last, F.col("cut_block").alias("block"), F.lit("part").alias("kind")))
    units = units.unionByName(nearer.join(hint(sources), "key").select("key", last, F.substring("fit_hash", 1, digits).alias("block"), F.lit("one").alias("kind")))
    order = hashed(seed, F.lit("unit"), F.col("key"), F.col("pass"), F.col("block"), F.col("kind"))
    units = checkpointed(units.withColumn("at", F.row_number().over(W.partitionBy("key").orderBy(order)) - 1))

    # Leaves draw their quotas from the permuted units, one after the other.
    leaves = splitting_tree(units.groupBy("key").agg(F.count("*").alias("n")), shards, seed)
    ends = F.sum("n").over(W.partitionBy("key").orderBy("shard"))
    leaves = leaves.withColumn("end", ends).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("end", "shard", "n"))).alias("leaves"))
    mine = F.get(F.filter("leaves", lambda v: (v["end"] > F.col("at")) & (v["end"] - v["n"] <= F.col("at"))), F.lit(0))
    dealt = units.join(hint(leaves), "key").withColumn("shard", mine["shard"]).filter("shard is not null")
    drawn = dealt.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "kind"))).alias("units"))
    facts = sources.select("key", "source_size", "target").join(hint(cut.select("key", "cut_hash")), "key", "left").join(hint(nearer), "key", "left")
    plan = blocks.select("key", "block").join(hint(facts), "key").join(drawn, ["key", "block"], "left")
    plan = checkpointed(plan)
    if plan.count() <= BROADCAST_PLAN:
        plan = F.broadcast(plan)

    taken = F.filter(
        F.coalesce("units", F.array().cast("array<struct<pass:bigint,shard:int,kind:string>>")),
        lambda u: (F.col("size") > 0) & ((u["kind"] == "all") | ((u["kind"] == "part") & (F.col("hash") <= F.col("cut_hash"))) | ((u["kind"] == "one") & (F.col("hash") == F.col("fit_hash")))),
    )
    draws = F.transform(taken, lambda u: F.struct(u["pass"].alias("pass"), u["shard"].alias("shard"), hashed(seed, F.lit("place"), u["shard"], u["pass"], F.col("hash")).alias("place")))
    mixed = rows.withColumn("block", block).join(plan, ["key", "block"], "left").withColumn("draws", draws)
    return mixed.select(
        F.col("id").alias(id_column), "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws", *(F.col(f"kept_{c}").alias(c) for c in keep or [])
    )


def shuffled_rows(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", shards: int | None = None, seed: int = 7) -> DataFrame:
    """A row of ``df`` for each time that the mix draws it, with pass and shard: each shard's rows in one partition,
    shuffled by their place. A shard has about SHARD_WORDS words, unless the number of shards is given."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    mixed = mix_documents(df.toDF(*names), at[id_column], at[text_column], at[source_column], shards, seed, keep=[n for n in names if n != at[id_column]])
    drawn = mixed.select(*names, F.explode("draws").alias("draw"))
    dealt = drawn.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.place")
    return dealt.select(*(F.col(n).alias(c) for c, n in at.items()), F.col("draw.pass").alias("pass"), F.col("draw.shard").alias("shard"))
