"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity; natively.

Texts are lower-cased and cut into words of letters and digits. A document's windows that can match an item hold some
of its five-word shingles, so the shingles of all texts meet those of the benchmark first; a document and item that
share fewer shingles than the similarity needs are dropped. Over what is left, windows as long as the item are laid at
every start that has enough shared shingles inside, in whatever order; a text shorter than the item is one window. A
window is a candidate only for the items that it was laid for: its 64-bit SimHash meets theirs in an equi-join on
(item, block, bits), with the 64 bits in ``radius + 1`` blocks, so that fingerprints within the radius agree in one
block at least. Each pair within the radius is verified once by the exact weighted similarity: shingles weigh as often
as they occur, the sum of the smaller weights over the sum of the larger ones.

At similarity 0.8 fingerprints differ in 9.7 of 64 bits on average with a deviation of 2.9. The radius of 26 is 5.6
deviations off: about one window in 10^8 that is only just similar enough lies beyond. At that radius a block has two or
three bits, which alone would let any two fingerprints meet; what selects is the item in the join's key.

Items under five words have one shingle, the whole item, and are found the same way with windows of their length. Work
and memory are linear in the windows' shingles: weights are counted by a grouped sum, not by comparing arrays.

Defined cases: null or empty texts and items match nothing; rows that repeat, of documents or of items, are one if id
and text agree; a null id is an id like others; an empty benchmark or table gives no rows. A text of repeated words is
laid out like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import columns_of
from loomwork.session import checkpointed

SHINGLE = 5
#: Least similarity, in hundredths.
SIMILARITY = 80
#: Hamming radius.
RADIUS = 26
#: Shingles of the benchmark up to which its side is broadcast (about 40 bytes each).
BROADCAST_SHINGLES = 500_000
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Windows up to which their starts are broadcast to the texts (about 30 bytes each); beyond that texts are shuffled.
BROADCAST_WINDOWS = 500_000
#: A column beside those of the documents while rows are chosen.
ROW = "_decontamination_row"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def shingle_hashes(word_hashes: Column, length: int = SHINGLE) -> Column:
    """The hashes of all runs of ``length`` words; empty if there are fewer words."""
    starts = F.when(F.size(word_hashes) >= length, F.sequence(F.lit(1), F.size(word_hashes) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.element_at(word_hashes, i + j) for j in range(length))))


def simhash(shingles: Column, lane: int = 32) -> Column:
    """64 bits; bit b is set if more than half of the shingles have it.

    One sum counts 64 / ``lane`` bits side by side, each of up to 2 ** ``lane`` - 1 shingles.
    """
    ones = sum(1 << at for at in range(0, 64, lane))

    def lanes(r):
        return F.aggregate(shingles, F.lit(0).cast("bigint"), lambda s, h: s + F.shiftrightunsigned(h, r).bitwiseAND(F.lit(ones)))

    counts = F.array(*(lanes(r) for r in range(lane)), (F.size(shingles) / 2).cast("bigint"))

    def majority(c):
        total = F.lit(0).cast("bigint")
        for b in range(64):
            count = F.shiftrightunsigned(c[b % lane], b // lane * lane).bitwiseAND(F.lit((1 << lane) - 1))
            total = total.bitwiseOR(F.shiftleft((count > c[lane]).cast("bigint"), b))
        return total

    return F.element_at(F.transform(F.array(counts), majority), 1)


def blocks(fingerprint: Column, radius: int) -> Column:
    """(block, bits) for each of ``radius + 1`` blocks of the 64 bits."""
    ends = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    parts = zip(ends, ends[1:], strict=False)
    return F.array(
        *(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(parts))
    )


def least_shared(n: Column, m: Column, similarity: int) -> Column:
    """Shingles that bags of n and m must share: shared >= s * (n + m - shared)."""
    return F.ceil(similarity * (n + m) / (100.0 + similarity) - 1e-9).cast("int")


def row_key(id_: Column, text: Column) -> Column:
    """What tells rows apart: the id, null or not, with 96 bits of the text's hashes."""
    return F.struct(id_.alias("id"), F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def benchmark_items(benchmark: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item, length, shingles): items under five words have their whole as the only shingle."""
    given = columns_of(benchmark, id=id_column, text=text_column).filter("text is not null")
    given = given.select(row_key(F.col("id"), F.col("text")).alias("item"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes")).dropDuplicates(["item"])
    given = given.withColumn("length", F.size("hashes")).filter("length > 0")
    short = F.concat(*(shingle_hashes(F.col("hashes"), k) for k in range(1, SHINGLE)))
    whole = F.array(F.element_at(short, -1))
    return given.select("item", "length", F.when(F.col("length") >= SHINGLE, shingle_hashes(F.col("hashes"))).otherwise(whole).alias("shingles"))


def window_starts(hits: Column, need: Column, m: Column) -> Column:
    """Starts of the windows of ``m`` shingles that hold at least ``need`` of the sorted places ``hits``, each once.

    Those whose first place is the i-th start after the place before it, and late enough to reach the last one needed.
    """
    first = F.slice(hits, F.lit(1), F.size(hits) - need + 1)
    laid = F.transform(first, lambda at, i: F.struct(F.greatest(F.get(hits, i + need - 1) - m + 1, F.coalesce(F.get(hits, i - 1) + 1, F.lit(0)), F.lit(0)).alias("from"), at.alias("until")))
    return F.flatten(F.transform(F.filter(laid, lambda w: w["from"] <= w["until"]), lambda w: F.sequence(w["from"], w["until"])))


def matched_rows(rows: DataFrame, benchmark: DataFrame, item_id_column: str, item_text_column: str, similarity: int, radius: int) -> DataFrame:
    """(row, item, start, n_words, shared, all): the best window of each row (row, text) and item that are similar enough."""
    items = checkpointed(benchmark_items(benchmark, item_id_column, item_text_column))
    size = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)).alias("n"), F.min("length").alias("least"), F.max("length").alias("most")).first()
    small = F.broadcast if size.n <= BROADCAST_SHINGLES else (lambda x: x)
    lengths = [k for k in range(1, SHINGLE) if size.least is not None and size.least <= k] + [SHINGLE]
    lane = 16 if (size.most or 0) < 1 << 16 else 32

    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    hashed = rows.select("row", hashes.alias("hashes"))

    # Shingles of all texts that the benchmark has.
    places = items.select("item", "length", F.size("shingles").alias("m"), F.explode(F.array_distinct("shingles")).alias("shingle"))
    found = None
    for k in lengths:
        at = hashed.select("row", F.size("hashes").alias("n_words"), F.posexplode(shingle_hashes(F.col("hashes"), k)).alias("at", "shingle"))
        part = at.join(small(places.filter(F.col("length") == k) if k < SHINGLE else places.filter(F.col("length") >= k)), "shingle")
        found = part if found is None else found.unionByName(part)
    found = found.select("row", "item", "length", "m", "n_words", "at")

    # Starts with enough of them; a text shorter than the item is a window of all its shingles.
    inside = F.when(F.col("n_words") < F.col("length"), F.col("n_words") - (SHINGLE - 1)).otherwise(F.col("m"))
    near = found.groupBy("row", "item", "length", "m", "n_words").agg(F.array_sort(F.collect_set("at")).alias("hits"))
    near = near.withColumn("need", least_shared(F.col("m"), inside, similarity)).filter(F.size("hits") >= F.col("need"))
    starts = F.filter(window_starts(F.col("hits"), F.col("need"), F.col("m")), lambda s: s + F.col("length") <= F.col("n_words"))
    near = near.select("row", "item", "length", F.when(F.col("n_words") < F.col("length"), F.array(F.lit(0))).otherwise(starts).alias("starts"))
    near = checkpointed(near.filter(F.size("starts") > 0))

    # The fingerprint of each window, on its text.
    spans = near.groupBy("row").agg(F.collect_set(F.struct("length", "starts")).alias("spans"))
    laid = near.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0)).alias("n")).first().n
    opened = rows.dropDuplicates(["row"]) if laid > BROADCAST_WINDOWS else rows
    opened = opened.join(F.broadcast(spans) if laid <= BROADCAST_WINDOWS else spans, "row").select("row", hashes.alias("hashes"), "spans")
    grams = F.array(*(shingle_hashes(F.col("hashes"), k) for k in lengths))
    opened = opened.select("row", F.size("hashes").alias("text_words"), grams.alias("grams"), F.explode("spans").alias("span"))
    width = F.least(F.col("span.length"), F.lit(SHINGLE))
    gram = F.element_at("grams", F.array_position(F.array(*map(F.lit, lengths)), width).cast("int"))
    windows = opened.select("row", F.col("span.length").alias("length"), F.least("span.length", "text_words").alias("n_words"), width.alias("width"), gram.alias("gram"), F.explode("span.starts").alias("start"))
    shingles = F.slice("gram", F.col("start") + 1, F.col("length") - F.col("width") + 1)
    windows = windows.select("row", "length", "start", "n_words", shingles.alias("shingles"))
    windows = checkpointed(windows.withColumn("print", simhash(F.col("shingles"), lane)).dropDuplicates(["row", "length", "start"]))

    # Windows meet the items that they were laid for, block by block.
    marked = items.select("item", simhash(F.col("shingles"), lane).alias("item_print"))
    laid_for = near.select("row", "item", "length", F.explode("starts").alias("start")).join(windows.select("row", "length", "start", "print"), ["row", "length", "start"])
    keys = laid_for.select("row", "item", "length", "start", "print", F.inline(blocks(F.col("print"), radius)))
    item_keys = marked.select("item", "item_print", F.inline(blocks(F.col("item_print"), radius)))
    differing = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = keys.join(small(item_keys), ["item", "block", "bits"]).filter(differing <= radius).select("row", "item", "length", "start").distinct()

    # Each pair once: the smaller weights of the shingles that both have.
    weights = items.select("item", F.size("shingles").alias("m"), F.explode("shingles").alias("shingle")).groupBy("item", "m", "shingle").agg(F.count("*").alias("weight"))
    both = pairs.join(windows.drop("print"), ["row", "length", "start"])
    both = both.select("row", "item", "start", "n_words", F.size("shingles").alias("window_m"), F.explode("shingles").alias("shingle")).join(small(weights), ["item", "shingle"])
    counted = both.groupBy("row", "item", "start", "n_words", "window_m", "m", "shingle").agg(F.least(F.count("*"), F.first("weight")).alias("smaller"))
    scored = counted.groupBy("row", "item", "start", "n_words", "window_m", "m").agg(F.sum("smaller").alias("shared"))
    scored = scored.withColumn("all", F.col("m") + F.col("window_m") - F.col("shared")).filter(100 * F.col("shared") >= similarity * F.col("all"))
    best = F.max(F.struct((F.col("shared") / F.col("all")).alias("similarity"), (-F.col("start")).alias("from"), "n_words", "shared", "all")).alias("best")
    return scored.groupBy("row", "item").agg(best).select("row", "item", (-F.col("best.from")).alias("start"), "best.n_words", "best.shared", "best.all")


def keyed_rows(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    given = columns_of(df, id=id_column, text=text_column).filter("text is not null")
    return given.select(row_key(F.col("id"), F.col("text")).alias("row"), "text")


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    similarity: int = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """A row for each document and item found in it: document id, item id, the best window's first word (from 0), its
    number of words, and shared and all weights of the two, whose quotient is the similarity."""
    found = matched_rows(keyed_rows(df, id_column, text_column), benchmark, item_id_column, item_text_column, similarity, radius)
    return found.select(
        F.col("row.id").alias(id_column),
        F.col("item.id").alias(item_id_column),
        F.col("start").cast("bigint").alias("start_word"),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.col("shared").cast("bigint").alias("shared_weight"),
        F.col("all").cast("bigint").alias("total_weight"),
    )


def without_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    similarity: int = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """The rows of ``df`` in which no benchmark item is found, also those without an id or a text."""
    found = matched_rows(keyed_rows(df, id_column, text_column), benchmark, item_id_column, item_text_column, similarity, radius)
    leaky = checkpointed(found.select(F.col("row").alias(ROW)).distinct())
    if leaky.count() <= BROADCAST_WINDOWS:
        leaky = F.broadcast(leaky)
    return df.withColumn(ROW, row_key(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))).join(leaky, ROW, "left_anti").drop(ROW)
