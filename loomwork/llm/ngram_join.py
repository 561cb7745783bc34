"""N-gram Jaccard join: documents whose sets of five-word shingles are similar, and the groups that links connect.

Texts that read alike word for word are one class, and classes are joined. Each class deals its shingle hashes to
partitions by hash, packed into blobs of five bytes a shingle; a partition counts the classes of each shingle and sends
back the shingles of two or more classes. A class then knows its singletons, which come first in the rare-first order
(frequency, hash). Prefix filter: only the shingles among its first n - ceil(0.8 n) + 1 can be met first by a similar
class, and if singletons fill this prefix the class is done. What is left is joined on prefix shingles under the length
filter, the positional filter (shared shingles from here on) and the suffix filter (shared shingles by sixteenths of the
hash range, singletons excluded). Each pair is verified once, by the intersection of both classes' shingles.

A group of n near copies has about n * n pairs, of which connecting the group needs few. So the first round verifies
each class against one hub of its prefix shingles, the class with the fewest singletons; the second round verifies all
remaining pairs whose classes are not yet connected. No pair of unconnected classes is left out. So every link lies inside
a component, and ``class_pairs`` and ``document_links`` compare all pairs of each component once: its classes are cut into
cells by size and hash, and each two cells that the length filter allows are one task, which counts shared shingles
exactly. The number of links of a class is summed over tasks, so that no row is made for each pair unless pairs are asked.

Skew: a shingle that many classes of one batch share is not dealt by class; the batch sends it once, marked frequent,
to its partition, and the classes' own copies travel by batch. Frequencies from FREQUENT up rank alike, whichever way they were learned.

Defined cases: a null or wordless text has no shingles and is its own component; texts under five words are one shingle;
rows that share an id are one node; a null id takes the component of its class (null if all are null); an empty table
gives no rows. Shingles are compared by 46 bits of hash or more inside pairs that share prefix shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import ROW_KEY, columns_of, row_key, slices
from loomwork.llm.components import components
from loomwork.llm.substring_dedup import Spans, mixed, word_hashes
from loomwork.session import checkpointed, ship

SHINGLE = 5
#: Least similarity in hundredths: 100 * shared >= 80 * all.
SIMILARITY = 80
#: Shingles that one partition counts at a time, which bounds a worker's memory, and the least number of partitions.
PARTITION_SHINGLES = 1_500_000
LEAST_PARTITIONS = 64
#: Frequencies from here on rank alike, and a batch sends a shingle of so many of its classes only once.
FREQUENT = 255
#: Parts of the hash range in the suffix filter.
PARTS = 16
KEY_BITS = 40
#: Classes, and shingles of them, that a cell of a component has about.
CELL_CLASSES = 1000
CELL_SHINGLES = 1_000_000
#: Sizes of classes in one bucket differ by less than this factor: similar ones are in the same bucket or in the next.
BUCKET = 1.3
#: A column beside those of the documents while rows are chosen.
ROW = "_ngram_join_row"


def lowered_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words; bytes.lower() changes A-Z alone."""
    return text.encode().lower().split() if text else []


def shingle_sets(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document: hashes and owners, ordered by owner."""
    hashes, owner = word_hashes(documents)
    spans, n = Spans(hashes), len(hashes)
    starts = np.flatnonzero(owner[: max(0, n - SHINGLE + 1)] == owner[SHINGLE - 1 :]) if n >= SHINGLE else np.zeros(0, np.int64)
    sizes = np.array([len(d) for d in documents], np.int64)
    heads = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    whole = mixed(spans.of(heads[short], heads[short] + sizes[short]) ^ sizes[short].astype(np.uint64))
    found = np.concatenate([spans.of(starts, starts + SHINGLE), whole])
    of = np.concatenate([owner[starts], short])
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return found[new], of[new]


def class_key(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def emit_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=2_000_000):
        documents = [lowered_words(t) for t in batch.column("text").to_pylist()]
        keys = [class_key(d) if d else (None, None) for d in documents]
        n = np.bincount(shingle_sets(documents)[1], minlength=len(documents))
        columns = {"id": batch.column("id"), "text_row": batch.column("text_row"), "c1": pa.array([k[0] for k in keys], pa.int64()), "c2": pa.array([k[1] for k in keys], pa.int64())}
        yield pa.RecordBatch.from_pydict(columns | {"n": pa.array(n, pa.int64())})


def pack(keys: np.ndarray) -> bytes:
    """Five bytes of each key."""
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    narrow = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(narrow), 8), np.uint8)
    wide[:, :5] = narrow
    return wide.view("<u8").reshape(-1)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(values)))


DEALT = "g int, p int, classes binary, ns binary, counts binary, keys binary, frequent binary"
ANSWER = "q int, p int, classes binary, ns binary, counts binary, keys binary, dfs binary"
ANSWER_ARROW = pa.schema([("q", pa.int32()), ("p", pa.int32()), *((k, pa.binary()) for k in ("classes", "ns", "counts", "keys", "dfs"))])


def packed_runs(classes: np.ndarray, ns: np.ndarray, keys: np.ndarray) -> dict[str, bytes]:
    """Entries ordered by class, with each class and its n once."""
    start, count = runs(classes)
    return {"classes": classes[start].tobytes(), "ns": ns[start].astype(np.uint32).tobytes(), "counts": count.astype(np.uint32).tobytes(), "keys": pack(keys)}


def emit_dealt(partitions: int):
    """The shingles of each batch's classes, dealt to partitions; frequent ones apart, under a group that only forwards."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4_000_000):
            documents: dict[int, list[bytes]] = {}
            for text in batch.column("text").to_pylist():
                if words := lowered_words(text):
                    documents.setdefault(class_key(words)[0], words)
            if not documents:
                continue
            classes = np.array(list(documents), np.int64)
            hashes, owner = shingle_sets(list(documents.values()))
            n = np.bincount(owner, minlength=len(classes))
            part = ((hashes >> np.uint64(KEY_BITS)) % np.uint64(partitions)).astype(np.int64)
            key = hashes & np.uint64((1 << KEY_BITS) - 1)
            low = (key & np.uint64(0xFFFFF)).astype(np.int64)
            often = np.flatnonzero(np.bincount(low, minlength=1 << 20)[low] >= FREQUENT)
            values, counts = np.unique(part[often].astype(np.uint64) << np.uint64(KEY_BITS) | key[often], return_counts=True)
            frequent = values[counts >= FREQUENT]
            is_frequent = np.zeros(len(key), bool)
            is_frequent[often] = np.isin(part[often].astype(np.uint64) << np.uint64(KEY_BITS) | key[often], frequent)
            rows = []
            salt = partitions + int(classes[0]) % partitions
            frequent_part = (frequent >> np.uint64(KEY_BITS)).astype(np.int64)
            for apart in (False, True):
                at = np.flatnonzero(is_frequent == apart)
                at = at[np.argsort(part[at], kind="stable")]
                start, count = runs(part[at])
                for s, c in zip(start.tolist(), count.tolist(), strict=True):
                    mine, p = at[s : s + c], int(part[at[s]])
                    packed = packed_runs(classes[owner[mine]], n[owner[mine]], key[mine])
                    known = b"" if apart else pack(frequent[frequent_part == p])
                    rows.append({"g": salt if apart else p, "p": p, **packed, "frequent": known})
            none = {k: b"" for k in ("classes", "ns", "counts", "keys")}
            for p in np.setdiff1d(frequent_part, part[~is_frequent]).tolist():  # marks reach partitions without other entries too
                rows.append({"g": p, "p": p, **none, "frequent": pack(frequent[frequent_part == p])})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("g", pa.int32()), ("p", pa.int32()), *((k, pa.binary()) for k in ("classes", "ns", "counts", "keys", "frequent"))]))

    return emit


def entries(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, n and key of every entry of packed rows."""
    joined = {k: b"".join(table.column(k).to_pylist()) for k in ("classes", "ns", "counts", "keys")}
    counts = np.frombuffer(joined["counts"], np.uint32)
    return np.repeat(np.frombuffer(joined["classes"], np.int64), counts), np.repeat(np.frombuffer(joined["ns"], np.uint32), counts), unpack(joined["keys"])


def answers(classes, ns, keys, dfs, p: int, partitions: int) -> list[dict]:
    """Entries with their frequencies, dealt by class."""
    q = (classes.view(np.uint64) % np.uint64(partitions)).astype(np.int64)
    order = np.lexsort((classes, q))
    classes, ns, keys, dfs, q = classes[order], ns[order], keys[order], dfs[order], q[order]
    start, count = runs(q)
    return [
        {"q": int(q[s]), "p": p, **packed_runs(classes[s : s + c], ns[s : s + c], keys[s : s + c]), "dfs": dfs[s : s + c].astype(np.uint8).tobytes()}
        for s, c in zip(start.tolist(), count.tolist(), strict=True)
    ]


def count_classes(partitions: int):
    """Frequencies in one partition of shingles; answers those of two or more classes."""

    def count(table: pa.Table) -> pa.Table:
        rows = []
        if table.column("g")[0].as_py() >= partitions:
            for batch in table.to_batches():
                for i in range(batch.num_rows):
                    classes, ns, keys = entries(batch.slice(i, 1))
                    rows += answers(classes, ns, keys, np.full(len(keys), FREQUENT), batch.column("p")[i].as_py(), partitions)
        else:
            classes, ns, keys = entries(table)
            frequent = unpack(b"".join(table.column("frequent").to_pylist()))
            order = np.argsort(keys, kind="stable")
            start, count = runs(keys[order])
            several = np.repeat(count > 1, count)
            if len(frequent):
                several |= np.isin(keys[order], frequent)
            at = order[several]
            at = at[np.lexsort((classes[at], keys[at]))]
            new = np.ones(len(at), bool)
            new[1:] = (keys[at][1:] != keys[at][:-1]) | (classes[at][1:] != classes[at][:-1])
            at = at[new]
            _, count = runs(keys[at])
            dfs = np.repeat(np.minimum(count, FREQUENT), count)
            if len(frequent):
                dfs[np.isin(keys[at], frequent)] = FREQUENT
            at, dfs = at[dfs > 1], dfs[dfs > 1]
            rows = answers(classes[at], ns[at], keys[at], dfs, table.column("p")[0].as_py(), partitions) if len(at) else []
        return pa.Table.from_pylist(rows, schema=ANSWER_ARROW)

    return count


SURVIVOR = "class bigint, n int, m int, prefix int, keys array<bigint>, parts array<int>"


def prefix_length(n: np.ndarray) -> np.ndarray:
    return n - (SIMILARITY * n + 99) // 100 + 1


def survivors(table: pa.Table) -> pa.Table:
    """Classes whose prefix holds shingles of other classes: n, m (shared shingles), how many of them are in the
    prefix, and the shared shingles in rare-first order."""
    found = [], [], [], []
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            classes, ns, keys = entries(row)
            found[0].append(classes)
            found[1].append(ns)
            found[2].append(keys | np.uint64(row.column("p")[0].as_py() << KEY_BITS))
            found[3].append(np.frombuffer(row.column("dfs")[0].as_py(), np.uint8))
    classes, ns, keys, dfs = (np.concatenate(f) for f in found)
    order = np.lexsort((keys, dfs, classes))
    classes, ns, keys, dfs = classes[order], ns[order].astype(np.int64), keys[order], dfs[order]
    new = np.ones(len(keys), bool)  # a class in several batches learns of a frequent shingle from each
    new[1:] = (classes[1:] != classes[:-1]) | (keys[1:] != keys[:-1])
    classes, ns, keys = classes[new], ns[new], keys[new]
    start, count = runs(classes)
    inside = prefix_length(ns[start]) - (ns[start] - count)
    rows = []
    part = mixed(keys) >> np.uint64(64 - int(math.log2(PARTS)))
    for s, c, k in zip(start[inside > 0].tolist(), count[inside > 0].tolist(), inside[inside > 0].tolist(), strict=True):
        parts = np.bincount(part[s : s + c].astype(np.int64), minlength=PARTS)
        rows.append({"class": int(classes[s]), "n": int(ns[s]), "m": c, "prefix": k, "keys": keys[s : s + c].view(np.int64), "parts": parts})
    schema = pa.schema([("class", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("prefix", pa.int32()), ("keys", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])
    return pa.Table.from_pylist(rows, schema=schema)


def needed(n: str, m: str) -> str:
    """Shingles that sets of n and m must share, as SQL: 100 * shared >= 80 * (n + m - shared)."""
    return f"ceil({SIMILARITY} * ({n} + {m}) / {100 + SIMILARITY}D - 1e-9)"


def pair_filters(a: str, b: str) -> str:
    """Length filter, singletons and positional filter for postings a and b of one shingle."""
    need = needed(f"{a}.n", f"{b}.n")
    return f"""100 * least({a}.n, {b}.n) >= {SIMILARITY} * greatest({a}.n, {b}.n) AND least({a}.m, {b}.m) >= {need}
      AND 1 + least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need}"""


def verified(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the suffix filter and then the exact intersection leave enough."""
    stats = kept.select("class", "n", "parts")
    both = pairs.join(stats.selectExpr("class AS a", "n AS an", "parts AS ap"), "a").join(stats.selectExpr("class AS b", "n AS bn", "parts AS bp"), "b")
    most = F.aggregate(F.zip_with("ap", "bp", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    left = checkpointed(both.filter(most >= F.expr(needed("an", "bn"))).select("a", "b"))
    keys = kept.select("class", "n", "keys")
    both = left.join(keys.selectExpr("class AS a", "n AS an", "keys AS ak"), "a").join(keys.selectExpr("class AS b", "n AS bn", "keys AS bk"), "b")
    shared = F.size(F.array_intersect("ak", "bk"))
    return both.filter(100 * shared >= SIMILARITY * (F.col("an") + F.col("bn") - shared)).select("a", "b")


def class_links(kept: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect all similar classes among the survivors."""
    postings = kept.select("class", "n", "m", F.posexplode(F.slice("keys", F.lit(1), F.col("prefix"))).alias("i", "key"))
    postings = checkpointed(postings.selectExpr("key", "class", "n", "m", "n - m + i + 1 AS pos"))

    hubs = postings.groupBy("key").agg(F.min(F.struct(((F.col("n") - F.col("m")) / F.col("n")).alias("alone"), "class", "n", "m", "pos")).alias("hub"), F.count("*").alias("size"))
    hubs = hubs.filter("size > 1").select("key", "hub.*")
    first = postings.alias("x").join(hubs.alias("h"), F.expr(f"x.key = h.key AND x.class != h.class AND {pair_filters('x', 'h')}"))
    first = first.groupBy(F.col("x.class").alias("a")).agg(F.min(F.struct("h.alone", "h.class")).alias("hub")).select("a", F.col("hub.class").alias("b"))
    tried = checkpointed(first.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct())
    links = checkpointed(verified(tried, kept))

    # All pairs left: in different components, of classes that could still be similar to the smallest of the shingle.
    labels = components(links)
    placed = postings.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = postings.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("size")).filter("size > 1")
    viable = checkpointed(placed.join(least, "key").filter(F.expr(f"m >= {needed('n', 'greatest(least, m)')}")).drop("least", "size"))
    mixed_keys = viable.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    rest = checkpointed(viable.join(mixed_keys, "key"))
    pairs = rest.alias("x").join(rest.alias("y"), F.expr(f"x.key = y.key AND x.class < y.class AND x.label != y.label AND {pair_filters('x', 'y')}"))
    pairs = pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return links.unionByName(verified(checkpointed(pairs), kept))


def shared_counts(ak: np.ndarray, ai: np.ndarray, bk: np.ndarray, bi: np.ndarray, n: int, m: int) -> np.ndarray:
    """For n sets and m sets, given as keys and the sets that have them, the keys that each two share."""
    shared = np.zeros(n * m, np.int64)
    both = np.intersect1d(ak, bk)
    if not len(both):
        return shared.reshape(n, m)

    def placed(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, keys), len(both) - 1)
        known = np.flatnonzero(both[at] == keys)
        order = known[np.argsort(at[known], kind="stable")]
        counts = np.bincount(at[order], minlength=len(both))
        return at[order], sets[order], np.cumsum(counts) - counts, counts

    (at, ai, astart, acount), (bt, bi, bstart, bcount) = placed(ak, ai), placed(bk, bi)
    dense = acount * bcount * 64 >= n * m
    often = np.flatnonzero(dense)
    for s in range(0, len(often), 2048):
        column = np.full(len(both), -1)
        column[often[s : s + 2048]] = np.arange(len(often[s : s + 2048]))
        x, y = np.zeros((n, 2048), np.float32), np.zeros((m, 2048), np.float32)
        mine, theirs = column[at] >= 0, column[bt] >= 0
        x[ai[mine], column[at[mine]]] = 1
        y[bi[theirs], column[bt[theirs]]] = 1
        shared += (x @ y.T).astype(np.int64).reshape(-1)
    rare = np.flatnonzero(~dense)
    sizes = acount[rare] * bcount[rare]
    part = np.cumsum(sizes) // 4_000_000
    for few in np.split(rare, np.flatnonzero(np.diff(part)) + 1) if len(rare) else ():
        size = acount[few] * bcount[few]
        key = np.repeat(few, size)
        inside = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
        pair = ai[astart[key] + inside // bcount[key]] * m + bi[bstart[key] + inside % bcount[key]]
        shared += np.bincount(pair, minlength=n * m)
    return shared.reshape(n, m)


PAIR = "a bigint, b bigint, shared bigint, total bigint"
COUNT = "class bigint, n_links bigint"


def compare_cells(counts_only: bool):
    """The similar pairs of classes in two cells (or of one with itself), or how many each class has of them."""

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        same = table.column("same")[0].as_py()
        sides = []
        for wanted in (0, 1):
            rows = table.filter(pa.array(side == (0 if same else wanted)))
            keys = [np.asarray(k, np.int64) for k in rows.column("keys").to_numpy()]
            sizes = [len(k) for k in keys]
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            sides.append((rows.column("class").to_numpy(), rows.column("n").to_numpy().astype(np.int64), flat, np.repeat(np.arange(len(keys)), sizes)))
        (a, an, ak, ai), (b, bn, bk, bi) = sides
        shared = shared_counts(ak, ai, bk, bi, len(a), len(b))
        total = an[:, None] + bn[None, :] - shared
        similar = 100 * shared >= SIMILARITY * total
        if same:
            similar &= a[:, None] < b[None, :]
        x, y = np.nonzero(similar)
        if counts_only:
            found = np.concatenate([a[x], b[y]])
            classes, n = np.unique(found, return_counts=True)
            return pa.table({"class": pa.array(classes, pa.int64()), "n_links": pa.array(n, pa.int64())})
        columns = {"a": np.minimum(a[x], b[y]), "b": np.maximum(a[x], b[y]), "shared": shared[x, y], "total": total[x, y]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    return compare


def component_tasks(kept: DataFrame, labels: DataFrame) -> DataFrame:
    """The classes of components, dealt to the tasks that compare two cells each."""
    bucket = F.floor(F.log("n") / math.log(BUCKET)).cast("int")
    nodes = kept.join(labels.withColumnRenamed("node", "class"), "class").withColumn("bucket", bucket).select("class", "n", "keys", "label", "bucket", "m")
    cells = nodes.groupBy("label", "bucket").agg(F.ceil(F.greatest(F.count("*") / CELL_CLASSES, F.sum("m") / CELL_SHINGLES)).cast("int").alias("cells"))
    above = cells.select("label", (F.col("bucket") - 1).alias("bucket"), F.col("cells").alias("above"))
    below = cells.select("label", (F.col("bucket") + 1).alias("bucket"), F.col("cells").alias("below"))
    cells = checkpointed(cells.join(above, ["label", "bucket"], "left").join(below, ["label", "bucket"], "left").fillna(0, ["above", "below"]))
    placed = nodes.join(cells, ["label", "bucket"]).withColumn("cell", F.pmod(F.xxhash64("class"), "cells").cast("int"))

    def tasks(number: str, task) -> Column:
        return F.transform(F.when(F.col(number) > 0, F.sequence(F.lit(0), F.col(number) - 1)).otherwise(F.array().cast("array<int>")), task)

    def task(low, first, second, side, wide):
        return F.struct(low.alias("low"), first.alias("first"), second.alias("second"), wide.alias("wide"), side.cast("int").alias("side"))

    mine, at = F.col("cell"), F.col("bucket")
    inside = tasks("cells", lambda c: task(at, F.least(mine, c), F.greatest(mine, c), mine > c, F.lit(False)))
    up = tasks("above", lambda c: task(at, mine, c, F.lit(0), F.lit(True)))
    down = tasks("below", lambda c: task(at - 1, c, mine, F.lit(1), F.lit(True)))
    dealt = placed.select("label", "class", "n", "keys", F.explode(F.concat(inside, up, down)).alias("task"))
    return dealt.select("label", "class", "n", "keys", "task.*").withColumn("same", ~F.col("wide") & (F.col("first") == F.col("second")))


def compared(kept: DataFrame, labels: DataFrame, counts_only: bool) -> DataFrame:
    tasks = component_tasks(kept, labels).groupBy("label", "low", "first", "second", "wide")
    return tasks.applyInArrow(compare_cells(counts_only), COUNT if counts_only else PAIR)


def shingled_classes(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's class (c1, c2) and n, the classes that others can be similar to, and the components (node, label)."""
    ship(df.sparkSession)
    rows = columns_of(df, id=id_column, text=text_column).withColumn("text_row", row_key(F.col("id"), F.col("text")))
    kind = rows.schema["id"].dataType.simpleString()
    stats = checkpointed(rows.mapInArrow(emit_classes, f"id {kind}, text_row {ROW_KEY}, c1 bigint, c2 bigint, n bigint"))
    total = stats.agg(F.sum("n")).first()[0] or 0
    partitions = max(LEAST_PARTITIONS, math.ceil(total / PARTITION_SHINGLES))

    dealt = rows.select("text").mapInArrow(emit_dealt(partitions), DEALT)
    counted = dealt.groupBy("g").applyInArrow(count_classes(partitions), ANSWER)
    kept = checkpointed(counted.groupBy("q").applyInArrow(survivors, SURVIVOR))
    return stats, kept, components(class_links(kept))


def class_pairs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """All pairs of similar classes, each once: (a, b, shared, total), and membership: the id and class of each row (null
    for wordless texts). Texts that read alike word for word are one class."""
    stats, kept, labels = shingled_classes(df, id_column, text_column)
    return compared(kept, labels, False), stats.select(F.col("id").alias(id_column), F.col("c1").alias("class"))


def document_links(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, class_id (the least id of its class; its own if wordless) and n_links, the number of other classes
    that its class is similar to."""
    stats, kept, labels = shingled_classes(df, id_column, text_column)
    links = compared(kept, labels, True).groupBy("class").agg(F.sum("n_links").alias("n_links"))
    classes = stats.filter("c1 is not null").groupBy("c1", "c2").agg(F.min("id").alias("class_id"))
    classes = classes.join(links, F.col("c1") == F.col("class"), "left").select("c1", "c2", "class_id", "n_links")
    joined = stats.join(checkpointed(classes), ["c1", "c2"], "left")
    return joined.select(F.col("id").alias(id_column), F.when(F.col("c1").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def similar_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id, n_shingles, component_id, the least id that links reach (its own included), and text_row, a hash of
    its id and text."""
    stats, _, labels = shingled_classes(df, id_column, text_column)

    classes = stats.filter("c1 is not null").groupBy("c1", "c2").agg(F.min("id").alias("first"))
    classes = classes.join(labels, F.col("c1") == F.col("node"), "left").select("c1", "c2", "first", F.coalesce("label", "c1").alias("label"))
    classes = checkpointed(classes)
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    placed = classes.join(least, "label").select("c1", "c2", "component_id")
    joined = stats.join(placed, ["c1", "c2"], "left")
    return joined.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("c1").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "text_row")


def one_of_each_group(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each group the row with the least id; rows without an id all stay."""
    groups = similar_groups(df, id_column, text_column)
    first = groups.filter(F.col(id_column).isNotNull()).groupBy("component_id").agg(F.min(F.struct(id_column, "text_row")).alias("first"))
    rows = df.withColumn(ROW, row_key(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")))
    chosen = rows.join(first.select(F.col("first.text_row").alias(ROW)), ROW).dropDuplicates([ROW]).select(*df.columns)
    return chosen.unionByName(df.filter(F.col(id_column).isNull()))
