"""Substring dedup over the de Bruijn graph of token k-mers, k being the window of 50 words.

Edges are the token k-mers, that is all windows of all texts; each joins the 49 words before its last with the 49 after
its first. They are dealt by minimum substring partitioning: a window owns the 10 words with the least hash in it (its
vertex here), so equal windows own equal words at equal places, and a document's windows that follow each other and own
the same words travel as one run, keyed by vertex and hash. No window is left out, and only runs are shuffled.

A join drops vertices of one document. What follows a run and counts give its degrees: where its occurrences all continue
alike, and as many continue as the next run has after any run, all of the next run's come from it and the two are
nonbranching; a join of neighbours in the first document compacts such runs into paths (of PATH_RUNS runs at most, which bounds what a piece of a path ships). An
occurrence of a path after its first document is one span. Where a vertex branches, one occurrence of each of its runs is
opened into its windows, these meet window by window, and neighbouring ones that meet the same run become one span.

Each span has coordinates, its own (row, first word) and its source's (path or run, offset). It is verified word for
word: the words at the source travel to the span's text, and only a span that agrees with them is removed. Rows are told
apart by id and 64 bits of hash.

Hot passages are pre-aggregated before each shuffle (the first document by run and window); joins on them are plain
equi-joins that adaptive execution splits.

Defined cases: a null text has no words; documents under 50 words are kept whole; a null id neither precedes nor
follows any document; rows that repeat with one id don't precede each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import columns_of, slices, words_of
from loomwork.session import ship, stored

#: Words of a window, and of a vertex.
WINDOW = 50
KMER = 10
#: Runs that a compacted path has at most; a longer one goes on as the next path.
PATH_RUNS = 16

_MULTIPLIER = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Spans:
    """Hashes of any span of a sequence of word hashes, from sums of words times powers."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        if "up" not in _powers or len(_powers["up"]) < n + 1:
            size = max(n + 1, 1 << 20)
            for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _powers["up"][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * _powers["down"][start])


def word_hashes(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words one after the other, and each word's document."""
    sizes = [len(d) for d in documents]
    hashes = np.fromiter((h for d in documents for h in map(xxhash.xxh3_64_intdigest, d)), np.uint64, sum(sizes))
    return hashes, np.repeat(np.arange(len(documents)), sizes)


def least_kmer(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each start the place of the least hash among ``window`` of them, the leftmost of equal ones."""
    at, length = np.arange(len(hashes)), 1
    while length < window:
        shift = min(length, window - length)
        left, right = at[:-shift], at[shift:]
        at = np.where(hashes[right] < hashes[left], right, left)
        length += shift
    return at


def edges_of(documents: list[list[bytes]]) -> dict[str, np.ndarray]:
    """The runs of some documents: owner (index of the document), vertex, edge (its hash), start (first word), windows, and
    the run after it, masked at the end of a document."""
    hashes, owner = word_hashes(documents)
    if len(hashes) < WINDOW:
        empty = np.zeros(0, np.int64)
        return {k: empty for k in ("owner", "vertex", "edge", "start", "windows")} | {"after": np.ma.array(empty)}
    spans, n = Spans(hashes), len(hashes)
    starts = np.arange(n - KMER + 1)
    kmers = spans.of(starts, starts + KMER)
    owned = least_kmer(kmers, WINDOW - KMER + 1)
    windows = np.flatnonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1 :])
    vertex = owned[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (vertex[1:] != vertex[:-1]) | (np.diff(windows) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    begin, place = windows[first], vertex[first]
    edge = spans.of(begin, begin + count + WINDOW - 1) ^ (count * 64 + place - begin).astype(np.uint64)
    head = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
    edge = mixed(edge).view(np.int64)
    first_of = np.diff(owner[begin], prepend=-1) != 0
    return {
        "owner": owner[begin],
        "vertex": kmers[place].view(np.int64),
        "edge": edge,
        "start": begin - head[owner[begin]],
        "windows": count,
        "after": np.ma.array(np.roll(edge, -1), mask=np.roll(first_of, -1)),
    }


def emit_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=2_000_000):
        found = edges_of([words_of(t) for t in batch.column("text").to_pylist()])
        owner = pa.array(found.pop("owner"))
        yield pa.RecordBatch.from_pydict({"row": batch.column("row").take(owner)} | {k: pa.array(np.ma.getdata(v), pa.int64(), mask=np.ma.getmaskarray(v)) for k, v in found.items()})


def emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs listed with each text: vertex, number of the run, offset in the run and hash."""
    for batch in slices(batches, limit=2_000_000):
        columns: dict[str, list] = {k: [] for k in ("vertex", "run", "at", "window")}
        owner = []
        for i, (text, edges) in enumerate(zip(batch.column("text").to_pylist(), batch.column("edges").to_pylist(), strict=True)):
            spans = Spans(word_hashes([words_of(text)])[0])
            for e in edges:
                at = np.arange(e["windows"])
                columns["at"].append(at)
                columns["window"].append(spans.of(e["start"] + at, e["start"] + at + WINDOW).view(np.int64))
                for k in ("vertex", "run"):
                    columns[k].append(np.full(len(at), e[k], np.int64))
                owner.append(np.full(len(at), i))
        if owner:
            ids = batch.column("id").take(pa.array(np.concatenate(owner)))
            yield pa.RecordBatch.from_pydict({"id": ids} | {k: pa.array(np.concatenate(v)) for k, v in columns.items()})


def emit_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the sources listed with each text, by vertex and edge."""
    for batch in slices(batches, limit=2_000_000):
        columns: dict[str, list] = {k: [] for k in ("vertex", "edge", "words")}
        for text, sources in zip(batch.column("text").to_pylist(), batch.column("sources").to_pylist(), strict=True):
            words = words_of(text)
            for s in sources:
                columns["vertex"].append(s["vertex"])
                columns["edge"].append(s["edge"])
                columns["words"].append(b" ".join(words[s["start"] : s["start"] + s["windows"] + WINDOW - 1]))
        if columns["words"]:
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "words" else pa.int64()) for k, v in columns.items()})


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    """The words that no span (start, windows) covers, of those whose words are the ones at their source's offset."""
    covered = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        end, length = s["start"] + s["windows"] + WINDOW - 1, s["windows"] + WINDOW - 1
        if words[s["start"] : end] == s["words"].split()[s["offset"] : s["offset"] + length]:
            covered[s["start"]] += 1
            covered[end] -= 1
    keep = np.cumsum(covered)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def emit_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=2_000_000):
        n_words, n_removed, kept = [], [], []
        column = batch.column("spans")
        for i, text in enumerate(batch.column("text").to_pylist()):
            words, spans = words_of(text), column[i].as_py()
            left = kept_words(words, spans) if spans else words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        counts = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}
        others = {k: batch.column(k) for k in batch.schema.names if k not in ("text", "spans")}
        yield pa.RecordBatch.from_pydict(others | counts | {"text": batch.column("text")})


def compacted(firsts: DataFrame, one_before: str = "one_before", left_columns: tuple[str, ...] = ()) -> DataFrame:
    """``firsts`` (the first occurrence of each run) with its path: pv, pe (the path's first run) and path_start.

    A join pairs a run with the one before it in the first document; they are one path if neither branches there.
    ``one_before`` is SQL; it may read ``left_columns`` of the run before as left_<name>."""
    left = firsts.selectExpr("first_row", "first_start + windows AS first_start", "one_after AS joined", *(f"{c} AS left_{c}" for c in left_columns))
    linked = firsts.join(left.dropDuplicates(["first_row", "first_start"]).hint("merge"), ["first_row", "first_start"], "left")
    goes_on = F.coalesce(F.col("joined") & F.expr(one_before), F.lit(False))
    along = Window.partitionBy("first_row").orderBy("first_start")
    chains = linked.withColumn("chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(along))
    inside = Window.partitionBy("first_row", "chain").orderBy("first_start")
    pieces = chains.withColumn("piece", F.floor((F.row_number().over(inside) - 1) / PATH_RUNS))
    head = F.first(F.struct("vertex", "edge", "first_start")).over(Window.partitionBy("first_row", "chain", "piece").orderBy("first_start"))
    return pieces.withColumn("head", head).select(*firsts.columns, F.col("head.vertex").alias("pv"), F.col("head.edge").alias("pe"), F.col("head.first_start").alias("path_start"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(row, spans) of the texts with words to remove: spans of windows that start in an earlier document too.

    ``rows`` comes from texts_by_row(). A span is (start, windows, offset, words): its first word, its number of windows,
    and the words of its source, which has it at the offset.
    """
    ship(rows.sparkSession)
    id_kind, row_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "row"))
    kinds = f"row {row_kind}, vertex bigint, edge bigint, start bigint, windows bigint, after bigint"
    edges = rows.select("id", "text", "row").filter("id is not null").mapInArrow(emit_edges, kinds)

    # The joins below get both sides by shuffles of their own, not by an aggregate's, so that hot vertices can be split.
    # Runs are stored as Parquet, smaller than checkpointed rows; its size says little of rows in memory, so joins merge.
    shared = edges.groupBy("vertex").agg(F.min("row.id").alias("low"), F.max("row.id").alias("high")).filter("low < high").select("vertex")
    edges = stored(edges.join(stored(shared, "vertices").hint("merge"), "vertex"), "runs")

    # Degrees: a run that ends its document says nothing about what follows it, one that starts it of what comes before.
    firsts = edges.groupBy("vertex", "edge").agg(
        F.min(F.struct("row", "start", "windows")).alias("first"),
        F.max("row.id").alias("last_id"),
        F.count_if(F.col("start") > 0).alias("n_before"),
        F.count("after").alias("n_after"),
        (F.min("after") == F.max("after")).alias("one_after"),
    )
    firsts = firsts.selectExpr("vertex", "edge", "first.row AS first_row", "first.start AS first_start", "first.windows AS windows", "last_id", "n_before", "n_after", "one_after")
    firsts = compacted(stored(firsts, "firsts"), "n_before = left_n_after", ("n_after",))
    firsts = stored(firsts.drop("n_before", "n_after", "one_after"), "paths")

    # Nonbranching: an occurrence of a path after its first document is repeated whole.
    known = edges.select("row", "vertex", "edge", "start").join(firsts.select("vertex", "edge", "first_row", "first_start", "windows", "pv", "pe", "path_start").hint("merge"), ["vertex", "edge"])
    later = known.filter("row.id > first_row.id").withColumn("shift", F.col("start") - F.col("first_start"))
    whole = later.groupBy("row", "pv", "pe", "path_start", "shift").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("windows")).alias("end"))
    whole = whole.selectExpr("row", "pv AS vertex", "pe AS edge", "start", "end - start AS windows", "start - shift - path_start AS offset")
    paths = firsts.groupBy("first_row", "pv", "pe", "path_start").agg(F.max("last_id").alias("last_id"), F.max(F.col("first_start") + F.col("windows")).alias("end")).filter("last_id > first_row.id")
    paths = paths.selectExpr("first_row AS row", "pv AS vertex", "pe AS edge", "path_start AS start", "end - path_start AS windows")

    # Branching: one occurrence of each run of such a vertex is opened into its windows. The joins on rows here and the
    # caller's deal the same columns by the same key within one query, so that Spark shuffles the texts once.
    branching = firsts.groupBy("vertex").agg(F.count("*").alias("n"), F.min("first_row.id").alias("low"), F.max("first_row.id").alias("high")).filter("n > 1 and low < high")
    opened = firsts.join(branching.select("vertex", "high").hint("merge"), "vertex").selectExpr("first_row AS row", "vertex", "edge", "first_start AS start", "windows", "high")
    opened = stored(opened.withColumn("run", F.monotonically_increasing_id()), "opened")
    listed = stored(opened.groupBy("row").agg(F.collect_list(F.struct("vertex", "run", "start", "windows")).alias("edges")), "listed")
    windows = rows.join(listed.hint("merge"), "row").mapInArrow(emit_windows, f"id {id_kind}, vertex bigint, run bigint, at bigint, window bigint")
    earliest = windows.groupBy("vertex", "window").agg(F.min(F.struct("id", "run", "at")).alias("source"), F.max("id").alias("high")).filter("source.id < high")
    earliest = earliest.selectExpr("vertex", "window", "source.id AS low", "source.run AS source", "source.at AS source_at")
    met = windows.join(earliest.repartition("window"), ["vertex", "window"]).filter("id > low").withColumn("shift", F.col("source_at") - F.col("at"))
    met = met.groupBy("run", "source", "shift").agg(F.sort_array(F.collect_set("at")).alias("ats")).select("run", "source", "shift", F.posexplode("ats").alias("i", "at"))
    met = met.groupBy("run", "source", "shift", (F.col("at") - F.col("i")).alias("stretch")).agg(F.min("at").alias("at"), F.count("*").alias("n"))
    met = met.join(opened.select("run", "vertex", "edge").hint("merge"), "run").join(opened.selectExpr("run AS source", "edge AS source_edge").hint("merge"), "source")
    parts = known.filter("row.id = first_row.id").select("vertex", "edge", "row", "start").join(met, ["vertex", "edge"])
    parts = parts.selectExpr("row", "vertex", "source_edge AS edge", "start + at AS start", "n AS windows", "at + shift AS offset")

    # The words at the sources: paths that a later document has, and opened runs that aren't the last of their vertex.
    sources = paths.unionByName(opened.filter("row.id < high").drop("high", "run")).groupBy("row", "vertex", "edge", "start").agg(F.max("windows").alias("windows"))
    sources = stored(sources.groupBy("row").agg(F.collect_list(F.struct("vertex", "edge", "start", "windows")).alias("sources")), "sources")
    texts = rows.join(sources.hint("merge"), "row").mapInArrow(emit_sources, "vertex bigint, edge bigint, words binary")
    spans = whole.unionByName(parts).join(texts, ["vertex", "edge"])
    return spans.groupBy("row").agg(F.collect_set(F.struct("start", "windows", "offset", "words")).alias("spans"))


def texts_by_row(df: DataFrame, id_column: str, text_column: str, **others: str) -> DataFrame:
    rows = columns_of(df, id=id_column, text=text_column, **others)
    return rows.withColumn("row", F.struct("id", F.xxhash64("id", "text").alias("a")))


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: its id, text, n_words, n_removed, kept_text (kept words joined by one space) and the columns ``keep``."""
    given = texts_by_row(df, id_column, text_column, **{f"kept_{c}": c for c in keep or []})
    rows = given.join(repeated_spans(given), "row", "left").drop("row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "spans"))
    done = rows.mapInArrow(emit_kept, f"{schema}, n_words bigint, n_removed bigint, kept_text string, text string")
    return done.withColumnsRenamed({"id": id_column} | {f"kept_{c}": c for c in keep or []} | {"text": text_column})


