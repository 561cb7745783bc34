"""Quality rules: counts of each text, and lines that too many documents of a host share.

The first pass gives the keys of each document's normalised lines (A-Z lower-cased, runs of white space made one
space) as integers, kept in a checkpoint. A line's frequency is the number of distinct documents of its host that have
it; a document is an id with its text, so rows that repeat count once and copies under other ids count each. A line is
above the limits if more than LINE_DOCUMENTS documents have it and more than LINE_SHARE of the host's documents or
LINE_MOST of them, so that the limit doesn't grow with the host without bound. The second pass counts each text, cuts
the lines above the limits out of it and judges what is left. Texts are never shuffled as long as the lines above the
limits fit a broadcast; beyond that they are dealt to their documents by a join.

A line is known by 64 bits of hash together with its host: among 10^12 lines about one in 10^7 lines above limits meets
another by chance. A hot host's lines are counted by partial sums before the shuffle.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; rows that
repeat are judged each; an empty table gives no rows. Lines without a word are never removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.common import columns_of, slices
from loomwork.session import checkpointed, ship

#: A line is removed if more than this many documents of its host have it, ...
LINE_DOCUMENTS = 20
#: ... and more than this share of the host's documents, ...
LINE_SHARE = 0.1
#: ... or more than this many, however large the host.
LINE_MOST = 10_000
#: A document is rejected if, after lines were removed, a smaller share of its words than this is left, ...
LEFT_SHARE = 0.2
#: ... or fewer words than this, which the base rules ask of every text.
LEAST_WORDS = 20
#: Lines above the limits up to which they are broadcast (8 bytes each).
BROADCAST_LINES = 500_000

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows that are found twice or more, by comparing windows exactly."""
    starts: dict[tuple, list[int]] = {}
    for i in range(len(words) - WINDOW + 1):
        starts.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = np.zeros(len(words) + 1, np.int64)
    for found in starts.values():
        if len(found) > 1:
            at = np.array(found)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def may_repeat(documents: list[list[bytes]]) -> np.ndarray:
    """Which documents have two windows of equal hash; all that have two equal windows are among them."""
    sizes = np.array([len(w) for w in documents], np.int64)
    hashes = np.fromiter((hash(w) for words in documents for w in words), np.int64, int(sizes.sum())).view(np.uint64)
    found = np.zeros(len(documents), bool)
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return found
    owner = np.repeat(np.arange(len(documents)), sizes)
    rolled = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    whole = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    rolled = rolled[whole] ^ (owner[whole].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(rolled, kind="stable")
    equal = np.flatnonzero(rolled[order][1:] == rolled[order][:-1])
    found[owner[whole[order[equal]]]] = True
    return found


def line_key(host: bytes, line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(host + b"\x00" + line) - (1 << 63)


def host_bytes(host: str | None) -> bytes:
    return b"\x00" if host is None else b"\x01" + host.encode()


def emit_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of the host and of the distinct lines of each row."""
    for batch in slices(batches, limit=2_000_000):
        hosts, keys = [], []
        for text, host in zip(batch.column("text").to_pylist(), batch.column("host").to_pylist(), strict=True):
            host = host_bytes(host)
            found = {b" ".join(words).lower() for words in map(bytes.split, (text or "").encode().split(b"\n")) if words}
            hosts.append(line_key(host, b""))
            keys.append([line_key(host, line) for line in found])
        yield pa.RecordBatch.from_pydict({"document": batch.column("document"), "host_key": pa.array(hosts, pa.int64()), "line_keys": pa.array(keys, pa.list_(pa.int64()))})


class Judged:
    """One text's counts and what is left of it without some lines."""

    __slots__ = ("counts", "left", "words")

    def __init__(self, text: str, host: bytes, gone: frozenset[int]):
        words, kept, seen, n_lines, lost = [], [], set(), 0, 0
        for line in text.encode().split(b"\n"):
            if found := line.split():
                words += found
                n_lines += 1
                seen.add(line)
                if gone and line_key(host, b" ".join(found).lower()) in gone:
                    lost += len(found)
                    continue
            kept.append(line)
        self.words = words
        self.left = b"\n".join(kept).decode() if lost else text
        self.counts = {
            "n_words": len(words),
            "word_chars": len(text) - sum(map(text.count, SPACES)),
            "n_symbols": sum(map(text.count, SYMBOLS)),
            "n_dup_lines": n_lines - len(seen),
            "n_removed_words": lost,
        }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_removed_words", "n_repeat_words")
VERDICTS = ("base_failed", "kept")


def judge_batch(batch: pa.RecordBatch, text_column: str, host_column: str, gone: frozenset[int], least_words: int, left_share: float) -> tuple[dict[str, list], list[str]]:
    """COUNTS and VERDICTS of each row, and the texts that are left."""
    lists = batch.column("gone").to_pylist() if "gone" in batch.schema.names else [None] * batch.num_rows
    texts = [t or "" for t in batch.column(text_column).to_pylist()]
    judged = [Judged(t, host_bytes(h), gone if mine is None else frozenset(mine)) for t, h, mine in zip(texts, batch.column(host_column).to_pylist(), lists, strict=True)]
    may = may_repeat([j.words for j in judged])
    rows: dict[str, list] = {k: [] for k in COUNTS + VERDICTS}
    for j, found in zip(judged, may, strict=True):
        counts = j.counts | {"n_repeat_words": repeated_words(j.words) if found else 0}
        n, lost = counts["n_words"], counts["n_removed_words"]
        failed = n < LEAST_WORDS or 100 * counts["n_repeat_words"] > 30 * n
        depleted = lost > 0 and (n - lost < least_words or n - lost < left_share * n)
        for k, v in (counts | {"base_failed": failed, "kept": not failed and not depleted}).items():
            rows[k].append(v)
    return rows, [j.left for j in judged]


def document_key(id_: Column, text: Column) -> Column:
    """96 bits beside the id: what tells documents apart."""
    return F.struct(id_.alias("id"), F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def lines_above(rows: DataFrame, line_documents: int, line_share: float, line_most: int) -> tuple[DataFrame, DataFrame]:
    """(line): keys of the lines above the limits, and (document, host_key, line_keys) of all documents, from rows (document, text, host)."""
    kind = rows.schema["document"].dataType.simpleString()
    features = checkpointed(rows.mapInArrow(emit_lines, f"document {kind}, host_key bigint, line_keys array<bigint>"))
    documents = features.groupBy("host_key", "document").agg(F.first("line_keys").alias("line_keys"))
    hosts = features.select("host_key", "document").distinct().groupBy("host_key").agg(F.count("*").alias("host_documents"))
    counts = documents.select("host_key", F.explode("line_keys").alias("line")).groupBy("host_key", "line").agg(F.count("*").alias("n")).filter(F.col("n") > line_documents)
    above = (F.col("n") > line_share * F.col("host_documents")) | (F.col("n") > line_most)
    return checkpointed(counts.join(hosts, "host_key").filter(above).select("line")), features


def with_lines(df: DataFrame, id_column: str, text_column: str, host_column: str, line_documents: int, line_share: float, line_most: int) -> tuple[DataFrame, object]:
    """``df`` as the second pass reads it, and the broadcast keys of the lines above the limits; if these are too many for
    a broadcast, ``df`` gets a column gone with each row's own."""
    spark = df.sparkSession
    ship(spark)
    rows = columns_of(df, id=id_column, text=text_column, host=host_column)
    key = document_key(F.col("id"), F.col("text"))
    above, features = lines_above(rows.select(key.alias("document"), "text", "host"), line_documents, line_share, line_most)
    if above.count() <= BROADCAST_LINES:
        return df, spark.sparkContext.broadcast(frozenset(r.line for r in above.collect()))
    gone = features.select("document", "host_key", F.explode("line_keys").alias("line")).join(above, "line").groupBy("document", "host_key").agg(F.collect_set("line").alias("gone"))
    # A document's rows may stand under several hosts; line keys hold the host, so the lists can be put together.
    gone = gone.groupBy("document").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    joined = df.withColumn("document", document_key(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))).join(gone, "document", "left").drop("document")
    return joined.withColumn("gone", F.coalesce("gone", F.array().cast("array<bigint>"))), spark.sparkContext.broadcast(frozenset())


def judge_documents(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    line_documents: int = LINE_DOCUMENTS,
    line_share: float = LINE_SHARE,
    line_most: int = LINE_MOST,
    least_words: int = LEAST_WORDS,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """Per row: its id, the base counts, n_removed_words (in removed lines), base_failed and kept."""
    rows, gone = with_lines(columns_of(df, id=id_column, text=text_column, host=host_column), "id", "text", "host", line_documents, line_share, line_most)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2_000_000):
            found, _ = judge_batch(batch, "text", "host", gone.value, least_words, left_share)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id")} | {k: pa.array(v, pa.bool_() if k in VERDICTS else pa.int64()) for k, v in found.items()})

    columns = [f"{k} bigint" for k in COUNTS] + [f"{k} boolean" for k in VERDICTS]
    return rows.mapInArrow(emit, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(columns)}").withColumnRenamed("id", id_column)


def cleaned_documents(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    chars_column: str = "n_chars",
    line_documents: int = LINE_DOCUMENTS,
    line_share: float = LINE_SHARE,
    line_most: int = LINE_MOST,
    least_words: int = LEAST_WORDS,
    left_share: float = LEFT_SHARE,
) -> DataFrame:
    """The rows of ``df`` that are kept, with their columns; the lines above the limits are removed from their texts, and
    ``chars_column``, if there, then counts the code points that are left."""
    names = [f"c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    rows, gone = with_lines(df.toDF(*names), at[id_column], at[text_column], at[host_column], line_documents, line_share, line_most)
    text_name, host_name, chars_name = at[text_column], at[host_column], at.get(chars_column)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_name, limit=2_000_000):
            found, left = judge_batch(batch, text_name, host_name, gone.value, least_words, left_share)
            changed = [n > 0 for n in found["n_removed_words"]]
            columns = {n: batch.column(n) for n in names}
            if any(changed):
                columns[text_name] = pa.array([new if c else old for c, new, old in zip(changed, left, columns[text_name].to_pylist(), strict=True)], columns[text_name].type)
                if chars_name:
                    columns[chars_name] = pa.array([len(new) if c else old for c, new, old in zip(changed, left, columns[chars_name].to_pylist(), strict=True)], columns[chars_name].type)
            yield pa.RecordBatch.from_pydict(columns).filter(pa.array(found["kept"]))

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema, strict=True)])
    return rows.mapInArrow(emit, schema).toDF(*df.columns)
