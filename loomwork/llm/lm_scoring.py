"""LM scoring: the cross-entropy difference of two matched n-gram models.

A target model learns from the documents with a target id, a background model from all others. Both count all words and
all pairs of neighbouring words of the whole corpus exactly, so that what they know grows with the input, and share one
vocabulary, every word of it. They are matched in size: the counts of the larger model are scaled to the words of the
smaller one, which is what a sample of that size would hold on average, without dropping a text. The chance of a word
after another is (c(v, w) + m p(w)) / (c(v) + m), p(w) = (c(w) + m q(w)) / (n + m), with c and n of the model and q(w)
the share of w in the whole corpus; a text starts after a sign of its own. A document's score is its mean loss per
token under the target model less that under the background model; the lower, the more it reads like the target.

Texts are cut into batches as they are read. A batch deals the hashes of its distinct words and pairs, with how often it
has them, to partitions by hash; a partition adds up the batches and sends each batch the sums for its own keys, in
its own order. These meet the batch's words (three bytes each), cut the same way from a second scan, and its documents
are scored. No model stands in one place, and nothing but totals comes to the driver. A hot word or pair is one key of
each batch. Batches are known by scan partition and place in it, with a checksum that fails the job if the scans ever
differ. Texts are only shuffled, and then written once for both scans, where there are too many targets for a broadcast.

Keys are compared by 40 bits inside a partition: about one of its million keys meets another by chance.

Defined cases: a null or wordless text has 0 tokens and null losses; null ids are background alone; an id that repeats
among the targets counts once; without target documents, or with nothing else, the model without texts has q(w) for
all words; rows that repeat are counted and scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import WORD, columns_of, slices
from loomwork.llm.ngram_join import KEY_BITS, pack, runs, unpack
from loomwork.llm.substring_dedup import mixed
from loomwork.session import ship, stored

#: Weight of the chance that a count is smoothed by.
SMOOTHING = 10.0
#: Text bytes of a batch, which bounds a worker's memory; and those whose words and pairs one partition adds up.
BATCH_BYTES = 5_000_000
PARTITION_BYTES = 16_000_000
LEAST_PARTITIONS = 64
#: Target ids up to which they are broadcast (about 40 bytes each).
BROADCAST_TARGETS = 1_000_000

_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: What stands before a text, as a word's hash.
_START = 0x51A7


def lowered(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def pack_counts(values: np.ndarray) -> bytes:
    """Two bytes of each count; those from 65,535 up follow in eight."""
    return np.minimum(values, 65_535).astype("<u2").tobytes() + values[values >= 65_535].astype("<i8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    values = np.frombuffer(blob, "<u2", n).astype(np.int64)
    values[values == 65_535] = np.frombuffer(blob, "<i8", offset=2 * n)
    return values


class Batch:
    """The words of some texts and the distinct keys of their words and pairs, in the order of partitions."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, partitions: int):
        """``ids``: the word of each token, by its place in ``hashes``, whose last entry stands before each text."""
        self.ids, self.sizes = ids, sizes
        self.start = len(hashes) - 1
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = self.start
        self.before = before
        pairs, self.pair = np.unique(before * len(hashes) + ids, return_inverse=True)
        keys = np.concatenate([mixed(hashes), mixed(hashes[pairs // len(hashes)] * _PAIR + hashes[pairs % len(hashes)] + np.uint64(1))])
        part = ((keys >> np.uint64(KEY_BITS)) % np.uint64(partitions)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")
        self.keys, self.part = keys[self.order] & np.uint64((1 << KEY_BITS) - 1), part[self.order]
        self.words = len(hashes)

    def counts(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """How often the batch has each key, or has it in the chosen tokens; the start counts once for each text."""
        ids, pair, before = (self.ids, self.pair, self.before) if chosen is None else (self.ids[chosen], self.pair[chosen], self.before[chosen])
        words = np.bincount(ids, minlength=self.words)
        words[self.start] += np.count_nonzero(before == self.start)
        return np.concatenate([words, np.bincount(pair, minlength=len(self.order) - self.words)])[self.order]


DEALT = "batch bigint, seal bigint, p int, at int, n int, keys binary, totals binary, targets binary"
ANSWER = "batch bigint, seal bigint, at int, n int, totals binary, targets binary"
#: A batch itself: its tokens of three bytes, the hashes of its words, ids and sizes of its texts.
HOME = "batch bigint, seal bigint, tokens binary, hashes binary, ids array<{}>, sizes binary"


def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """For each batch its name and seal, its rows, and the ids of its words, sizes of its texts and hashes of its words."""
    place = TaskContext.get().partitionId() << 32
    for number, given in enumerate(slices(batches, limit=BATCH_BYTES)):
        known: dict[bytes, int] = {}
        ids, sizes = [], []
        for text in given.column("text").to_pylist():
            words = lowered(text)
            sizes.append(len(words))
            ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        hashes = np.fromiter((*map(xxhash.xxh3_64_intdigest, known), _START), np.uint64, len(known) + 1)
        ids, sizes = np.concatenate(ids).astype(np.int64), np.array(sizes, np.int64)
        seal = xxhash.xxh3_64_intdigest(hashes.tobytes() + sizes.tobytes()) - (1 << 63)
        yield {"batch": place + number, "seal": seal}, given, ids, sizes, hashes


def emit_dealt(partitions: int, schema: pa.Schema):
    """A row of each batch for each partition: its keys there and how often all texts and the target ones have them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, given, ids, sizes, hashes in encoded(batches):
            batch = Batch(ids, sizes, hashes, partitions)
            target = np.repeat(given.column("target").to_numpy(zero_copy_only=False).astype(bool), sizes)
            totals, targets = batch.counts(), batch.counts(target)
            rows = [
                name | {"p": int(batch.part[s]), "at": s, "n": c, "keys": pack(batch.keys[s : s + c]), "totals": pack_counts(totals[s : s + c]), "targets": pack_counts(targets[s : s + c])}
                for s, c in zip(*(x.tolist() for x in runs(batch.part)), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return emit


def emit_homes(schema: pa.Schema):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, given, ids, sizes, hashes in encoded(batches):
            tokens = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
            home = {"tokens": tokens, "hashes": hashes.tobytes(), "ids": given.column("id").to_pylist(), "sizes": sizes.astype("<u4").tobytes()}
            yield pa.RecordBatch.from_pylist([name | home], schema=schema)

    return emit


def add_up(table: pa.Table) -> pa.Table:
    """The sums of one partition, for each batch in its own order."""
    sizes = table.column("n").to_pylist()
    keys = unpack(b"".join(table.column("keys").to_pylist()))
    _, key = np.unique(keys, return_inverse=True)
    out = {k: table.column(k) for k in ("batch", "seal", "at", "n")}
    ends = np.cumsum(sizes)
    for name in ("totals", "targets"):
        mine = np.concatenate([unpack_counts(b, n) for b, n in zip(table.column(name).to_pylist(), sizes, strict=True)])
        sums = np.bincount(key, weights=mine).astype(np.int64)[key]
        out[name] = pa.array([pack_counts(sums[e - n : e]) for e, n in zip(ends.tolist(), sizes, strict=True)], pa.binary())
    return pa.table(out)


def losses(batch: Batch, counts: np.ndarray, n: float, share: np.ndarray) -> np.ndarray:
    """-log p of each token by a model's counts of the batch's keys and the words' shares in the corpus."""
    found = np.empty(len(batch.order))
    found[batch.order] = counts
    words, pairs = found[: batch.words], found[batch.words :]
    chance = (words + SMOOTHING * share) / (n + SMOOTHING)
    return -np.log((pairs[batch.pair] + SMOOTHING * chance[batch.ids]) / (words[batch.before] + SMOOTHING))


def mean_by_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0.0], np.cumsum(values)])
    stop = np.cumsum(sizes)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (ends[stop] - ends[stop - sizes]) / sizes


def score_batch(partitions: int, n_tokens: int, n_target: int, kind: pa.DataType):
    """The scores of one batch's documents, from the batch and the sums of its keys."""
    n_other = n_tokens - n_target
    size = min(n_target, n_other) or max(n_target, n_other)
    scales = (size / n_target if n_target else 0.0, size / n_other if n_other else 0.0)

    def score(table: pa.Table) -> pa.Table:
        home = pc.is_valid(table.column("tokens"))
        found = table.filter(home).to_pylist()
        if len(found) != 1 or len(pc.unique(table.column("seal"))) != 1:
            raise RuntimeError("the scans of the texts differ")
        mine = found[0]
        narrow = np.frombuffer(mine["tokens"], np.uint8).reshape(-1, 3)
        wide = np.zeros((len(narrow), 4), np.uint8)
        wide[:, :3] = narrow
        sizes = np.frombuffer(mine["sizes"], "<u4").astype(np.int64)
        batch = Batch(wide.view("<u4").reshape(-1).astype(np.int64), sizes, np.frombuffer(mine["hashes"], np.uint64), partitions)
        sums = np.zeros((2, len(batch.order)), np.int64)
        known = 0
        for row in table.filter(pc.invert(home)).select(["at", "n", "totals", "targets"]).to_pylist():
            at = slice(row["at"], row["at"] + row["n"])
            sums[0, at], sums[1, at] = unpack_counts(row["totals"], row["n"]), unpack_counts(row["targets"], row["n"])
            known += row["n"]
        if known != len(batch.order):
            raise RuntimeError("the scans of the texts differ")
        share = np.empty(len(batch.order))
        share[batch.order] = sums[0] / max(1, n_tokens)
        share = share[: batch.words]
        models = [mean_by_text(losses(batch, c * s, size if s else 0, share), sizes) for c, s in zip((sums[1], sums[0] - sums[1]), scales, strict=True)]
        none = sizes == 0
        columns = {"id": pa.array(mine["ids"], kind), "n_tokens": pa.array(sizes)}
        for name, values in (("target_loss", models[0]), ("background_loss", models[1]), ("score", models[0] - models[1])):
            columns[name] = pa.array(values, pa.float64(), mask=none)
        return pa.table(columns)

    return score


def score_documents(df: DataFrame, targets: DataFrame, id_column: str = "doc_id", text_column: str = "text", target_column: str = "doc_id") -> DataFrame:
    """Per row: its id, n_tokens, target_loss, background_loss (nats per token) and score, their difference.

    ``targets`` holds the ids of the documents that the target model learns from.
    """
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    spark = df.sparkSession
    ship(spark)
    rows = columns_of(df, id=id_column, text=text_column)
    chosen = columns_of(targets, id=target_column).filter("id is not null").distinct().withColumn("target", F.lit(True))
    few = chosen.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
    told = rows.join(F.broadcast(chosen) if few else chosen, "id", "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    if not few:
        told = stored(told, "lm-scoring")
    words = F.regexp_count("text", F.lit(WORD)).cast("bigint")
    size = told.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(words).alias("n_tokens"), F.sum(F.when(F.col("target"), words)).alias("n_target")).first()
    partitions = max(LEAST_PARTITIONS, math.ceil((size.bytes or 0) / PARTITION_BYTES))

    def arrow(schema: str) -> pa.Schema:
        return to_arrow_schema(spark.createDataFrame([], schema).schema)

    id_type = rows.schema["id"].dataType
    home = HOME.format(id_type.simpleString())
    sums = told.mapInArrow(emit_dealt(partitions, arrow(DEALT)), DEALT).groupBy("p").applyInArrow(add_up, ANSWER)
    met = told.mapInArrow(emit_homes(arrow(home)), home).unionByName(sums, allowMissingColumns=True)
    score = score_batch(partitions, size.n_tokens or 0, size.n_target or 0, to_arrow_type(id_type))
    scored = met.groupBy("batch").applyInArrow(score, f"id {id_type.simpleString()}, n_tokens bigint, target_loss double, background_loss double, score double")
    return scored.withColumnRenamed("id", id_column)
