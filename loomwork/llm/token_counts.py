"""Token counts by a map-side two-tier lookup of pre-token lengths.

A tokenizer with byte-level pre-tokens encodes every pre-token by itself, and a pre-token never reaches over a single
space between two words: it starts there. So a text's count is the sum over its space-led words. Tier one is a compact
table of the token lengths of the most frequent words of all rows, broadcast to all workers. Tier two is each worker's own
cache: a word in neither is encoded once, by ranks from the same file, and kept.

The frequencies are exact: a first pass counts the words of all texts, added up in each task and then by partitions of
words, so that a hot word is one row from each flush of a task. Only words and their counts are shuffled, texts never.
Words over ENTRY_CHARS are not in the table, so that its size is bounded, and go to tier two. The table only saves time:
token counts are the same with any table.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text are single tokens, the
library's default; a text with a character that Unicode tables of different age classify differently is encoded whole
by the library. Rows that repeat are counted each; column names beyond the two that are read don't matter.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import columns_of, slices
from loomwork.session import checkpointed, ship

#: Fixed value: how byte-level pre-tokenizers split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER_SPACE = re.compile(r"[^\S \n]")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")

#: Entries of the broadcast table.
FREQUENT_ENTRIES = 65_536
#: Characters of the longest word that the table can hold, which bounds its bytes; longer ones are left to tier two.
ENTRY_CHARS = 64
#: Words that a task counts before it sends their counts on.
PARTIAL_WORDS = 200_000
#: Entries of a worker's cache before it falls back to the broadcast table.
CACHE_ENTRIES = 1_000_000

_workers: dict = {}


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def parts(text: str, special: list[str]) -> list[str]:
    """What is between the special strings of a text, each of which is a token."""
    return re.split("|".join(map(re.escape, special)), text) if any(s in text for s in special) else [text]


def cut(text: str) -> list[str]:
    """The text cut before each single space between words; pre-tokens never reach over such a cut."""
    if "  " in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text):
        return SINGLE_SPACE.split(text)
    return text.split(" ")


class PretokenLengths:
    """The two tiers inside one Python worker; keys are words without the space that leads them."""

    def __init__(self, tokenizer_json: str, frequent: dict[str, int]):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE without a normalizer splits into independent pre-tokens")
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): rank for token, rank in model["vocab"].items()}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.encode = tiktoken.Encoding("pretokens", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.frequent = frequent
        self.known = dict(frequent)

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        counts = []
        for text in texts:
            if not text:
                counts.append(0)
            else:
                found = parts(text, self.special)
                counts.append(sum(map(self.count_one, found)) + len(found) - 1)
        return counts

    def count_one(self, text: str) -> int:
        first, *words = cut(text)
        found = list(map(self.known.get, words))
        total = len(self.encode(first)) if first.isascii() or assigned(first) else None
        if None in found:
            for at, word in enumerate(words):
                if found[at] is None:
                    if not (word.isascii() or assigned(word)):
                        total = None
                        break
                    if len(self.known) >= CACHE_ENTRIES:
                        self.known = dict(self.frequent)
                    found[at] = self.known[word] = len(self.encode(" " + word))
        if total is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        return total + sum(found)


def assigned(text: str) -> bool:
    """Whether all characters are old enough for every library to classify them alike."""
    return not any(unicodedata.category(c) == "Cn" for c in text)


def _worker(key: str, tokenizer_json, frequent) -> PretokenLengths:
    """The tables of this worker process, kept from task to task under the query's key."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = PretokenLengths(tokenizer_json.value, frequent.value)
    return _workers[key]


def word_counts(batches: Iterator[pa.RecordBatch], special: list[str], most: int = PARTIAL_WORDS) -> Iterator[pa.RecordBatch]:
    """The space-led words that the table can hold, as count_one() looks them up, with counts to be added up."""
    seen: Counter = Counter()

    def counted() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            for part in parts(text or "", special):
                seen.update([w for w in cut(part)[1:] if len(w) <= ENTRY_CHARS])
        if len(seen) >= most:
            yield counted()
            seen.clear()
    yield counted()


def frequent_words(df: DataFrame, text_column: str, special: list[str], entries: int) -> list[str]:
    """The ``entries`` most frequent space-led words of all rows, of those that the table can hold and that are found twice
    or more: it saves nothing for the others. Which of equally frequent ones come last is left open."""
    rows = columns_of(df, text=text_column)
    counts = rows.mapInArrow(lambda batches: word_counts(batches, special), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts.filter("n > 1"))
    # k frequencies that differ add up to k * k / 2 words or more, so the driver gets few.
    room, tied = entries, 0
    for n, words in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):
        if words > room:
            tied = n
            break
        room -= words
    found = counts.filter(F.col("n") > tied).collect()
    if tied and room:
        found += counts.filter(F.col("n") == tied).limit(room).collect()
    return [r.word for r in found]


def count_tokens(
    df: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 1024,
    frequent_entries: int = FREQUENT_ENTRIES,
) -> DataFrame:
    """Per row: its id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens)."""
    spark = df.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    tables = PretokenLengths(text, {})
    words = [w for w in frequent_words(df, text_column, tables.special, frequent_entries) if assigned(w)]
    lengths = {w: len(tables.encode(" " + w)) for w in words}
    key = uuid.uuid4().hex
    tokenizer_json, frequent = spark.sparkContext.broadcast(text), spark.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _worker(key, tokenizer_json, frequent)
        for batch in slices(batches):
            texts = batch.column("text")
            n_tokens = pa.array(tables.count(texts.to_pylist()), pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n_bytes, n_tokens, pc.greater(n_tokens, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = columns_of(df, id=id_column, text=text_column)
    counted = rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return counted.withColumnRenamed("id", id_column)
