"""Language ID: a linear-chain conditional random field labels the words of code-switched text.

A word's features are its prefixes and suffixes, the letter pairs and triples inside it, the word itself and, for each
language, whether the language's lexicon has it; all are hashed into one table of weights. Transitions between the
languages of neighbouring words are learned with them. Training maximises the likelihood of label sequences that are
spliced from texts of several languages, its gradient by the forward-backward pass. The same pass gives each word its
chance of each language; a text's language is the one with the largest mean chance.

The model learns from a bounded sample: at most ``rows_per_language`` labelled texts of each language, taken whole, in
the order of a hash of their id. Everything else runs on all rows in one scan; workers keep the scores of words they
have seen, and a long text costs time in proportion to its words.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing is labelled;
a null id is neither held out nor learned from; ties go to the language first in order; rows that repeat are labelled
each; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.llm.common import columns_of, slices, words_of
from loomwork.session import ship

UNDETERMINED = "und"
#: Labelled texts of each language that the model learns from, at most.
ROWS_PER_LANGUAGE = 250
#: Weights of the table, a power of two; words of each language's lexicon.
TABLE = 1 << 16
LEXICON_WORDS = 3_000
#: Training: words of a sequence, words until a sequence may switch, the chance that it does, rounds, step, decay.
SEQUENCE = 64
SEGMENT = 16
SWITCH = 0.25
ROUNDS = 25
STEP = 0.3
DECAY = 1e-3
#: Letters (an even number) from which a word is scored piece by piece; lexicons have no such words.
LONG_WORD = 4_096
#: Words that a worker keeps scores of before it starts anew.
CACHE_WORDS = 600_000


def letters_of(word: bytes) -> str:
    """The word lower-cased without what stands before its first and after its last letter; empty without a letter."""
    text = word.decode().lower()
    if text.isalpha():
        return text
    first = next((i for i, c in enumerate(text) if c.isalpha()), len(text))
    last = next((i for i in range(len(text) - 1, first - 1, -1) if text[i].isalpha()), first - 1)
    return text[first : last + 1]


def features(word: str) -> list[int]:
    """Places in the table of a word's affix, identity and n-gram features, before lexicons.

    Letters are cut as the two bytes of UTF-16; each sort of feature starts its checksum from a number of its own.
    """
    framed = f"^{word}$".encode("utf-16-le")
    inner, crc = framed[2:-2], zlib.crc32
    found = [crc(inner, 7)]
    found += [crc(inner[:k], 1) for k in (2, 4, 6)[: len(inner) // 2]]
    found += [crc(inner[-k:], 2) for k in (2, 4, 6)[: len(inner) // 2]]
    found += [crc(framed[i : i + 4], 3) for i in range(0, len(framed) - 3, 2)]
    found += [crc(framed[i : i + 6], 4) for i in range(0, len(framed) - 5, 2)]
    return [f % TABLE for f in found]


def lexicon_place(language: int) -> int:
    return TABLE + language


class Field:
    """The trained model: languages, lexicons, weights (features by languages), transitions and first chances."""

    def __init__(self, languages: list[str], lexicons: list[set[str]], weights: np.ndarray, transitions: np.ndarray, first: np.ndarray):
        self.languages, self.lexicons, self.weights, self.transitions, self.first = languages, lexicons, weights, transitions, first

    def places(self, word: str) -> list[int]:
        return features(word) + [lexicon_place(i) for i, lexicon in enumerate(self.lexicons) if word in lexicon]

    def long_scores(self, word: str) -> np.ndarray:
        """The same as scores() of one word, piece by piece, so that memory doesn't grow with it."""
        framed, crc = f"^{word}$".encode("utf-16-le"), zlib.crc32
        inner = framed[2:-2]
        total = self.weights[[f % TABLE for f in (crc(inner, 7), *(crc(inner[:k], 1) for k in (2, 4, 6)), *(crc(inner[-k:], 2) for k in (2, 4, 6)))]].sum(axis=0)
        for size, kind in ((4, 3), (6, 4)):
            for s in range(0, len(framed) - size + 1, LONG_WORD):
                total += self.weights[[crc(framed[i : i + size], kind) % TABLE for i in range(s, min(s + LONG_WORD, len(framed) - size + 1), 2)]].sum(axis=0)
        return total

    def scores(self, words: list[str]) -> np.ndarray:
        """The languages' scores of each word."""
        if any(len(w) > LONG_WORD for w in words):
            out = np.empty((len(words), len(self.languages)))
            short = np.array([len(w) <= LONG_WORD for w in words])
            out[short] = self.scores([w for w in words if len(w) <= LONG_WORD])
            out[~short] = [self.long_scores(w) for w in words if len(w) > LONG_WORD]
            return out
        places = [self.places(w) for w in words]
        if not words:
            return np.zeros((0, len(self.languages)))
        flat = np.fromiter((p for word in places for p in word), np.int64)
        starts = np.cumsum([0] + [len(p) for p in places[:-1]])
        return np.add.reduceat(self.weights[flat], starts, axis=0)


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, first: np.ndarray, pairs: bool = False):
    """The chance of each language for each word of texts that stand one after the other, all texts in step.

    With ``pairs`` also the expected number of each transition.
    """
    heads = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    heads, lengths = heads[order], sizes[order]
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    move, begin = np.exp(transitions), np.exp(first)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    ahead = np.empty_like(emit)
    for t in range(steps):
        at = heads[: active[t]] + t
        now = emit[at] * (ahead[at - 1] @ move if t else begin)
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    back = np.ones_like(emit)
    expected = np.zeros_like(move)
    for t in range(steps - 2, -1, -1):
        at = heads[: active[t + 1]] + t
        after = emit[at + 1] * back[at + 1]
        if pairs:
            joint = ahead[at][:, :, None] * move[None] * after[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        now = after @ move.T
        back[at] = now / now.sum(axis=1, keepdims=True)
    chances = ahead * back
    chances /= chances.sum(axis=1, keepdims=True)
    return (chances, expected) if pairs else chances


def spliced(texts: list[list[int]], labels: list[int], seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training sequences (word, label, size): segments of the texts in turn, some followed by another text's segment."""
    random = np.random.default_rng(seed)
    pieces = [(text[i : i + SEGMENT], label) for text, label in zip(texts, labels, strict=True) for i in range(0, len(text), SEGMENT)]
    words, tags, sizes, size = [], [], [], 0
    for at in range(len(pieces)):
        piece, label = pieces[at]
        if random.random() < SWITCH:
            piece, label = pieces[int(random.integers(len(pieces)))]
        words += piece
        tags += [label] * len(piece)
        size += len(piece)
        if size >= SEQUENCE or at == len(pieces) - 1:
            sizes.append(size)
            size = 0
    return np.array(words, np.int64), np.array(tags, np.int64), np.array(sizes, np.int64)


def train(rows: list[tuple[str, str]]) -> Field | None:
    """The field learned from (text, language) rows; None without any word."""
    languages = sorted({lang for _, lang in rows})
    known: dict[str, int] = {}
    texts, labels, counts = [], [], [Counter() for _ in languages]
    for text, lang in rows:
        words = [w for w in map(letters_of, words_of(text)) if w]
        words = [w for w in words if len(w) <= LONG_WORD]
        if words:
            texts.append([known.setdefault(w, len(known)) for w in words])
            labels.append(languages.index(lang))
            counts[labels[-1]].update(words)
    if not texts:
        return None
    lexicons = [{w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON_WORDS] if len(w) <= LONG_WORD} for c in counts]
    n = len(languages)
    field = Field(languages, lexicons, np.zeros((TABLE + n, n)), np.zeros((n, n)), np.zeros(n))
    places = [field.places(w) for w in known]
    flat, of = np.fromiter((p for word in places for p in word), np.int64), np.repeat(np.arange(len(places)), [len(p) for p in places])
    starts = np.cumsum([0] + [len(p) for p in places[:-1]])
    words, tags, sizes = spliced(texts, labels)
    heads = np.cumsum(sizes) - sizes
    inner = np.ones(len(words), bool)
    inner[heads] = False
    seen = np.zeros((n, n))
    np.add.at(seen, (tags[:-1][inner[1:]], tags[1:][inner[1:]]), 1)
    began = np.bincount(tags[heads], minlength=n)

    squares = [np.full_like(x, 1e-8) for x in (field.weights, field.transitions, field.first)]
    for _ in range(ROUNDS):
        scores = np.add.reduceat(field.weights[flat], starts, axis=0)[words]
        chances, expected = forward_backward(scores, sizes, field.transitions, field.first, pairs=True)
        start_error = began - chances[heads].sum(axis=0)
        chances[np.arange(len(words)), tags] -= 1
        by_word = np.stack([np.bincount(words, weights=-chances[:, k], minlength=len(places)) for k in range(n)], axis=1)
        by_place = np.stack([np.bincount(flat, weights=by_word[of, k], minlength=len(field.weights)) for k in range(n)], axis=1)
        steps = (by_place - DECAY * field.weights, seen - expected, start_error)
        for values, square, step in zip((field.weights, field.transitions, field.first), squares, steps, strict=True):
            square += step * step
            values += STEP * step / np.sqrt(square)
    return field


class Labeller:
    """A field with the scores of the words that this worker has seen."""

    def __init__(self, field: Field):
        self.field = field
        self.reset()

    def reset(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.scores = np.zeros((1024, len(self.field.languages)))
        self.used = 0

    def learn(self, words: list[bytes]) -> None:
        named = {w: letters_of(w) for w in words}
        new = [w for w, n in named.items() if n]
        scores = self.field.scores([named[w] for w in new])
        while self.used + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[self.used : self.used + len(new)] = scores
        self.ids.update((w, -1) for w, n in named.items() if not n)
        self.ids.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def chances(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of all words with letters, the number of such words of each document, and which words they are."""
        missing = set().union(*documents) - self.ids.keys()
        if len(self.ids) + len(missing) > CACHE_WORDS:
            self.reset()
            missing = set().union(*documents)
        self.learn(list(missing))
        lengths = np.array([len(d) for d in documents], np.int64)
        ids = np.fromiter((i for d in documents for i in map(self.ids.__getitem__, d)), np.int64, int(lengths.sum()))
        lettered = ids >= 0
        sizes = np.bincount(np.repeat(np.arange(len(documents)), lengths)[lettered], minlength=len(documents))
        return forward_backward(self.scores[ids[lettered]], sizes, self.field.transitions, self.field.first), sizes, lettered


_workers: dict[str, Labeller] = {}


def emit_labels(key: str, field, spans: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _workers:
            _workers.clear()
            _workers[key] = Labeller(field.value)
        labeller, languages = _workers[key], field.value.languages
        for batch in slices(batches, limit=8_000_000):
            documents = [words_of(t) for t in batch.column("text").to_pylist()]
            chances, sizes, lettered = labeller.chances(documents)
            ends = np.concatenate([np.zeros((1, len(languages))), np.cumsum(chances, axis=0)])
            stop = np.cumsum(sizes)
            means = (ends[stop] - ends[stop - sizes]) / np.maximum(sizes, 1)[:, None]
            best = np.where(sizes > 0, np.round(means, 12).argmax(axis=1), -1)
            score = np.where(sizes > 0, means.max(axis=1), 0.0).clip(0, 1)
            columns = {"id": batch.column("id"), "lang_pred": pa.array([languages[b] if b >= 0 else UNDETERMINED for b in best], pa.string()), "score": pa.array(score)}
            if spans:
                columns["spans"] = pa.array(word_spans(documents, chances, lettered, languages), pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_pydict(columns)

    return emit


def word_spans(documents, chances: np.ndarray, lettered: np.ndarray, languages: list[str]) -> list[list[dict]]:
    """Runs of words of one language; a word without a letter goes with the run before it."""
    tags = np.full(len(lettered), -1)
    tags[lettered] = chances.argmax(axis=1)
    found, at = [], 0
    for words in documents:
        runs: list[dict] = []
        for i, tag in enumerate(tags[at : at + len(words)].tolist()):
            if runs and (tag < 0 or runs[-1]["lang"] == languages[tag]):
                runs[-1]["words"] += 1
            elif tag >= 0:
                runs.append({"start": i, "words": 1, "lang": languages[tag]})
        found.append(runs)
        at += len(words)
    return found


def held_out(id_: Column) -> Column:
    """Whether the id's remainder is 2: such rows are never learned from."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def training_rows(df: DataFrame, id_column: str, text_column: str, lang_column: str, rows_per_language: int) -> list[tuple[str, str]]:
    """At most so many labelled texts of each language; their ids are chosen before any text is read."""
    rows = columns_of(df, id=id_column, text=text_column, lang=lang_column).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows_per_language).select("id", "lang").distinct()
    taken = rows.join(F.broadcast(chosen), ["id", "lang"], "left_semi").select("id", "text", "lang").distinct().collect()
    return [(r.text, r.lang) for r in sorted(taken, key=lambda r: (r.id, r.lang, r.text))]


def identify_languages(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    spans: bool = True,
) -> DataFrame:
    """Per row: its id, held_out, lang_pred, score and, on demand, spans of words (start, words, lang)."""
    spark = df.sparkSession
    ship(spark)
    field = train(training_rows(df, id_column, text_column, lang_column, rows_per_language))
    rows = columns_of(df, id=id_column, text=text_column)
    extra = ", spans array<struct<start: bigint, words: bigint, lang: string>>" if spans else ""
    if field is None:
        named = rows.select("id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), *([F.expr("cast(array() as array<struct<start: bigint, words: bigint, lang: string>>) AS spans")] if spans else []))
    else:
        named = rows.mapInArrow(emit_labels(uuid.uuid4().hex, spark.sparkContext.broadcast(field), spans), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double{extra}")
    return named.select(F.col("id").alias(id_column), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", *(["spans"] if spans else []))
