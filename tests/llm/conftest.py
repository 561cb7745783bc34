import random

import duckdb
import pytest

SOURCES = ["src0", "src1", "b", None]
EXTRA = ["id", "row", "key", "hash", "size", "host", "label", "text_row", "spans", "vertex", "edges", "low", "n", "units", "draws", "block", "item", "length"]


def words(rng, n, vocabulary=400, prefix="w"):
    return [f"{prefix}{int(rng.paretovariate(0.9)) % vocabulary}" for _ in range(n)]


def corpus(seed=3, n=120):
    """Random texts with copies, near copies, shared passages and lines, and odd ones."""
    rng = random.Random(seed)
    passage, line = " ".join(words(rng, 70, 5000, "p")), "a line that very many documents of all sources have"
    texts = []
    for i in range(n):
        body = words(rng, rng.choice([3, 30, 60, 120, 250]), 3000)
        if i % 9 == 4:
            at = rng.randrange(len(body))
            body[at:at] = passage.split()[rng.randrange(15) :]
        text = " ".join(body[: len(body) // 2]) + "\n" + " ".join(body[len(body) // 2 :])
        if i % 2:
            text += "\n" + line
        texts.append(text)
    for i in range(0, 24, 2):
        base = texts[i + 30].split(" ")
        if len(base) > 40:
            for edits in (1, 2, 4):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
                texts.append(" ".join(copy))
        texts.append(texts[i + 30])
        texts.append(texts[i + 30].upper().replace("\n", " \t "))
    texts += [None, "", " \n\t ", "one", "One", "one two three four", "ONE  two three\nfour", "x " * 3000, "é ü ß " * 40, "a #*$%&|<> b", "\n\n same \nsame\n same \n", "#### " * 30, "1 2 3"]
    texts += [" ".join(words(rng, 6000, 50_000, "long"))]
    return [(i * 3 + 1, t, ["en", "fr", None][i % 3], SOURCES[0] if i % 3 == 0 else SOURCES[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]


def items(rows):
    taken = [t.replace("\n", " ").split(" ") for _, t, *_ in rows if t and len(t.split()) > 100]
    found = [" ".join(t[5 : 5 + n]) for t, n in zip(taken, (20, 33, 50, 16, 12), strict=False)]
    return [*enumerate(found), (100, None), (101, ""), (102, "w1 w2"), (103, "nothing of this is anywhere at all in the corpus"), (104, found[0].upper() + "!"), (105, "one two three")]


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def with_extra(df):
    """Columns whose names operators use inside, to clash."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    """documents, benchmark, labels and pages as Parquet."""
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(items(rows), "item_id bigint, text string").write.parquet(str(root / "benchmark.parquet"))
    spark.createDataFrame([(r[0], int(r[0] % 5 > 0), int(r[0] % 7 == 0)) for r in rows if r[0] % 2], "doc_id bigint, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


@pytest.fixture(scope="session")
def duck(folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return con


def plain(found):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in found)


@pytest.fixture(scope="session")
def agrees(duck):
    """Whether a DataFrame has the rows of a DuckDB query."""

    def check(df, sql):
        columns = sorted(df.columns)
        mine = plain(map(tuple, df.select(*columns).collect()))
        assert mine == plain(duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
        return mine

    return check
