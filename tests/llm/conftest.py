"""Documents with every awkward case: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF_SMALL = "/root/testdata/sf0.001"


def words(rng: random.Random, n: int, alphabet: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def awkward() -> list[tuple]:
    rng = random.Random(11)
    line = lambda n: words(rng, n)
    shared = "\n".join(line(9) for _ in range(5))
    passage = line(70)
    out: list[tuple] = []
    for k in range(40):
        text = "\n".join(line(rng.randrange(3, 12)) for _ in range(rng.randrange(1, 9)))
        if k % 4 == 0:
            text = f"{text}\n{shared}\n{line(6)}"
        if k % 5 == 0:
            text = f"{line(4)} {passage} {line(4)}\n{text}"
        out.append((k, text, ["en", "de", None][k % 3], f"src{k % 3}", len(text)))
    out += [
        (100, None, "en", "src0", 0),
        (101, "", "en", None, 0),
        (102, "   \n\n\t ", None, "src0", 7),
        (103, out[3][1], "en", "src1", 1),
        (103, out[3][1], "en", "src1", 1),
        (104, out[4][1] + " ", "en", "src1", 1),
        (105, "same line here again and again\n" * 40, "en", "src2", 1),
        (106, "ab" * 20_000, "de", "src2", 1),
        (107, words(rng, 6_000), "de", "src2", 1),
        (108, "Ünïcödé wörds ▁ 中文 😀 é ́ Σ\x1c x\r\n" * 3, "fr", "src2", 1),
        (None, out[5][1], "en", "src0", 1),
        (None, "a null id\nwith two lines", "en", "src0", 1),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(docs):
    """The documents with columns whose names the operators might use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(7).alias(c) for c in ("key", "row", "_row", "_doc", "_text", "fp", "id", "bits", "ids", "_p", "_tokens", "removed", "unit", "hi", "with.dot")))


def as_given(out, names) -> bool:
    """Whether the columns are those, and the made-up ones hold what they held."""
    extra = [c for c in names if c not in ("doc_id", "text", "lang", "source", "n_chars", "removed")]
    return out.columns == names and all(v == 7 for r in out.select(*(f"`{c}`" for c in extra)).collect() for v in r)


def by_id(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
