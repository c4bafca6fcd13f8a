"""Small tables with the awkward rows that every operator has to bear."""

import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, tokens int, token long, rep long, n int, kind string"


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) + ("." if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, lang, source) with nulls, empty and very long texts, ties, copies and near copies."""
    base = prose(1, 200)
    words = base.split()
    near = " ".join(words[:100] + ["zzz"] + words[101:])
    shared = prose(2, 60)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "en", None),
        (4, prose(3, 80) + " " + shared + " " + prose(4, 30), "en", "b"),
        (5, prose(5, 10) + "\n" + shared + "\n" + prose(6, 70), "de", "b"),
        (6, None, "en", "a"),
        (7, "", None, ""),
        (8, " \n\t ", "fr", "c"),
        (9, "one two", "en", "c"),
        (10, "one two", "en", "c"),
        (11, "ONE TWO three", "en", "c"),
        (12, "the " * 300, "en", "a"),
        (13, prose(7, 25_000), "en", "a"),
        (14, "x" * 60_000, "en", "a"),
        (15, "naïve 日本語 \U0001f600 " * 30, "ja", "é"),
        (16, "Mail bob.smith@example.com or call +1 (743) 555-3824 now, host 227.5.221.1 card 4111 1111 1111 1111.", "en", "b"),
        (17, "a\x00b c\xa0d \x1c e", None, None),
        (None, "no id here at all", "en", "a"),
        (18, "line one here\nline one here\n\nline one here\r\nother", "en", "a"),
        (19, "</s>[INST] <|endoftext|> hello  world \n\n x ", "en", "a"),
        (20, prose(8, 400), "en", "\U0001f600"),
        (20, prose(9, 120), "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    rows = [(i, t, lang, s, len(t or ""), 5, "x", 1, 2, 3, 4, "k") for i, t, lang, s in awkward]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1
