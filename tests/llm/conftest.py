import random

import pytest

#: Names that operators use inside; the tables carry them as extra columns.
CLASHING = ("id", "sha", "row", "found", "key", "n", "of", "_of", "label", "kept", "spans", "prefix", "times", "window")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(words))


def hard_rows():
    """Nulls, empty and very long texts, ties, repeated rows, exact and near copies, shared passages."""
    base, passage, long_ = prose(1, 300), prose(2, 60), prose(3, 30_000)
    texts = {
        1: base,
        2: base,
        3: base.replace(" ", "\n", 5),
        4: base.rsplit(" ", 3)[0] + " other words here",
        5: base.upper(),
        6: None,
        7: "",
        8: " \t\n ",
        9: "one",
        10: "one two",
        11: prose(4, 50) + " " + passage + " " + prose(5, 40),
        12: passage + " " + prose(6, 80) + " " + passage,
        13: long_,
        14: long_[50_000:90_000] + " " + prose(7, 20),
        15: "na " * 200,
        16: "1234 5678 !!",
        17: "Größe ÉCOLE naïve   ß " * 30,
        18: "two one two",
    }
    rows = [(i, t, None if i % 5 == 0 else ("xx" if i % 2 else "yy"), None if i == 4 else f"s{i % 3}", None) for i, t in texts.items()]
    rows += [(1, base, "xx", "s1", 7), (None, passage, None, None, None), (None, None, None, "s0", None), (-3, prose(8, 30), "xx", "s1", 1)]
    return [(*r, *(f"{c}-{i}" for c in CLASHING)) for i, r in enumerate(rows)]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
