"""Small tables with every awkward row: nulls, empty and long texts, repeats, ties, and columns with clashing names."""

import random

import pytest

WORDS = "the of and river stone light amber walking quiet forest under seven copper bridge letters morning window garden silver thread".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """(doc_id, text, lang, source, n_chars, and columns that operators name their own): 40 rows."""
    shared = prose(99, 60)
    texts = [prose(k, 40 + k) for k in range(12)]
    texts += [texts[0], texts[0], texts[1] + " extra", texts[2].replace("river", "lake", 1)]
    texts += [f"{prose(20, 30)} {shared} {prose(21, 30)}", f"{prose(22, 20)} {shared}", shared, shared[: len(shared) // 2]]
    texts += [None, None, "", "", " \t\n ", "word", "Word", "!!!", "a " * 300, "x" * 5000, "é中文 \U0001f642 \u0000 \x1c y", prose(7, 4000)]
    texts += [prose(50, 9), prose(51, 10), prose(52, 34), prose(53, 35), prose(54, 36), "ab" * 99, "ab" * 100, "ab" * 101]
    rows = [(k, t, "en" if k % 3 else None, "s", len(t or ""), 1, 2.0, "z", [1]) for k, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, prose(3, 43), "en", "s", 1, 1, 2.0, "z", [1]))  # a null id
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, score double, h string, wanted array<int>")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
