import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, raw int, k int, fp int, rep int, node int, component string, row int, b int, score int, n_words string"


@pytest.fixture(scope="session")
def make_docs():
    """Documents from (doc_id, text[, lang]); further columns have names that the operators use inside."""

    def make(spark, rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), *["x", 1, 2, 3, 4, 5, "y", 6, 7, 8, "z"]) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def sentences(seed, n, words=40, stock=400):
    rng = np.random.default_rng(seed)
    known = ["".join(rng.choice(list("abcdeéß"), size=rng.integers(2, 7))) for _ in range(stock)]
    return [" ".join(rng.choice(known, size=rng.integers(1, words))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, one very long, repeated rows, ties, copies and shared passages."""
    base = sentences(5, 30)
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "?! 12"), (104, "A"), (None, base[3]), (None, None), (None, passage)]
    rows += [(110, base[3]), (111, base[3].upper()), (112, base[4] + " " + passage), (113, passage + "\n" + base[5]), (114, passage), (115, passage)]
    rows += [(116, base[7]), (116, base[7]), (117, " ".join(base * 120)), (118, "Σίσυφος İstanbul 中文 😀 don't <|endoftext|> x"), (-5, passage + " end"), (119, "the the the the " * 30)]
    return rows
