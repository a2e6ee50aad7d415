import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
EXTRA = ("h1 long, h2 string, chunk int, bucket string, size string, rank string, copies int, node string, u string, label string, "
         "least int, body string, _key string, _q_n_words string, _mix_copy string, k string")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + ("." if r.random() < 0.1 else "") for _ in range(n))


def odd_texts():
    """Nulls, empties, copies, near copies, shared passages, ties, long and non-ASCII texts."""
    base, other, shared = prose(1, 220), prose(2, 180), prose(3, 60)
    edited = base.split(" ")
    edited[100] = "changed"
    lines = "\n".join(prose(40 + i, 12) for i in range(8))
    r = [(1, base), (2, other), (3, base), (4, " ".join(edited)), (5, None), (6, ""), (7, "  \n\t "), (8, "one two three"),
         (9, "one  two\nthree"), (10, prose(4, 30) + " " + shared + " " + prose(5, 30)),
         (11, prose(6, 40) + "\n" + shared + "\n" + prose(7, 10)), (12, "ab " * 300), (13, "äöü ß " * 60), (14, lines),
         (15, prose(8, 20) + "\n" + "\n".join(lines.split("\n")[2:6]) + "\n\n" + prose(9, 20)), (16, base.upper()), (None, base),
         (None, None), (17, other + " " + other), (1, base), (18, prose(10, 9000)), (19, "x" * 5000), (20, "😀 " * 40 + shared),
         (-3, prose(11, 50) + " " + shared), (21, "one two three")]
    return r


@pytest.fixture(scope="session")
def odd_rows():
    return odd_texts()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    n = len(EXTRA.split(","))
    rows = [(d, t, ("en", "de", None)[i % 3], ("a", "a", "b", None)[i % 4], None if t is None else len(t)) + (None,) * n
            for i, (d, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, SCHEMA + ", " + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
