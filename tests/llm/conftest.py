import random

import pytest

WORDS = "the of and thesh onder inble reaton stour ering handle weath mones tillow parch gendal soft river motion candle herring open field table seven lantern".split()
EXTRA = {"lang": "en", "source": "s", "n_chars": 1, "row": 7, "fp": 1, "drops": "x", "spans": "y", "w": "z", "score": 0.5, "kh": 3, "items": "i", "doc": 9, "key": "k", "n": 4}


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) + r.choice(["", "", "ly", "er", str(r.randint(0, 9))]) for _ in range(n)]
    return " ".join(w + ("\n" if k % 17 == 16 else "") for k, w in enumerate(out))


def edge_rows() -> list[tuple]:
    """Null and empty texts, a null id, repeated rows, copies, ties, a very long text, odd characters."""
    long = prose(1, 6000)
    return [
        (None, prose(2, 80)), (1, None), (2, ""), (3, " \n\t \n"), (4, prose(3, 120)), (5, prose(3, 120)), (6, prose(3, 120)), (6, prose(3, 120)),
        (7, long), (8, prose(4, 400) + "\n" + long[500:2500] + "\n" + prose(5, 60)), (9, "é" * 500 + prose(6, 90) + "ß \x00\x85 İ Σς"), (10, "a"), (11, "aaaa " * 300),
        (12, prose(4, 400)), (13, prose(4, 399) + " other"), (14, "\n".join(["Shared license line, all rights", "x", " shared LICENSE line, all rights\t"] * 3)), (15, "Shared license line, all rights"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    """Rows as a sorted list of tuples."""
    got = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(got, key=lambda x: tuple((v is None, str(type(v)), v) for v in x))
