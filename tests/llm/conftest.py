import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, nulls, empties, odd characters and one long unsplit run."""
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta,", "epsilon.", "zeta", "été", "straße", "İ", "中文", "x1", "don't", "!!", "a"]
    out = [None, "", "   \n\t", "a", "A", "a b", "A  B", "\x1cx\x85y", "<|endoftext|> z", "The and The"]
    base = [" ".join(r.choices(words, k=r.randint(3, 60))) for _ in range(40)]
    out += base + base[:5] + [t.upper() for t in base[5:9]] + [t + " tail" for t in base[9:14]]
    out.append("".join(r.choices("abcdefgh", k=3000)) + " end")
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids (one null, one repeated row) and columns whose names clash with the operators' own."""
    rows = [(i, t, "en", None if i % 11 == 0 else f"src{i % 4}") for i, t in enumerate(texts)]
    rows += [rows[12], (None, "no id at all", "en", "src1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("digest", "key", "n", "file", "row", "fp", "doc", "score", "h", "s", "size", "kept", "ids", "id", "d", "_metadata"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
