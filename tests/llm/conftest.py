import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns whose names the operators use themselves
        T.StructField("key", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("kept", T.StringType()),
    ]
)

VOCAB = ["the", "of", "and", "Le", "für", "ñandú", "thntble", "ereawh", "x", "1984", "don't", "日本", "ab,", "q."]


def make_documents(seed=0, n=60):
    """Rows with nulls, empties, odd white space, copies, near copies, shared passages and one long text."""
    rng = random.Random(seed)
    words = lambda k: [rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(k)]
    texts = [None, "", " \n\t ", "one", "two words", "  padded\twith\x0bodd\x0cwhite\r\nspace ", "a b c", "A B c", "no-break space <|endoftext|> here"]
    passage, base = words(50), words(120)
    for k in range(n):
        kind = k % 6
        if kind == 0:
            texts.append(" ".join(words(rng.randrange(1, 90))))
        elif kind == 1:
            texts.append(" ".join(base))
        elif kind == 2:
            near = list(base)
            for _ in range(rng.randrange(1, 9)):
                near[rng.randrange(len(near))] = "edit%d" % rng.randrange(1000)
            texts.append(" ".join(near))
        elif kind == 3:
            texts.append("\n".join((" ".join(words(20)), " ".join(passage), " ".join(words(20)))))
        elif kind == 4:
            texts.append(" ".join(passage[: rng.randrange(30, 50)] * 2))
        else:
            texts.append("Line of text\n" * rng.randrange(2, 5) + " ".join(words(60)))
    texts.append(" ".join(words(3000)))
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], [None, "hot", "hot", f"s{i % 4}"][i % 4], None if t is None else len(t), "k", "s", "yes") for i, t in enumerate(texts)]
    rows.append((None, "a null id with some words", "en", "hot", 5, None, None, None))
    rows += [rows[20], rows[20]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
