import random

import pytest
from corpus import DOCS, make_texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Rows in odd order, with a null and a repeated doc_id and columns whose names operators use themselves."""
    rows = [(i * 3, t, "en", "src0", 7, "s", i, 1) for i, t in enumerate(texts)]
    rows.append(rows[5])
    rows.append((None, "a document without an id but with some words in it", None, None, None, None, None, None))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
