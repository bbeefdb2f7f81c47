from __future__ import annotations

import pytest

from sondeflow.llm.queries import ready

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    return ready(spark)


@pytest.fixture
def documents(spark):
    """Documents from (id, text) or (id, text, source) tuples."""

    def make(rows, extra: str = ""):
        data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        df = spark.createDataFrame(data, DOCUMENT)
        for name in extra.split():
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
