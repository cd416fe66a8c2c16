import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture()
def docs(spark):
    """Documents from (doc_id, text) rows, over several partitions, with columns that clash with results'."""
    def make(rows, parts=5):
        df = spark.createDataFrame([(d, t, "en", "src", len(t or ""), -1, "x", "y") for d, t in rows],
                                   "doc_id long, text string, lang string, source string, n_chars long, "
                                   "n_words int, h1 string, pos string")
        return df.repartition(parts)
    return make
