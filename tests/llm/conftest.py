import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) as a table of documents, in two partitions."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS).repartition(2)

    return make


#: Nulls, empty and very long texts, ties, repeated rows, odd white space, several scripts.
ODD = [
    (0, None), (1, ""), (2, "A long enough line\nshort\nA Long Enough Line  "), (3, "\ta long enough line\x0b\nother words here at last"),
    (4, "ten chars é\nshort"), (5, "Ten Chars é\r\nÉcole normale supérieure"), (6, "ÉCOLE NORMALE SUPÉRIEURE\nécole normale supérieure"),
    (7, "x " * 30_000), (8, "one two three four five six seven eight nine ten\n" * 3), (8, "one two three four five six seven eight nine ten"),
    (None, "A long enough line"), (9, " nbsp em \x1c\x85 controls \x00 zero <|endoftext|> It's 12,345  double\n\n\n end "), (10, "   \n\n  "),
    (11, "one two three four five six seven eight nine ten"), (12, "### $$$ %%% &&& *** ||| <<< >>> # $ % & *"), (13, "日本語のテキスト 漢字 かな\n한국어 텍스트"),
]
