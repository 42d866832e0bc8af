"""Small tables and plain-Python models for the operator tests."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOC_SCHEMA):
    return spark.createDataFrame(rows, schema)


def doc(i, text, source="s0", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


def words(rng, n, vocab=4000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def odd_docs():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(7)
    long_text = " ".join(words(rng, 60_000))
    return [doc(1, "alpha beta gamma delta"), doc(1, "alpha beta gamma delta"), doc(2, None), doc(3, ""), doc(4, " \n\t \n"),
            (None, "no id here at all", "en", "s1", 3), (None, None, None, None, None), doc(5, "no source line", None),
            (6, "no language", None, "s1", None), doc(7, long_text), doc(8, long_text), doc(9, "é" * 300 + "\n" + "日本語 " * 50),
            doc(10, "x"), doc(11, "x"), doc(12, "0123 4567 !!"), doc(-3, "negative id text")]


def clashing(df, names):
    """df with extra columns named like the operators' outputs."""
    from pyspark.sql import functions as F
    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
