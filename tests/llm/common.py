"""Small documents with the odd cases: nulls, blanks, ties, repeated rows, a very long text, clashing names."""

import random

LETTERS = "an the of to und der les que con para".split()


def prose(seed, n, letters="abcdefghij", spread=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))


def odd_texts():
    return [None, "", "  \n\t ", "one", "a b", "x " * 5, prose(1, 30), prose(1, 30), prose(2, 3000), "naïve café ☃ 日本語 🎉", "\x00nul \x1c sep"]


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [(None, "no identifier here", None, None, None), rows[-1]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for name in ("n_words", "shard", "row", "node", "kept", "c0", "score", "bucket", "tokens", "text2"):
            df = df.withColumn(name, F.lit(1))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
