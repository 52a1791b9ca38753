"""Documents with every awkward shape: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

ODD = [
    (None, "a text without an id that has a few words in it"), (900, None), (901, ""), (902, " \t\n "), (903, "one"), (904, "é" * 70 + "ß"), (905, "the same words " * 4000),
    (906, "twice the same row"), (906, "twice the same row"), (907, "\0\x01 control \x7f"), (908, "a" * 99), (909, "a" * 250),
]


def random_docs(n=150, seed=4):
    """Texts of invented words with exact copies, near copies and passages that several share."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßn") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [" ".join(words(rng.randrange(25, 60))) for _ in range(4)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.12:
            text = rng.choice(docs)[1]
        elif docs and kind < 0.4:
            base = rng.choice(docs)[1].split(" ")
            for _ in range(rng.randrange(1, 6)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            text = " ".join(base)
        else:
            parts = [" ".join(words(rng.randrange(5, 90)))]
            if rng.random() < 0.3:
                parts.append(rng.choice(passages))
                parts.append(" ".join(words(rng.randrange(0, 30))))
            text = rng.choice([" ", "\n"]).join(parts)
        docs.append((i, text))
    return docs


def frame(spark, docs, columns="doc_id long, text string"):
    """Documents with further columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(docs, columns).repartition(3)
    clashing = {"spans": F.lit(1), "id": F.lit("x"), "bucket": F.lit(2.5), "Spans_of": F.lit(True), "_spans": F.lit("y"), "kept_id": F.lit(0), "gram": F.lit(1.5), "set_key": F.lit(4)}
    return df.withColumns(clashing)
