"""Small made-up corpora for the tests, with the odd cases that every operator defines."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"{'the of and to'.split()[k % 4]}" if k % 5 == 0 else f"w{rng.randrange(vocabulary)}" for k in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text = words(rng, rng.randrange(3, 160))
        out.append((k, text, "en", f"src{k % 3}", len(text)))
    out.append((n, out[0][1], "en", "src0", 1))  # an exact copy
    out.append((n + 1, out[1][1] + " tail", "en", "src0", 1))  # a near copy
    out += [
        (n + 2, None, None, None, None),
        (n + 3, "", "en", "src1", 0),
        (None, "no id here " + words(rng, 20), "en", "src1", 0),
        (n + 4, " \t\n ", "en", "src2", 4),
        (n + 5, words(rng, 5000), "en", "src0", 0),
        out[2],  # a repeated row
    ]
    return out


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def with_clashes(df, *names):
    """The same table with more columns, named like those that operators make."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(n) for n in names])
