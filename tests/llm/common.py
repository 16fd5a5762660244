"""Documents for the tests, odd ones among them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n: int = 60, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    parts = ["re", "ti", "on", "ea", "th", "ing", "le", "sta", "vi", "nou"]
    vocabulary = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(400)] + ["the", "of", "and"] * 20
    line = lambda k: " ".join(r.choices(vocabulary, k=k)).capitalize() + "."
    common = line(12)
    texts = []
    for i in range(n):
        lines = [line(r.randint(1, 25)) for _ in range(r.randint(1, 12))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), common)
        texts.append("\n".join(lines))
    words = texts[1].split(" ")
    words[len(words) // 2] = "changed"
    texts += [texts[0], texts[0], " ".join(words), texts[1].upper(), texts[2] + "\n" + texts[2], "word " * 3000, "a b c d", "a B c d", "é ñ \u3000 x", "\n\n \t", "", None]
    rows = [(i, t, "en", f"s{i % 4}" if i % 3 else "s0", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], (rows[5][0], "another text with an id that repeats", None, None, None), (None, texts[6], None, None, None)]
    return rows


def frame(spark, rows=None, partitions: int = 3):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(partitions)


def clashing(df):
    """df with extra columns that have names which the operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("component_id", "n_shingles", "label", "node", "print", "line", "block", "part", "h", "size", "members", "removed", "x", "score", "ids", "place", "media"):
        df = df.withColumn(name, F.lit(name))
    return df
