"""Small tables with every awkward case: nulls, empty, blank and very long texts, ties, repeated rows, clashing columns."""
import random

from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, size: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(size))


def edited(text: str, seed: int, changes: int) -> str:
    draw, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
    return " ".join(words)


def awkward_texts() -> list:
    long_text = prose(1, 6000)
    base = prose(2, 120)
    shared = prose(3, 60)
    texts = [None, "", "   \n\t", "one", "one", "A B C d", "a b c D", long_text, edited(long_text, 4, 40), "Ünï 漢字 😀 x y z", base, base, base.upper()]
    texts += [edited(base, 10 + i, 1 + i % 5) for i in range(12)]
    texts += [shared + " " + prose(50 + i, 15 + i) for i in range(12)]
    texts += [prose(100 + i, 30) for i in range(8)]
    return texts


def awkward_documents(spark, texts=None):
    rows = [(i * 3, t) for i, t in enumerate(awkward_texts() if texts is None else texts)]
    rows.append(rows[min(10, len(rows) - 1)])  # a row that occurs twice
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["id", "n", "node", "component", "spans", "keep", "block", "bucket", "path", "host", "token", "ids", "_id", "_block"]
    return df.withColumns({c: F.lit("clash") for c in names})
