"""Small made-up texts and brute-force versions."""

import random

WORDS = ["the", "of", "and", "to", "año", "été"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    some = WORDS + ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(150)]
    return " ".join(r.choice(some) for _ in range(n))


def documents(spark, texts, **extra):
    """doc_id, text, lang, source, n_chars and columns with clashing names."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or ""), i) for i, t in enumerate(texts)]
    names = extra.get("clash", "score")
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {names} long")
