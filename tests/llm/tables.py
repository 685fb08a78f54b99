"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def documents(spark, rows):
    """A documents table of (doc_id, text) rows, with columns whose names operators use themselves."""
    base = spark.createDataFrame([(i, t, "en", "hot", len(t or "")) for i, t in rows], SCHEMA)
    return base.selectExpr("*", "1 AS id", "'x' AS hash", "2 AS n", "3 AS row", "'y' AS `key`", "4 AS part", "5 AS score")


def corpus(seed=3, size=120):
    """Random texts with exact copies, near copies and shared passages; nulls, empty and white-space texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    base = [" ".join(word() for _ in range(rng.randint(60, 140))) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One TWO"), (6, "one two three four")]
    for i in range(10, size):
        kind = rng.random()
        words = rng.choice(base).split()
        if kind < 0.2:
            text = " ".join(words)
        elif kind < 0.7:
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(len(words))] = word()
            text = " ".join(words)
        elif kind < 0.85:
            text = passage + " " + " ".join(word() for _ in range(rng.randint(3, 80)))
        else:
            text = "\n".join(" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))) + "\nA shared line of text.\n  a SHARED line of text. "
        rows.append((i, text))
    rows.append((500, " ".join(word() for _ in range(30_000))))
    return rows
