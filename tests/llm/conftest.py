import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, n long, _sha string, rep string"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text[, lang]) as a documents table with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "xx", "s", len(r[1] or ""), "b", 7, "h", "r") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """Made-up documents: nulls, empties, white space, repeats, near copies, shared passages and one very long text."""
    r = random.Random(5)
    parts = ["an", "bo", "ciu", "dé", "er", "fo", "gá", "hu", "ion", "Ka"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(20)
    rows = [(i, text(r.randrange(1, 60))) for i in range(40)]
    for i in range(40, 60):
        words = text(60).split()
        rows.append((i, " ".join(words)))
        for k in range(2):
            changed = list(words)
            changed[r.randrange(60)] = word() + str(k)
            rows.append((i * 10 + k, "\n".join(changed).upper() if k else " ".join(changed)))
    rows += [(900 + i, text(5) + " " + shared + "  " + text(3)) for i in range(6)]
    rows += [(1000 + i, t) for i, t in enumerate(["", None, " \t\n", "x", "X", " x\v", "eins zwei", "eins zwei", "a a a a a a a a a a a a a a a a a a", "a a a a a a a a a a a a a a a"])]
    rows += [(7, rows[7][1]), (2000, rows[3][1] + " "), (2001, rows[3][1])]
    rows.append((3000, text(4000)))
    return rows
