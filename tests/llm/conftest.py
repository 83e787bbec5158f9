from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(r: random.Random, n: int, vocab: int = 500) -> str:
    words = ["".join(random.Random(k).choice("aeilnorst") for _ in range(2 + k % 7)) for k in range(vocab)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Copies, near copies, nulls, empty and long texts, repeated rows, a hot source."""
    r = random.Random(5)
    base = [text(r, r.randint(5, 300)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5]) for i in range(20)]
    for i in range(20):
        w = base[10 + i % 3].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "   \n\t"), (303, "one"), (304, "One"), (305, text(r, 20_000)), (None, base[0]), (None, "alone here"), (7, base[7])]
    full = [(d, t, "en", None if i % 17 == 0 else f"s{i % 3 and i % 12}", len(t or "")) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(4)
