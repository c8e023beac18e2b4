import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, digest string, node long, quality string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows: (doc_id, text)."""
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("the", "on", "er", "ing", "ÉA") for b in ("st", "nd", "ou", "è", "")]
    base = " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(120))
    near = [base.replace(base.split()[i], "changed", 1) for i in (3, 60, 110)]
    repeated = "one two three four five six seven eight nine ten " * 12
    lines = "\n".join(" ".join(r.choice(words) + str(i) for i in range(12)) for _ in range(6))
    texts = [None, "", "   \n\t ", "a", "two words", base, base, base.upper(), *near, repeated, lines, lines + "\n" + base, "x" * 20_000, " ".join(r.choice(words) for _ in range(30_000)), "\x00\x1c\u2003 é e\u0301 \U0001d4b3 Σ"]
    texts += ["mail a.b@c.example.org,d%e@f-g.h or a@b.c%d@e.f +1 (499) 555-6503 +12 card 4111 1111 1111 1111 and 4111-1111-1111-1112 ip 1.2.3.4.5.6.7.8 999.1.1.1 10.0.0.255 " + "1 " * 5000 + "9" * 3000]
    texts += ["call 555-123-4567 now or write to jane [at] mail.com please; version 1.2.3 order 123-456-7890"]
    rows = list(enumerate(texts))
    return [*rows, (5, base), (6, "another text under an id that is used twice"), (None, "no id but a text with enough words to count here"), (None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(i, t, "en", "x", 1, "own") for i, t in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
