import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "st", "tu", "vo") for b in ("an", "el", "ir", "on", "us", "em")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    out = []
    for i in range(n):
        word = rng.choice(WORDS) if rng.random() < 0.7 else f"{rng.choice(WORDS)}{rng.choice(WORDS)}"
        out.append(word + (".\n" if i % 11 == 10 else " "))
    return "".join(out)


@pytest.fixture(scope="session")
def texts():
    """(id, text): prose, exact and near copies, shared passages, junk, empty and null texts, and a long one."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    found = list(base)
    found += base[:6]  # exact copies
    for t in base[10:22]:  # near copies
        words = t.split(" ")
        for _ in range(max(1, len(words) // 30)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        found.append(" ".join(words))
    passage = prose(rng, 40)
    found += [prose(rng, 30) + passage + prose(rng, 25) for _ in range(8)]
    found += ["", None, "  \n\t ", "Einzel", "zwei Worte", "na " * 3000, prose(rng, 4000), "NA\x0bna\x0cna"]
    return list(enumerate(found))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in texts]
    return _table(spark, rows)


def _table(spark, rows):
    import tempfile

    path = tempfile.mkdtemp(prefix="foliodiff-test-")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def awkward(spark):
    """Null and repeated ids, repeated rows, null texts, and extra columns whose names clash with results."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words here"), (None, "a b c d e f"), (None, None), (2, None), (3, ""), (4, "A  B c d e f")]
    return spark.createDataFrame(
        [(i, t, "x", None, 0, 1.5, True, "k", "h") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, kept_text string, host string",
    )
