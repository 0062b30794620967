import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, mh string"


def make_docs(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, odd white space, empty, null, long and repeated rows; columns that clash."""
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "ε", "the", "of", "x", "日本語", "zeta#", "eta|", "IOTA!!"]
    say = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))
    texts = [say(r.randint(0, 120)) for _ in range(40)]
    passage, line = say(90), "A line that several documents hold, word for word.\n"
    texts += [say(20) + passage + say(20) for _ in range(5)] + [line + say(30) + line for _ in range(4)]
    texts += [texts[3], texts[3], texts[7].replace("the", "teh", 1), None, None, "", " \n\t", "one", passage * 8, "ab " * 900, "é" * 700]
    near = [f"w{i}" for i in range(120)]
    texts += [" ".join(near), " ".join(near[:60] + ["changed"] + near[61:]), " ".join(near[1:]), " ".join(reversed(near))]
    rows = [(i, t, "en", f"src{i % 4}" if i % 7 else None, len(t or ""), 1, "s", "m") for i, t in enumerate(texts)]
    rows += [rows[2], rows[41], (None, "no id at all", None, "src0", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, KINDS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KINDS)
