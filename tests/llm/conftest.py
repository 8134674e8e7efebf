"""Small documents for the operators: copies, edits, nulls, empties, a long text, repeated rows, odd columns."""

import random

import pytest
from pyspark.sql import functions as F

WORDS = "the of and river stone bright window carries morning letter garden copper travel seven market silver engine valley winter paper".split()


def make_texts(seed: int = 5) -> list:
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") if rng.random() < 0.4 else "") for _ in range(n)).capitalize() + "."
    base = [prose(rng.randrange(20, 120)) for _ in range(12)]
    shared = prose(30)
    texts = [*base, base[0], base[0], base[1] + " tail", base[2].replace("the", "a", 1), base[3] + "\n" + shared, base[4] + "\n" + shared, shared, base[5].upper()]
    for k in range(25):  # a group of near copies, each with its own edits
        w = base[6].split()
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    texts += [None, "", " ", "\n\n", "one", "a b", "éé ñ  中文 😀", "Same line here\nSame line here\nother", "z" * 5000, " ".join(["long"] * 6000), prose(4000)]
    texts += ["Released under the MIT License.", "licensed under the apache license, version 2.0.\nx", "mail bob@mail.example.com or +1 (555) 010-9999, ip 10.0.0.1, card 4111 1111 1111 1111", "write to john (at) example [dot] com now", "junk### junk$$$ <|endoftext|> junk&&&"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text, and columns whose names the operators use for their results."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {n: F.lit(-1) for n in ("id", "kept", "n_tokens", "length", "start", "shard", "bucket", "doc", "key", "n", "spans", "host", "_id", "component")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
