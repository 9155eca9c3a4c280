import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node long, key long, doc long, part int, score double, component_id long, bucket long, fingerprint string, n_words long, gone boolean, _tag string"


def make(spark, rows):
    """A documents table from (doc_id, text), with more columns, some named like what operators use inside."""
    full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t), None, 7, 7, 7, 7, 0.5, 7, 7, "f", 7, True, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def words(rng, n, size=300):
    letters = "abcdefghijklmnopqrstuvwxyz"
    bag = ["".join(random.Random(k).choices(letters, k=2 + k % 8)) for k in range(size)]
    return " ".join(rng.choice(bag) for _ in range(n))


def edge_rows():
    """Nulls, empties, ties, repeated rows, non-ASCII, very long texts, copies and near copies."""
    rng = random.Random(5)
    passage = words(rng, 60)
    base = [words(rng, rng.randrange(1, 200)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, t.replace(" ", "\n", 1)) for k, t in enumerate(base[:8])]
    rows += [(200 + k, base[0] + " ") for k in range(6)]
    rows += [(300 + k, words(rng, 40) + "\n" + passage + "\n" + words(rng, 30)) for k in range(8)]
    near = base[5].split()
    rows += [(400 + k, " ".join(near[:k] + ["zzz"] + near[k + 1 :])) for k in range(3)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, None), (None, base[1]), (504, "Ünïcödé ▁ ﬁ 中文 文字 🙂 " * 30), (505, "x"), (506, "x"), (506, "x")]
    rows += [(507, words(rng, 30000)), (508, "a" * 50000), (509, "word " * 4000)]
    rows += [(510, 'the token = "' + "0123456789abcdef" * 2 + '" here'), (511, "password=hunter2hunter9 and " + base[2]), (512, "commit 0123456789abcdef0123456789abcdef01234567")]
    rows += [(513, "Licensed under the Apache License, Version 2.0. All rights reserved. CC BY 4.0")]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return make(spark, edge_rows()).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
