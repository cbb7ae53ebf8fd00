import random

import pytest


@pytest.fixture(scope="session")
def texts():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice(["the", "of", "Über", "näher", "code", "x9", "日本", "re-do", "a"]) + str(rnd.randint(0, 40)) for _ in range(rnd.randint(5, 90))) for _ in range(40)]
    out = base + [None, "", " \n\t", "one", "one two", base[0], base[0].upper(), base[1].replace(" ", "\n"), "w " * 3000]
    for b in base[:12]:
        w = b.split()
        for _ in range(4):
            v = list(w)
            v[rnd.randrange(len(v))] = "changed%d" % rnd.randint(0, 9)
            out.append(" ".join(v))
    return dict(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "extra", 1.0) for i, t in texts.items()]
    # names that the operators use inside must not clash
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, n double").repartition(5)
