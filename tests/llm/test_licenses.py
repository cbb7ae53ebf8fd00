"""Licence scan on planted wordings, also in repeated rows and rows without an id."""

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import licenses


def test_licences(spark):
    mit, apache = licenses.RULES[3][1], licenses.RULES[0][1]
    wrapped = "# " + apache.replace("software distributed", "software\n#  distributed").replace(". You may", ".\n# You may")
    rows = [(1, "Intro.\n" + mit + "\nEnd."), (2, wrapped), (3, "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), (4, mit[:200]), (5, None), (6, ""), (7, "no such thing"), (8, "text | Released  under the mit license!"), (9, "Licensed under the\nApache License, Version 2.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("view", F.lit(1)).withColumn("number", F.lit(2))
    got = {r.doc_id: r for r in licenses.scan_licences(df).collect()}
    assert got[1].licences == "MIT" and got[1].rule == 3 and got[1].n_sentences == 4 - 1
    assert got[2].licences == "Apache-2.0" and got[2].rule == 0
    assert got[3].licences == "CC-BY-NC-4.0,MIT" and got[9].licences == "Apache-2.0"
    assert not set(got) & {4, 5, 6, 7}
    assert licenses.scan_licences(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def wordings():
    return {name: text for name, text in reversed(licenses.RULES) if not text.startswith("SPDX")}


def test_every_licence(spark, wordings):
    rows = [(k, f"/*\n * Copyright 2020.\n{text}\n*/") for k, text in enumerate(wordings.values())]
    tags = [(100 + k, f"x = 1  # SPDX-License-Identifier: {name}\ny") for k, name in enumerate(licenses.TAGGED)]
    got = {r.doc_id: r.licences for r in licenses.scan_licences(spark.createDataFrame(rows + tags, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == list(wordings)
    lines = spark.createDataFrame([(k, f"SPDX-License-Identifier: {name}") for k, name in enumerate(licenses.TAGGED)], "doc_id long, text string")
    assert [r.licences for r in licenses.scan_licences(lines).orderBy("doc_id").collect()] == list(licenses.TAGGED)


def test_rows_are_kept_apart(spark, wordings):
    long = "word " * 400_000 + "\n" + wordings["ISC"]
    rows = [(1, wordings["MIT"]), (1, wordings["MIT"]), (None, wordings["Zlib"]), (None, wordings["BSD-2-Clause"]), (None, None), (2, long), (1, wordings["BSD-3-Clause"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("hits", F.lit(1)).repartition(3)
    got = [(r.doc_id, r.licences) for r in licenses.scan_licences(df).collect()]
    want = [(1, "MIT"), (1, "MIT"), (1, "BSD-3-Clause"), (2, "ISC"), (None, "BSD-2-Clause"), (None, "Zlib")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_altered_wordings(spark, wordings):
    """A holder's name may be any; a changed or an added condition is another licence."""
    bsd, mit = wordings["BSD-3-Clause"], wordings["MIT"]
    holder = "the copyright holder nor"
    assert holder in bsd
    named = [bsd.replace(holder, f"{x} nor") for x in ("Acme Corp.", "the University", "Foo, Inc. and its authors")]
    regents = bsd.replace(holder, "the University nor").replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS").replace("COPYRIGHT HOLDER OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS")
    assert "REGENTS AND" in regents and "REGENTS OR" in regents
    third = bsd[bsd.index("Neither") : bsd.index("THIS SOFTWARE")]
    changed = bsd.replace(third, "This software may not be used in weapons. ")
    middle = mit.index("The above copyright notice")
    added = mit[:middle] + "The Software shall be used for Good, not Evil. " + mit[middle:]
    texts = [*named, regents, changed, added, mit, bsd]
    want = ["BSD-3-Clause"] * 4 + ["", ""] + ["MIT", "BSD-3-Clause"]
    for wrap in (lambda t: t, lambda t: t.replace(". ", ".\n").replace("; ", ";\n"), lambda t: "Intro.\n" + t):
        df = spark.createDataFrame(list(enumerate(map(wrap, texts))), "doc_id long, text string")
        got = {r.doc_id: r.licences for r in licenses.scan_licences(df).collect()}
        assert [got.get(k, "") for k in range(len(texts))] == want


def test_rules_need_an_anchor():
    with pytest.raises(ValueError):
        licenses.LicenceRules([("X", "Nothing that tells.")])
