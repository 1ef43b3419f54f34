"""Licence notices that no line of the corpus should hide, and notices that stand as source files have them."""

import pytest
from evidara.llm import licenses
from evidara.llm.runtime import table

NOISE = "Thnd erin hethed erster onble for theden"


@pytest.fixture(scope="module")
def model():
    lines = [NOISE] * 3 + ["Licensed under CC BY-NC 4.0.", "Licensed under EPL-2.0.", "SPDX-License-Identifier: EPL-2.0", "Copyright (c) 2020 Erin Onble."] * 30
    return licenses.fit(lines)


def scan(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scanned(df, model).collect()}


def test_notices_outside_the_templates_are_unknown(spark, model):
    cases = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "// SPDX-License-Identifier: GPL-3.0-only": "GPL",
        "Licensed under EPL-2.0.": "unknown", "SPDX-License-Identifier: EPL-2.0": "unknown", "Copyright (c) 2020 Erin Onble.": "unknown", NOISE: "none",
    }
    got = scan(spark, model, [f"{NOISE}\n{x}\n{NOISE}" for x in cases])
    assert [got[i].family for i in range(len(cases))] == list(cases.values())


def test_lines_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = licenses.scanned(docs).join(docs, "doc_id").where("text like '%Licensed under CC BY-NC 4.0.%'")
    assert {(r.family, r.confirmed) for r in got.collect()} == {("CC-BY-NC", True)}


def test_wrapped_and_dual_notices(spark, model):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction."
    dual = f"{NOISE}\nReleased under the MIT License.\n{NOISE}\n\nLicensed under the Apache License, Version 2.0.\n{NOISE}"
    beside = "Licensed under the Quxly Gralto terms.\nReleased under the MIT License."
    cut = mit.replace("copy\n", "copy\n\n")
    got = scan(spark, model, [gpl, mit, dual, f"{gpl}\n\n{mit}", beside, cut])
    assert [(got[i].family, got[i].confirmed) for i in (0, 1, 5)] == [("GPL", True), ("MIT", True), ("unknown", False)]
    assert [(f.family, f.line) for f in got[2].families] == [("MIT", 1), ("Apache-2.0", 4)]
    assert {f.family for f in got[3].families} == {"GPL", "MIT"}
    assert [(f.family, f.line) for f in got[4].families] == [("MIT", 1)]


def test_two_notices_in_one_line(spark):
    both = " ".join([licenses.TEMPLATES["MIT"][-1], "and", licenses.TEMPLATES["Apache-2.0"][-1]])
    df = spark.createDataFrame([(1, both), (2, licenses.TEMPLATES["MIT"][-1])], "doc_id long, text string")
    got = {r.doc_id: [f.family for f in r.families] for r in licenses.scanned(df, licenses.fit(["some line of text"])).collect()}
    assert sorted(got[1]) == ["Apache-2.0", "MIT"] and got[2] == ["MIT"]


def test_learning_from_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scanned(empty).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_id long, text string")
    assert [(r.doc_id, r.family, r.notices) for r in licenses.scanned(nulls).orderBy("doc_id").collect()] == [(1, "none", 0), (2, "none", 0), (3, "none", 0)]


def test_lines_to_learn_from_are_whole_and_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(licenses, "fit", lambda lines: seen.append(lines) or "model")
    long = "word " * 5_000
    df = spark.createDataFrame([(1, "\n".join([long, "a line", "a line", "another"])), (2, None)], "doc_id long, text string")
    licenses.learn(df)
    assert seen[-1] == sorted([long, "a line", "another"])
    licenses.learn(df, lines=2)
    assert len(seen[-1]) == 2
    licenses.learn(df, most=20)
    assert sum(map(len, seen[-1])) <= 20
