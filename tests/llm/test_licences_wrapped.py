"""Notices wrapped over several lines, as in source files."""

import pytest

from cadenza.llm import licenses

GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MIT = """ * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:"""
APACHE = """// Licensed under the Apache
// License, Version 2.0 (the "License");
// you may not use this file except in
// compliance with the License.
// You may obtain a copy of the License at"""


@pytest.fixture(scope="module")
def model():
    return licenses.train(["plain words of prose and nothing else here"] * 40 + ["the river ran past the old mill"] * 40)


def labels(spark, model, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return licenses.scan(docs, model).collect()


@pytest.mark.parametrize("family, text", [("gpl-3.0", GPL3), ("mit", MIT), ("apache-2.0", APACHE)])
def test_wrapped_notices_have_their_family(spark, model, family, text):
    rows = labels(spark, model, f"#!/bin/sh\n#\n{text}\n#\nx = 1\n")
    found = [r for r in rows if r.label == family]
    assert found and {r.label for r in rows} <= {family, "unknown"}
    for r in rows:
        body = "\n".join(f"#!/bin/sh\n#\n{text}\n#\nx = 1\n".split("\n")[r.paragraph : r.paragraph + r.lines])
        assert model.predict(body)[0] == r.family and model.predict(body)[1] == pytest.approx(r.probability, abs=1e-6)
    assert {(r.paragraph, r.lines) for r in found if r.lines > 1} == {(2, len(text.split("\n")))}


def test_runs_end_at_lines_without_words(spark, model):
    rows = labels(spark, model, f"\n{GPL3}\n#\n{MIT}\n *\nprose\n\n\nAll rights reserved.")
    assert {(r.paragraph, r.lines, r.label) for r in rows if r.label != "unknown"} == {(1, 4, "gpl-3.0"), (6, 6, "mit"), (16, 1, "proprietary")}


def test_single_lines_are_reported_as_before(spark, model):
    rows = labels(spark, model, "text\nReleased under the MIT License.\nmore text")
    assert [(r.paragraph, r.lines, r.label) for r in rows] == [(1, 1, "mit")]


def test_a_notice_inside_a_wrapped_one_keeps_its_row(spark, model):
    rows = labels(spark, model, f"{GPL3}\n# All rights reserved.\n# Released under the MIT License.")
    assert {(r.paragraph, r.lines, r.label) for r in rows if r.lines == 1 and r.label != "unknown"} == {(4, 1, "proprietary"), (5, 1, "mit")}


def test_training_paragraphs_are_bounded_and_those_of_the_lowest_hashes(spark):
    from pyspark.sql import functions as F

    rows = [(i, None if i == 3 else f"first {i}\n\nsecond {i}\n" + "z" * (50 * i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id", "text")).collect()][:20]
    texts = sorted(dict(rows)[i] or "" for i in order)
    want = [p for t in texts for p in t.split("\n") if p and len(p) <= 1000]
    assert licenses.sample(docs, 20, 6000, 1000) == want
    assert licenses.sample(docs, 20, 7, 1000) == want[:7] and licenses.sample(docs.limit(0)) == []
