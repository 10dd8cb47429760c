"""Notices and licences inside documents."""

import re

from millrace.llm import licenses, registry


def test_notices_inside_documents(spark, odd):
    mit = licenses.KNOWN["MIT"]
    wrapped = "\n".join(re.findall(r".{1,60}(?:\s|$)", licenses.KNOWN["0BSD"]))
    rows = [
        (1, "Some prose here. Released under the MIT License. More prose."), (2, "First line\n# released under the MIT licence\nlast line"), (3, "It was not released under the MIT License."),
        (4, f"A readme.\n\n{mit}\n\nAnd more."), (5, mit), (6, f"intro\n{wrapped}\noutro\nLicensed under CC BY-NC 4.0."), (7, None), (8, "Released under the MIT License."), (8, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["license_id"], tuple(r["within"])) for r in licenses.scanned_within(docs).collect() if r["doc_id"] != 5)
    notice = "MIT-notice"
    assert sorted(got, key=str) == sorted([(1, None, (notice,)), (2, None, (notice,)), (3, None, ()), (4, None, ("MIT",)), (6, None, ("0BSD", "CC-BY-NC-4.0-notice")), (7, None, ()), (8, notice, (notice,)), (8, notice, (notice,))], key=str)
    assert [(r["license_id"], r["within"]) for r in licenses.scanned_within(docs.where("doc_id = 5")).collect()] == [("MIT", ["MIT"])]
    assert licenses.scanned_within(odd).count() == odd.count() and licenses.scanned_within(odd.limit(0)).count() == 0
    none = spark.createDataFrame([], "license_id string, text string")
    assert [r["within"] for r in licenses.scanned_within(docs.limit(1), none).collect()] == [[]]


def test_given_documents(spark):
    """Each document that holds a notice names it, and the whole-text columns are those of the whole-text scan."""
    sf = "/root/testdata/sf0.01"
    marks = {"MIT-notice": "Released under the MIT License.", "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.", "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3."}
    want = {r["doc_id"]: sorted(k for k, m in marks.items() if m in (r["text"] or "")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = registry.queries()["op3_license_notices"](spark, sf).collect()
    assert {r["doc_id"]: r["within"] for r in found} == want and sum(map(bool, want.values())) == 39
    whole = registry.queries()["op3_license_scan"](spark, sf).collect()
    assert sorted((r["doc_id"], r["canonical_sha256"], str(r["license_id"])) for r in found) == sorted((r["doc_id"], r["canonical_sha256"], str(r["license_id"])) for r in whole)


def test_forms_wrapped_anew(spark):
    """Every known form, wrapped at 60 to 100 columns, by a plain rule of its own: words in order, without stated copyrights."""
    stated = re.compile(r"\W*(copyright\W*(\(c\)|©|\d{4}|yyyy|<year|19yy)|(\(c\)|©)\W*(copyright|\d{4})|all rights reserved\W*$)", re.I)
    rows, want = [], []
    for license_id, text in licenses.forms():
        for n in range(60, 101, 4 if len(text) > 8000 else 1):
            out = []
            for line in text.split("\n"):
                out += [line] if stated.match(line) or not line.strip() else re.findall(rf"\S(?:.{{0,{n}}}\S)?(?=\s|$)", line.strip())
            rows.append((len(rows), "\r\n".join(f"  // {x}" for x in out)))
            want.append((license_id, text))
    known = {}
    for i, t in licenses.forms():
        key = tuple(re.findall(r"[a-z0-9]+", " ".join(x for x in t.lower().split("\n") if not stated.match(x))))
        known[key] = min(known.get(key, "~"), i)
    got = {r["doc_id"]: r["license_id"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(want):
        key = tuple(re.findall(r"[a-z0-9]+", " ".join(x for x in t.lower().split("\n") if not stated.match(x))))
        assert got[k] == known[key], (i, k)


def test_lines_of_a_licence_stay(spark):
    """Lines that a wrap begins with the word or the sign are no statements."""
    one = lambda t: spark.createDataFrame([(1, t)], "i int, t string").select(licenses.canonical(licenses.F.col("t"))).first()[0]
    assert one("a\nCOPYRIGHT HOLDERS BE LIABLE\n(c) You must retain\ncopyright notice\nall rights reserved by x") == "a copyright holders be liable c you must retain copyright notice all rights reserved by x"
    assert one("© 2020 X\nCopyright (C) Y\n* copyright 1999 Z\n(c) Copyright W\nAll Rights Reserved.\nb") == "b"


def test_statements_of_any_holder(spark):
    """By the word or the sign alone, over lines that a comma ends, and beside an identifier."""
    mit = licenses.KNOWN["MIT"]
    heads = ["Copyright The Foo Authors", "Copyright by Foo Inc., 2019", "© Foo Inc.", "* Copyright: Someone\n* All rights reserved.", "Copyright (c) 2019 Foo,\n  Bar & Sons and\n  others", "SPDX-License-Identifier: MIT\nSPDX-FileCopyrightText: 2020 X", "copyright foo"]
    rows = [(k, f"{h}\n{gap}{mit}") for k, (h, gap) in enumerate((h, g) for h in heads for g in ("", "\n"))]
    assert [r["license_id"] for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == ["MIT"] * len(rows)
    one = lambda t: spark.createDataFrame([(1, t)], "i int, t string").select(licenses.canonical(licenses.F.col("t"))).first()[0]
    assert one("we protect rights:\ncopyright the software\n\"copyright\" line\ncopyrights\ncopyright, or") == "we protect rights copyright the software copyright line copyrights copyright or"
    assert one("copyright") == "copyright" and one("a\nspdx\nb") == "a spdx b"
