"""Canonical digests: spellings, marks and copyright lines don't matter, words do."""

import re
import textwrap

from pyspark.sql import functions as F

from sluice.llm import licenses


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    text = re.sub(r"(?m)^[ \t]*(?:copyright[ \t]|\(c\)|©|all rights reserved)[^\n]*$", " ", text)
    text = " " + re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", text).strip() + " "
    for a, b in licenses.SPELLINGS:
        text = text.replace(f" {a} ", f" {b} ")
    return text.strip()


def test_whole_texts(spark):
    mit, isc = licenses.TEXTS[0][1], licenses.TEXTS[1][1]
    data = [
        (1, mit), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper()), (3, mit.replace("License", "Licence").replace(",", " ,").replace("sublicense", "sub-licence")), (4, mit + " more"), (5, None), (6, ""), (7, " .,-\n"),
        (8, isc.replace('"', "''").replace("\n", "  \n")), (8, isc), (None, isc), (9, "© 2001 A\n(C) B\nAll rights reserved.\n" + isc), (10, "word " * 200000), (11, mit[5:]),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' as digest", "'y' as license_id", "'z' as notices")
    got = licenses.scan(df).collect()
    assert len(got) == len(data)
    want = {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: "ISC", None: "ISC", 9: "ISC", 10: None, 11: None}
    assert all(r["license_id"] == want[r["id"]] for r in got)
    assert all((r["digest"] is None) == (r["id"] in (5, 6, 7)) for r in got)
    forms = df.select("doc_id", licenses.canonical(F.col("text")).alias("c")).filter("c is not null").collect()
    texts = {}
    for i, t in data:
        texts.setdefault(i, set()).add(plain(t))
    assert all(r["c"] in texts[r["doc_id"]] for r in forms)
    assert licenses.scan(df.limit(0)).collect() == []


def test_notices(spark):
    data = [(1, "Some words.\nReleased under the MIT Licence.\nMore"), (2, "Licensed under CC BY-NC 4.0. And on. This work is licensed under the GNU GPL, version 3!"), (3, "Not released under the MIT License."), (4, "LICENSED UNDER THE APACHE LICENSE VERSION 2.0\n" * 3), (5, None)]
    got = {r["id"]: r["notices"] for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "CC-BY-NC-4.0,GPL-3.0-only", 3: "", 4: "Apache-2.0", 5: ""}


def test_wrapping_keeps_wording(spark):
    isc = licenses.TEXTS[1][1]
    head, body = isc.split("\n\n", 1)
    wrapped = [head + "\n\nCopyright (c) 2020 Someone\nCopyright 2021 Other\nCopyright © 2022 B\nCopyright [yyyy] [name]\n\n" + "\n\n".join(textwrap.fill(x, width) for x in body.split("\n\n")) for width in range(30, 90)]
    assert any("\ncopyright notice" in t for t in wrapped)
    rows = [*enumerate(wrapped), (1000, isc.replace("copyright notice and", "copyright notice\ncopyright holders and"))]
    got = {r["id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.pop(1000) is None and set(got.values()) == {"ISC"}
    kept = ["(c) You must retain", "(c) under Patent Claims", "copyright license to reproduce"]
    forms = spark.createDataFrame([(t,) for t in kept], "text string").select(licenses.canonical(F.col("text"))).collect()
    assert all(r[0] for r in forms)


def test_whole_files(spark):
    texts = dict(reversed(licenses.TEXTS))
    rows = []
    for name in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "MPL-2.0", "CC-BY-SA-4.0", "Unlicense"):
        rows += [(name, texts[name]), (None, texts[name][: len(texts[name]) // 2])]
    mit, zero = licenses.TEXTS[0][1], licenses.TEXTS[2][1]
    rows += [("MIT", "Copyright (c) 2020 A\n\n" + mit.split("\n\n", 1)[1]), ("0BSD", "Zero-Clause BSD\n\n" + zero)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r["license_id"] == r["id"] for r in got)


def test_the_canonical_form_is_one(spark):
    forms = ["the licence licence licence end", "sub licence sub licence", "the license license license end"]
    df = spark.createDataFrame([(t,) for t in forms], "t string")
    once = [r[0] for r in df.select(licenses.canonical(F.col("t"))).collect()]
    again = [r[0] for r in spark.createDataFrame([(t,) for t in once], "t string").select(licenses.canonical(F.col("t"))).collect()]
    assert once == again and once[0] == once[2] and "licence" not in " ".join(once)


def test_wrapped_bsd_files(spark):
    import textwrap

    data = []
    for n in (2, 3):
        body = licenses.bsd(n, True, f"BSD {n}-Clause License", "HOLDER").split("\n\n")
        body.insert(1, "Copyright (c) 2020, Somebody\nAll rights reserved.")
        data.append((n, "\n\n".join(textwrap.fill(x, 60, initial_indent="   ") if k > 1 else x for k, x in enumerate(body))))
        data.append((n + 10, data[-1][1].replace("SUBSTITUTE", "OTHER")))
    got = {r["id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {2: "BSD-2-Clause", 3: "BSD-3-Clause", 12: None, 13: None}
