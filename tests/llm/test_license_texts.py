"""Entire licence texts and wrapped notices."""

import textwrap

from tideline.llm import licenses


def wrapped(text, width, lead=""):
    """Paragraphs filled anew; those with a copyright line stay, it is a line of its own."""
    fill = lambda p: textwrap.fill(" ".join(p.split()), width, initial_indent=lead, subsequent_indent=lead, break_on_hyphens=False)
    return "\n\n".join(p if "copyright (c)" in p.lower() or "copyright [" in p.lower() else fill(p) for p in text.split("\n\n"))


def test_entire_licenses_however_wrapped(spark):
    texts, want = [], []
    for r in licenses.entire_licenses(spark).collect():
        for width in (60, 70, 78, 10**6):
            texts.append("Copyright (c) 2024 Some Body\nAll rights reserved.\n\n" + wrapped(r.text, width))
            want.append(r.license)
    for path, name in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0")):
        texts.append(open(f"/usr/share/common-licenses/{path}", encoding="utf-8").read())
        want.append(name)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [(i, want[i]) for i in range(len(texts)) if got[i].whole_license != want[i]] == []
    assert all(want[i] in got[i].licenses.split(",") for i in range(len(texts)))


def test_wrapped_notices_inside_a_document(spark):
    rows = [(i, f"Some prose.\n\n{wrapped(text, 72, lead)}\n\nint x;") for i, (_, text) in enumerate(licenses.KNOWN) for lead in ("# ",)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licenses for i, _ in rows] == [name for name, _ in licenses.KNOWN]
    assert all(r.whole_license is None for r in got.values())


def test_rows_that_share_an_id_or_have_none(spark):
    rows = [(1, "Released under the MIT License."), (1, "nothing here"), (None, "Released under the MIT License."), (1, "Released under the MIT License."), (None, None)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.whole_license, r.licenses, r.n_lines) for r in out.collect()), key=repr)
    assert got == sorted([(1, "MIT", "MIT", 1), (1, None, "", 0), (None, "MIT", "MIT", 1), (1, "MIT", "MIT", 1), (None, None, "", 0)], key=repr)
    own = spark.createDataFrame([("Own", "A text of our own, quite short."), ("None", None)], "license string, text string")
    mine = licenses.scan(spark.createDataFrame([(5, "a text of OUR own\nquite short"), (6, "x")], "doc_id long, text string"), own)
    assert {r.doc_id: r.whole_license for r in mine.collect()} == {5: "Own", 6: None}
