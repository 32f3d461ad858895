from pathlib import Path

import pytest

from tallyweave.llm import license_scan as m


def scan(spark, texts):
    rows = [(n, t, "clash") for n, t in enumerate(texts)]
    return {r["doc_id"]: r for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}


def test_whole_texts_and_notices(spark):
    mit = next(t for name, t in m.KNOWN if name == "MIT")
    texts = [
        "Copyright (c) 2020 Some One\n\n" + mit.upper(),
        mit.replace("copyright holders", "Copyright Owners").replace(",", " ,\t"),
        "Words.\nReleased under the MIT licence!\nMore.\n  RELEASED UNDER THE MIT LICENSE.",
        mit + " and more",
        None,
        "",
        "x " * 50_000,
        "Copyright 2020\nCopyright 2021\nLicensed under CC BY 4.0",
    ]
    got = scan(spark, texts)
    assert [got[n]["license"] for n in range(8)] == ["MIT", "MIT", None, None, None, None, None, "CC-BY-4.0"]
    assert [got[n]["n_notices"] for n in range(8)] == [0, 0, 2, 0, 0, 0, 0, 1]
    assert got[2]["notices"] == "MIT" and got[0]["notices"] == ""
    assert got[4]["text_digest"] == got[5]["text_digest"] and got[0]["text_digest"] == got[1]["text_digest"]


def test_repeats_and_empty_table(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License.")]
    assert [r["n_notices"] for r in m.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1, 1]
    assert m.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_has_no_python(spark):
    plan = m.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_files_with_titles(spark):
    held = dict(reversed([x for x in m.KNOWN if len(x[1]) > 300]))
    notice = "\n\nCopyright (c) 2020 Some One\n\n"
    titles = [("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("ISC", "ISC License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License")]
    got = scan(spark, [title + notice + held[name] for name, title in titles] + ["MIT License", "The MIT License of it"])
    assert [got[n]["license"] for n in range(7)] == [name for name, _ in titles] + [None, None]


def test_long_known_texts_are_found_as_lines(spark):
    long = "you may " * 700 + "do this"
    known = m.known_digests(spark, (("X", long),))
    got = m.scan(spark.createDataFrame([(1, "Intro.\n" + long + "\nEnd.")], "doc_id long, text string"), known).first()
    assert got["n_notices"] == 1 and got["notices"] == "X"


@pytest.mark.skipif(not Path("/usr/share/common-licenses/GPL-3").exists(), reason="no licence texts on this system")
def test_published_texts(spark):
    named = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    found = {name: Path("/usr/share/common-licenses", file) for file, name in named.items() if Path("/usr/share/common-licenses", file).exists()}
    got = scan(spark, [p.read_text() for p in found.values()])
    assert [got[n]["license"] for n in range(len(found))] == list(found)
