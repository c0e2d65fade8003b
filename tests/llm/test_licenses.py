from __future__ import annotations

import textwrap

from pyspark.sql import SparkSession

from chainmark.llm import licenses

from .fixtures import documents

MIT = "Released under the MIT License."


def scan(spark: SparkSession, files: list) -> dict:
    df = spark.createDataFrame(files, "path string, text string, license string, f long")
    return {r.path: (r.license, r.origin, r.n_headers) for r in licenses.scan(df).collect()}


def test_headers_files_and_nearest_ancestor(spark: SparkSession) -> None:
    words = " ".join(f"code{i}" for i in range(50))
    files = [
        ("LICENSE", "Licensed under the Apache License, Version 2.0.", None, 1),
        ("a/COPYING", "This work is licensed under the GNU General Public License, version 3.", None, 1),
        ("a/b/x.py", words, None, 1),
        ("a/b/y.py", f"{words}\n{MIT}\n{words}", None, 1),
        ("c/d/z.py", words, None, 1),
        ("top.py", words, None, 1),
        ("e/note.txt", MIT, None, 1),
        ("e/f/g.txt", None, None, 1),
        (None, words, None, 1),
    ]
    found = scan(spark, files)
    assert found["a/b/x.py"] == ("GPL-3.0", "inherited", 0)
    assert found["a/b/y.py"] == ("MIT", "header", 1)
    assert found["c/d/z.py"] == ("Apache-2.0", "inherited", 0)
    assert found["top.py"] == ("Apache-2.0", "inherited", 0)
    assert found["e/note.txt"] == ("MIT", "file", 1)
    assert found["e/f/g.txt"] == ("MIT", "inherited", 0)
    assert found[None] == (None, None, 0)
    assert found["LICENSE"][:2] == ("Apache-2.0", "file")


def test_awkward_rows(spark: SparkSession) -> None:
    docs = documents(spark).selectExpr("cast(doc_id as string) as path", "text", "key", "t")
    found = licenses.scan(docs).collect()
    assert len(found) == docs.count()
    assert all(r.license is None for r in found)
    assert licenses.scan(docs.limit(0)).count() == 0


def wrapped(text: str, sign: str, width: int = 60) -> str:
    return "\n".join(f"{sign} {x}" for x in textwrap.wrap(text, width))


def test_full_texts_and_wrapped_notices(spark: SparkSession) -> None:
    """Whole licence files, and header notices wrapped over comment lines."""
    full = dict(reversed([(i, t) for i, t in licenses.TEMPLATES if len(t) > 700]))
    code = "\n".join(f"x{i} = call{i}(value{i})" for i in range(40))
    files = [(f"{i}/LICENSE", f"{i} License\n\nCopyright (c) 2021 Some Body and others\n\n{textwrap.fill(t, 70)}\n", None, 1) for i, t in full.items()]
    files += [(f"{i}/src/main.c", code, None, 1) for i in full]
    gpl = next(t for i, t in licenses.TEMPLATES if i == "GPL-3.0" and t.startswith("This program"))
    files += [("h/a.py", f"{wrapped('Copyright (C) 2020 Some Body', '#')}\n#\n{wrapped(gpl, '#')}\n\n{code}", None, 1), ("h/b.c", f"/*\n{wrapped(licenses._APACHE, ' *')}\n */\n{code}", None, 1)]
    files += [("g/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n" + "\n\n".join(f"Section {i} has words about things number {i}" for i in range(200)), None, 1)]
    found = scan(spark, files)
    assert len(full) >= 4
    for i in full:
        assert found[f"{i}/LICENSE"][:2] == (i, "file")
        assert found[f"{i}/src/main.c"] == (i, "inherited", 0)
    assert found["h/a.py"][:2] == ("GPL-3.0", "header")
    assert found["h/b.c"][:2] == ("Apache-2.0", "header")
    assert found["g/COPYING"][:2] == ("GPL-2.0", "file")
