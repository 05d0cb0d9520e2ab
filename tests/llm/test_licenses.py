import pytest

from tests.duck import assert_same
from veriloom.llm import licenses as li

MIT = "Released under the MIT License."


def found(spark, rows, **more):
    df = spark.createDataFrame([(p, t, 1, "x") for p, t in rows], "path string, text string, similarity int, licence string")
    return {r.path: (r.licence, r.how, r.directory) for r in li.scan(df, **more).collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_against_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = li.scan(li.document_files(docs), keys=("doc_id",))
    assert assert_same(out, li.oracle(), sf) == docs.count()
    assert {r.how for r in out.select("how").distinct().collect()} >= {"own", "none"}


def test_headers_licence_files_and_nearest_directory(spark):
    got = found(
        spark,
        [
            ("a/LICENSE", "Licensed under the Apache License, Version 2.0.\n"),
            ("a/b/COPYING.txt", f"MIT\n{MIT}"),
            ("a/x.py", "code"),
            ("a/b/c/d/y.py", "code"),
            ("a/bb/z.py", "code\n# This work is licensed under the GNU General Public License, version 3.\nmore"),
            ("a/bb/w.py", "no notice"),
            ("q/v.py", "license plates are sold here by the road"),
            ("top.py", "code"),
        ],
    )
    assert got == {
        "a/LICENSE": ("Apache-2.0", "own", None),
        "a/b/COPYING.txt": ("MIT", "own", None),
        "a/x.py": ("Apache-2.0", "inherited", "a"),
        "a/b/c/d/y.py": ("MIT", "inherited", "a/b"),
        "a/bb/z.py": ("GPL-3.0", "own", None),
        "a/bb/w.py": ("Apache-2.0", "inherited", "a"),
        "q/v.py": ("none", "none", None),
        "top.py": ("none", "none", None),
    }


def test_root_directory(spark):
    assert found(spark, [("LICENSE", MIT), ("a/b.py", "x"), ("/c/LICENSE", "All rights reserved."), ("/c/d", "x")]) == {
        "LICENSE": ("MIT", "own", None), "a/b.py": ("MIT", "inherited", ""), "/c/LICENSE": ("Proprietary", "own", None), "/c/d": ("Proprietary", "inherited", "/c"),
    }


def test_edges(spark):
    rows = [("a/LICENSE", None), ("b/LICENSE", ""), (None, MIT), ("c/x", None), ("c/y", MIT), ("c/y", MIT), ("c/z", "word " * 100_000 + "\n" + MIT), ("d/LICENSE", MIT), ("d/e", None)]
    got = found(spark, rows)
    assert got == {"a/LICENSE": ("none", "none", None), "b/LICENSE": ("none", "none", None), None: ("MIT", "own", None), "c/x": ("none", "none", None), "c/y": ("MIT", "own", None), "c/z": ("MIT", "own", None), "d/LICENSE": ("MIT", "own", None), "d/e": ("MIT", "inherited", "d")}
    df = spark.createDataFrame(rows, "path string, text string")
    assert li.scan(df).count() == len(rows) and li.scan(df.limit(0)).count() == 0


def test_words_of_other_licences_count(spark):
    """A notice that differs from a template in rare words only is another licence; the same with the template's own words is found."""
    docs = li.document_files(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("path", "text")
    more = spark.createDataFrame([("own/foo", "x\nReleased under the Foo Community Software License.\ny"), ("own/mit", f"x\n{MIT}\ny")], "path string, text string")
    got = {r.path: (r.licence, r.how) for r in li.scan(docs.unionAll(more)).filter("path like 'own/%'").collect()}
    assert got == {"own/foo": ("none", "none"), "own/mit": ("MIT", "own")}
