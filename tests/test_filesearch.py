"""Search in files: each limit, and what is left out."""

import pytest

from gradeloom.operators import filesearch


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    (base / "a").mkdir()
    (base / "node_modules").mkdir()
    (base / "a" / "one.py").write_text("import os\nLimit = 1\r\nlimit = 2\n")
    (base / "two.py").write_text("  limit three  \n" + "x" * 500 + "limit")
    (base / "notes.md").write_text("limit in a note")
    (base / "big.py").write_text("limit\n" * 1000)
    (base / "raw.py").write_bytes(b"limit \xff\xfe")
    (base / "node_modules" / "lib.py").write_text("limit")
    return str(base)


def test_hits_in_order(spark, root):
    got = filesearch.grep(spark, root, "limit", glob="*.py", most_bytes=2000)
    assert [(m["path"], m["line"]) for m in got["matches"]] == [("a/one.py", 2), ("a/one.py", 3), ("two.py", 1), ("two.py", 2)]
    assert got["matches"][2]["text"] == "limit three" and len(got["matches"][3]["text"]) == 400
    assert (got["truncated"], got["reason"], got["scanned"]) == (False, None, 2)


def test_each_limit_says_so(spark, root):
    hits = filesearch.grep(spark, root, "limit", glob="*.py", most_hits=3)
    assert (hits["truncated"], hits["reason"], len(hits["matches"])) == (True, "hits", 3)
    few = filesearch.grep(spark, root, "limit", glob="*.py", most_bytes=2000, most_files=1)
    assert (few["reason"], few["scanned"], {m["path"] for m in few["matches"]}) == ("files", 1, {"a/one.py"})
    assert filesearch.grep(spark, root, "limit", glob="*.md")["scanned"] == 1
    assert filesearch.grep(spark, root, "nothing like it")["matches"] == []
    with pytest.raises(ValueError, match="leave the root"):
        filesearch.grep(spark, root, "x", glob="../*.py")


def test_a_slow_search_is_stopped(spark, root):
    got = filesearch.grep(spark, root, "(x+x+)+y", glob="two.py", most_seconds=0.0)
    assert (got["truncated"], got["reason"]) == (True, "time")
