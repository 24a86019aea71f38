"""Nested books in every shape of body."""

import json

from palimpsest.sources import transcript


def test_sections(spark):
    book = {
        "Introduction": ["first", ["<b>se</b>cond", "  "]],
        "Prefatory Remarks": "later wins \"quoted\"",
        "Part 1": [["a", ["b"]], [], "c"],
        "Part 2": {"Introduction": ["in"], "": [["x"], ["y", "z"]]},
        "Part 3 Introduction": ["third"],
        "Colophon": ["end"],
        "Index": [],
        "Appendix": "last",
    }
    frame = spark.createDataFrame([(json.dumps(book, ensure_ascii=False), 1), ("{}", 2), (None, 3)], "value string, n int").select("value")
    found = {r["key"]: r["paras"] for r in transcript.sections(frame).collect()}
    assert found == {
        "pref:0:0": ["later wins \"quoted\""],
        "ch:1:1": ["a", "b"],
        "ch:1:3": ["c"],
        "intro:2:0": ["in"],
        "ch:2:1": ["x"],
        "ch:2:2": ["y", "z"],
        "intro:3:0": ["third"],
        "other:0:0": ["last"],
    }
    assert transcript.sections(frame.limit(0)).count() == 0


def test_blocks_are_trimmed(spark):
    frame = spark.createDataFrame([("\n# T\n\n> n\n\n## page 1\n\n one \n\n",)], "value string")
    assert [tuple(r)[1:] for r in transcript.markdown_volume(frame).collect()] == [("title", "T"), ("note", "n"), ("page", "page 1"), ("paragraph", "one")]
