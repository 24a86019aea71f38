"""Arbitration, collation and mending against their rules, read off word by word."""

import random

from palimpsest.operators import alignment, collation, repair, similarity, witness

WORDS = ["שלום", "דברים", "רבים", "ספר", "מלכים", "ארץ", "ישראל", "כתב", "אדם", "גדול"]
RANK = {"eye": 0, "layer": 1, "tesseract": 2}
KEY = ["volume", "page"]


def lexicon(spark, words=WORDS):
    from palimpsest.functions import normal

    return spark.createDataFrame([(w, 5) for w in words], "w string, n long").select(normal.fold("w").alias("word"), "n")


def noisy(words, rng):
    out = []
    for w in words:
        turn = rng.random()
        if turn < 0.08:
            continue
        out.append(w[:-1] + "ז" if turn < 0.2 else w)
        if turn > 0.92:
            out.append(rng.choice([*WORDS, "ינטרנט"]))
    return out


def inserted_by_rule(base, others, by):
    """Words of V4 that the backbone lacks: {place: the words taken}."""
    adds = []
    for words in others:
        extra, at = {}, 0
        for i, j in alignment.align(base, words):
            if i is None:
                extra.setdefault(at, []).append(words[j])
            else:
                at = i + 1
        adds.append(extra)
    out = {}
    for place in range(len(base) + 1):
        runs = [a.get(place, []) for a in adds]
        if any(runs):
            best = min(range(len(runs)), key=lambda t: (RANK[by[t]], -len(runs[t])))
            rest = {alignment.bare(w) for t, r in enumerate(runs) if t != best for w in r}
            out[place] = [(w, "most" if alignment.bare(w) in rest else "lex" if w in WORDS else "doubt") for w in runs[best]]
    return out


def test_arbitration_against_the_rule(spark):
    rng = random.Random(3)
    pages, want = [], {}
    for page in range(12):
        text = rng.choices(WORDS, k=rng.randint(1, 30))
        base, eye, other = (noisy(text, rng) or ["ספר"] for _ in range(3))
        pages.append(("V", page, base, "layer", [("eye", eye), ("tesseract", other)], [0]))
        want[page] = inserted_by_rule(base, [eye, other], ["eye", "tesseract"])
    frame = spark.createDataFrame(pages, "volume string, page int, backbone array<string>, by string, others array<struct<by:string,words:array<string>>>, opens array<int>")
    rows = witness.arbitrated(frame, lexicon(spark), KEY).collect()
    for page in range(12):
        own = [r for r in rows if r["page"] == page]
        assert sorted(r["at"] for r in own if r["part"] == 1) == list(range(len(pages[page][2])))
        assert [r["at"] for r in own if r["opens"]] == [0]
        got = {}
        for r in sorted((r for r in own if r["part"] == 0), key=lambda r: (r["at"], r["n"])):
            got.setdefault(r["at"], []).append((r["form"], r["why"]))
        assert got == {k: v for k, v in want[page].items() if v}
        for r in own:
            assert all(alignment.bare(a["form"]) != alignment.bare(r["form"]) for a in r["alt"] or ())
    assert witness.arbitrated(frame.limit(0), lexicon(spark), KEY).count() == 0


def test_collation(spark):
    base = "אב גד שלום דברים רבים ספר מלכים סוף".split()
    page = "זר שלזם דברים רביס ספר מלכין גדול שלום דברים".split()
    sound = [w in (*WORDS, "מלכין") for w in page]
    rows = [("V", 1, k, w, "keep", s, [], None) for k, (w, s) in enumerate(zip(page, sound))] + [("V", 2, 0, None, "doubt", False, None, None)]
    schema = "volume string, page int, at int, form string, why string, sound boolean, alt array<struct<form:string,witness:string>>, was string"
    frame = spark.createDataFrame(rows, schema)
    out = {(r["page"], r["at"]): r for r in collation.restored(frame, base, KEY, 3).collect()}
    # a quotation is seeded by two equal neighbours, and there are none
    assert all(r["why"] == "keep" for (p, _), r in out.items() if p == 1)
    page[3] = "רבים"
    rows = [("V", 1, k, w, "keep", s, [], None) for k, (w, s) in enumerate(zip(page, sound))]
    out = {r["at"]: r for r in collation.restored(spark.createDataFrame(rows, schema), base, KEY).collect()}
    assert [out[k]["why"] for k in range(9)] == ["keep"] + ["guide"] * 5 + ["keep"] * 3  # led back to the damaged first word
    assert (out[1]["form"], out[1]["was"], out[1]["mended"]) == ("שלום", "שלזם", True)
    assert out[5]["form"] == "מלכין" and [tuple(a) for a in out[5]["alt"]] == [("מלכים", "guide")] and out[5]["was"] is None
    assert collation.restored(frame.limit(0), base, KEY).count() == 0 and collation.restored(frame, [], KEY).count() == 10


def test_mending_in_its_order(spark):
    page = [
        ("דברים", "agree", True), ("דב|רים", "doubt", False), ("מלכ", "doubt", False), ("ים", "doubt", False), ("שלוז", "doubt", False), ("אדז", "agree", False),
        ("ספרארץ", "doubt", False), ("רבזים", "guide", False), ("כת", "doubt", True), ("ב", "doubt", True), ("xx", "doubt", False),
    ]
    rows = [("V", 1, k, f, w, o, [("a", "layer")] if k == 3 else None, None) for k, (f, w, o) in enumerate(page)]
    tokens = spark.createDataFrame(rows, "volume string, page int, at int, form string, why string, opens boolean, alt array<struct<form:string,witness:string>>, was string")
    seen = spark.createDataFrame([("V", 1, "דברימ")], "volume string, page int, bare string")
    seams = spark.createDataFrame([("V", 1, "ספר", "ארצ")], "volume string, page int, a string, b string")
    table = spark.createDataFrame([("ז", "מ", 3)], "a string, b string, n long")
    words = lexicon(spark)
    out = {r["at"]: r for r in repair.mended(tokens, seen, seams, words, words, table, table.limit(0), KEY).collect()}
    assert {k: r["how"] for k, r in out.items() if r["how"]} == {1: "closed", 2: "joined", 4: "replaced", 6: "split"}
    assert out[1]["form"] == "דברים" and out[1]["was"] == "דב|רים"
    assert out[2]["form"] == "מלכים" and out[2]["was"] == "מלכ ים" and [tuple(a) for a in out[2]["alt"]] == [("a", "layer")] and 3 not in out
    assert out[4]["form"] == "שלום" and out[6]["form"] == "ספר ארץ" and out[4]["why"] == "fix"
    assert out[5]["form"] == "אדז"  # sure, and the strong table knows nothing of it
    strong = {r["at"]: r for r in repair.mended(tokens, seen, seams, words, words, table, table, KEY).collect()}
    assert strong[5]["form"] == "אדם"
    misread = spark.createDataFrame([("אז", "אמ")] * 2, "`read` string, true string")
    rounds = {r["at"]: (r["how"], r["round"]) for r in repair.mended_rounds(tokens, seen, seams, words, words, misread, KEY).collect()}
    assert rounds[4] == ("replaced", 1) and rounds[0] == (None, 0) and len(rounds) == 10
    assert repair.mended(tokens.limit(0), seen, seams, words, words, table, table, KEY).count() == 0


def test_sequence_ratio(spark):
    rows = [(["a", "b", "c"], ["a", "c"]), ([], []), (None, ["a"]), (["a"], ["a"])]
    frame = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[0] for r in frame.select(similarity.sequence_ratio("a", "b")).collect()] == [0.8, 0.0, 0.0, 1.0]
