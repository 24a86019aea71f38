"""Places where a training-data query once did less than the whole job."""


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_p6_sentences_run_over_lines_and_pages(spark, tmp_path):
    from palimpsest.llm import queries

    body = ["The first line of the page stands here and", "goes on. A second one begins on this line", "and is still open at the foot of the page"]
    more = ["when the next page takes it up again. And", "a third one has no end before the volume ends"]
    lines = [(k + 1, "V", 1, k + 1, "body", t) for k, t in enumerate(body)] + [(9, "V", 1, 4, "notes", "a note of its own without any stop at all"), (5, "V", 2, 1, "body", more[0]), (6, "V", 2, 2, "body", more[1]), (7, None, None, 1, "body", "a line that has no page"), (8, "V", 2, 2, "body", more[1])]
    d = written(
        spark,
        tmp_path,
        page_lines=(lines, "line_id long, volume string, page int, line_no int, zone string, text string"),
        addenda_munich=([(1, ["One here. Two there."])], "addenda_id long, text array<string>"),
        common_words=([("en", "the"), ("en", "of")], "lang string, word string"),
    )
    found = {(r["tbl"], r["row_id"], r["sentence_no"]): r["sentence"] for r in queries.QUERIES["p6_sentences"](spark, d).collect()}
    assert found == {
        ("addenda_munich", 1, 0): "One here.",
        ("addenda_munich", 1, 1): "Two there.",
        ("page_lines", 1, 0): body[0] + "\ngoes on.",
        ("page_lines", 2, 1): "A second one begins on this line\n" + body[2] + "\nwhen the next page takes it up again.",
        ("page_lines", 5, 2): "And\n" + more[1],
        ("page_lines", 9, 0): "a note of its own without any stop at all",
        ("page_lines", 7, 0): "a line that has no page",
    }


def test_p2_pages_hold_a_word_broken_over_pages_once(spark, tmp_path):
    from palimpsest.llm import queries

    long = "standing words fill the whole width of it"
    tokens = [(k, "V", page, k, w, k in (1, 7)) for page, row in ((1, "some plain words stand here frag-"), (2, "ment goes on over the page"), (3, "open to the last frag-")) for k, w in enumerate(row.split(), 1)]
    lines = [(1, "V", 1, 1, "body", long), (2, "V", 1, 2, "body", "and its last word is bro-"), (3, "V", 1, 3, "notes", "a note below"), (4, "V", 2, 1, "body", "ken over the page and goes"), (5, "V", 2, 2, "body", long)]
    words = "some plain words stand here fragment goes on over the page open to last standing fill whole width of it and its word is broken a note below".split()
    d = written(
        spark,
        tmp_path,
        tokens=([(n, *t[1:]) for n, t in enumerate(tokens)], "token_id long, volume string, page int, pos int, text string, nl boolean"),
        page_lines=(lines, "line_id long, volume string, page int, line_no int, zone string, text string"),
        addenda_munich=([(1, ["plain words"])], "addenda_id long, text array<string>"),
        corpus=([("en", " ".join(words))], "lang string, text string"),
        common_words=([("en", "the")], "lang string, word string"),
    )
    found = {(r["tbl"], r["page"]): r["text"] for r in queries.QUERIES["p2_pages"](spark, d).collect()}
    assert found["tokens", 1] == "some plain words stand here" and found["tokens", 2] == "fragment goes on over the page"
    assert found["tokens", 3] == "open to the last frag-"  # nothing follows
    assert found["page_lines", 1] == long + " and its last word is\na note below"
    assert found["page_lines", 2] == "broken over the page and goes " + long


def test_p3_canonical_takes_garbled_texts_ligatures_and_any_two_scripts(spark, tmp_path):
    from palimpsest.llm import queries

    hebrew = "שלום דברים"
    garbled = hebrew.encode().decode("latin-1")
    d = written(
        spark,
        tmp_path,
        gold=([(1, garbled), (2, "plain")], "gold_id long, text string"),
        tokens=([(1, "ﻻ"), (2, "ﷲ"), (3, "Ωж"), (4, "שب"), (5, "Ω ж ש")], "token_id long, text string"),
        addenda_munich=([(1, ["one"])], "addenda_id long, text array<string>"),
        corpus=([("he", hebrew)], "lang string, text string"),
        common_words=([("en", "the")], "lang string, word string"),
    )
    rows = {(r["tbl"], r["row_id"]): (r["canonical"], r["disguised"]) for r in queries.QUERIES["p3_canonical"](spark, d).collect()}
    assert rows["gold", 1] == (hebrew, False) and len(rows) == 8
    assert rows["tokens", 1] == ("لا", True) and rows["tokens", 2] == ("الله", True)
    assert [rows["tokens", k][1] for k in (3, 4, 5)] == [True, True, False]
    found = {(r["tbl"], r["row_id"]) for r in queries.QUERIES["p3_found"](spark, d).collect()}
    assert found == {("tokens", k) for k in (1, 2, 3, 4)}


def test_p9_mean_word_length_counts_letters_of_words_only(spark):
    from palimpsest.llm import quality

    docs = spark.createDataFrame([(1, "ab cd"), (2, "  ab      cd\n\n\n\t ef \n"), (3, "")], "doc_id int, text string")
    found = {r["doc_id"]: r["mean_word_length"] for r in quality.with_measures(docs, []).collect()}
    assert found == {1: 2.0, 2: 2.0, 3: 0.0}
