"""Places where a query once did less than the whole job."""

from palimpsest.operators import quotation
from palimpsest.plans import catalogue, edition  # noqa: F401  (it registers its queries in the catalogue)

LETTERS = "אבגדהוזחטיכלמנסעפצקרשת"


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_g4_counts_every_length_and_null_model(spark, tmp_path):
    own, near, far = LETTERS[:16], LETTERS[::-1][:13], (LETTERS[::2] + LETTERS[1::2])[:10]
    d = written(
        spark,
        tmp_path,
        units=([("u", "V", 1, 1, 1, 1), ("x", "V", 9, 9, 2, 1)], "unit_id string, volume string, part_no int, chapter int, page int, token_at int"),
        # the word before the unit's start and those behind the next unit's are not the unit's
        tokens=([(1, "V", 1, 1, own), (2, "V", 1, 2, own), (3, "V", 1, 3, near), (4, "V", 2, 1, far), (5, "V", 2, 2, own)], "token_id long, volume string, page int, pos int, text string"),
        corpus=([("g", "ch", "he", 1, 1, 1, own), ("g", "ch", "he", 1, 2, 1, near), ("g", "ch", "de", 1, 2, 1, own)], "witness string, kind string, lang string, part_no int, chapter int, para_no int, text string"),
        gold=([(1, "ab " + far + " cd"), (2, far)], "gold_id long, text string"),
    )
    rows = {r["minlen"]: (r["hits"], r["random_null"], r["adjacent_null"], r["passages"]) for r in catalogue.QUERIES["ref_G4_calibration"](spark, d).collect()}
    assert rows == {10: (1, 1, 1, 1), 11: (1, 1, 1, 0), 12: (1, 1, 1, 0), 13: (1, 1, 1, 0), 14: (1, 0, 0, 0), 16: (1, 0, 0, 0)}


def test_g4_reads_each_length_by_itself():
    import random

    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("אבג") for _ in range(80)) for _ in range(2))
        assert quotation.run_counts(a, b) == [len(quotation.runs(a, b, n)) for n in quotation.LENGTHS]


def test_repairs_accept_prefixed_words_and_two_letters(spark):
    from palimpsest.operators import repair

    lex = spark.createDataFrame([("שלום", 5), ("דבר", 4)], "word string, n long")
    table = spark.createDataFrame([("ס", "ש", 20), ("ז", "ו", 2)], "a string, b string, n long")
    words = spark.createDataFrame([("וסלום", False), ("סלזם", False), ("סלזם", True), ("סלום", True)], "word string, protected boolean")
    found = {tuple(r) for r in repair.candidates(words, table, lex).collect()}
    # one letter behind a particle; two letters only where the form is free
    assert found == {("וסלום", False, "ושלום"), ("סלזם", False, "שלום"), ("סלום", True, "שלום")}
    seams = spark.createDataFrame([("ושלום", "הדבר")], "a string, b string")
    forms = spark.createDataFrame([("ושלוםהדבר",)], "word string")
    assert [tuple(r) for r in repair.splits(forms, seams, lex).collect()] == [("ושלוםהדבר", "ושלום", "הדבר")]
    assert {tuple(r) for r in repair.fixed_point(words, table, lex, lex).select("word", "fixed", "protected").collect()} == {("וסלום", "ושלום", False), ("סלזם", "שלום", False), ("סלום", "שלום", True)}


def gold(spark, folder):
    """Two passages of one text, one that shares a stretch with them and stands between them, one alone, and a null text."""
    shared, alone = LETTERS[:14], LETTERS[::-1]
    rows = [(1, "x " + shared), (2, shared + " z"), (3, "x " + shared), (4, alone), (5, None)]
    return written(spark, folder, gold=(rows, "gold_id long, text string"))


def broadcasts(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_seeds_are_not_broadcast_and_equal_texts_pair(spark, tmp_path):
    pairs = catalogue.QUERIES["ref_J1_seed_pairs"](spark, gold(spark, tmp_path))
    assert broadcasts(pairs) == 0
    assert {tuple(r) for r in pairs.collect()} == {(1, 2, 3), (1, 3, 3), (2, 3, 3)}


def test_texts_of_passages_are_not_broadcast_and_equal_texts_quote_each_other(spark, tmp_path):
    d = gold(spark, tmp_path)
    for name in ("ref_J1_quotations", "ref_J14_bijection"):
        spans = catalogue.QUERIES[name](spark, d)
        assert broadcasts(spans) == 0
        assert {tuple(r) for r in spans.collect()} == {(1, 2, 2, 16, 0, 14), (1, 3, 2, 16, 2, 16), (2, 3, 0, 14, 2, 16)}


def test_g4_counts_every_pair_of_equal_texts_and_broadcasts_no_passage(spark, tmp_path):
    d = gold(spark, tmp_path)
    written(
        spark,
        tmp_path,
        units=([("u", "V", 1, 1, 1, 1)], "unit_id string, volume string, part_no int, chapter int, page int, token_at int"),
        tokens=([(1, "V", 1, 1, "אב")], "token_id long, volume string, page int, pos int, text string"),
        corpus=([("g", "ch", "he", 1, 1, 1, "אב")], "witness string, kind string, lang string, part_no int, chapter int, para_no int, text string"),
    )
    assert broadcasts(catalogue._passage_pairs(spark, d, quotation.LENGTHS[0])) == 0
    counted = {r["minlen"]: r["passages"] for r in catalogue.QUERIES["ref_G4_calibration"](spark, d).collect()}
    assert counted == {10: 3, 11: 3, 12: 3, 13: 3, 14: 3, 16: 0}


def test_anchors_of_pages_beyond_21474(spark, tmp_path):
    d = written(spark, tmp_path, units=([("V", 1, 21475, 3), ("V", 1, 80000, 1), ("V", 2, 90000, 7)], "volume string, part_no int, page int, token_at int"))
    assert {tuple(r) for r in catalogue.QUERIES["ref_P10_anchors"](spark, d).collect()} == {("V", 1, 2147500003), ("V", 2, 9000000007)}
