import random

from quarry.llm import line_dedup as q

from .helpers import awkward, clashing, empty


def slow(rows, words=q.WORDS):
    """Texts after deletion, for rows (doc_id, text) in the order of their ids: all pairs of places, matched line by
    line as far as they are equal."""
    docs = [[(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()] for _, text in rows]
    gone = [set() for _ in rows]
    for e, later in enumerate(docs):
        for d in range(e + 1):
            for j in range(len(later)):
                for i in range(len(docs[d]) if d < e else j):
                    n = 0
                    while i + n < len(docs[d]) and j + n < len(later) and docs[d][i + n][1] == later[j + n][1] and (d < e or n < j - i):
                        n += 1
                        if n >= 3 or words is not None and sum(len(later[j + k][1].split()) for k in range(n)) >= words:
                            gone[e].update(later[j + k][0] for k in range(n))
    return ["\n".join(x for i, x in enumerate(text.split("\n")) if i not in g) for (_, text), g in zip(rows, gone)]


def check(spark, rows, words):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in q.dedup_lines(docs, words=words).collect()}
    assert [got[i] for i, _ in rows] == slow(rows, words)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    check(spark, [(i, "\n".join(rng.choice(["a", "b", "c", " d ", "", "e f"]) for _ in range(rng.randint(0, 14)))) for i in range(120)], None)


def test_overlaps_equal_brute_force(spark):
    """Few different lines, so that runs overlap themselves."""
    rng = random.Random(4)
    for words in (None, 3, 8):
        check(spark, [(i, "\n".join(rng.choice(["a", "a", "b", "one two", "x y z w"]) for _ in range(rng.randint(0, 12)))) for i in range(60)], words)


def test_a_kept_run_stays_whole(spark):
    rows = [(1, "a\na\na\na\nb"), (2, "p\np\np\np\np\np"), (3, "k\nl\nk\nl\nk\nl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in q.dedup_lines(docs).collect()} == {1: rows[0][1], 2: "p\np\np", 3: rows[2][1]}


def test_a_hot_line_is_joined_as_a_cold_one(spark, monkeypatch):
    from quarry.llm import common

    rows = [(i, f"own {i}\nthe same long line is in all of these many documents\n{i} own") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(r.doc_id, r.text) for r in q.dedup_lines(docs).orderBy("doc_id").collect()]
    join = common.join_first
    monkeypatch.setattr(q, "join_first", lambda rows, first, keys: join(rows, first, keys, least=50))
    assert [(r.doc_id, r.text) for r in q.dedup_lines(docs).orderBy("doc_id").collect()] == want
    assert want[0][1] == rows[0][1] and want[5][1] == "own 5\n5 own"


def test_minima_guarantee():
    rng = random.Random(1)
    for _ in range(200):
        g = [rng.randrange(9) for _ in range(rng.randint(1, 20))]
        for w in (1, 2, 5):
            at = q.select_minima(g, w)
            assert all(any(i <= p < i + w for p in at) for i in range(len(g) - w + 1))


def test_cases(spark):
    run = "l one\nl two\nl three\nl four"
    docs = clashing(awkward(spark, [(20, run, "en", "s", 1), (21, "new\n" + run + "\nend", "en", "s", 1), (None, run, "en", "s", 1)]))
    out = q.dedup_lines(docs, removed_col="n_removed")
    assert out.columns == [*docs.columns, "n_removed"] and out.count() == docs.count()
    rows = out.select("doc_id", "text", "n_removed").collect()
    by = {r.doc_id: r for r in rows}
    assert by[21].text == "new\nend" and by[21].n_removed == 4 and by[20].text == ""
    assert [r.text for r in rows if r.doc_id is None and r.text and r.text.startswith("l")] == [run]  # null ids are first
    assert by[1].text is None and by[2].text == ""
    assert [r.n_removed for r in rows if r.doc_id == 7] == [0, 0]
    assert q.dedup_lines(empty(spark)).count() == 0


def test_short_runs_go_by_words(spark):
    rng = random.Random(5)
    for words in (2, 4, 8):
        check(spark, [(i, "\n".join(rng.choice(["a", "b", " d ", "", "e f", "g h i", "k l m n o"]) + rng.choice(["", " x", " y"]) for _ in range(rng.randint(0, 8)))) for i in range(100)], words)


def test_one_long_line_goes_at_the_defaults(spark):
    line = "This text is under a license that all the others have as well"
    docs = spark.createDataFrame([(1, line), (2, "own words\n" + line + "\nmore own"), (3, line[:30] + "\nsix words more are in here"), (4, line[:30])], "doc_id long, text string")
    assert {r.doc_id: r.text for r in q.dedup_lines(docs).collect()} == {1: line, 2: "own words\nmore own", 3: line[:30] + "\nsix words more are in here", 4: line[:30]}
