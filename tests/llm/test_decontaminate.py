import random

from quarry.llm import decontaminate as q

from .helpers import awkward, clashing, empty

ITEMS = "item_id long, text string"
ITEM = "A train leaves the old station at 7 in the morning and covers 120 km before it stops, so how far is it from the start after 3 hours"


def found(spark, docs, items):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(items)], ITEMS)
    return {(r.doc, r.item): r for r in q.leaks(docs, items).collect()}


def test_copies_and_new_parameters(spark):
    again = ITEM.replace("7", "9").replace("120", "80.5").replace("3", "4")
    got = found(spark, ["Before it. " + ITEM + " and after", "intro words here " + again + ".", "nothing to see in this text at all, really nothing, not one word of it"], [ITEM])
    assert set(got) == {(0, 0), (1, 0)}
    assert got[(0, 0)].exact and not got[(1, 0)].exact and got[(1, 0)].n_slots >= 3


def test_slots_must_map_one_to_one(spark):
    item = "the farmer has 5 cows and 5 pigs in the yard while the miller has 8 cows and 8 pigs in the barn behind it"
    good = item.replace("5", "6").replace("8", "9")
    bad = "the farmer has 5 cows and 6 pigs in the yard while the miller has 6 cows and 7 pigs in the barn behind it"
    got = found(spark, [good, bad], [item])
    assert set(got) == {(0, 0)}


def test_every_place_and_length_is_found(spark):
    rng = random.Random(6)
    for n in (5, 7, 10, 11, 12, 16, 40):
        item = " ".join(f"q{rng.randrange(10**6)}z" for _ in range(n))
        docs = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(k)) + " " + item + " tail words" for k in range(0, 9)]
        assert len(found(spark, docs, [item, "unrelated item text that no document holds anywhere at all"])) == 9


def test_brute_force_on_tables(spark, sf):
    got = q.query(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    want = {(d, i) for i, t in zip(items.item_id, items.text) for d in docs.doc_id[docs.text.str.contains(t, regex=False)]}
    assert want <= set(zip(got.doc_id, got.item_id)) and len(want) > 0
    assert len(got) <= 1.2 * len(want) + 2


def test_native_plan(spark, sf):
    plan = q.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shuffled_index(spark):
    docs = spark.createDataFrame([(0, "x " + ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(0, ITEM)], ITEMS)
    assert q.leaks(docs, items, broadcast_rows=0).count() == 1


def test_cases(spark):
    items = spark.createDataFrame([(0, None), (1, ""), (2, "too short"), (None, ITEM), (3, "5 6 7 8 9 10 11 12 13 14 15 16 17 18")], ITEMS)
    docs = clashing(awkward(spark, [(40, ITEM, "en", "s", 1), (40, ITEM, "en", "s", 1), (None, ITEM, "en", "s", 1), (41, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "en", "s", 1), (42, "\x01 \x02 odd \x03 marks", "en", "s", 1)]))
    got = q.leaks(docs, items).collect()
    assert {(r.doc, r.item) for r in got} == {(40, None), (None, None)} and len(got) == 2
    out = q.remove(docs, items)
    assert out.columns == docs.columns and out.count() == docs.count() - 3
    assert q.leaks(empty(spark), items).count() == 0 and q.leaks(docs, items.limit(0)).count() == 0


def test_both_token_forms_agree(spark):
    texts = [ITEM, "Later Mrs O'Brien paid $5.50 to John Smith, then 30% more; 5km 7 miles, 3/4 cups!", "É über, Ärger 12 Grams and 5 grams", "", "... 1,000.5 MHz x5y 2nd"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    for r in df.select(q.template(F.col("t")).alias("a"), q.slots(F.col("t")).alias("b")).collect():
        assert [x if x[0] > "\x03" else x[0] for x in r.b] == r.a


def test_partial_quotes_are_found_at_every_place(spark):
    item = " ".join("q" + chr(97 + i % 26) * (1 + i // 26) for i in range(40))
    part = " ".join(item.split()[11:24])
    docs = ["other " * k + " " + part + " tail words" for k in range(8)] + ["start " + " ".join(item.split()[11:23]) + " tail words"]
    got = found(spark, docs, [item])
    assert set(got) == {(i, 0) for i in range(8)} and {r.n_covered for r in got.values()} == {13}


def test_slots_may_take_one_value_and_conflicts_cost_their_windows_alone(spark):
    item = "the farmer has 3 apples and 7 pears in the yard while the miller has 8 cows in the large barn just behind it"
    equal = item.replace("3", "5").replace("7", "5")
    twice = "the farmer has 5 cows and a dog in the yard while the miller has 5 pigs in the large barn just behind the old mill of this town"
    got = found(spark, [equal, twice.replace("5 cows", "6 cows")], [item, twice])
    assert set(got) == {(0, 0), (1, 1)} and not got[(0, 0)].exact and not got[(1, 1)].exact
    n = len(twice.split())
    assert got[(0, 0)].n_covered == len(item.split()) and n - 8 <= got[(1, 1)].n_covered < n


def test_partial_runs_of_every_length_equal_brute_force(spark):
    """Items of 1 to 40 tokens, runs of them of every kind of length, at every offset modulo 8."""
    rng = random.Random(8)
    name = lambda x: chr(97 + x % 26) * (1 + x // 26)
    items = [[f"{name(n)}z{name(k)}" for k in range(n)] for n in range(1, 41)]
    docs, want = [], set()
    for n, item in enumerate(items, 1):
        for k in sorted({1, n // 2, (n + 1) // 2, n, *(x for x in (4, 7, 8, 9, 12, 13, 14) if x <= n)} - {0}):
            start, offset = rng.randrange(n - k + 1), rng.randrange(8)
            if k == n if n < q.WINDOW else k >= q.WINDOW and k >= min(q.COVERED, n * q.SHARE):
                want.add((len(docs), n - 1))
            docs.append(" ".join(["lead"] * offset + item[start : start + k] + ["tail"] * 3))
    assert set(found(spark, docs, [" ".join(x) for x in items])) == want and len(want) > 100


def test_short_and_dense_items_are_matched_by_their_values(spark):
    items = ["What is 12 times 17?", "Zip codes: 10115, 20095, 80331, 50667, 60311, 70173, 40213, 44135", "two words"]
    docs = ["He asked: What is 12 times 17? Nobody knew", "a list 10115 20095 80331 50667 60311 70173 40213 44135 but Zip codes stand elsewhere", "some text with two words of mine", "what is 12 times 18?",
            "Zip codes: 10115, 20095, 80331, 50667, 60311, 70173, 40213, 44135", "Zip codes: 10115, 20095, 80331, 99999, 60311, 70173, 40213, 44135"]
    got = set(found(spark, docs, items))
    assert {(0, 0), (2, 2), (4, 1)} <= got and not {(1, 1), (5, 1)} & got


def test_a_first_word_is_found_within_a_sentence(spark):
    item = "What is the capital of the old republic"
    assert set(found(spark, ["so I ask you: What is the capital of the old republic", "then, tell me What is the capital of the old republic", item], [item])) == {(0, 0), (1, 0), (2, 0)}


def test_rows_of_one_item_are_forms_of_it(spark):
    items = spark.createDataFrame([(0, ITEM), (0, "an other question with more than eight plain words in it"), (0, ITEM)], ITEMS)
    docs = spark.createDataFrame([(0, ITEM), (1, "it reads an other question with more than eight plain words in it")], "doc_id long, text string")
    got = q.leaks(docs, items).collect()
    assert sorted((r.doc, r.item) for r in got) == [(0, 0), (1, 0)]
