import random

from quarry.llm import unit_dedup as q

from .helpers import awkward, clashing, empty


def slow(rows, min_words):
    """{id: [(start, end)]} of rows (id, text) in order of id."""
    seen, out = set(), {}
    for i, text in rows:
        runs = []
        for no, (a, b, normal) in enumerate(q.units(text)):
            if normal in seen:
                if runs and runs[-1][0] + runs[-1][1] == no:
                    runs[-1][1:] = [runs[-1][1] + 1, runs[-1][2], b, runs[-1][4] + len(normal.split())]
                else:
                    runs.append([no, 1, a, b, len(normal.split())])
            seen.add(normal)
        spans = [(r[2], r[3]) for r in runs if r[4] >= min_words]
        if spans:
            out[i] = spans
    return out


def test_units():
    text = " One two. Three!  Four\n\nFive... six? v1.2 is.\tLast"
    assert [text[a:b] for a, b, _ in q.units(text)] == ["One two.", "Three!", "Four", "Five...", "six?", "v1.2 is.", "Last"]
    assert [n for *_, n in q.units("A  b\nC", sentences=False)] == ["a b", "c"]
    assert len(list(q.units("." * 200_000 + "x"))) == 1


def test_equals_brute_force(spark):
    rng = random.Random(8)
    for min_words in (0, 4):
        rows = [(i, "".join(rng.choice(["A b c. ", "d e! ", "f\n", "G h i j k. ", "l? ", "m  n. "]) for _ in range(rng.randint(0, 9)))) for i in range(150)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {}
        for r in q.repeats(docs, min_words=min_words).collect():
            got.setdefault(r.doc, []).append((r.start, r.end))
        assert {i: sorted(x) for i, x in got.items()} == slow(rows, min_words)


def test_passages_inside_lines_are_found_and_offsets_kept(spark):
    passage = " ".join("Some words of sentence %d stand here now." % i for i in range(10))
    rows = [(1, "Intro of the first. " + passage + " end"), (2, "other beginning without stop " + passage + " and more."), (3, "Clean text that nobody else has, about nothing at all in particular, ever.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in q.apply(docs).collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1] and out[1].removed == []
    assert len(out[2].text) < 120
    text = rows[1][1]
    assert "".join(text[s.start : s.end] for s in out[2].kept) == out[2].text
    assert out[2].removed[0].end - out[2].removed[0].start > 300
    kept = q.repeats(docs).first()
    assert kept.kept_doc == 1 and rows[0][1][kept.kept_start :].startswith("Some words of sentence 1")


def test_cases(spark):
    long = " ".join(f"unit words number {i} are here." for i in range(20))
    docs = clashing(awkward(spark, [(70, long, "en", "s", 1), (71, long, "en", "s", 1), (71, long, "en", "s", 1), (None, long, "en", "s", 1)]))
    out = q.apply(docs)
    rows = out.select("doc_id", "text", "removed").collect()
    assert len(rows) == docs.count() and set(docs.columns) <= set(out.columns)
    assert [r.text for r in rows if r.doc_id == 71] == ["", ""] and [r.text for r in rows if r.doc_id is None and r.text.startswith("unit")] == [long]
    assert [r.text for r in rows if r.doc_id == 70] == [""] and [r.text for r in rows if r.doc_id == 1] == [None]
    assert len([1 for r in rows if r.doc_id == 7 and r.removed == []]) == 2
    assert q.repeats(empty(spark)).count() == 0


def test_a_long_text_with_many_removed_runs(spark):
    """Every other unit of a long text repeats one of another document; non-ASCII, so offsets are code points."""
    units = [f"Größe {i} ist hier zu lesen." for i in range(20_000)]
    other = " ".join(x if i % 2 else f"own {i} stays." for i, x in enumerate(units))
    docs = spark.createDataFrame([(1, " ".join(units)), (2, other)], "doc_id long, text string")
    out = {r.doc_id: r for r in q.apply(docs, min_words=0).collect()}
    assert out[1].text == " ".join(units) and len(out[2].removed) == 10_000
    assert out[2].text.split() == " ".join(f"own {i} stays." for i in range(0, 20_000, 2)).split()
    assert "".join(other[s.start : s.end] for s in out[2].kept) == out[2].text
