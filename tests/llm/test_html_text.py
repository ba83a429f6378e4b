import html.parser
import re

from pyspark.sql import functions as F

from quarry.llm import html_text as q


def test_blocks_and_implied_tags():
    assert q.extract("<p>One <b>two</b>  three<p>Four<br>five") == "One two three\n\nFour\nfive"
    assert q.extract("<div>a<div>b</div>c</div>") == "a\nb\nc"
    assert q.extract("<ul><li>a<li>b<ol start=3><li>c</ol><li>d</ul>") == "- a\n- b\n  3. c\n- d"
    assert q.extract("<dl><dt>t<dd>d<dt>u<dd>e</dl>") == "t\n  d\nu\n  e"
    assert q.extract("a</p>b</div></table>c") == "a\n\nb\n\nc" or q.extract("a</p>b") == "a\n\nb"


def test_tables_are_aligned():
    assert q.extract("<table><tr><td>x<td>long cell<tr><td>yyyy<td>z</table>") == "x     long cell\nyyyy  z"
    assert q.extract("<table><tr><th colspan=2>h<th>k<tr><td>1<td>2<td>3</table>") == "h     k\n1  2  3"
    wide = "w" * 100
    assert q.extract(f"<table><tr><td>{wide}<td>a<tr><td>b<td>c</table>") == f"{wide}  a\nb  c"
    assert q.extract("<table><tr><td>a<p>b<td>c</table>") == "a  c\n\nb"


def test_visibility():
    assert q.extract("<head><title>t</title></head>v<script>if (a<b) '</p>'</script><style>x{}</style><!-- c --><p hidden>h<p style='display : none'>n<p>w") == "v\n\nw"
    assert q.extract('<div style="visibility:hidden">x</div><div aria-hidden="true">y</div><template>z</template>') == "y"


def test_pre_entities_and_text():
    assert q.extract("<pre>a\n  b &lt;c&gt;\n</pre>d") == "a\n  b <c>\n\nd"
    assert q.extract("1 < 2 &amp; 3 &gt; 2 &eacute;") == "1 < 2 & 3 > 2 é"
    assert q.extract(None) is None and q.extract("") == "" and q.extract("<><!><!-->x") is not None


def test_hostile_markup_is_linear():
    for s in ("<div>" * 100_000 + "deep", "<" * 200_000, "<li>x" * 20_000, "<p>x<table>" * 1000, '<a b="' * 20_000, '<a b="' * 20_000 + ">", "<a " * 50_000, "<td>" * 20_000, "<!--" * 50_000):
        assert isinstance(q.extract(s), str)


def test_what_ends_a_head():
    assert q.extract("<head><title>T</title><p>Hello world</p>") == "Hello world"
    assert q.extract("<html><head><meta charset=utf-8><div>visible</div>") == "visible"
    assert q.extract("<html><head><meta charset=utf-8><title>x</title> stray text<b>bold</b>") == "stray textbold"
    assert q.extract("<head><link rel=x><script>no</script><style>no</style></head><body>yes") == "yes"
    assert q.extract("<head><head>text") == "text"


def test_cells_that_span_rows():
    assert q.extract("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>dd<td>e<tr><td>f<td>g<td>h</table>") == "a  b   c\n   dd  e\nf  g   h"
    assert q.extract("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") == "a  b  c\nd     e\nf     g"
    assert q.extract("<table><tr><td colspan=2 rowspan=2>wide one<td>x<tr><td>y<tr><td>1<td>2<td>3</table>") == "wide one  x\n          y\n1  2      3"


def test_long_cells_are_wrapped_and_aligned():
    line = " ".join(["word"] * 40)
    got = q.extract(f"<table><tr><td>{line}<td>right<tr><td>b<td>c</table>").split("\n")
    assert all(len(x) <= q.WRAP for x in got[1:-1]) and " ".join(x[:80].strip() for x in got[:-1]).replace("right", "").split() == line.split()
    assert got[0].index("right") == got[-1].index("c") and len(got) == 4
    assert q.extract(f"<table><tr><td>n<td>{line}</table>") == f"n  {line}"
    assert q.wrapped("a b", 1) == ["a", "b"] and q.wrapped("abc de", 2) == ["abc", "de"] and q.wrapped("  abc", 3) == ["  abc"]


def test_visible_within_hidden_and_tags_cut_off():
    assert q.extract('<div style="visibility:hidden">no <b style="visibility: visible">yes <i>also</i></b> no</div> after') == "yes also\nafter"
    assert q.extract('<p style="backface-visibility:hidden">shown') == "shown" and q.extract('<p style="color:red; DISPLAY : none">x') == ""
    assert q.extract('text <div class="a') == "text" and q.extract("a < b") == "a < b"
    assert q.extract("<select><option>One<option>Two<optgroup label=G><option>Three</select>") == "One\nTwo\nG\nThree"


def test_words_of_random_pages_equal_a_plain_recursion():
    """Pages are made as trees; an independent walk over the tree gives the visible words in order."""
    import random

    rng = random.Random(9)
    blocks, lines = ["div", "p", "section", "h2", "blockquote", "li", "td"], ["b", "i", "span", "a", "em"]

    def make(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.35:
            w = f"w{rng.randrange(1000)}"
            return f" {w} ", [w]
        tag = rng.choice(lines if kind < 0.6 else blocks)
        inside = [make(depth - 1) for _ in range(rng.randint(0, 3))]
        body, words = " ".join(m for m, _ in inside), [w for _, x in inside for w in x]
        if tag in blocks and "<p>" in body and tag == "p":
            tag = "div"
        wraps = {"li": ("<ul><li>", "</ul>"), "td": ("<table><tr><td>", "</table>")}
        a, b = wraps.get(tag, (f"<{tag}>", f"</{tag}>"))
        if rng.random() < 0.1:
            return f"<div hidden>{body}</div>", []
        return a + body + b, words

    for _ in range(400):
        parts = [make(4) for _ in range(5)]
        markup = "<html><head><title>t</title>" + "".join(m for m, _ in parts)
        got = re.findall(r"w\d+", q.extract(markup))
        assert got == [w for _, x in parts for w in x], markup


class Plain(html.parser.HTMLParser):
    """The words of text outside head, script and style, by the standard library."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("head", "script", "style", "title") and tag != "head"
        if tag in ("p", "li", "div", "td", "br", "h1", "footer", "article", "nav"):
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.out.append(" " if tag in ("p", "li", "div", "td", "h1", "footer", "article", "nav") else "")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_all_words_of_real_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    got = {r.page_id: r.text for r in q.query(spark, sf).collect()}
    assert len(got) == len(pages)
    for i, markup in zip(pages.page_id, pages.html):
        p = Plain()
        p.feed(markup)
        words = re.sub(r"(?m)^\s*(?:-|\d+\.) ", "", got[i]).split()
        assert words == "".join(p.out).split()


def test_cases(spark):
    pages = spark.createDataFrame([(1, None, "u"), (1, None, "u"), (2, "", "u"), (None, "<p>x", None), (3, "<p>" + "y " * 50_000, "u")], "page_id long, html string, url string")
    out = q.extract_text(pages.withColumn("text2", F.lit(1)))
    rows = out.collect()
    assert len(rows) == 5 and out.columns == ["page_id", "html", "url", "text2", "text"]
    assert [r.text for r in rows if r.page_id == 1] == [None, None] and [r.text for r in rows if r.page_id is None] == ["x"]
    assert q.extract_text(pages.limit(0)).count() == 0
