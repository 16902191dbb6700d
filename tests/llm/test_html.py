import math
from collections import Counter, defaultdict

from lexigraph.llm import html_extract

PAGE = """<!doctype html><html><head><title>A page</title><style>p {x}</style></head><body>
<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a><li><a href=/c>About</a></ul></nav>
<div class="main"><h1>The heading</h1>
<p>First paragraph, long enough to count: it has <b>bold</b> words, commas, and stops. It goes on; and on.
<p>Second paragraph &amp; more text, with punctuation. It is as long as the first one, or nearly so, anyway.</p>
<p>A third one closes the text, and it too says a lot. So much for this, then. Goodbye, reader!</p></div>
<script>var x = "<p>not text</p>";</script>
<footer><span>Terms</span> <span>Privacy</span> <span>Imprint</span></footer></body></html>"""


def test_page():
    text, n_nodes, n_content = html_extract.extract(PAGE)
    lines = text.split("\n")
    assert lines[-3].startswith("First paragraph") and "has bold words" in lines[-3] and "Second paragraph & more" in lines[-2] and lines[-1].endswith("reader!")
    assert "Home" not in text and "Privacy" not in text and "not text" not in text and 0 < n_content < n_nodes


def by_plain_loops(nodes, strength):
    """The same scores, one node at a time."""
    length, marks, of = defaultdict(list), defaultdict(list), [p for p, _, _ in nodes]
    for p, _, t in nodes:
        length[p].append(len(t))
        marks[p].append(sum(c in ".,;:!?…。、，！？；：" for c in t))
    fused = {}
    smooth = {}
    for name, value in (("length", length), ("marks", marks)):
        ratio = [sum(value[p]) / len(value[p]) for p in of]
        along = defaultdict(list)
        for i, p in enumerate(of):
            near = [(ratio[j], math.exp(-0.5 * (i - j) ** 2)) for j in range(max(0, i - 2), min(len(of), i + 3))]
            along[p].append(sum(r * w for r, w in near) / sum(w for _, w in near))
        smooth[name] = {p: sum(x) / len(x) for p, x in along.items()}
    fused = {p: smooth["length"][p] * math.sqrt(1 + smooth["marks"][p]) for p in length}
    values = [fused[p] for p in of]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return [fused[p] >= min(strength * spread, max(fused.values())) for p in of]


def test_scores_equal_plain_loops():
    for page in (PAGE, PAGE * 2, "<p>one", "<div><p>a. b.</p>x<p>" + "long text, " * 30 + "</div><i>z</i>"):
        nodes = html_extract.text_nodes(page)
        want = by_plain_loops(nodes, html_extract.STRENGTH)
        assert html_extract.extract(page)[1:] == (len(nodes), sum(want))


def test_tag_paths():
    assert [(p, t) for p, _, t in html_extract.text_nodes("<ul><li>a<li>b<ul><li>c</ul></ul><p>d<div>e</p>f")] == [("ul/li", "a"), ("ul/li", "b"), ("ul/li/ul/li", "c"), ("p", "d"), ("div", "e"), ("div", "f")]
    assert [p for p, _, _ in html_extract.text_nodes('<TABLE><tr><td a=">">x<td>y<tr><th>z</table>')] == ["table/tr/td", "table/tr/td", "table/tr/th"]


def test_pages_of_all_kinds(spark):
    deep = "<div>" * 3000 + "inside, deep down." + "</div>" * 3000
    pages = [(1, None), (2, ""), (3, "no tags at all"), (4, "<p>never closed"), (5, "<!-- never closed"), (6, "<script>x"), (7, "a < b & c &amp; d &bogus; <"), (8, deep), (None, PAGE), (9, "<p>" + "word. " * 200_000 + "</p>"), (10, "</div></p><br/><img>"), (11, "\x00<p>�</p>"), (12, PAGE), (12, PAGE)]
    df = spark.createDataFrame([(i, h, "u", "t") for i, h in pages], "page_id long, html string, url string, text string")
    rows = html_extract.extract_pages(df).collect()
    got = {r["page_id"]: r for r in rows}
    assert Counter(r["page_id"] for r in rows) == Counter(i for i, _ in pages)
    assert [(got[i]["text"], got[i]["n_nodes"]) for i in (1, 2, 5, 6, 10)] == [("", 0)] * 5
    assert got[3]["text"] == "no tags at all" and got[4]["text"] == "never closed" and got[8]["text"] == "inside, deep down." and got[7]["text"].startswith("a < b & c & d")
    assert len(got[9]["text"]) == 1_199_999 and got[None]["text"] == got[12]["text"] != ""
    assert html_extract.extract_pages(df.limit(0)).count() == 0
