import html
import random
import re
from collections import Counter

import numpy as np

from barspan.llm import op11_html_main_text as op11
from barspan.llm import op11_layouts
from barspan.llm.htmltree import read

PAGE = "page_id long, url string, html string, text long, n_chars string"


def runs(source):
    p = read(source)
    return [t for t in p.text if t]


def test_reader_on_raw_markup():
    assert runs("<p>a<b>b</b> c<br>d<p>e &amp f&am<ul><li>1<li>2</ul>tail") == ["ab c d", "e & f&am", "1", "2", "tail"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table><script>if(a<b){'</p>'}</script>z") == ["a", "b", "c", "z"]
    assert runs("<a title='x>y' href=x>q</a> 1 < 2 <!-- <p>no --> <3 </ f> &lt;b&gt;&nbsp;x") == ["q 1 < 2 <3 <b> x"]
    assert runs("<div class='a' hidden>x</div><p title=\"unclosed >y</p>") == ["x", "y"]
    assert runs("<title>no</title><textarea>no</textarea><style>no") == []
    assert runs("") == runs(None) == []
    tags = [(t, k) for t, k in zip(*(lambda p: (p.tag, p.tokens))(read('<DIV Class="mainContent c-Post__body" ID=x1 style="display: none">a</DIV>')))]
    assert tags[0] == ("div", ("main", "content", "post", "body", "+hidden"))


def test_reader_survives_any_markup():
    rnd = random.Random(1)
    bits = ["<", ">", "<p>", "</p>", "<div ", "class='", '"', "'", "=", "<!--", "-->", "<script>", "</script", "<table><tr><td>", "</table>", "text ", "&amp;", "&#x41;", "&", "<li>", "</ul>", "<a href=x>", "\0", "<br/>", "<svg/>"]
    for _ in range(2000):
        read("".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40))))
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000 + "y"
    assert runs(deep) == ["x", "y"]


def overlap(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    both = sum((a & b).values())
    return 2 * both / max(1, sum(a.values()) + sum(b.values()))


def test_held_out_layouts():
    sources = op11_layouts.pages(300, seed=5)
    gold = []
    for h in sources:
        p = read(h)
        nodes = op11.Nodes([p])
        label, _ = op11._labels([p], nodes)
        gold.append(" ".join(t for t, k in zip(nodes.text, label) if t and k == op11.IN))
    model = op11.trained()
    got = model.main_texts(sources)
    scores = np.array([overlap(a, b) for a, b in zip(got, gold)])
    named = np.array([(w := op11_layouts.Writer(5 * 1_000_003 + i)).named or w.semantic for i in range(len(sources))])
    assert scores[named].mean() > 0.93 and scores.mean() > 0.91
    assert model.main_texts(sources[:40]) == [model.main_texts([s])[0] for s in sources[:40]]  # pages do not sway each other


def test_decoding_is_consistent_and_best():
    rnd = np.random.default_rng(0)
    page = read("<div><p>a</p><div><p>b</p>c<ul><li>d</li></ul></div></div><p>e</p>f")
    nodes = op11.Nodes([page])
    parent, leaf = nodes.parent.tolist(), [not t for t in nodes.tag]
    alone = [leaf[i] and parent[i] >= 0 and parent.count(parent[i]) == 1 for i in range(nodes.n)]

    def best(i, logp):
        kids = [j for j in range(nodes.n) if parent[j] == i]
        below = [best(j, logp) for j in kids]
        own = np.zeros(3) if alone[i] else logp[i]
        whole, none = own[0] + sum(b[0] for b in below), own[1] + sum(b[1] for b in below)
        return whole, none, -np.inf if leaf[i] else own[2] + sum(max(b) for b in below)

    for _ in range(200):
        logp = np.log(rnd.dirichlet([0.5] * 3, nodes.n))
        taken = op11.decode(nodes, logp)
        for i, p in enumerate(parent):
            if p >= 0 and taken[p]:
                assert taken[i]  # nothing is left out below a block that is taken whole
        states = {}
        for i, p in enumerate(parent):  # the score of the choice equals the best over all consistent ones
            states[i] = 0 if taken[i] else (1 if p >= 0 and states[p] == 1 else None)
            if states[i] is None:
                inside = [j for j in range(nodes.n) if taken[j] and _under(parent, j, i)]
                states[i] = 2 if inside else None
        if None not in states.values():
            score = sum(0 if alone[i] else logp[i][s] for i, s in states.items())
            assert score <= sum(max(best(i, logp)) for i in range(nodes.n) if parent[i] < 0) + 1e-9


def _under(parent, j, i):
    while j >= 0 and j != i:
        j = parent[j]
    return j == i


def test_rows_of_every_kind(spark):
    article = "<p>" + "Long sentences, with words and marks, tell the story of the day. " * 6 + "</p>"
    page = f"<html><body><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav><article><h1>Head line</h1>{article * 3}<div class=ad>Buy now</div></article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page, 3, "x"), (1, "u", page, 3, "x"), (2, None, None, 3, "x"), (3, "v", "", 3, "x"), (None, "w", page, 3, "x"), (4, "long", page.replace(article, article * 4000, 1), 3, "x")]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in op11.extract(spark.createDataFrame(rows, PAGE)).collect()}
    want = "Head line " + " ".join([" ".join(re.sub("<.*?>", "", article).split())] * 3)
    assert got[(1, "u")] == got[(None, "w")] == (want, len(want))
    assert got[(2, None)] == got[(3, "v")] == ("", 0)
    assert got[(4, "long")][1] > 1_000_000
    assert op11.extract(spark.createDataFrame(rows, PAGE)).count() == 6
    assert op11.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_pages_of_the_tables(spark, sf_dir):
    """Their main text stands in the article element."""
    from barspan.llm.queries import QUERIES

    def inside(source):
        m = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
        return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>|<br>", " ", m.group(1)))).split())

    want = {p.page_id: inside(p.html) for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in QUERIES["op11_html_main_text"](spark, sf_dir).collect()} == want


def test_rates_of_long_runs_count_the_whole_run():
    runs = ["1A" * 600 + "b" * 5000 + "Ü٣" * 4000 + "." * 1200, "", "x1Y", "\U0001d7d8" * 3000]
    counts = op11._run_counts(runs)
    for row, t in zip(counts, runs):
        assert row[0] == len(t)
        assert row[3] == sum(map(str.isdigit, t)) and row[4] == sum(map(str.isupper, t))
