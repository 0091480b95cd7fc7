import random
import re
import time

import pytest

from hostlens.llm.html_text import pages_text, visible_text

CASES = [
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("a  b\n c<br>d<br/>e", "a b c\nd\ne"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "- a\n- b\n  - c\n- d\n\ne"),
    ("<ol start=3><li>x</li><li>y<p>z</li></ol>", "3. x\n4. y\n\n   z"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>t", "a   | bb\nccc | d\n\nt"),
    ("<table><td>only</table>", "only"),
    ("<table><tr><th>h1<th>h2<tbody><tr><td>x<td>y<br>z</table>", "h1 | h2\nx  | y\n   | z"),
    ("<table><tr><td>o<td><table><tr><td>i<td>j</table></table>", "o | i | j"),
    ("<head><title>t</title><style>p{}</style></head><body>x", "x"),
    ("<html><head><meta charset=u><title>t</title>text<p>b", "text\n\nb"),
    ("<script>if (a</p>) '<p>'</script>v", "v"),
    ("<p hidden>no</p><p style='display: none'>no</p><span aria-hidden=true>shown </span>yes", "shown yes"),
    ("<textarea>a &lt;b> <i>c</textarea><xmp>&lt;<b></xmp>d", "a <b> <i>c&lt;<b>d"),
    ("<svg><title>no</title><defs><text>no</text></defs><text>in svg</text></svg> <math><mi>x</mi></math>", "in svg x"),
    ("<a title='x\"y>z' href=\"q'r\">l</a>m", "lm"),
    ("a<b", "a<b"),
    ("x<p title='>y", "x\n\ny"),
    ("</ >a<?b>c<!d>e</>f", "acef"),
    ("<div style='visibility:hidden'>a<b>c</b></div>d", "d"),
    ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("&lt;b&gt; &amp;&nbsp;&eacute; &unknown;", "<b> &\xa0é &unknown;"),
    ("a<!-- <p>x -->b<!doctype html>c", "abc"),
    ("a < b and 1<2", "a < b and 1<2"),
    ("<a href='x>y'>l</a><img alt=q>", "l"),
    ("<p><b>x<p>y</b>z", "x\n\nyz"),
    ("<h1>a<h2>b</h1>c", "a\n\nb\n\nc"),
    ("</p>a</div>b</b>", "ab"),
    ("<dl><dt>t<dd>d</dl>", "t\nd"),
    ("<p>unclosed <!-- x", "unclosed"),
    ("<p title=\"oops>a</p>", "a"),
    ("<select><option>1<option>2</select>", "1\n2"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("source,want", CASES)
def test_layout(source, want):
    assert visible_text(source) == want


def test_deep_and_long_pages():
    assert visible_text("<div>" * 20_000 + "x") == "x"
    assert visible_text("<ul><li>" * 3_000 + "x").strip(" -") == "x"
    assert len(visible_text("<p>word</p>" * 20_000)) == 6 * 20_000 - 2
    assert visible_text("<table><tr><td>" * 300 + "x") == "x"


def test_all_visible_words_stay():
    page = "<body>" + "".join(f"<div><p>w{i}<table><tr><td>c{i}<td>d{i}</table><li>l{i}" for i in range(50))
    assert re.findall(r"[wcdl]\d+", visible_text(page)) == [f"{k}{i}" for i in range(50) for k in "wcdl"]


def test_table(spark):
    rows = [(1, "u", "<p>a<p>b", 1), (2, None, None, 2), (None, "v", "", 3), (1, "u", "<p>a<p>b", 1)]
    got = pages_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_lines int")).collect()
    assert sorted((str(r.page_id), r.text, r.n_lines) for r in got) == [("1", "a\n\nb", 3), ("1", "a\n\nb", 3), ("2", "", 0), ("None", "", 0)]
    assert pages_text(spark.createDataFrame(rows, "page_id long, url string, html string, n int").limit(0)).count() == 0


@pytest.mark.parametrize("page", [
    "<table><tr><td>a<td>b" * 2000,
    '<a href="' * 120_000,
    "<a " * 330_000,
    "<a '\"" * 200_000,
    "<" * 1_000_000,
    "<!" * 500_000,
    "<p>" + "<b>" * 150_000 + "</p>" * 100_000,
    "<i><table><tr><td>" + "<b>" * 100_000 + "</i>" * 100_000,
    "<ul><li>" * 100_000 + "x",
    "&" * 1_000_000,
    "<div> " * 150_000,
])
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    text = visible_text(page)
    assert time.process_time() - start < 4
    assert len(text) < 9 * len(page)


def test_deeply_nested_tables_keep_their_text():
    page = "".join(f"<table><tr><td>a{i}<td>b{i}" for i in range(50))
    assert re.findall(r"[ab]\d+", visible_text(page)) == [x for i in range(50) for x in (f"a{i}", f"b{i}")]


class Plain:
    """Random pages made as trees, and their text by recursion over the tree, apart from the tokenizer and its stack."""

    def __init__(self, seed):
        self.rng = random.Random(seed)

    def word(self):
        return "".join(self.rng.choices("abcdeé", k=self.rng.randrange(1, 6)))

    def inline(self):
        """(source, text) of a line."""
        words, source = [], []
        for _ in range(self.rng.randrange(1, 6)):
            w = self.word()
            kind = self.rng.randrange(6)
            words.append(w + "&" if kind == 5 else w)
            source.append({0: f"<b>{w}</b>", 1: f"<i class='x>y'>{w}</i>", 2: f"<!-- no -->{w}", 5: f"{w}&amp;"}.get(kind, w))
        return self.rng.choice([" ", "\n ", "  "]).join(source), " ".join(words)

    def block(self, depth):
        """(source, lines, lines left free around)."""
        kind = self.rng.randrange(6 if depth else 2)
        if kind < 2:
            source, text = self.inline()
            tag = "p" if kind else "div"
            close = f"</{tag}>" if kind == 0 or self.rng.random() < 0.5 else ""
            return f"<{tag}>{source}{close}", [text], kind
        if kind == 2:
            source, lines = self.blocks(depth - 1)
            return f"<section>{source}</section>", lines, 1
        if kind == 3:
            items = [self.inline() for _ in range(self.rng.randrange(1, 4))]
            ordered = self.rng.random() < 0.5
            marks = [f"{i + 1}. " if ordered else "- " for i in range(len(items))]
            tag = "ol" if ordered else "ul"
            end = self.rng.choice(["", "</li>"])
            return f"<{tag}>" + "".join(f"<li>{s}{end}" for s, _ in items) + f"</{tag}>", [m + t for m, (_, t) in zip(marks, items)], 1
        if kind == 4:
            rows = [[self.inline() for _ in range(self.rng.randrange(2, 4))] for _ in range(self.rng.randrange(1, 4))]
            columns = max(map(len, rows))
            widths = [min(40, max(len(r[k][1]) for r in rows if k < len(r))) for k in range(columns)]
            end = self.rng.choice(["", "</td>"])
            source = "<table>" + "".join("<tr>" + "".join(f"<td>{s}{end}" for s, _ in r) for r in rows) + "</table>"
            return source, [" | ".join(t.ljust(w) for (_, t), w in zip(r, widths)).rstrip() for r in rows], 1
        return f"<p hidden>{self.word()}</p><script>if (a < b) '<p>'</script>", [], 0

    def blocks(self, depth):
        source, lines, free = [], [], False
        for _ in range(self.rng.randrange(1, 5)):
            s, more, around = self.block(depth)
            source.append(s)
            if more:
                lines += ([""] if lines and (free or around) else []) + more
                free = around
        return self.rng.choice(["", "\n"]).join(source), lines


@pytest.mark.parametrize("seed", range(150))
def test_against_a_plain_renderer_of_trees(seed):
    source, lines = Plain(seed).blocks(3)
    assert visible_text(f"<html><head><title>no</title></head><body>{source}</body></html>") == "\n".join(lines)


def test_a_tall_cell_beside_many_cells_grows_with_the_page():
    """A row of n cells and one of n lines: the text grows as the page does, and none of it is lost."""
    sizes = []
    for n in (1000, 2000, 4000):
        page = "<table><tr>" + "<td>" * n + "<td>" + "a<br>" * n + "<td>end"
        text = visible_text(page)
        assert text.count("a") == n and text.endswith("end")
        sizes.append(len(text))
    assert sizes[2] < 5 * sizes[0] and sizes[2] < 36_000
    small = visible_text("<table><tr><td>one<td>a<br>b<td>x<tr><td>2<td>c<td>y")
    assert small == "one | a | x\n    | b |\n2   | c | y"
