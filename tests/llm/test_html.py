from collections import Counter

import pytest

from tidemark.llm import html

TREE = html.trained()
LONG = "The council met on Tuesday to hear what the engineers had found below the wall of the old harbour this winter."


def text(source):
    return html.main_text(source, TREE)[0]


def test_the_tree_fits_its_labelled_pages():
    for source, labels in html.LABELLED:
        assert html.judged(html.Page(source), TREE) == [x == "1" for x in labels], source
    assert sum(len(labels) for _, labels in html.LABELLED) >= 150


def splits(tree):
    return set() if tree.left is None else {html.FEATURES[tree.feature]} | splits(tree.left) | splits(tree.right)


def test_the_tree_asks_for_link_density():
    assert {"density", "share"} <= splits(TREE)


def test_the_tree_equals_its_rules_block_by_block():
    """Every split of the grown tree has the least impurity of all thresholds, by brute force."""
    pages = [(html.Page(s), labels) for s, labels in html.LABELLED]
    inputs = html.np.concatenate([html.features(p)[[not b.apart for b in p.blocks]] for p, _ in pages])
    kept = [x == "1" for p, labels in pages for b, x in zip(p.blocks, labels, strict=True) if not b.apart]

    def impurity(rows):
        share = sum(kept[i] for i in rows) / len(rows)
        return len(rows) * share * (1 - share)

    def check(tree, rows):
        if tree.left is None:
            return
        cost = lambda f, t: sum(impurity(part) for part in ([i for i in rows if inputs[i, f] <= t], [i for i in rows if inputs[i, f] > t]) if part)
        least = min(cost(f, v) for f in range(inputs.shape[1]) for v in {inputs[i, f] for i in rows})
        assert abs(cost(tree.feature, tree.threshold) - least) < 1e-9
        check(tree.left, [i for i in rows if inputs[i, tree.feature] <= tree.threshold])
        check(tree.right, [i for i in rows if inputs[i, tree.feature] > tree.threshold])

    check(TREE, list(range(len(kept))))


WALK = "Later a second group walked along the wall and counted the stones that were missing from it."
TWELVE = " ".join(f"<a href=/{k}>one two three</a>" for k in range(12))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f"<div><p>{LONG}</p><p>{WALK}</p><p>{LONG}</p></div><div>{TWELVE}</div>", f"{LONG}\n{WALK}\n{LONG}"),
        (f"<p>{LONG}</p><p>{WALK}</p><p>{TWELVE}</p><p>{LONG}</p>", f"{LONG}\n{WALK}\n{LONG}"),
        (f"<div><p>{LONG}</p><p>{WALK}</p><p>No vote was taken.</p></div>", f"{LONG}\n{WALK}\nNo vote was taken."),
        (f"<div><p>{LONG}</p><ul><li>one</li><li>two three</li></ul><p>{WALK}</p></div>", f"{LONG}\none\ntwo three\n{WALK}"),
        ("<div>" + "".join(f"<p>line {w} of it</p>" for w in "abcdefgh") + "</div>", "\n".join(f"line {w} of it" for w in "abcdefgh")),
        (f"<div><p>{LONG}</p><p>{WALK}</p></div><p>Copyright 2020 by the people of the harbour and all of their friends, all rights reserved everywhere.</p>", f"{LONG}\n{WALK}"),
        (f"<form id=aspnetForm><div><a href=/>Home</a> <a href=/b>Contact</a></div><div><h1>Title</h1><p>{LONG}</p><p>{WALK}</p></div></form>", f"Title\n{LONG}\n{WALK}"),
        (f"<div class='single comments-open'><p>{LONG}</p><p>{WALK}</p></div>", f"{LONG}\n{WALK}"),
        (f"<article><p>{LONG}</p><div class=share-price-table><p>Ten</p></div></article>", f"{LONG}\nTen"),
        (f"<article><p>{LONG}</p><div class='ad-free'>{WALK}</div></article>", f"{LONG}\n{WALK}"),
        (f"<article><p>{LONG} <math><mi>x</mi></math></p></article>", f"{LONG} x"),
        (f"<div class=comment-list><p>{WALK}</p><p>{WALK}</p></div><div><p>{LONG}</p><p>Ends.</p></div>", f"{LONG}\nEnds."),
    ],
)
def test_pages_of_other_layouts(source, want):
    assert text(source) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("<", ""),
        ("<p", ""),
        ("<article><p>Tom &amp; Ann&#39;s&nbsp;  caf&eacute;\n now</p></article>", "Tom & Ann's café now"),
        ("<article>a<b>b</b>c<br>d<p>e<p>f</article>", "abc d\ne\nf"),
        ("<article><p><b>open<p>next</article><p>out", "open\nnext"),
        (f"<script>var p='<p>no</p>'</script><style>p{{}}</style><article><p>{LONG}</p><!-- <p>no</p> --></article>", LONG),
        (f"<article><p>{LONG}</p><form><p>Search</p><button>Go</button></form><aside>{LONG}</aside></article>", LONG),
        (f"<article><p>{LONG}</p></article><div id='comment-3' class='x'><p>{LONG}</p></div>", LONG),
        (f"<div class='Ad-Box'>{LONG}</div><article><p>One.</p></article>", "One."),
        (f"<article><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p></article>", LONG),
        ("<article><p>5 < 6 and 7 > 6</p><p title='a > b'>x</p></article>", "5 < 6 and 7 > 6\nx"),
        (f"<nav><a href='/'>Home</a></nav><p>{LONG}</p><p>{LONG}</p>", f"{LONG}\n{LONG}"),
        ("<article><ul><li>one<li>two</ul></article>", "one\ntwo"),
    ],
)
def test_pages(source, want):
    assert text(source) == want


def test_hard_markup_is_read_in_time():
    for source in ("<b>" * 100_000 + "x", "<a \"" * 100_000, "<p>" * 100_000, "</p>" * 100_000, "<" * 200_000, "<!--" * 100_000, "<script>" * 100_000):
        html.main_text("<article>" + source, TREE)
    assert text("<article><p>" + "word " * 200_000 + "</p></article>").count("word") == 200_000


def test_tables(spark):
    rows = [(1, "u", "<article><p>A</p></article>"), (1, "u", "<article><p>A</p></article>"), (2, None, None), (None, "u", ""), (3, "u", "<nav>x</nav>")]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(frame).collect())
    assert got == Counter([(1, "u", "A", 1)] * 2 + [(2, None, "", 0), (None, "u", "", 0), (3, "u", "", 0)])
    assert html.extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("""<article><a href="x"">one</a><p>two</p></article>""", "one\ntwo"),
        ("<article><p title=it's>one</p><p>it's two</p></article>", "one\nit's two"),
        ("""<article><img alt="5" tall"><p>one</p><p class="b">two</p></article>""", "one\ntwo"),
        ("""<article><p title="a>one</p><p>two</p></article>""", "one\ntwo"),
        ("""<article><p>one</p><p title = 'a > b' x="c>d">two</p></article>""", "one\ntwo"),
        ("""<article><p title="a"">one</p><p>two</p><p id=">""", "one\ntwo"),
        ("""<article><p>one</p><b x="><p>two</p><i y="z" """, "one\ntwo"),
    ],
)
def test_unbalanced_quotes_end_no_page(source, want):
    assert text(source) == want


def test_unbalanced_quotes_are_read_in_time():
    for source in ('<a x=">" ' * 100_000, "<a x='" * 100_000, "<a =\"" * 100_000, "<a x = " * 100_000):
        html.main_text("<article>" + source, TREE)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f"<div class='content-sidebar-wrap'><article><p>{LONG}</p><p>One.</p></article><aside class=sidebar><p>{LONG}</p></aside></div>", f"{LONG}\nOne."),
        (f"<div class='site has-sidebar'><main><p>{LONG}</p></main><div class=sidebar><p>{LONG}</p></div></div>", LONG),
        (f"<div class='no-comments'><p>{LONG}</p><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
        (f"<div class='header-wrap'><article><p>One.</p></article><article><p>Two.</p><div class=related><p>{LONG}</p></div></article></div>", "One.\nTwo."),
        (f"<article><p>One.</p></article><section id=comments><article><p>{LONG}</p></article></section>", "One."),
        (f"<article><p>One.</p><div class=related><article><p>{LONG}</p></article></div></article>", "One."),
        (f"<div class=sidebar><p>{LONG}</p></div><article><p>One.</p></article>", "One."),
    ],
)
def test_layout_around_an_article_is_not_apart(source, want):
    assert text(source) == want
