"""HTML extraction by fitted weights: names bounded, absent or misleading; the cut."""

import re
from collections import Counter

import pytest

from bnlake.llm import html_extract as H
from bnlake.llm.common import table
from tests.llm.test_tokens_and_text import simple_article

PROSE = "This is a long and plain sentence of the text, one that goes on for a while and ends with a stop. "


def stripped(page):
    """The page without class, id and role and with its sectioning elements made div."""
    page = re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page or "")
    return re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", page)


@pytest.fixture(scope="module")
def pages(spark):
    return table(spark, "/root/testdata/sf0.01", "pages")


@pytest.fixture(scope="module")
def fitted(pages):
    return H.fit_weights(pages)


def test_names_are_bounded_and_weights_fitted(fitted):
    start = H.Weights()
    assert 0 <= fitted.good <= start.hint_bound and -start.hint_bound <= fitted.bad <= 0
    assert (fitted.company, fitted.paragraph, fitted.bias) != (start.company, start.paragraph, start.bias)
    assert fitted.company > 0 > fitted.links


def test_pages_without_names_give_the_same_text(pages, fitted):
    want, got, common = 0, 0, 0
    for r in pages.collect():
        w, g = Counter(simple_article(r.html).split("\n")), Counter(H.extract(stripped(r.html), fitted).split("\n"))
        want, got = (n + sum(len(k) * c for k, c in x.items()) for n, x in ((want, w), (got, g)))
        common += sum(len(k) * c for k, c in (w & g).items())
    assert common >= 0.99 * want and common >= 0.99 * got


def test_named_pages_are_whole(pages, fitted):
    assert {r.page_id: r.text for r in H.main_text(pages, fitted).collect()} == \
        {r.page_id: simple_article(r.html) for r in pages.collect()}


@pytest.mark.parametrize("name", ["content no-sidebar", "post comments-open", "article share-enabled", "main-content has-related"])
def test_names_of_states_say_nothing(fitted, name):
    page = f'<body><nav><a href=x>Home</a></nav><div class="{name}"><p>{PROSE * 4}</p><p>{PROSE}</p></div><footer>c me</footer>'
    assert H.extract(page, fitted) == f"{(PROSE * 4).strip()}\n{PROSE.strip()}"


def test_comments_go_and_an_articles_header_stays(fitted):
    body = f"<header><h1>Title of it</h1></header><p>{PROSE * 3}</p>"
    want = f"Title of it\n{(PROSE * 3).strip()}"
    assert H.extract(f"<header>Site</header><article>{body}</article><div class='comments'><p>{PROSE * 9}</p></div>", fitted) == want
    assert H.extract("<body><p>Short one here.</p><p>Another short one.</p></body>", fitted) == "Short one here.\nAnother short one."


def test_the_cut_changes_labels(fitted):
    """A block half of links between two long paragraphs stays with them: its own score
    is against it, its edges are for it. One all of links goes."""
    kept, alone = [], []
    for linked in range(41):
        middle = f"<div>{'word ' * (40 - linked)}<a href=z>{'link ' * linked}</a></div>"
        found = H.blocks(f"<body><div><a href=x>Home</a></div><div><p>{PROSE * 4}</p>{middle}<p>{PROSE * 4}</p></div></body>")
        z = H.scores(found, fitted)
        cut = H.minimum_cut(z, H.edges(found, fitted))
        assert cut[0] is False and cut[1] and cut[3]
        kept.append(cut[2])
        alone.append(z[2] > 0)
    assert kept[0] and not kept[-1]
    assert all(k or not a for k, a in zip(kept, alone)) and sum(kept) > sum(alone)


def test_tables_without_marked_pages_keep_the_start(spark, pages):
    assert H.fit_weights(pages.limit(0)) == H.Weights()
    plain = spark.createDataFrame([(f"<p>{PROSE}</p>", 1), (None, 2), ("", 3), (f"<p>{PROSE}</p>", 1)], "html string, h int")
    assert H.fit_weights(plain) == H.Weights()


def test_copies_are_one_page_of_the_sample(pages):
    few = pages.orderBy("page_id").limit(30)
    many = few
    for _ in range(5):
        many = many.unionByName(few.limit(1))
    a, b = H.fit_weights(few), H.fit_weights(many)
    assert a.company == pytest.approx(b.company, abs=1e-6) and a.bad == pytest.approx(b.bad, abs=1e-6)
