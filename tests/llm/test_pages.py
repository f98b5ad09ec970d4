"""Block rules of pages: articles that an earlier rule lost, and what must still go."""

import pytest

from treelens.llm.html import BlockRules, main_text, names_outside

MENU = "<nav><a href=/a>Home</a> <a href=/b>News</a></nav>"
FOOT = "<footer>Imprint and more of it, all rights of the house.</footer>"
ENGLISH = "The tide came in at noon, and with it the boats that had been out on the bank for most of the morning. "
LINKED = '<p>See <a href="/one">the first of the long lists of boats</a> and <a href="/two">the second of them</a>.</p>'

# Invented, plain sentences in several languages.
LANGUAGES = {
    "Russian": "Лодки вернулись в полдень, когда вода поднялась до старого причала, и рыбаки сразу начали разгружать улов. ",
    "Polish": "Łodzie wróciły w południe, gdy woda podniosła się do starego pomostu, a rybacy zaczęli wyładowywać połów. ",
    "Turkish": "Tekneler öğleyin geri döndü, su eski iskeleye kadar yükseldi ve balıkçılar hemen avlarını boşaltmaya başladı. ",
    "Chinese": "中午时分渔船都回来了，海水涨到了旧码头边，渔民们马上开始卸下当天的收获，孩子们在岸上等着。",
    "Greek": "Οι βάρκες γύρισαν το μεσημέρι, όταν το νερό ανέβηκε ως την παλιά προβλήτα, και οι ψαράδες άρχισαν αμέσως. ",
    "German": "Die Boote kamen am Mittag zurück, als das Wasser bis zum alten Steg stand, und die Fischer luden sofort aus. ",
}


def page(body, around=""):
    return f"<html><head><title>T</title></head><body>{MENU}{around}{body}{FOOT}</body></html>"


def text_of(html):
    return main_text(html, BlockRules())


def test_short_paragraphs_beside_links_stay_in_a_marked_article():
    body = "<article><p>The boats are in.</p>" + LINKED + "<p>The bank is dry.</p></article>"
    expected = "The boats are in. See the first of the long lists of boats and the second of them. The bank is dry."
    assert text_of(page(body)) == expected


def test_short_paragraphs_beside_links_stay_without_an_article():
    body = "<div><p>The boats are in and the crew is on the bank.</p>" + LINKED + "<p>All of it is for the market.</p></div>"
    found = text_of(page(body))
    assert "The boats are in" in found and "for the market" in found and "Home" not in found and "Imprint" not in found


@pytest.mark.parametrize("mark", ["<a name=top>", '<a id="top">', '<a href="#x">back'])
def test_an_unclosed_anchor_does_not_swallow_the_page(mark):
    body = f"<div><p>{mark} {ENGLISH * 2}</p><p>{ENGLISH * 3}</p></div>"
    assert ENGLISH.strip() in text_of(page(body)) and text_of(page(body)).count("boats") >= 3
    body = f"{mark}<article><p>{ENGLISH}</p></article>"
    assert text_of(page(body)) == ENGLISH.strip()


@pytest.mark.parametrize("language", LANGUAGES)
def test_prose_of_any_language_is_found_without_an_article(language):
    sentence = LANGUAGES[language]
    body = f"<div><h1>{sentence[:20]}</h1>" + "".join(f"<p>{sentence * n}</p>" for n in (3, 1, 4)) + "</div>"
    found = text_of(page(body))
    assert found.count(sentence.strip()[:30]) == 8 and "Home" not in found and "Imprint" not in found


@pytest.mark.parametrize(
    "name", ['class="content-sidebar-wrap"', 'class="social-history"', 'id="search-for-meaning"', 'class="has-menu-open page"', 'id="advertising-law"']
)
def test_names_are_judged_as_a_whole(name):
    body = f"<div {name}><p>{ENGLISH * 3}</p></div>"
    assert text_of(page(body)) == (ENGLISH * 3).strip()


@pytest.mark.parametrize(
    "name", ["sidebar", "site-footer", "main-nav", "sidebar-left", "comment-list", "cookie-banner", "share-buttons", "related_posts", "ad", "ad-slot-2", "x newsletter-signup"]
)
def test_names_that_tell_still_do(name):
    assert names_outside(name)
    body = f"<div><p>{ENGLISH * 3}</p></div><div class='{name}'><p>{ENGLISH.upper() * 3}</p></div>"
    assert text_of(page(body)) == (ENGLISH * 3).strip()


def test_an_article_outweighs_what_it_stands_in():
    for wrap in ('<div class="sidebar">', "<form action=/>", '<div id="search">'):
        assert text_of(page(f"{wrap}<main><p>{ENGLISH}</p></main>")) == ENGLISH.strip()
    # Articles of comments and of related pages, which come after the first one, do not.
    later = f"<div class=comments><article><p>{ENGLISH.upper()}</p></article></div>"
    assert text_of(page(f"<article><p>{ENGLISH}</p></article>{later}")) == ENGLISH.strip()
    assert text_of(page(f"<article><p>{ENGLISH}</p><aside>{ENGLISH}</aside></article>")) == ENGLISH.strip()


def test_lists_of_links_and_debris_still_go():
    links = "".join(f'<li><a href="/{n}">Page number {n} of the list</a></li>' for n in range(9))
    body = f"<ul>{links}</ul><div><p>{ENGLISH * 3}</p></div><ul>{links}</ul>"
    assert text_of(page(body)) == (ENGLISH * 3).strip()
    assert text_of("") == "" and text_of(page("")) == ""


def test_a_long_page_is_read_in_time_that_grows_with_it():
    import time

    def seconds(n):
        html = page("<article>" + f"<p>{ENGLISH} &amp; <a href=/x>x</a></p>" * n + "</article>")
        start = time.perf_counter()
        assert text_of(html).count("noon") == n
        return time.perf_counter() - start

    seconds(200)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.01)
