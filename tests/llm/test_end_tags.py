"""Pages that leave out end tags, as HTML lets them."""

import time

import pytest

from freshet.llm import html_text

ARTICLE = "<article><p>a</p></article>"


@pytest.mark.parametrize(
    "page, blocks",
    [
        (f"<html><head><title>x</title><body>{ARTICLE}", ["a"]),
        (f"<html><head><title>x</title><meta charset=utf-8><script>var p = '<p>';</script>{ARTICLE}", ["a"]),
        (f"<head><title>x</title><link rel=a><noscript><style>p {{}}</style></noscript></head><body>{ARTICLE}</body>", ["a"]),
        ("<head><noscript><meta name=x><body><main><p>a</main>", ["a"]),
        *[(f"<body><p class=notice>n<{tag}>{ARTICLE}</{tag}>", ["a"]) for tag in ("div", "section", "main")],
        (f"<body><p class=notice>n{ARTICLE}", ["a"]),
        ("<article><p class=notice>n<h1>T</h1><p class=ad>x<table><tr><td>c</table><p hidden>y<ul><li>i</ul></article>", ["T", "c", "i"]),
        ("<article><p>a<div class=ad>x<p>y</div>b</article>", ["a", "b"]),
        ("<article><dl><dt class=ad>x<dd>one<dd class=ad><p>y<dt>two<dd>three</dl></article>", ["one", "two", "three"]),
        ("<article><ul><li class=ad><p>x<li>one<ul><li>in</ul><li class=ad>y<ul><li>z</ul></ul></article>", ["one", "in"]),
        ("<article><table><tr class=ad><td>x<tr><td class=ad>y<td>one<tbody class=ad><tr><td>z<tbody><tr><td>two</table></article>", ["one", "two"]),
        ("<article><p>a<button><div>x</div>y</button>b</article>", ["a", "b"]),
        ("<article><div class=ad><span>x<span>y</span></span>z</div><p>a</article>", ["a"]),
        ("<article><p class=ad>x<a href=/>y<div>all of it a link</div></a><p>a</article>", ["a"]),
    ],
)
def test_omitted_end_tags(page, blocks):
    assert html_text.main_text(page.encode()) == "\n\n".join(blocks)


LONG = " ".join(["Questo paragrafo racconta la storia di una piccola città sul mare e della gente che ci vive da sempre."] * 3)
POLISH = " ".join(["Dawno temu w małym mieście nad rzeką mieszkał stary zegarmistrz, który naprawiał wszystkie zegary."] * 3)
ENGLISH = " ".join(["This is the story of a small town by the sea and of the people who have lived in it for a long time."] * 3)
CODE = "for k in range(10): print(k, k * k, k ** 3, sum(range(k)), max(k, 3), min(k, 4), divmod(k, 2), abs(k), pow(k, 2, 7))"


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<article><h2 id=related-work>Related work</h2><section id=search><p>a</section><p class=notice-of-appeal>b<div class=login-flow>c</div></article>",
         ["Related work", "a", "b", "c"]),
        ("<article><h1><a href=/x>Title</a></h1><p>a</article>", ["Title", "a"]),
        ("<article><h2 class=promo>Offers</h2><p>a</article>", ["Offers", "a"]),
        ("<article><p>a<div class=ad-box>x</div><div class='cookie-notice'>y</div><div class=sidebar>z</div><p id=comments>b</article>", ["a", "b"]),
        ("<article><p>a<div class='share share-buttons'>x</div><div class=widget-2>y</div><div class=with-sidebar>b</div></article>", ["a", "b"]),
        (f"<body><div id=sidebar>{ENGLISH}</div><p>{ENGLISH}<h2 id=share>Next</h2><p>{ENGLISH}<div class=cookie-notice>x</div>", [ENGLISH, "Next", ENGLISH]),
        *[(f"<body><ul><li><a href=/>Home</a></ul><h1>T</h1><p>{text}<p>{text}</p><p><a href=/b>{text}</a>", ["T", text, text]) for text in (LONG, POLISH)],
        (f"<body><p>{ENGLISH}<pre>{CODE}</pre><p>{ENGLISH}<table><tr><td>{CODE * 2}</table>", [ENGLISH, CODE, ENGLISH, CODE * 2]),
        (f"<body><p>x <a href=/a>{'y ' * 60}</a><p>{ENGLISH}", [ENGLISH]),
        ("<article class=comment><p>x</article><article id=comment-7><p>y</article><article class=promo-code-guide><p>a</article>", ["a"]),
        ("<article><p>a <a href=/1>b<a href=/2>c</a> d e f g h</article>", ["a bc d e f g h"]),
    ],
)
def test_names_that_may_mean_something_else_and_other_languages(page, blocks):
    assert html_text.main_text(page.encode()) == "\n\n".join(blocks)


@pytest.mark.parametrize("start", ["<div>", "<a href=/x>", "<div class=ad><span>", "<ul><li>", "<p class=notice-of>", "<td><dd>", "<h1><p><a>"])
@pytest.mark.parametrize("then", ["", "x</p></li>", "x<dd></dd>"])
def test_time_grows_with_the_page_whatever_stays_open(start, then):
    def seconds(n):
        page = ("<article>" + (start + then) * n + "text</article>").encode()
        least = []
        for _ in range(2):
            began = time.process_time()
            html_text.main_text(page)
            least.append(time.process_time() - began)
        return min(least)

    seconds(200)
    assert seconds(16_000) < 16 * seconds(2_000) + 0.3


def test_rows_that_repeat_are_empty_or_missing(spark):
    rows = [(1, ARTICLE), (1, ARTICLE), (2, None), (None, ""), (3, "<p>" + "word " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    found = pages.select("page_id", html_text.extracted()).collect()
    assert [r["text"] for r in found[:4]] == ["a", "a", "", ""] and len(found[4]["text"]) == 1_499_999
    for none in (pages.limit(0), pages.where("html is null")):
        assert all(r["text"] == "" for r in none.select(html_text.extracted()).collect())
