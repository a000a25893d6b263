import math
import random
import time

from topicloom.llm import extraction
from topicloom.llm.extraction import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy &amp; save</div><aside>Links</aside>
<article><h1>A &eacute;t&eacute;</h1><p>First   paragraph with
enough words to be content &amp; more.<br>Same block.<p>Second one, also with many words in it.</p><p>No.</p>
<form><p>Your mail</p></form><div class="cookie-notice">We use cookies</div>
<div id="comments"><p>A reader says something rather long about the article here.</p></div></article>
<footer>&copy; all</footer></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE) == (
        "A été\nFirst paragraph with enough words to be content & more. Same block.\n"
        "Second one, also with many words in it.\nNo."
    )


def test_page_without_article_element():
    page = (
        "<body><ul><li><a href=a>Start</a><li><a href=b>Shop</a></ul><div><h2>Head of it</h2>"
        "<p>A long paragraph of plain text that is the content of the page.</p><p>Short.</p>"
        "<p>Another long paragraph of plain text, as content goes.</p></div><ul><li><a href=c>More</a></ul></body>"
    )
    assert main_text(page).split("\n") == [
        "Head of it", "A long paragraph of plain text that is the content of the page.", "Short.",
        "Another long paragraph of plain text, as content goes.",
    ]


def _paragraphs(name, n, length=150):
    return [f"{name}{i} ".ljust(length, "x") for i in range(n)]


def _html(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_one_very_long_paragraph_hides_no_section():
    before, after, long = _paragraphs("a", 20), _paragraphs("b", 20), ["y" * 20_000]
    middle = ["Head", *long, "End of it"]
    menu = "<ul><li><a href=a>Start</a><li><a href=b>Shop</a></ul>"
    for tag in ("section", "div", "blockquote"):
        page = f"<body>{menu}<div><{tag}>{_html(before)}</{tag}><{tag}>{_html(middle)}</{tag}><{tag}>{_html(after)}</{tag}></div>{menu}</body>"
        assert main_text(page).split("\n") == [*before, *middle, *after]


def test_short_section_beside_a_long_one():
    texts = _paragraphs("a", 10, 400)
    page = f"<body><div>{_html(texts)}</div><div><h2>Needed</h2><ul><li>Salt<li>Two eggs</ul></div><ul><li><a href=c>More</a></ul></body>"
    assert main_text(page).split("\n") == [*texts, "Needed", "Salt", "Two eggs"]


def test_several_articles_and_text_beside_them():
    one, two, lead = _paragraphs("a", 3, 900), ["Short note."], _paragraphs("lead", 2, 600)
    nav = "<nav><ul><li><a href=a>Start</a></ul></nav>"
    page = f"<body>{nav}<div><h2>Lead</h2>{_html(lead)}</div><article>{_html(one)}</article><article>{_html(two)}</article></body>"
    assert main_text(page).split("\n") == ["Lead", *lead, *one, *two]


def test_broken_markup():
    assert main_text("<article><p>one two three <b>four<p>five six seven</article>") == "one two three four\nfive six seven"
    assert main_text("plain text only") == "plain text only"
    assert main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert main_text("<p") in ("", "<p") and main_text("") == "" and main_text(None) == ""


def test_long_page():
    text = "word " * 200_000
    assert main_text(f"<main><p>{text}</p></main>") == text.strip()


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "y"), (3, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract(pages).collect()
    assert len(got) == 4 and got[0]["text"] == got[1]["text"] == main_text(PAGE)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and got[2]["text"] == got[3]["text"] == ""
    assert extraction.extract(pages.limit(0)).collect() == []


def test_comments_and_adverts_marked_as_articles():
    texts, note = _paragraphs("a", 4, 300), _paragraphs("c", 3, 400)
    page = (
        f"<body><main><article class='post type-post'>{_html(texts)}</article>"
        f"<section><article class='comment even'>{_html(note)}</article><article id='comment-12'>{_html(note)}</article>"
        f"<article class='ad promo'>{_html(note)}</article><article class='related-post'>{_html(note)}</article></section>"
        "</main></body>"
    )
    assert main_text(page).split("\n") == texts
    outside = f"<body><article>{_html(texts)}</article><section><article class='comment'>{_html(note)}</article></section></body>"
    assert main_text(outside).split("\n") == texts


def test_marks_are_whole_names():
    kept = ["share-price", "legal-reform", "search-results", "social-history", "register-office", "promo_code_guide"]
    gone = ["share", "site-footer", "cookie-notice", "ad_slot-3", "article-comments", "main-nav", "newsletter-signup"]
    parts = [f"<div class='{name}'><p>{name} and some text about it.</p></div>" for name in kept + gone]
    assert main_text(f"<article>{''.join(parts)}</article>").split("\n") == [f"{n} and some text about it." for n in kept]
    assert main_text("<article><p id='legal-reform'>A law was made.</p><p>Second.</p></article>") == "A law was made.\nSecond."


def test_deep_pages_take_linear_time():
    n = 100_000
    pages = [
        "<div>" * n + "<p>The only text of a very deep page.</p>" + "</section>" * n,
        "<blockquote>" * n + "<p>The only text of a very deep page.</p>" + "</p>" * n,
        "".join(f"<div><p>Line {i} of many.</p>" for i in range(20_000)),
        "<article>" + "".join(f"<div><p>Line {i} of many.</p>" for i in range(20_000)),
        "".join(f"<article><p>Line {i} of many.</p>" for i in range(20_000)),
    ]
    for page in pages:
        start = time.process_time()
        text = main_text(page)
        assert time.process_time() - start < 10  # seconds; a walk up per line takes minutes
        assert text.count("\n") in (0, 19_999)


def test_ratios_and_clusters_equal_a_plain_scan():
    rng = random.Random(3)
    for _ in range(30):
        lines = [
            ("x" * rng.randint(1, 200), rng.randint(0, 6), rng.choice([0, 0, 100]), None, rng.random() < 0.2)
            for _ in range(rng.randint(1, 40))
        ]
        ratio = [0.0 if f or 2 * k > len(t) else len(t) / max(1, g) for t, g, k, _, f in lines]
        positive = sorted(r for r in ratio if r)
        if not positive:
            continue
        at = 0.75 * (len(positive) - 1)
        low = int(at)
        third = positive[low] + (at - low) * (positive[min(low + 1, len(positive) - 1)] - positive[low])
        clipped = [min(r, extraction.CLIP * third) for r in ratio]
        mean = sum(clipped) / len(clipped)
        spread = math.sqrt(sum((r - mean) ** 2 for r in clipped) / len(clipped))
        kernel = {d: math.exp(-0.5 * d * d) for d in range(-2, 3)}
        smoothed = [
            sum(kernel[d] * ratio[i + d] for d in kernel if 0 <= i + d < len(ratio)) / sum(kernel.values())
            for i in range(len(ratio))
        ]
        want = [i for i, r in enumerate(ratio) if r > 0 and smoothed[i] >= 0.5 * spread]
        assert extraction.content_lines(lines) == want
