"""What main text keeps: parts in other containers, headings and leads, names inside articles; and what a host repeats."""

import pytest

from ledgerloom.llm import html

PAGES = "page_id long, url string, html string"


def extracted(spark, rows):
    return {r.page_id: r.text for r in html.extracted(spark.createDataFrame(rows, PAGES)).collect()}


def paragraphs(word, n):
    return "".join(f"<p>{word} {i} {'text ' * 12}</p>" for i in range(n))


def test_a_page_that_differs_from_its_host_keeps_all_of_its_text(spark):
    rows = [(i, f"http://a.b/{i}", f"<body><nav>menu</nav><div class=content>{paragraphs(f'page{i}', 6)}</div></body>") for i in range(20)]
    rows.append((99, "http://a.b/99", f"<body><div class=content>{paragraphs('first', 6)}</div><div class=more>{paragraphs('second', 5)}</div></body>"))
    got = extracted(spark, rows)
    assert [w for w in got[99].split() if w in ("first", "second")] == ["first"] * 6 + ["second"] * 5
    assert all(got[i].count(f"page{i} ") == 6 and "menu" not in got[i] for i in range(20))


@pytest.mark.parametrize("path", [None, "html>body>div.post>div.body", "nowhere"])
def test_headings_and_leads_before_the_body_stay(path):
    page = f"<html><body><div class=post><h1>The Title</h1><p class=lead>INTRO</p><div class=body>{paragraphs('para', 10)}</div></div></body></html>"
    assert html.extract(page, path).split("\n\n")[:2] == ["The Title", "INTRO"] and html.extract(page, path).count("para") == 10


def test_an_article_keeps_its_header_and_parts_with_common_names():
    page = f"<body><header><h1>Site</h1></header><article><header><h2>Head</h2><p>By me</p></header>{paragraphs('body', 4)}<div class=alert>mind the gap</div><p class=share-price>12 a share</p><header>no heading</header></article></body>"
    text = html.extract(page.replace("<header><h1>Site</h1></header>", ""), None)
    assert text.startswith("Head\n\nBy me\n\n") and "mind the gap" in text and text.endswith("12 a share") and "no heading" not in text
    assert "Site" not in html.extract(page, None)
    menu = "<div class=share><a href=x>this network</a> <a href=y>that network</a></div><div class=related-links>more: <ul><li><a href=1>one more article</a><li><a href=2>two more articles</a></ul></div><div class=ad>buy</div><aside>side</aside>"
    assert html.extract(f"<body><article><h1>T</h1>{paragraphs('body', 2)}{menu}</article></body>", None).count("\n\n") == 2
    assert html.extract(f"<body><div class=alert>out</div><article><h1>T</h1>{paragraphs('body', 2)}</article></body>", None).startswith("T")


def test_what_a_host_repeats_goes_outside_and_under_doubtful_names(spark):
    say = "<div class=c7>Read us every day, wherever you are.</div>"
    page = lambda i: f"<body>{say}<article><h1>T{i}</h1>{paragraphs(f'page{i}', 3)}<p>Said in every article.</p><div class=alert>Rate this article now.</div><div class=alert>Own note {i}.</div></article></body>"
    rows = [(i, f"http://a.b/{i}", page(i)) for i in range(8)]
    got = extracted(spark, rows)
    for i in range(8):
        assert "Read us" not in got[i] and "Rate this" not in got[i] and "Said in every article." in got[i] and f"Own note {i}." in got[i]
    # Copies of one page are no host's consensus, and neither are two pages.
    assert "Read us" in extracted(spark, [(i, "http://a.b/1", page(1)) for i in range(8)])[3]
    assert "Read us" in extracted(spark, rows[:2])[1]


def test_mostly_links_outside_go():
    page = f"<body><div class=x1><a href=1>one page</a> <a href=2>another page</a></div><div class=t>{paragraphs('body', 4)}<ul><li><a href=3>kept link of the text</a></ul></div><div class=note>An <a href=4>own</a> note of some length.</div></body>"
    text = html.extract(page, None)
    assert "one page" not in text and "kept link" in text and text.endswith("An own note of some length.")
    assert html.extract("<body><ul><li><a href=1>only</a><li><a href=2>links</a></ul></body>", None) == "only\n\nlinks"


def test_nested_pages_against_a_walk_over_their_parts(spark):
    """Pages built of nested parts that are known to be text or not."""
    import random

    rnd = random.Random(2)

    def part(depth):
        kind = rnd.choice(["p", "p", "p", "div", "section", "list", "quote", "out"])
        if kind == "out":
            return rnd.choice(["<nav>x out</nav>", "<div class=ad>x out</div>", "<aside><p>x out</p></aside>", "<div class=comments><p>x out</p></div>", "<script>out</script>", "<form>out<input></form>"]), []
        if kind in ("div", "section") and depth < 4:
            own = [part(depth + 1) for _ in range(rnd.randint(1, 4))]
            return f"<{kind} class=k{rnd.randint(0, 3)}>{''.join(h for h, _ in own)}</{kind}>", [t for _, ts in own for t in ts]
        texts = [f"t{rnd.randint(0, 10**9)} {'word ' * rnd.randint(1, 30)}".strip() for _ in range(rnd.randint(1, 3))]
        if kind == "list":
            return f"<ul>{''.join(f'<li>{t}' for t in texts)}</ul>", texts
        if kind == "quote":
            return f"<blockquote>{texts[0]}</blockquote>", texts[:1]
        return "".join(f"<p>{t}</p>" for t in texts), texts

    rows, want = [], {}
    for i in range(60):
        own = [part(0) for _ in range(6)]
        body = f"<h1>H{i}</h1>{''.join(h for h, _ in own)}"
        shell = rnd.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div id=x>{}</div>", "{}"])
        rows.append((i, f"http://h{i % 3}.x/{i}", f"<html><body><nav><a href=/>x out</a></nav>{shell.format(body)}<footer>out</footer></body></html>"))
        want[i] = "\n\n".join([f"H{i}", *[t for _, ts in own for t in ts]])
    assert extracted(spark, rows) == want
