import math
import re
from collections import defaultdict
from html import unescape

import pytest

from brindle.llm import html, queries

from .fixtures import DATA


def brute_article(page):
    """The article of a page of the test tables: its h1, p and stray text, without a parser."""
    inside = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|p|ul|li|div|blockquote|h2|h3)\b[^>]*>", inside[1]) if inside else []
    texts = (" ".join(unescape(re.sub(r"<br\s*/?>", " ", p) and re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", p)).split()) for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op7_html_extraction(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == brute_article(pages[r.page_id].html) and r.n_chars == len(r.text)


def test_roles_and_references():
    page = """<!doctype html><title>t</title><style>p{}</style><body><header><h1>Site</h1></header><nav><a>x</a></nav><div class="cookie-notice">ok?</div>
    <article><header><h1>Head&nbsp;&amp; tail</h1></header><p>One <b>bold<br>line</b>\n\n two<p>Three &lt;p&gt; &#233;<script>var x="</p>";</script>
    <div class="share-links">Share</div><ul><li>first<li>second</ul><aside>Ad</aside><form>Your mail</form><!-- gone <p> --></article>
    <section id="comments"><article class="comment"><p>Nice!</p></article></section><footer>foot</footer>"""
    assert html.main_text(page).split("\n\n") == ["Head & tail", "One bold line two", "Three <p> é", "first", "second"]
    assert html.main_text("") == "" and html.main_text("plain text only") == "plain text only"
    assert html.main_text("<main><p>a</p></main><p>b</p>") == "a"
    assert html.main_text("<article><p>unclosed") == "unclosed"


def test_style_tree_removes_what_a_host_repeats(spark):
    page = lambda n: f"<body><div class=top>Welcome to us</div><div class=body><p>Story {n} is told here.</p><p>It ends {n * 7}.</p></div><div class=low>All rights</div></body>"
    rows = [(n, f"https://h.org/{n}", page(n), "x") for n in range(30)] + [(50, None, None, "x"), (51, "https://z.org/", "<div class=top>Welcome to us</div>", "x"), (51, "https://z.org/", "<div class=top>Welcome to us</div>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for most in (200_000, 0):  # by broadcast, by join
        got = sorted(map(tuple, html.extract(df, most_broadcast=most).collect()), key=repr)
        assert len(got) == len(rows)
        told = {r[0]: r[2] for r in got}
        assert all(told[n] == f"Story {n} is told here.\n\nIt ends {n * 7}." for n in range(30))
        assert told[50] == ""
    assert html.extract(df.limit(0)).count() == 0


def told(spark, pages, **how):
    """The text of each of ``pages`` as (id, host, html), extracted together."""
    df = spark.createDataFrame([(i, f"https://{h}/{i}", p) for i, h, p in pages], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.extract(df, **how).collect()}


def test_wrapper_with_repeated_text_of_its_own(spark):
    layouts = {
        "a.org": '<body><div class="page"><p>Daily News</p><article><p>story {}</p></article></div></body>',
        "b.org": '<body><div class="page"><button>Menu</button><article><p>story {}</p></article></div></body>',
        "c.org": '<body><div class="page"><p>Daily News</p><div class="text"><p>story {}</p></div></div></body>',
        "d.org": '<body><div class="page"><button>Menu</button><section><p>story {}</p></section></div></body>',
        "e.org": '<body><div class="page"><nav>Menu</nav><nav>Top</nav>story {}</div></body>',
    }
    pages = [(10 * h + n, host, page.format(10 * h + n)) for h, (host, page) in enumerate(layouts.items()) for n in range(5)]
    for most in (200_000, 0):
        assert told(spark, pages, most_broadcast=most) == {i: f"story {i}" for i, _, _ in pages}


def test_copies_within_a_host(spark):
    page = lambda n: f"<body><div class=top>Welcome to us</div><div class=content><p>Story {n} is told.</p><p>It ends {n * 7}.</p></div></body>"
    text = lambda n: f"Story {n} is told.\n\nIt ends {n * 7}."
    pages = [(1, "a.org", page(1)), (1, "a.org", page(1))]  # repeated rows
    pages += [(2, "b.org", page(2)), (3, "b.org", page(2))]  # a host of two copies
    pages += [(10 + n, "c.org", page(max(n, 60))) for n in range(100)]  # 61 copies among 100
    pages += [(200 + n, "d.org", f"<body><section><p>Share this</p><p>Read on</p><p>Only here: {n}.</p></section></body>") for n in range(100)]
    for most in (200_000, 0):
        got = told(spark, pages, most_broadcast=most)
        assert all(got[n] == "Welcome to us\n\n" + text(min(n, 2)) for n in (1, 2, 3))  # as one page alone
        assert all(got[10 + n] == text(max(n, 60)) for n in range(100))
        assert all(got[200 + n] == f"Only here: {n}." for n in range(100))


def test_names_on_layouts_and_articles():
    story = "<p>The story is told here at some length.</p>"
    plain = "The story is told here at some length."
    for page in (
        f'<div class="layout has-sidebar">{story}</div>', f'<div class="with-sidebar"><article>{story}</article></div>',
        f'<main class="no-sidebar">{story}</main>', f'<main class="sidebar">{story}</main>', f'<div class="menu"><main>{story}</main></div>',
        f'<article class="post has-comments">{story}</article>', f'<article class="promo">{story}</article>',
        f'<div id="page" class="menu-open">{story}</div>', f'<section id="related-work">{story}</section>',
        f'<div class="widget"><div class="share"><article>{story}</article></div></div>', f'<div class="page has-header">{story}</div>',
        f'<article>{story}</article><div class="related"><article class="card"><p>A teaser</p></article></div>',
        f'<div class="social"><article>{story}</article></div><section class="post-comments"><article class="comment"><p>I do not agree. {plain * 3}</p></article></section>',
        f'<div class="sidebar"><p>Side</p></div><div class="share-links">Share</div><div class="site-footer">Foot</div><div id="ad-1">Buy</div>{story}',
    ):
        assert html.main_text(page) == plain, page


def test_article_level_only_where_articles_hold_most():
    story = "<p>The story is told here at some length.</p>"
    plain = "The story is told here at some length."
    assert html.main_text(f'<main>{story}<article class="card">teaser</article></main>') == f"{plain}\n\nteaser"
    assert html.main_text(f"<div>{story}</div><article>teaser</article>") == f"{plain}\n\nteaser"
    assert html.main_text(f"<main><p>Lead</p><article>{story}</article></main><p>rest</p>") == f"Lead\n\n{plain}"  # a main element is kept whole
    assert html.main_text(f"<p>rest</p><article>{story}</article>") == plain
    assert html.main_text(f"<main>{story}</main><article>teaser</article>") == plain
    assert html.main_text(f"<main><p>Head</p></main><article>{story}</article>") == f"Head\n\n{plain}"


def test_looks_hold_the_whole_sequence():
    page = lambda last: "<div>" + "<p>a</p><ul><li>b</ul>" * 40 + last + "</div>"
    looks = [html.blocks(page(last))[1]["/div"] for last in ("<pre>c</pre>", "<table></table>")]
    assert looks[0] != looks[1] and looks[0].count(">") == 80


def brute_tree(rows):
    """importance and pages of every branch, and own importance of every repeated content, by host; rows: host, html."""
    votes = defaultdict(set)  # what each distinct main text of a host holds
    for host, page in rows:
        found, looks = html.blocks(page or "")
        found = [b for b in found if not b[2]]
        held = {(b[1], "content", b[0]) for b in found} | {(b[1], "page", "") for b in found} | {(b, "look", x) for b, x in looks.items()}
        votes[host, html._chosen(found)] |= held
    counts = defaultdict(lambda: defaultdict(int))
    for (host, _), held in votes.items():
        for branch, kind, what in held:
            counts[host, branch][kind, what] += 1
    tree = {}
    for place, seen in counts.items():
        m = seen.get(("page", ""), 0)
        if not m:
            continue
        told = {w: k for (kind, w), k in seen.items() if kind == "content"}
        looks = [k for (kind, _), k in seen.items() if kind == "look"]
        content = 1 - sum(k * math.log(k) for k in told.values()) / sum(told.values()) / math.log(m) if m > 1 else 1.0
        entropy = -sum(k / sum(looks) * math.log(k / sum(looks)) for k in looks) / math.log(m) if m > 1 and looks else 0.0
        mixed = lambda x, e=min(1, max(0, entropy)): x + html.DAMP * e * (1 - x)
        tree[place] = (m, mixed(content), sorted(mixed(1 - math.log(k) / math.log(m)) for k in told.values() if k > 1))
    return tree


def test_style_tree_of_the_whole_table_against_brute_force(spark):
    rows = html._hosted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id", "url", "html")
    want = brute_tree([(r.host, r.html) for r in rows.collect()])
    got = defaultdict(list)
    for r in html.style_tree(rows).collect():
        got[r.host, r.branch].append(r)
    assert set(got) == set(want) and any(len(w[2]) for w in want.values())
    for place, (m, importance, own) in want.items():
        assert all(r.pages == m and r.importance == pytest.approx(importance, abs=1e-9) for r in got[place]), place
        assert sorted(r.own for r in got[place] if r.place is not None) == pytest.approx(own, abs=1e-9)


def test_headings_leads_and_tails_of_main():
    assert html.main_text("<main><h1>T</h1><p>Lead</p><article><p>Body</p></article><p>tail</p></main>") == "T\n\nLead\n\nBody\n\ntail"
    assert html.main_text("<main><h1>A title</h1><article><p>The story is told at some length.</p></article></main>") == "A title\n\nThe story is told at some length."
    for name in "content has-sidebar|no-sidebar|layout-with-nav|post related-posts-enabled|ad-free|social-science|share-price-report|notice-board".split("|"):
        assert html.main_text(f'<div class="{name}"><article><p>Real text.</p></article></div>') == "Real text.", name


def test_awkward_pages(spark):
    long = "<article>" + "".join(f"<p>Paragraph {n} of a very long page.</p>" for n in range(30_000)) + "</article>"
    rows = [(1, "https://a.org/x", long, 1), (2, None, "<p>no host</p>", 2), (None, "https://a.org/y", "", 3), (4, "not a url", None, 4), (5, "https://a.org/z", "<div>" * 3000 + "deep", 5),
            (6, "https://b.org/x", "<article><p>Same</p></article>", 6), (7, "https://b.org/x?utm=1", "<article><p>Same</p></article>", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert len(got) == len(rows) and got[1].text.count("\n\n") == 29_999 and got[1].text.endswith("Paragraph 29999 of a very long page.")
    assert (got[2].text, got[None].text, got[4].text, got[5].text, got[6].text, got[7].text) == ("no host", "", "", "deep", "Same", "Same")


LONG = "This sentence belongs to the article and is long enough to count as its text. " * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><form id="aspnetForm"><nav>Menu</nav><article><p>{LONG}</p></article></form></body>', [LONG]),
        (f'<form><div class="content"><p>{LONG}</p></div></form>', [LONG]),
        (f'<article><p>{LONG}</p><form><label>Your mail</label></form></article>', [LONG]),
        (f'<article><p>{LONG}</p><div class="reader-comments"><p>First!</p></div><section class="user-comments">me</section><div id="discussion">so</div></article>', [LONG]),
        (f'<div class="post has-comments"><p>{LONG}</p></div>', [LONG]),
        (f"<main><h1>Title</h1><p>Lead</p><article><p>{LONG}</p></article><p>tail</p></main>", ["Title", "Lead", LONG, "tail"]),
        (f"<main><h2>Title</h2><article><p>{LONG}</p></article></main>", ["Title", LONG]),
        (f"<article><p>{LONG}</p></article><section><h2>More stories</h2><article>Teaser</article></section>", [LONG]),
        (f'<article><p>{LONG} <span class="advert">BUY <b>NOW</b></span>end <ins class="adsbygoogle">x</ins><span hidden>no</span><a class="share">Share</a></p><p>Next</p></article>', [LONG + " end", "Next"]),
        (f'<article><p>{LONG}</p></article><div class="pageFooter">(c)</div><div class="mainMenu">Home</div>', [LONG]),
        (f'<article><p>{LONG}<span class="advert">open</p><p>Next</p></article>', [LONG, "Next"]),
    ],
)
def test_cases_of_the_contract(page, want):
    assert html.main_text(page) == "\n\n".join(" ".join(w.split()) for w in want)


def test_the_tree_decides_where_no_element_says_article(spark):
    """With the article and main tags taken off, the style tree changes pages, and every change removes what the host repeats."""
    bare = lambda page: re.sub(r"</?(?:article|main)\b[^>]*>", "", page or "")
    rows = [(r.page_id, r.url, bare(r.html)) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = {i: html.main_text(page) for i, _, page in rows}
    changed = [i for i in got if got[i] != whole[i]]
    print(f"the tree changes {len(changed)} of {len(got)} pages")
    assert all(set(got[i].split("\n\n")) <= set(whole[i].split("\n\n")) for i in got)
