from placekit.llm import html

SCHEMA = "page_id long, url string, html string"


def text(page, templates=frozenset()):
    root = html.parse(page)
    return html.main_text(root, set(templates), html.subtree_hashes(root, ""))


def test_frames_go_and_the_article_stays():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><a>Menu</a></nav>
      <div class="cookie-notice">We use cookies</div><article><header><h1>Head</h1></header><p>One &amp; <b>two</b>
      three&nbsp;four<br>five<p>Unclosed <i>paragraph<ul><li>item <li>other</ul><div class="ad-box">Buy</div><aside>Side</aside><form>Send</form>
      <section id="comments"><article class="comment"><p>First!</p></article></section></article><div id="sidebar">More</div><footer>&copy; all</footer></body></html>"""
    assert text(page) == "Head\n\nOne & two three four five\n\nUnclosed paragraph\n\nitem\n\nother"


def test_cut_off_and_odd_markup():
    assert text("<article><p>Kept</p><p>also &am") == "Kept\n\nalso &am"
    assert text("<article><p>Kept</p><p cla") == "Kept"
    assert text("<article>a < b and 3<4 <!-- gone --> end<!-- open") == "a < b and 3<4 end"
    assert text('<article><p title="a > b">in</p><p title="open>rest</p>') == "in\n\nrest"
    assert text("<p>one<p>two</div></p>three") == "one\n\ntwo\n\nthree"
    assert text("plain") == "plain" and text("") == "" and text("<script>x") == ""
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_names_that_only_look_like_frames():
    assert text('<div class="page has-sidebar no-comments"><p>a</p></div>') == "a"
    assert text('<div id="sidebar-layout"><article class="post comments-open"><div class="entry-header"><h1>T</h1></div><p>b</p></article></div>') == "T\n\nb"
    assert text('<div class="mainHeader"><h1>Site</h1></div><p>c</p><div class="articleComments"><article class="comment">no</article></div>') == "c"
    assert text("<header><nav>x</nav><main><p>d</p></main></header>") == "d"


def test_what_recurs_on_a_host_is_deleted(stored):
    rows = [(i, f"http://site.org/{i}", f"<body><div>Site name</div><div>Own words {i}</div><p>Read our other pages</p></body>") for i in range(20)]
    rows += [(100 + i, f"http://other.org/{i}", f"<body><div>Site name</div><div>Else {i}</div></body>") for i in range(5)]
    got = {r.page_id: r for r in html.extract(stored(rows, SCHEMA, extra=True)).collect()}
    assert got[3].text == "Own words 3" and got[3].n_chars == 11 and got[3].url == "http://site.org/3"
    assert got[102].text == "Site name\n\nElse 2"


def test_paragraphs_of_articles_are_never_templates(stored):
    rows = [(i, "http://site.org/x", f"<article><p>Shared passage</p><p>Own {i}</p><div>Share this</div></article>") for i in range(30)]
    got = {r.page_id: r.text for r in html.extract(stored(rows, SCHEMA)).collect()}
    assert got[4] == "Shared passage\n\nOwn 4"


def test_templates_equal_a_count_by_hand(stored):
    rows = [(i, f"https://u@H{i % 2}.org:80/p", f"<body><div>frame {i % 3}</div><div>own {i}</div></body>") for i in range(60)]
    got = {r.host: set(r["keys"]) for r in html.site_templates(stored(rows, SCHEMA)).collect()}
    want = {}
    for host in ("h0.org", "h1.org"):
        seen = {}
        for i, _, page in rows:
            if f"h{i % 2}.org" == host:
                for key, _ in set(html.subtree_hashes(html.parse(page), host).values()):
                    seen[key] = seen.get(key, 0) + 1
        want[host] = {k for k, n in seen.items() if n >= html.MIN_PAGES}
    assert got == want and all(len(v) == 3 for v in want.values())


def test_nulls_repeats_and_empty_table(stored):
    rows = [(1, None, None), (1, None, None), (None, "bad url", "<p>x</p>"), (2, "http://a/", ""), (3, "http://a/", "<nav>m</nav>"), (4, "http://a/", "<article>" + "long " * 200_000)]
    got = html.extract(stored(rows, SCHEMA, extra=True)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 0), (3, 0), (4, 999_999)]
    assert all(r.text is not None for r in got)
    assert html.extract(stored([], SCHEMA)).collect() == []


def test_copies_of_a_page_are_one_page(stored):
    page = "<body><div class='top'>Site name</div><div class='text'><p>The first passage of the page</p><p>and its second</p></div></body>"
    rows = [(i, f"http://site.org/?v={i}", page.replace("<body>", f"<head><meta name='v' content='{i}'></head><body>") if i % 2 else page) for i in range(12)]
    rows += [(100 + i, None, "<p>Alone</p>") for i in range(9)]
    got = {r.page_id: r.text for r in html.extract(stored(rows, SCHEMA)).collect()}
    assert got[1] == got[2] == "Site name\n\nThe first passage of the page\n\nand its second" and got[103] == "Alone"


def test_most_of_an_unmarked_page_is_no_template(stored):
    body = "<body><div>Site name</div><div id='wrap'><div class='text'>{}</div></div><div>All rights</div></body>"
    rows = [(i, f"http://site.org/{i}", body.format(f"<p>A passage that many pages quote</p><p>Own words {i}</p><div>Read more</div>")) for i in range(20)]
    rows += [(100 + i, f"http://site.org/{i}", body.format("<p>The same long text with another line below it</p>") + f"<span>{i}</span>") for i in range(10)]
    got = {r.page_id: r.text for r in html.extract(stored(rows, SCHEMA)).collect()}
    assert got[3] == "A passage that many pages quote\n\nOwn words 3"
    assert got[104] == "The same long text with another line below it\n\n4"


def test_depth_changes_nothing():
    for n in (3, 197, 250, 3000):
        assert text("<div>" + "<b>" * n + "<article><p>one</p><div>in</div><p>two</p></article>") == "one\n\nin\n\ntwo"
        assert text("<span>" * n + "<nav>menu</nav><p>text</p><div class='comments'><p>c</p></div><aside>side</aside>") == "text"
    assert text("<div role='main' class='banner'>" * 300 + "x" + "</div>" * 300) == ""
    assert text("<p><div>" + "<font>" * 50_000 + "<h1>t</h1>" * 3000).startswith("t\n\nt")


def test_a_head_without_its_end_tag():
    assert text("<html><head><title>T</title><meta charset=utf-8><body><article><p>in</p></article></body>") == "in"
    assert text("<head><title>T</title><style>x{}</style><p>para</p>") == "para" and text("<head><title>T</title>bare text") == "bare text"


def test_wrapped_pages_keep_their_text():
    long = "A long text that makes up most of what this page says. " * 5
    for wrap in ('<form action="/">{}</form>', '<div class="sticky-header">{}</div>', '<div class="content-sidebar-wrap">{}</div>', "<header>{}</header>", '<div role="form">{}</div>'):
        assert text("<body>" + wrap.format(f"<nav><a>m</a></nav><p>{long}</p>") + "<footer>f</footer></body>") == long.strip()
        assert text("<body>" + wrap.format(f"<nav><a>m</a></nav><article><p>{long}</p></article>") + "</body>") == long.strip()
    assert text(f"<body><nav>{'<a>link of the menu</a> ' * 50}</nav><p>short</p><form>Search</form></body>") == "short"


def test_names_inside_an_article_need_evidence():
    long = "What is said here is part of the article and longer than a label, whatever its block is called by the people who wrote the page. "
    for block in ('<section id="related-work">{}</section>', '<div class="comment-box">{}</div>', '<p class="alert">{}</p>', '<div class="share-price">{}</div>'):
        assert text("<article><p>one</p>" + block.format(long) + "<p>two</p></article>") == f"one\n\n{long.strip()}\n\ntwo"
    assert text('<article><p>one</p><div class="share-price">ACME 12.50</div><p class="alert">Mind the gap</p></article>') == "one\n\nACME 12.50\n\nMind the gap"
    for block in (f'<div id="comments"><p>{long}</p></div>', '<div class="share-bar">Share this</div>', f'<div class="related-posts">{"<a>an older article of ours</a> " * 20}</div>',
                  f'<section class="comment-list comments"><article class="comment"><p>{long}</p></article></section>'):
        assert text(f"<article><p>one</p>{block}<p>two</p></article>") == "one\n\ntwo"


def test_only_the_count_tells_a_named_block_of_an_article(stored):
    note = "This offer of the house goes on for longer than a label would, so that only its recurring on many pages of the site tells what it is. " * 2
    rows = [(i, f"http://site.org/{i}", f'<article><p>Own text {i}</p><div class="promo-box"><p>{note}</p></div></article>') for i in range(20)]
    rows += [(100, "http://other.org/1", f'<article><p>Own</p><div class="promo-box"><p>{note}</p></div></article>')]
    got = {r.page_id: r.text for r in html.extract(stored(rows, SCHEMA)).collect()}
    assert got[7] == "Own text 7" and got[100] == f"Own\n\n{note.strip()}"


def test_whole_results_by_hand(stored):
    """Texts of a small site, worked out page by page with counts in plain Python."""
    rows = [(i, f"http://site.org/{i}", f"<head><title>{i}</title><body><div>Site name</div><div class='c{i % 3}'>Section {i % 3}</div><div><p>Own words of page {i}, a few more than the frame has</p></div>"
             f"<div>Only {i // 4}</div><ul><li>one<li>two</ul>") for i in range(24)]
    got = {r.page_id: r.text for r in html.extract(stored(rows, SCHEMA)).collect()}
    for i, _, _ in rows:
        # the name and the list are on all pages, a section on eight, "Only" lines on four
        assert got[i] == f"Own words of page {i}, a few more than the frame has\n\nOnly {i // 4}"
