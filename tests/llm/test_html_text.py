import random

from loomgraph.llm.html_text import blocks, extract_pages, shared_lines

SCHEMA = "page_id long, url string, html string, text string"


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        found = shared_lines(a, b)
        assert len(found) == lcs_length(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def text_of(html):
    return " ".join(t for t, skip, *_ in blocks(html) if not skip)


def test_blocks():
    assert text_of("<p>a&amp;b<br>c  d</p><script>x<p></script><p>e") == "a&b c d e"
    assert text_of("<div class='ad-box'>buy</div><p>keep</p><div id=comments><p>hi</p></div>") == "keep"
    assert text_of("<article><header><h1>T</h1></header><p>x</p></article><footer>f</footer>") == "T x"
    assert text_of("<p>1 < 2 <!-- no --> and <b>bold</b>ly<p>next<form><p>f</p></form>") == "1 < 2 and boldly next"
    assert text_of("<p>cut off <a href='x") == "cut off"
    assert text_of("<article><p class='share-price'>1.20</p><p class='comment-on-law'>x</p><p id='notice-of-claim'>y</p><p class='has-sidebar'>z</p></article>") == "1.20 x y z"
    assert text_of("<p>a</p><div class='site-header top'>h</div><div id='cookie_banner-2'>c</div><ul class='related-posts'><li>r</ul><div class='ad-300'>b</div>") == "a"
    for name in ("user-comments", "fb-comments", "reader-responses", "breaking-notice", "cookie-law-info", "userComments", "site-cookie-policy", "comments_list-2"):
        assert text_of(f"<article><p>a</p><div class='{name}'>x</div></article>") == "a", name
    for name in ("share-price", "notice-of-claim", "cookie-recipe", "results-discussion", "no-sidebar", "article-text", "login-history-essay"):
        assert text_of(f"<article><p>a</p><div class='{name}'>x</div></article>") == "a x", name
    assert text_of("") == "" and text_of("plain") == "plain"
    assert len(text_of("<p>word</p>" * 50_000).split()) == 50_000


def test_differencing_and_edges(spark):
    page = "<body><div>Site name</div><div>Home of {0}</div><p>Own text {0} one.</p><p>More of {0}.</p><div>All about us</div></body>"
    rows = [(i, f"http://h.example/a/{i}", page.format(f"n{i}x" * 30), "x") for i in range(6)]
    rows += [(100, "http://k.example/a", "<div>alone</div>", "x"), (101, None, None, "x"), (102, "::bad[url", "", "x"), (103, "http://k.example/z", "<main><p>in main</p></main><p>out</p>", "x")]
    rows += [(104, "http://c.example/1", "<p>copy text</p><p>same</p>", None), (105, "http://c.example/2", "<p>copy text</p><p>same</p>", None), (106, "http://h.example/a/0", rows[0][2], "x"), (106, "http://h.example/a/0", rows[0][2], "x")]
    got = [(r.page_id, r.text, r.n_chars) for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[1] for r in got}
    for i in range(1, 6):
        own = f"n{i}x" * 30
        assert by[i] == f"Home of {own} Own text {own} one. More of {own}."
    assert by[100] == "alone" and by[101] == "" and by[102] == "" and by[103] == "in main"
    assert by[104] == by[105] == "copy text same"
    assert all(n == len(t) for _, t, n in got)
    assert extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_are_shared_over_halves_too():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        found = shared_lines(a, b, most=4)
        assert len(found) == lcs_length(a, b) and all(a[i] == b[j] for i, j in found)


def test_differencing_inside_article_and_teasers(spark):
    page = "<body><article><h1>Title {0}</h1><div class='x1'>Read all our offers of the week here.</div><p>Own text {0} first part.</p></article></body>"
    teaser = "<body><article><p>Short teaser.</p></article><div><p>Long own main text of page {0}.</p></div><div>All rights with us</div></body>"
    menu = "<body>" + "".join(f"<div>Menu entry number {i} of the shop</div>" for i in range(20)) + "<p>{0}</p></body>"
    rows = [(i, f"http://a.example/x/{i}", page.format(f"n{i}x" * 20), "x") for i in range(4)]
    rows += [(10 + i, f"http://t.example/x/{i}", teaser.format(f"n{i}x" * 20), "x") for i in range(4)]
    rows += [(20 + i, f"http://m.example/x/{i}", menu.format(f"n{i}x" * 33), "x") for i in range(2)]
    copy = "<article><p>A copied article of one host.</p><p>With its second line.</p></article>"
    rows += [(30 + i, f"http://c.example/{i}", copy + f"<footer>{i}</footer>", "x") for i in range(2)]
    by = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(4):
        own = f"n{i}x" * 20
        # The ends of a host have one neighbour only, which isn't enough to delete inside an article.
        end = i in (0, 3)
        assert by[i] == f"Title {own} " + "Read all our offers of the week here. " * end + f"Own text {own} first part."
        assert by[10 + i] == "Short teaser. " * end + f"Long own main text of page {own}."
    assert [by[20 + i] for i in range(2)] == [f"n{i}x" * 33 for i in range(2)]
    assert by[30] == by[31] == "A copied article of one host. With its second line."


def test_whole_pages_by_words(spark):
    """Precision and recall of words on pages with planted furniture, with and without telling names."""
    rng = random.Random(13)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows, want = [], {}
    for host in range(6):
        top, foot, side = text(12), text(15), [text(4) for _ in range(5)]
        for i in range(20):
            article = [text(rng.randint(10, 60)) for _ in range(rng.randint(2, 6))]
            named = host % 2
            wrap = lambda name, body: f"<div class='{name if named else 'x' + str(host)}'>{body}</div>"  # noqa: B023, E731
            body = "".join(f"<p>{p}</p>" for p in article)
            body = f"<article>{body}</article>" if host % 3 else body
            rows.append((host * 100 + i, f"http://h{host}.example/a/{i}", f"<body>{wrap('navbar', top)}{''.join(wrap('sidebar-left', x) for x in side)}{body}{wrap('site-footer', foot)}<script>x</script></body>", "x"))
            want[host * 100 + i] = " ".join(article)
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    both = sum(len(set(got[i].split()) & set(want[i].split())) for i in want)
    precision, recall = both / sum(len(set(got[i].split())) for i in want), both / sum(len(set(want[i].split())) for i in want)
    assert precision > 0.98 and recall > 0.99, (precision, recall)


def test_articles_keep_what_they_share_by_chance(spark):
    """Headings, a sentence of two articles, and versions of one text stay; a notice at the same place in all goes."""
    rng = random.Random(21)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(20))
    rows, want = [], {}

    def add(i, url, blocks_):
        rows.append((i, url, "<body><nav>n</nav><article>" + "".join(f"<{t}>{x}</{t}>" for t, x in blocks_) + "</article></body>", "x"))

    for i in range(6):
        own = [("h1", text()), ("h2", "Introduction"), ("p", text()), *[("p", text()) for _ in range(i % 3)], ("p", "A sentence that many articles have."), *[("p", text()) for _ in range(i * 2 % 5)], ("h2", "Conclusion"), ("p", text())]
        if i % 2:
            own.insert(2, ("p", "Another shared one."))
        want[i] = " ".join(x for _, x in own) + " Sign up for our letters below." * (i in (0, 5))
        add(i, f"http://a.example/n/{i}", [*own, ("div", "Sign up for our letters below.")])
    version = [("p", text()) for _ in range(13)]
    for i in range(3):
        version[12] = ("p", text())
        want[20 + i] = " ".join(x for _, x in version)
        add(20 + i, f"http://v.example/text/{i}", list(version))
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want

