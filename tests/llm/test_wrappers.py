"""Wrapper inference and main text."""

import random

from talkframe.llm import wrappers as W


def page(rng, k, body="article", hidden=True):
    menu = "".join(f'<li><a href="/{i}">item {rng.randrange(99)}</a></li>' for i in range(rng.randint(2, 6)))
    paras = [f"Paragraph {k} {i} with some words &amp; more\n text" for i in range(rng.randint(1, 5))]
    text = [f"Title {k}"] + [" ".join(p.replace("&amp;", "&").split()) for p in paras]
    inner = f"<h1>Title {k}</h1>" + "".join(f"<p>{p}" + rng.choice(["", "</p>"]) for p in paras)
    note = '<div class="cookie-notice">We use cookies</div>' if rng.random() < 0.5 else ""
    side = '<aside><p>Other stories today</p></aside>' if rng.random() < 0.5 else ""
    comments = '<section id="comments"><h2>Comments</h2><p>I disagree, says a reader</p></section>' if rng.random() < 0.5 else ""
    opening = {"article": "<article>", "div": '<div class="content">'}[body]
    closing = {"article": "</article>", "div": "</div>"}[body]
    html = (f'<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>'
            f"<header><p>Site name</p></header><nav><ul>{menu}</ul></nav>{note}{opening}{inner}{closing}{side}{comments}"
            f"<p>All rights belong to the example site</p><form><label>Mail</label><input></form><footer>&copy; site {k}</footer>" + rng.choice(["</body></html>", ""]))
    return html, "\n".join(text)


def test_articles_by_wrapper():
    for body in ("article", "div"):
        rng = random.Random(4)
        pages = [page(rng, k, body) for k in range(30)]
        wrapper = None
        for html, _ in pages:
            t = W.slim(W.tree(html))
            wrapper = t if wrapper is None else W.merge(wrapper, t)
        found = W.roles(wrapper)
        for html, want in pages:
            assert W.article(html, found) == want


def test_alignment_makes_optional_and_repeated_groups():
    a, b = W.tree("<div><h2>x</h2><p>1</p><p>2</p></div>"), W.tree("<div><p>3</p><span>s</span></div>")
    kids = {k[W.SIG]: k for k in W.merge(a, b)[W.KIDS][0][W.KIDS]}
    assert (kids["h2"][W.FLAGS], kids["p"][W.FLAGS], kids["span"][W.FLAGS]) == ("?", "+", "?")
    assert kids["p"][W.KIDS][0][W.TEXT] is None and kids["h2"][W.KIDS][0][W.TEXT] == "x"
    c = W.tree("<dl><dt>a</dt><dd>1</dd><dt>b</dt><dd>2</dd></dl>")[W.KIDS][0]
    assert [(k[W.SIG], k[W.FLAGS]) for k in c[W.KIDS]] == [("dt", "+"), ("dd", "+")]


def test_edges():
    assert W.article(None, None) == W.article("", None) == W.article("<p>", None) == ""
    assert W.article("plain &lt; text &#233;\xa0 &hellip; &am", None) == "plain < text é … &am"
    assert W.article("<article><p>a<br>b <i>c</i>d</p>e</article><p>f", None) == "a b cd\ne"
    assert W.article("<p>a < b</p></b></div><!-- x", None) == "a < b"
    deep = "<div>" * 300 + "x" + "</div>" * 300
    assert W.article(deep, None) == "x"
    assert W.host("https://User@Ex.ample:80/a?b//c") == "ex.ample" and W.host(None) == W.host("abc") == ""


def test_extract(spark):
    rng = random.Random(6)
    pages = [page(rng, k, "div") for k in range(24)]
    rows = [(k, f"http://h.example/{k}", h, "clash") for k, (h, _) in enumerate(pages)]
    rows += [(100, None, "<p>alone</p>", "c"), (101, "http://x/", None, "c"), (None, "http://y/", "", "c"), rows[0]]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(5)
    want = sorted([(str(k), pages[k][1]) for k in range(24)] + [("0", pages[0][1]), ("100", "alone"), ("101", ""), ("None", "")])
    for bound in (W.BROADCAST_BYTES, -1):
        old, W.BROADCAST_BYTES = W.BROADCAST_BYTES, bound
        got = W.extract(df).collect()
        W.BROADCAST_BYTES = old
        assert sorted((str(r.page_id), r.text) for r in got) == want
        assert all(r.n_chars == len(r.text) for r in got)
    assert W.extract(df.limit(0)).collect() == []


def test_places_of_one_path_have_their_own_marks():
    kinds = {
        "notice": lambda k: (f"<body><p>Constant notice</p><h1>Title {k}</h1>" + "".join(f"<p>Body {k} {i}</p>" for i in range(1 + k % 3)) + "</body>",
                             [f"Title {k}"] + [f"Body {k} {i}" for i in range(1 + k % 3)]),
        "menu": lambda k: ("<body>" + ("<div>" + "".join(f'<a href="/{i}">item {k} {i}</a> ' for i in range(2 + k % 3)) + "</div>" if k % 4 else "")
                           + f"<h1>Title {k}</h1><div>Article {k} with words of its own</div></body>",
                           [f"Article {k} with words of its own"]),  # the smallest element with most of the text
        "a text that equals the notice": lambda k: (f"<body><p>Notice</p><h1>Title {k}</h1><p>{'Notice' if k == 3 else f'A body of page {k}'}</p></body>",
                                                    [f"Title {k}", "Notice" if k == 3 else f"A body of page {k}"]),
    }
    for kind, make in kinds.items():
        pages = [make(k) for k in range(12)]
        wrapper = None
        for html, _ in pages:
            t = W.slim(W.tree(html))
            wrapper = t if wrapper is None else W.merge(wrapper, t)
        found = W.roles(wrapper)
        for html, want in pages:
            assert W.article(html, found).split("\n") == want, kind
