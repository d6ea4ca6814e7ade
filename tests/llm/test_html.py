import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tracelode.llm import common as C
from tracelode.llm import html as H

P1 = "The first paragraph of the article has a few sentences. It goes on for a while, and then it stops."
P2 = "A second paragraph, with an &amp; and a &lt;tag&gt;, follows here; it is long enough to count as text, too."
P3 = "Short one."
WANT = f"Title\n\n{P1}\n\n{unescape(P2)}\n\n{P3}"
BODY = f"<h1>Title</h1><p>{P1}</p><p>{P2}<p>{P3}</p>"

PAGES = {
    "article": (f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article>{BODY}</article><footer>&copy; Someone, 2020. All rights reserved.</footer></body></html>", WANT),
    "main div": (f"<body><header><h2>Site name</h2></header><div class='sidebar'><p>Popular: one, two, three.</p></div><div id=content>{BODY}</div><div class='cookie-notice'><p>We use cookies, and more cookies, to show you things. Accept?</p></div>", WANT),
    "comments": (f"<main><article>{BODY}<section id='comments'><h3>3 comments</h3><div class=comment><p>I don't agree with this article at all, since it is wrong. Yes, all of it.</p></div></section></article></main>", WANT),
    "form, aside, advert": (f"<body><article><header><h1>Title</h1></header><p>{P1}</p><aside><p>Read also: other things, and more.</p></aside><div class='ad'>Buy it now, it's cheap, and good.</div><form><p>Subscribe to us, please.</p><input><button>Go</button></form><p>{P2}</p><p>{P3}</p></article>", WANT),
    "script and style": (f"<body><script>var t = '<p>no, never, not this.</p>';</script><style>p {{}}</style><article>{BODY}<script>x</script></article><!-- <p>nor, ever, this.</p> -->", WANT),
    "unclosed": (f"<body><div class=ad>x<div>y</div></div><article><h1>Title</h1><p><b>{P1}<br><p>{P2}<p>{P3}", WANT),
    "uppercase and quotes": (f"<BODY><ARTICLE data-x='a > b' DATA-Y=\"c > d\">{BODY.replace('<p>', '<P>')}</ARTICLE>", WANT),
    "white space": (f"<article><h1> Title\n</h1>\n<p>\n{P1.replace(' ', '  ', 5)}&nbsp;</p><p>{P2.replace(' ', '<br>', 3)}</p><p>{P3}</p></article>", WANT),
    "inline": (f"<article><h1>Ti<b>t</b>le</h1><p>{P1.replace('first', '<a href=x>fi<i>rst</i></a>')}</p><p>{P2}</p><p>{P3}</p></article>", WANT),
    "entities": ("<article><p>caf&eacute; &#233;&#xE9; &amp;amp; &hellip; ok.</p></article>", "café éé &amp; … ok."),
    "form around the page": (f"<body><form id=aspnet><div class=menu><ul><li>Home</li></ul></div><div>{BODY}</div><div class=footer>Imprint, and more.</div></form></body>", WANT),
    "text in a form": ("<body><form>article</form></body>", "article"),
    "odd names around": (f"<body><nav><a>Home</a></nav><div class='hidden-gem notice-board tags'><div class=related>{BODY}</div></div><p>Imprint</p></body>", WANT),
    "odd names inside": (f"<article><h1 class=banner>Title</h1><p class=related>{P1}</p><p class='share notice'>{P2}</p><p class=bottom>{P3}</p></article>", WANT),
    "formulas": (f"<article><h1>Title</h1><p>{P1}</p><p>{P2}</p><p>Short <math><mi>o</mi><mo>n</mo></math>e.</p></article>", WANT),
    "tables": (f"<article><h1>Title</h1><p>{P1}</p><table><tr><td>a<td>7</table><p>{P3}</p></article>", f"Title\n\n{P1}\n\na\n\n7\n\n{P3}"),
    "a short list in long text": (f"<article><h1>Title</h1><p>{P1 * 40}</p><ul><li>x</li><li>two</li></ul></article>", f"Title\n\n{P1 * 40}\n\nx\n\ntwo"),
    "only a menu": ("<nav><ul><li>Home, sweet home.</li><li>Away</li></ul></nav>", ""),
    "null": (None, ""),
    "empty": ("", ""),
    "only menus": ("<nav><a>x</a></nav><footer>y</footer>", ""),
    "text": ("no markup < here > at all", "no markup < here > at all"),
    "broken": ("<p class=\"x>never closed <p>a</p><!-- open", None),
    "long": ("<article>" + "<p>Some words, and more.</p>" * 30000 + "</article>", "\n\n".join(["Some words, and more."] * 30000)),
    "one long block": (f"<nav>m</nav><article><h1>Title</h1><p>{'word, ' * 40000}</p></article>", "Title\n\n" + " ".join(["word,"] * 40000)),
    "a long section": (f"<body><nav>Home</nav><article><h1>Title</h1><p>{P1}</p><p>{P2}</p><section id=results>{f'<p>{P1}</p>' * 12}</section></article><p>Imprint</p>", f"Title\n\n{P1}\n\n{unescape(P2)}" + f"\n\n{P1}" * 12),
    "a long part in a div": (f"<body><div class=sidebar><p>{P1}</p></div><div id=content><h1>Title</h1><p>{P1}</p><div id=results>{f'<p>{P1}</p>' * 12}</div></div></body>", f"Title\n\n{P1}" + f"\n\n{P1}" * 12),
    "comments longer than the article": (f"<body><article>{BODY}</article><section id=comments>{f'<div class=comment><p>{P1}, {P1}, {P1}</p></div>' * 9}</section></body>", WANT),
    "lists": (f"<article><h1>Title</h1><p>{P1}</p><ul><li>one thing, here</li><li>two</li></ul><p>{P3}</p></article>", f"Title\n\n{P1}\n\none thing, here\n\ntwo\n\n{P3}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    got = H.extract(html or "")
    assert want is None or got == want


def test_operator(spark):
    rows = [(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES.values())] + [(None, None, "<p>x", ""), (0, "u0", PAGES["article"][0], "")]
    out = H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    want = {i: w for i, (_, w) in enumerate(PAGES.values())}
    assert all(want.get(r.page_id) in (None, r.text) for r in out if r.page_id is not None)
    assert H.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_driver_table(spark):
    """The pages' articles are flat, so a plain parse of the article element must agree."""
    pages = C.table(spark, "/root/testdata/sf0.01", "pages").collect()
    got = {r.page_id: r.text for r in H.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        plain = [" ".join(unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
        assert got[p.page_id] == "\n\n".join(x for x in plain if x)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/\"'=!- apdivbrscript&;#x1", max_size=200))
def test_total_on_anything(html):
    assert isinstance(H.extract(html), str)


def plain_blocks(html):
    """The blocks of a well-formed page by the standard library's parser: (ancestors with their classes, text)."""
    from html.parser import HTMLParser

    out, stack, text = [], [], []

    class Parser(HTMLParser):
        def flush(self):
            s = " ".join("".join(text).split())
            text.clear()
            if s:
                out.append((tuple(stack), s))

        def handle_starttag(self, tag, attrs):
            self.flush()
            stack.append((tag, dict(attrs).get("class") or "", len(out), object()))

        def handle_endtag(self, tag):
            self.flush()
            stack.pop()

        def handle_data(self, data):
            text.append(data)

    p = Parser()
    p.feed(html)
    p.close()
    p.flush()
    return out


def brute(html):
    """The method's rules one by one, with paths as tuples of names and every ancestor looked at for every block."""
    found = plain_blocks(html)
    if not found:
        return ""
    paths = [tuple((t, c) for t, c, *_ in up) for up, _ in found]
    mean = {p: [sum(f(s) for q, (_, s) in zip(paths, found) if q == p) / paths.count(p) for f in (len, lambda s: sum(c in ".,;:!?" for c in s))] for p in set(paths)}
    smooth = lambda x: [(x[i] + H.NEIGHBOUR * sum(x[j] for j in (i - 1, i + 1) if 0 <= j < len(x))) / (1 + H.NEIGHBOUR * sum(0 <= j < len(x) for j in (i - 1, i + 1))) for i in range(len(x))]
    fused = [(a * (b + 0.1)) ** 0.5 for a, b in zip(*(smooth([mean[p][k] for p in paths]) for k in (0, 1)))]
    fused = {p: sum(f for f, q in zip(fused, paths) if q == p) / paths.count(p) for p in set(paths)}
    bad = lambda t, up: t in H.NEVER and not (t == "header" and "article" in [u[0] for u in up])
    never = lambda up: sum(bad(t, up[:k]) for k, (t, *_) in enumerate(up))
    marked = lambda t, c: t not in ("html", "body", "article", "main") and any(w.lower() in H.MARKS for w in re.findall("[A-Z]?[a-z]+|[A-Z]+", c))
    hard = lambda up: sum(t in H.FORM or marked(t, c) and not bad(t, up[:k]) and t not in H.PARAGRAPHS for k, (t, c, *_) in enumerate(up))
    soft = lambda up: sum(marked(t, c) and t in H.PARAGRAPHS for t, c, *_ in up)
    weighted = [fused[p] * H.MARKED ** (never(up) + min(1, hard(up))) for p, (up, _) in zip(paths, found)]
    chosen = [(up, s) for w, (up, s) in zip(weighted, found) if w >= H.LEAST_RATIO * max(weighted)]
    penalty = lambda up: never(up) + min(1, hard(up))
    for most in sorted({penalty(up) for up, _ in chosen}):
        fewer = [(up, s) for up, s in chosen if penalty(up) <= most]
        if sum(len(s) for _, s in fewer) >= H.LEAST_SHARE * sum(len(s) for _, s in chosen):
            break
    chosen = fewer
    best = ()
    for up, _ in chosen:
        for k in range(len(up) + 1):
            held = sum(len(s) for other, s in chosen if [u[3] for u in other[:k]] == [u[3] for u in up[:k]])
            if held >= H.MOST_TEXT * sum(len(s) for _, s in chosen) and k > len(best):
                best = up[:k]
    if best and best[-1][0] in H.PARAGRAPHS:
        best = best[:-1]
    grown = len(best)
    ids = lambda up: [u[3] for u in up]
    for k in range(len(best) - 1, 0, -1):
        up = best[:k]
        if up[-1][0] in ("html", "body") or best[k][0] in ("article", "main"):
            break
        below = ids(best[: k + 1])
        near = [o for o, _ in chosen if ids(o[:k]) == ids(up) and (never(o), hard(o)) == (never(up), hard(up))]
        beside = [o for o in near if ids(o[: k + 1]) != below]
        own = [o for o in near if len(o) == k + 1 and o[-1][0] in H.PARAGRAPHS]
        if beside and (own or any(u[0] == "article" for u in up) or up[-1][0] == "main"):
            grown = k
    best = best[:grown]
    inside = [(p, up, s) for p, (up, s) in zip(paths, found) if [u[3] for u in up[: len(best)]] == [u[3] for u in best]]
    least = H.LEAST_INSIDE * max(fused[p] for p, *_ in inside)
    return "\n\n".join(s for p, up, s in inside if fused[p] * H.INSIDE ** (never(up) + hard(up) - hard(best)) * H.PARAGRAPH ** (soft(up) - soft(best)) >= least)


NODES = st.recursive(st.sampled_from(["Some words, here.", "x", "A longer sentence; it goes on, and on, until it ends.", "Menu"]), lambda inner: st.tuples(st.sampled_from(["div", "section", "article", "nav", "footer", "form", "aside", "header"]), st.sampled_from(["", "", "ad", "comments", "text"]), st.lists(inner, min_size=1, max_size=4)), max_leaves=14)


@settings(max_examples=150, deadline=None)
@given(st.lists(NODES, min_size=1, max_size=5))
def test_against_brute_force(nodes):
    def written(node):
        if isinstance(node, str):
            return f"<div class='par'>{node}</div>" if len(node) % 2 else f"<blockquote>{node}</blockquote>"
        return f"<{node[0]} class='{node[1]}'>{''.join(map(written, node[2]))}</{node[0]}>"

    html = "<body>" + "".join(map(written, nodes)) + "</body>"
    assert H.extract(html) == brute(html)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "deep text", "<b>" * 100_000 + "<div>x</div>" * 20_000, "<div class=c>y" * 50_000, "<ul><li>" * 50_000 + "z", "</p>" * 100_000 + "t", "<p>" * 100_000 + "t"])
def test_deep_pages_take_little(page):
    import time
    import tracemalloc

    tracemalloc.start()
    start = time.perf_counter()
    assert H.extract(page)
    took, peak = time.perf_counter() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and took < 60
