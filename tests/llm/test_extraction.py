import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almanack.llm import extraction

FRAME = (
    "<!DOCTYPE html><html><head><title>{n} title</title><style>p{{}}</style><script>var t='</p><article>';</script></head><body>"
    "<header><h1>Site</h1></header><nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- note {n} -->"
    "<div class='cookie-notice'>We use cookies {n}</div>{body}"
    "<aside>Side {n}</aside><form><label>Search</label></form><div id='comments'><p>First! {n}</p></div><footer>&copy; Site</footer></body></html>"
)


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "page_id long, url string, html string, host string, article boolean")
    return {r.page_id: r.text for r in extraction.main_texts(df.repartition(2)).collect()}


def test_article(spark):
    body = "<article class='post'><h1>Head &amp;  line</h1><p>One <b>bold</b>\n text<br>more<p>Two &lt;x&gt; {n}<div class='ad'>Buy</div><p>Three</article>"
    rows = [(n, f"http://h.example/{n}", FRAME.format(n=n, body=body.replace("{n}", str(n)))) for n in range(4)]
    got = texts(spark, rows)
    assert got[2] == "Head & line\nOne bold text more\nTwo <x> 2\nThree"


def test_host_without_article_elements(spark):
    body = "<div class='content'><h2>Story {n}</h2><p>" + "Long text of page {n}. " * 8 + "</p></div><div class='fixed'>The same on every page</div>"
    rows = [(n, f"http://plain.example/{n}", FRAME.format(n=n, body=body.replace("{n}", str(n)))) for n in range(5)]
    got = texts(spark, rows)
    assert got[3] == "Story 3\n" + " ".join(["Long text of page 3."] * 8)


def test_joined_decisions(spark, monkeypatch):
    monkeypatch.setattr(extraction, "MOST_BROADCAST", 0)
    test_article(spark)
    test_host_without_article_elements(spark)


def test_nulls_empties_and_repeats(spark):
    rows = [(1, None, None), (2, "http://x.example", ""), (None, "::bad::[", "<p>a"), (4, "", "<p>b</p>"), (4, "", "<p>b</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id or 0), r.url or "", r.text) for r in extraction.main_texts(df).collect())
    assert got == [(0, "::bad::[", "a"), (1, "", ""), (2, "http://x.example", ""), (4, "", "b"), (4, "", "b")]
    assert extraction.main_texts(df.limit(0)).count() == 0


def test_template_classes(spark):
    rows = [(n, f"http://t.example/{n}", f"<html><body><div><p>{n}</p></div><ul>{'<li>x</li>' * n}</ul></body></html>") for n in range(1, 6)]
    template, _ = extraction.templates(spark.createDataFrame(rows, "page_id long, url string, html string"))
    by = {}
    for r in template.collect():
        by.setdefault(tuple(r["class"]), set()).add(r.token)
    assert {"/html", "/html/body", "/html/body/div", "/html/body/div/p", "/html/body/ul", "/html/body/ul/"} <= max(by.values(), key=len)
    assert {"/html/body/ul/li", "/html/body/ul/li/"} in by.values()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<br>", "<b", "'", '"', ">", "<!--", "-->", "<script>", "</script>", "&amp", "x ", "<li>", "</nav>", "<nav>"]), max_size=30).map("".join))
def test_parse_never_fails(page):
    _, blocks = extraction.parse(page)
    assert all(b.text and b.text == " ".join(b.text.split()) and 0 <= b.linked <= len(b.text) for b in blocks)


@pytest.mark.parametrize("page", ["<a " + "'" * 20_000, "<" * 20_000, "<p>" * 5_000, "<!--" * 5_000])
def test_parse_is_not_quadratic(page):
    extraction.parse(page)


def test_template_decides_inside_articles(spark):
    """A line that every page repeats is template in an article too; teasers are no article of the page."""
    repeated = "<main><h1>Story {n}</h1><p>Text of page {n}.</p><div class='hint'>Read this on our app</div></main>"
    teasers = "<div class='content'><p>" + "Long text of page {n}. " * 8 + "</p></div><article class='teaser'><p>Teaser {n}</p></article>"
    rows = [(n, f"http://a.example/{n}", FRAME.format(n=n, body=repeated.replace("{n}", str(n)))) for n in range(4)]
    rows += [(10 + n, f"http://b.example/{n}", FRAME.format(n=n, body=teasers.replace("{n}", str(n)))) for n in range(4)]
    got = texts(spark, rows)
    assert got[2] == "Story 2\nText of page 2."
    assert got[12] == " ".join(["Long text of page 2."] * 8)


def test_class_words_take_no_headline_and_no_page():
    text = lambda page: [t for *_, t in extraction.parse(page)[1]]
    assert text("<article><header class='entry-header'><h1>Headline</h1></header><p>Text</p></article>") == ["Headline", "Text"]
    wrapped = "<a href='#c'>Skip</a><div id='page' class='right-sidebar'><nav>Menu</nav><h1>Story</h1><p>Long text</p><div class='sidebar'>Side</div></div>"
    assert text(wrapped) == ["Skip", "Story", "Long text"]
    assert text("<p>Text of the page</p><div class='header'><h1>Site</h1></div><div class='comments'><p>A longer comment than the page</p></div>") == ["Text of the page"]


@pytest.mark.parametrize("raw", ["<svg viewBox='0 0 1 1'/>", "<object data='x' />", "<select>", "<object data='x'>", "<iframe src='x'>"])
def test_raw_elements_without_an_end_take_no_text(raw):
    assert [t for *_, t in extraction.parse(f"<p>Before</p>{raw}<p>After</p><svg><text>Drawn</text></svg><p>Last</p><title>t")[1]] == ["Before", "After", "Last"]


KEPT = ["<div class='social-policy'>{}</div>", "<div class='related-work'>{}</div>", "<section class='notice-period'>{}</section>", "<p class='alert'>{}</p>", "<p class='comment-quote'>{}</p>", "<div class='notice'>{}</div>", "<div class='has-sidebar'>{}</div>"]
LEFT = ["<div class='ad'>{}</div>", "<div class='ad-slot'>{}</div>", "<ul class='comment-list'><li>{}</li></ul>", "<div class='cookie-banner'>{}</div>", "<div id='sidebar-right'>{}</div>", "<div class='share_links'>{}</div>"]


@pytest.mark.parametrize("pages", [1, 2, 6])
def test_marks_are_whole_names(spark, pages):
    """Text of its own under a name that only holds a boilerplate word stays, on hosts of any size."""
    rows, want = [], {}
    for k, marked in enumerate(KEPT + LEFT):
        own = "A paragraph that only page {n} has"
        body = "<article><h1>Story {n}</h1><p>" + "Text of page {n}. " * 3 + "</p>" + marked.format(own if "<p " in marked else f"<p>{own}</p>") + "</article>"
        rows += [(100 * k + n, f"http://m{k}.example/{n}", FRAME.format(n=n, body=body.replace("{n}", str(n)))) for n in range(pages)]
        want[100 * k] = "Story 0\n" + " ".join(["Text of page 0."] * 3) + ("\nA paragraph that only page 0 has" if marked in KEPT else "")
    got = texts(spark, rows)
    assert {k: got[k] for k in want} == want


def test_doubtful_marks_go_where_the_host_confirms_them(spark):
    """Constant, or mostly links: template. Else article."""
    body = (
        "<article><h1>Story {n}</h1><div class='notice'>Always the same</div><p>Text of page {n}.</p>"
        "<div class='related'><a href='/{n}'>Another story {n}</a> <a href='/x{n}'>and one more {n}</a></div><div class='banner'>Only {n} has this</div></article>"
    )
    rows = [(n, f"http://d.example/{n}", FRAME.format(n=n, body=body.replace("{n}", str(n)))) for n in range(5)]
    assert texts(spark, rows)[3] == "Story 3\nText of page 3.\nOnly 3 has this"


def test_deep_elements_are_slots_of_their_own(spark):
    """Below the depth limit a constant slot goes and a changing one next to it stays."""
    deep = lambda x: "<div>" * 90 + x + "</div>" * 90
    rows = [(n, f"http://deep.example/{n}", "<article><h1>Head {n}</h1>".replace("{n}", str(n)) + deep(f"<p>Own text {n}</p><section>Same</section>") + "</article>") for n in range(4)]
    assert texts(spark, rows)[1] == "Head 1\nOwn text 1"
    tokens, _ = extraction.parse(deep("<p>x</p>"))
    assert len(set(tokens)) == len(tokens) and max(map(len, tokens)) < 600


def plain_decisions(pages):
    """Container and template slots of one host, with every page's slots at hand."""
    parsed = [extraction.parse(html) for _, html in pages]
    vectors = {}
    for k, (tokens, _) in enumerate(parsed):
        for t in tokens:
            vectors.setdefault(t, [0] * len(pages))[k] += 1
    classes = {}
    for t, v in vectors.items():
        classes.setdefault(tuple(v), set()).add(t)
    template = {t for v, ts in classes.items() if len(ts) > 1 and 2 * sum(map(bool, v)) >= len(pages) for t in ts} if len(pages) >= 3 else set()
    slots, doubts = {}, {}
    for k, (_, blocks) in enumerate(parsed):
        for b in blocks:
            slots.setdefault((b.path, b.inside), {}).setdefault(k, []).append(b.text)
            if b.doubtful:
                d = doubts.setdefault(b.path, [set(), 0, 0])
                d[0].add(k)
                d[1] += len(b.text)
                d[2] += b.linked
    same = lambda by: len({tuple(x) for x in by.values()}) == 1
    changing = {k: by for k, by in slots.items() if len(by) < 3 or not same(by)}
    chars = lambda by: sum(len(t) for x in by.values() for t in x)
    best = max(changing, key=lambda k: (k[0] in template, chars(changing[k]), k[1], k[0]), default=None)
    if best is None or len(pages) < 3 and any(inside for _, inside in changing):
        return None
    fixed = {p for (p, _), by in slots.items() if len(by) >= 3 and 2 * len(by) >= len(pages) and same(by) and not extraction.re.search(extraction.FIRST_HEADING, p)}
    fixed |= {p for p, (on, n, linked) in doubts.items() if len(on) >= 3 and 2 * linked >= n}
    return best[0], frozenset(fixed)


def test_decisions_equal_those_with_all_pages_at_hand(spark):
    import random

    rng = random.Random(3)
    parts = [
        "<div class='hint'>Same</div>", "<p>Text {n}</p>", "<p>{n} more text of its own</p>", "<div class='related'><a href='/'>Link {n}</a></div>", "<div class='alert'>Careful {n}</div>",
        "<ul><li>A {n}</li><li>B</li></ul>", "<section><h2>Part</h2><p>Sub {n}</p></section>", "<div class='ad'>Buy {n}</div>", "<h1>Head {n}</h1>", "<nav><a href='/'>x</a></nav>",
    ]
    hosts = {}
    for h in range(14):
        own, wrap = rng.sample(parts, rng.randrange(2, 7)), rng.choice(["<article>{}</article>", "<div class='body'>{}</div>", "{}", "<main><div>{}</div></main>"])
        pages = []
        for n in range(rng.choice([1, 2, 3, 5, 9])):
            held = [x for x in own if rng.random() < 0.8] or own[:1]
            pages.append((f"http://h{h}.example/{n}", "<html><body><header>Site</header>" + wrap.format("".join(held).replace("{n}", str(rng.randrange(4)))) + "</body></html>"))
        hosts[f"h{h}.example"] = pages
    rows = [(k, u, p) for k, (u, p) in enumerate(x for ps in hosts.values() for x in ps)]
    _, decisions = extraction.templates(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = {r.host: (r.container, frozenset(r.fixed or ())) for r in decisions.collect()}
    want = {h: d for h, ps in hosts.items() if (d := plain_decisions(ps))}
    assert got == want and len(want) > 6
