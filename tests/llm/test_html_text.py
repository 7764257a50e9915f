import math
import random

from hoploom.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>one</a></li></ul></nav><!-- ad --><div class="ad">Buy now, a long advert text that goes on and on for very many words.</div>
<div class=cookieNotice>We use cookies</div><article><h1>Title&nbsp;A</h1><p><b>First  para&amp;graph.<br><p>Second
 <a href=x>with link</a> text that is long enough.</p><form><input name=q>Search</form><ul><li>item one<li>item two</ul>
<section class="comments"><p>A reader says that this is a very long comment, longer than all of the article.</p></section></article><aside>More</aside><footer>&copy; me</footer>"""


def test_page():
    assert h.extract(PAGE) == "Title A\n\nFirst para&graph.\n\nSecond with link text that is long enough.\n\nitem one\n\nitem two"


def test_density_without_article_element():
    html = "<div><a href=1>l1</a> <a href=2>l2</a> <a href=3>l3</a></div><div><p>" + "long text of the story " * 9 + "</p><p>" + "and more of it here " * 9 + "</p></div><div>tiny</div>"
    assert h.extract(html) == ("long text of the story " * 9).strip() + "\n\n" + ("and more of it here " * 9).strip()


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "bare text  only"), (4, "u", "<p>unclosed <b>x</i></p></b> y"), (5, "u", "<script>never ends"), (6, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (7, "u", PAGE), (8, "u", PAGE), (9, "u", "<p>" + "x " * 200000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in h.extract_pages(df).collect()}
    assert [got[i].text for i in (1, 2, 3, 4, 5, 6)] == ["", "", "bare text only", "unclosed x\n\ny", "", "deep"]
    assert got[7].text == got[8].text and got[9].n_chars == 399999
    assert h.extract_pages(df.limit(0)).count() == 0


def paragraphs(name, n, size=500):
    return [f"{name}{i} ".ljust(size - 1, "x") + "." for i in range(n)]


def as_html(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_sections_without_article_stay_whole():
    first, second = paragraphs("a", 10), paragraphs("b", 8)
    links = "<ul>" + "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(9)) + "</ul>"
    sections = f"<div>{as_html(first)}</div><div>{as_html(second)}</div>"
    whole = ["The title", *first, *second]
    assert h.extract(f"<body><div id=content><h1>The title</h1>{sections}</div>").split("\n\n") == whole
    assert h.extract(f"<body>{links}<h1>The title</h1><div>{links}<div>{sections}</div></div>{links}<div>tiny</div>").split("\n\n") == whole
    # The second section's wrapper is mostly links; the section itself reaches the threshold.
    assert h.extract(f"<body><h1>The title</h1><div>{as_html(first)}</div><div>{links * 9}<div>{as_html(second)}</div></div>").split("\n\n") == whole


def test_title_and_lead_before_one_section():
    text = paragraphs("a", 10)
    page = f"<body><div>Site</div><div><h1>The title</h1><p>A short lead.</p><div>{as_html(text)}</div></div><div>tiny</div>"
    assert h.extract(page).split("\n\n") == ["The title", "A short lead.", *text]


def test_articles_side_by_side_stay_and_main_ends_the_search():
    first, second = paragraphs("a", 6), paragraphs("b", 5)
    assert h.extract(f"<article>{as_html(first)}</article><article>{as_html(second)}</article>").split("\n\n") == [*first, *second]
    assert h.extract(f"<main><div>{as_html(first)}</div></main><div>{as_html(second)}</div>").split("\n\n") == first


def test_wrappers_with_noise_words_keep_the_article():
    text = paragraphs("a", 6)
    article = f"<article><h1>T</h1>{as_html(text)}</article>"
    side = "<div class=sidebar><p>" + "side text " * 20 + "</p></div>"
    comments = "<div id=comments><article class=comment><p>" + "a reader says " * 400 + "</p></article></div>"
    for wrapper in ('div class="content has-sidebar"', "div class=no-sidebar", "div class=layout-with-header", "div class=search-result-page", "div id=content-header-fixed", "div class=hasSidebar", "form", "div role=form"):
        end = f"</{wrapper.split()[0]}>"
        for page in (article + side, article + comments, f"<h1>T</h1>{as_html(text)}{side}"):
            assert h.extract(f"<body><{wrapper}>{page}{end}").split("\n\n") == ["T", *text], (wrapper, page[:20])
    # Two wrappers around each other, and a form in the article around its text.
    assert h.extract(f"<form><div class='sidebar-right page'>{article}{side}</div></form>").split("\n\n") == ["T", *text]
    assert h.extract(f"<article><h1>T</h1><form>{as_html(text)}</form></article>").split("\n\n") == ["T", *text]


def test_noise_words_on_running_text_and_on_true_noise():
    text = paragraphs("a", 6)
    marked = [f"{name} ".ljust(300, "y") for name in ("notice", "related", "discussion", "social")]
    inner = "".join(f"<p class={t.split()[0]}>{t}</p>" for t in marked)
    noise = "<p class=ad>buy</p><div class='related'><article><p>teaser</p></article></div><form>Search</form><div class='banner has-image'>big</div>"
    assert h.extract(f"<article><h1>T</h1>{as_html(text)}{inner}{noise}</article>").split("\n\n") == ["T", *text, *marked]
    assert h.extract(f"<article><h1>T</h1>{as_html(text)}</article>{noise}<div class=comments><h1>Replies</h1><p>" + "so long " * 999).split("\n\n") == ["T", *text]
    assert h.extract("<div class=ad>" + "buy now " * 30 + "</div><article><h1>T</h1><p>short</p></article>") == "T\n\nshort"


def table_pages():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column(0).to_pylist()


def test_density_finds_the_text_without_class_words(monkeypatch):
    """With no class word marking anything, the densest subtree still gives the text of nine pages in ten."""
    pages = table_pages()
    texts = [h.extract(x) for x in pages]
    monkeypatch.setattr(h, "NOISE_WORDS", frozenset())
    assert sum(h.extract(x) == t for x, t in zip(pages, texts, strict=True)) >= 0.9 * len(pages) > 0


def test_without_density_and_class_words_each_page_changes(monkeypatch):
    """On the tables either of the two nearly suffices; without both no page keeps its text."""
    pages = table_pages()
    texts = [h.extract(x) for x in pages]
    monkeypatch.setattr(h, "NOISE_WORDS", frozenset())
    monkeypatch.setattr(h, "_densest", lambda top: top)
    assert sum(h.extract(x) != t for x, t in zip(pages, texts, strict=True)) == len(pages) > 0


def test_an_open_head_ends_where_the_page_begins():
    text = paragraphs("a", 4)
    body = f"<h1>News</h1>{as_html(text)}"
    for head in ("<html><head><title>t</title>", "<head><meta charset=utf-8><title>t</title><style>p {}</style>", "<head><noscript><img src=x></noscript><link rel=x>\n", "<head>", "<title>t</title>"):
        assert h.extract(head + body).split("\n\n") == ["News", *text], head
        assert h.extract(f"{head}<article>{body}</article><footer>f</footer>").split("\n\n") == ["News", *text]
        assert h.extract(f"{head}</head><body>{body}").split("\n\n") == ["News", *text]
    assert h.extract("<html><head>bare text").strip() == "bare text"


class PlainPath:
    """End tags by walking all ancestors: what the kept depths have to equal."""

    def __init__(self):
        self.path = ["html"]

    def start(self, tag):
        if tag in h.BLOCKS:
            self.close_up_to({"p"}, h.SCOPES)
        if tag in h.IMPLIED_END:
            self.close_up_to(h.IMPLIED_END[tag], h.SCOPES - h.IMPLIED_END[tag])
        self.path.append(tag)

    def close_up_to(self, tags, scopes):
        for k in range(len(self.path) - 1, -1, -1):
            if self.path[k] in tags:
                del self.path[k:]
                return
            if self.path[k] in scopes:
                return

    def end(self, tag):
        for k in range(len(self.path) - 1, 0, -1):
            if self.path[k] == tag:
                del self.path[k:]
                return
            if tag not in h.BLOCKS and self.path[k] in h.BLOCKS:
                return


def test_open_elements_against_a_walk_over_ancestors():
    rng = random.Random(2)
    tags = "div p b i li ul td tr table dt dd dl a section span option select button".split()
    for _ in range(300):
        builder, plain = h.TreeBuilder(), PlainPath()
        for _ in range(60):
            tag = rng.choice(tags)
            if rng.random() < 0.6:
                builder.handle_starttag(tag, [])
                plain.start(tag)
            else:
                builder.handle_endtag(tag)
                plain.end(tag)
            assert [n.tag for n in builder.path] == plain.path


def test_deep_pages_take_time_in_proportion():
    import time

    n = 100_000
    for page in ("<b>" * n + "</i>" * n + "text", "<i><div>" + "<b>" * n + "</i>" * n + "text", "<div>" * n + "text" + "</div>" * n):
        began = time.time()
        assert h.extract(page) == "text"
        assert time.time() - began < 15


def brute_density(node, share, weak=False):
    """(characters, tags, characters in links, link tags, density, sum) by recursion."""
    inner = [(x, brute_density(x, share, weak or bool(x.kind))) for x in node.children if isinstance(x, h.Node) and not x.noise]
    chars = sum(len(" ".join(x.split())) for x in node.children if isinstance(x, str)) + sum(m[0] for _, m in inner)
    tags = sum(m[1] + 1 for _, m in inner)
    link_chars, link_tags = (chars, tags + 1) if node.tag == "a" else (sum(m[2] for _, m in inner), sum(m[3] for _, m in inner))
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    density = 0.0
    if chars:
        base = math.log(math.log(chars / max(1, chars - link_chars) * lc + share * chars + math.e))
        density = max(0.0, chars / t * math.log(chars / lc * t / lt) / base) * (h.PENALTY if weak else 1)
    return chars, tags, link_chars, link_tags, density, sum(m[4] for _, m in inner)


def test_densities_against_brute_force():
    rng = random.Random(1)

    def grow(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "p", "a href=x", "span", "section", "div class=ad", "ul", "nav"])
            out += rng.choice(["", "word " * rng.randint(1, 30)])
            out += f"<{tag}>{grow(depth - 1) if depth else 'leaf ' * rng.randint(0, 9)}</{tag.split()[0]}>"
        return out

    for _ in range(40):
        top = h.parse_tree(grow(3))
        nodes = h._measure(top)
        share = brute_density(top, 0.0)[2] / max(1, brute_density(top, 0.0)[0])
        for node in nodes:
            assert (node.chars, node.tags, node.link_chars, node.link_tags) == brute_density(node, share)[:4]
            want = brute_density(node, share, node.weak)
            assert math.isclose(node.density, want[4], abs_tol=1e-9) and math.isclose(node.total, want[5], abs_tol=1e-9)


def test_sections_of_ambiguous_names_are_left_to_their_density():
    text, work = paragraphs("a", 6), paragraphs("w", 3, 300)
    teasers = "<div class='related-posts'>" + "<p><a href=/x>Another story</a></p>" * 6 + "</div>"
    assert h.extract(f"<article><h1>T</h1>{as_html(text)}<div class='related-work'>{as_html(work)}</div>{teasers}</article>").split("\n\n") == ["T", *text, *work]
    assert h.extract(f"<article><h1>T</h1>{as_html(text)}</article><div class='related-posts'>{as_html(work)}</div>").split("\n\n") == ["T", *text]
