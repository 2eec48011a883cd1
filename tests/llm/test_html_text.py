import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from marginalia.llm import html_text
from marginalia.llm.html_text import extract, main_text, stretches


def test_article_only():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies</div>
    <article><header><h1>Head&amp;line</h1></header><p>One <b>b</b>old&nbsp;word
      and  more.<br>Next<p>Unclosed <a title="a > b">link</a></p><aside>Side</aside><div class="ad">Buy</div><p>Be.</p>
      <form><input><button>Go</button></form><section id="comments"><p>Reader says</p></section><footer>Tags</footer></article>
    <div class="sidebar">Recent</div><footer>&copy; me</footer></body></html>"""
    want = "Head&line One bold word and more. Next Unclosed link Be."
    assert main_text(page) == want
    assert main_text(page.replace("article>", "section>")).endswith(want.removeprefix("Head&line "))


def test_pages_without_an_article():
    long = "Long sentences of the story go on and on, for more than the threshold of characters in a window of lines."
    page = f"<body><div>Home</div><nav>x</nav><nav>y</nav><nav>z</nav><p>{long}</p><p>Short.</p><p>{long}</p><div id='footer'>foot</div></body>"
    assert main_text(page) == f"{long} Short. {long}"
    assert main_text("<body><nav>Home</nav><div>A story of sixty-eight characters is a whole page, short as it is.</div></body>").startswith("A story")
    teaser = f"<article><p>Read this too.</p></article><nav>a</nav><nav>b</nav><nav>c</nav><div><p>{long}</p><p>{long}</p></div>"
    assert main_text(teaser) == f"{long} {long}"
    linked = f"<h2><a href=x>A linked headline</a></h2><p>{long}</p><p><a href=y>and a linked line</a></p><p>{long}</p>"
    assert main_text(linked) == f"A linked headline {long} and a linked line {long}"


@pytest.mark.parametrize("name", ["form-factor", "side-effects", "related-work", "social-history", "foot-notes", "alert", "share", "post comments-enabled", "download", "menu-card-history"])
def test_longer_names_mean_nothing(name):
    assert main_text(f"<article><p>one</p><div class='{name}'><p>two</p></div><p>three</p></article>") == "one two three"


@pytest.mark.parametrize("name", ["ad", "Advert", "x cookie-banner", "ad-slot-3", "sidebar", "comments", "comment-list", "site-footer", "newsletter-box", "notice"])
def test_boilerplate_names(name):
    assert main_text(f"<div><p>one</p><div class='{name}'><p>two</p></div><section id={name.split()[-1]}>four</section><p>three</p></div>") == "one three"


def brute_stretches(sizes):
    """Lines of text joined where fewer than WINDOW - 1 others lie between, by the largest sum of a window in each."""
    sums = {i: sum(sizes[i : i + html_text.WINDOW]) for i in range(len(sizes))}
    runs = []
    for i, size in enumerate(sizes):
        if size:
            if runs and i - runs[-1][-1] <= html_text.WINDOW:
                runs[-1].append(i)
            else:
                runs.append([i])
    top = max(sums.values(), default=0)
    best = lambda r: max(sums[i] for i in range(max(0, r[0] - html_text.WINDOW + 1), r[-1] + 1) if not any(sizes[k] for o in runs if o is not r for k in o if i <= k < i + html_text.WINDOW))
    return [(r[0], r[-1] + 1) for r in runs if best(r) >= html_text.SURGE * top]


def test_surge_and_dive_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(2000):
        sizes = [rnd.choice([0, 0, 0, rnd.randint(1, 20), rnd.randint(1, 400)]) for _ in range(rnd.randint(0, 25))]
        assert stretches(sizes) == brute_stretches(sizes), sizes


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p>") == ""
    assert main_text("<article><p>a &am") == "a &am"
    assert main_text("<article><p>cut <scr") == "cut"
    assert main_text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert main_text("<article><p title='it's>one</p><p>two's</p></article>").endswith("two's")
    assert len(main_text("<article>" + "<p>word</p>" * 20_000)) == 20_000 * 5 - 1


@pytest.mark.parametrize("piece", ["<a '", "<a \"'>", "<div>x", "<p>", "<a ' \" >", "<svg>", "<!--", "<i><p>", "</div>", "<a href='x>", "class=\"", "&#x", "<b class="])
def test_broken_markup_takes_linear_time(piece):
    took = []
    for n in (100_000, 400_000):
        page = "<p>begin</p>" + piece * (n // len(piece))
        began = time.process_time()
        main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0] + 0.2 and took[1] < 8


def test_raw_elements_and_open_heads():
    for tag in ("svg", "iframe", "object", "canvas"):
        assert main_text(f"<article><p>one</p><{tag} class='i'/><p>two</p><{tag}><p>no</p></{tag}><p>thr<{tag}/>ee</p></article>") == "one two three"
    assert main_text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "so x=2 holds"
    assert main_text("<article><p>one</p><script src='x'/><p>no</p></script ><p>two</p></article>") == "one two"
    head = "<html><head lang='en'><meta charset=utf-8><title>No <p>no</title><link href=x><script>'<p>no'</script>"
    for rest in ("</head><body>", "</head>", "<body>", ""):
        assert main_text(f"{head}{rest}<article><p>yes</p></article>") == "yes"
        assert main_text(f"<!-- c -->\n{head}\n{rest}\nyes <b>and</b> yes" + " on" * 40).startswith("yes and yes on")
    assert main_text("<article><head-line>yes</head-line><video-list>too</video-list></article>") == "yes too"
    assert main_text(head) == main_text("<head><meta") == ""


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    renamed = pages.selectExpr("page_id", "url", r"regexp_replace(html, '(</?)article\\b', '$1div') AS html")
    got, other = ({r["page_id"]: r for r in extract(df).collect()} for df in (pages, renamed))
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", body)
        want = " ".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"</?b>", "", b)).split())))
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
        assert other[r["page_id"]]["text"] == want


def test_windows_choose_the_text(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "NAMES", frozenset())
    monkeypatch.setattr(html_text, "NEVER", frozenset())
    assert sum(main_text(p) == w for p, w in zip(pages, want, strict=True)) > 0.9 * len(pages)  # adverts go without their name
    monkeypatch.setattr(html_text, "stretches", lambda sizes: [])
    assert not any(main_text(p) for p in pages)


@pytest.mark.parametrize("name", ["notice", "widget", "banner", "menu", "promo-box", "newsletter", "modal", "sponsor", "related-posts"])
def test_named_blocks_of_the_story(name):
    long = "Long sentences of the story go on and on, for more than the threshold of characters in a window of lines."
    assert main_text(f"<article><p>{long}</p><div class='{name}'><p>{long}</p></div><p>end</p></article>") == f"{long} {long} end"
    assert main_text(f"<article><p>{long}</p><div class='{name}'><p>Buy it now.</p></div><p>end</p></article>") == f"{long} end"
    assert main_text(f"<article><div class='{name}'><p>{long}</p></div></article>") == long
    assert main_text(f"<p>{long}</p><div class='{name}'><p>{long}</p></div><p>end</p>") == f"{long} end"


def test_gaps_edges_and_readers():
    long = "Long sentences of the story go on and on, for more than the threshold of characters in a window of lines."
    nav = "<nav>" + "".join(f"<p>n{k}</p>" for k in range(6)) + "</nav>"
    assert main_text(f"<body><p>{long}</p><p>{long}</p>{nav}<p>The end.</p></body>") == f"{long} {long} The end."
    assert main_text(f"<body><article><p>{long}</p><section><p>{long}</p></section>{nav}<div>The end.</div></article><div>(c) me</div></body>") == f"{long} {long} The end."
    assert main_text(f"<div>Unnamed advert</div><article><p>{long}</p></article><div>(c) me</div>") == long
    assert main_text(f"<h1>Head</h1><article><p>{long}</p></article>") == f"Head {long}"
    assert main_text(f"<article><p>{long}</p>{'<p><a href=x>A source of the story</a></p>' * 5}<p>{long}</p></article>").count("A source") == 5
    for name in ("user-comments", "reader_comments", "fb-comment", "comments-area", "post-comments-list"):
        for tag in ("article", "div"):
            assert main_text(f"<{tag}><p>{long}</p><div class='{name}'><p>{long} Not mine.</p></div></{tag}>") == long
    assert main_text(f"<div class='no-comments'><p>{long}</p></div>") == long
    assert main_text(f"<article><p>{long}</p><p>so <span class='ad'>Buy</span> on</p></article>") == f"{long} so on"


class Plain(HTMLParser):
    """Lines of a page as [text, linked, inside an article, a headline, boilerplate, kind of block], by the standard parser."""

    def __init__(self):
        super().__init__()
        self.lines, self.stack, self.text = [], [], []

    def end_line(self):
        text = " ".join("".join(t for t, _ in self.text).split())
        if text:
            tags = [t for t, _ in self.stack]
            bad = any(t in ("nav", "footer") or (t == "header" and "article" not in tags[:k]) or ("class", "ad") in a for k, (t, a) in enumerate(self.stack))
            blocks = [x for x in self.stack if x[0] not in ("b", "a")]
            kind = (id(blocks[-2]) if len(blocks) > 1 else 0, blocks[-1][0] if blocks else "")
            self.lines.append([text, sum(len(t.strip()) for t, linked in self.text if linked), "article" in tags, "h1" in tags, bad, kind, blocks])
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a"):
            self.end_line()
        if tag == "p" and self.stack and "p" in [t for t, _ in self.stack[-2:]]:
            while self.stack.pop()[0] != "p":
                pass
        if tag not in ("br", "meta", "link", "img", "hr"):
            self.stack.append((tag, attrs))

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.end_line()
        if tag in [t for t, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not {"script", "style", "title"} & {t for t, _ in self.stack}:
            self.text.append((data, "a" in [t for t, _ in self.stack]))


def plain_text(page):
    """A second way through a whole page: spans of lines between the edges of articles, then runs by brute force."""
    reader = Plain()
    reader.feed(page)
    reader.close()
    reader.end_line()
    sized = []
    for text, linked, inside, head, bad, kind, _ in reader.lines:
        size = 0 if bad else len(text)
        if size and not head and 2 * linked > size:
            size = -(-size // 4) if inside else 0
        sized.append((size * (1 + inside), text, inside, head, bad, kind))
    rows = []  # size, text
    for i, (size, text, inside, head, bad, kind) in enumerate(sized):
        before = next((x for x in sized[:i][::-1] if x[0]), None)
        after = next((x for x in sized[i + (not size) :] if x[0]), None)
        if bad and before and after and ((before[2] and after[2]) or before[5] == after[5]):
            continue  # no gap of what it stands in
        if size and before and before[2] != inside and not before[3]:
            rows += [(0, None)] * html_text.WINDOW
        rows.append((size, None if bad else text))
    runs = brute_stretches([size for size, _ in rows])
    return " ".join(t for b, e in runs for _, t in rows[b:e] if t is not None)


def test_whole_pages_by_a_plain_second_way(spark):
    rnd = random.Random(3)
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page in pages:
        assert main_text(page) == plain_text(page)
        odd = page.replace("article>", rnd.choice(["article>", "div>"])).replace("<div class=\"ad\">", rnd.choice(["<div>", "<div class='ad'>", "<h1>x</h1><div>"]))
        paragraphs = odd.split("<p>")
        for _ in range(rnd.randint(0, 4)):  # links, short lines and boilerplate at any place
            paragraphs.insert(rnd.randint(1, len(paragraphs)), rnd.choice(["<a href='x'>a link, and more</a></p>", "x</p>", "</p><nav>n<p>n</p></nav>", f"{'y' * 300}</p>"]))
        odd = "<p>".join(paragraphs)
        assert main_text(odd) == plain_text(odd), odd


def test_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "<article>x</article>"), (1, "u", "<article>x</article>"), (2, None, None)], "page_id long, url string, html string")
    out = extract(df.selectExpr("*", "'old' AS text"))
    assert sorted(map(tuple, out.select("page_id", "text", "n_chars").collect())) == [(1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert extract(df.limit(0)).count() == 0
