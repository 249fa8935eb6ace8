from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from roomledger.llm import boilerplate as B


def kept(page):
    return " ".join(t for k, t in B.blocks(page) if k == 2)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<body><nav>m</nav><article><h1>A&amp;B</h1><p>x<b>y</b>\n z<br>w<p>&lt;q&gt; &#233;&nbsp;!</article><footer>f</footer>", "A&B xy z w <q> é !"),
        ("<article>a<script>var t='</p>';</script><style>p{}</style>b<!-- c --><form>d</form><aside>e</aside></article>", "a b"),
        ("<ARTICLE><header><h1>T</h1></header><p class=x>p</p><div class='ad'>no</div><div id=\"comments\">c<p>d</div>q</ARTICLE>", "T p q"),
        ("<article><p>a</p><ul class=menu><li>no</ul><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>", "a one two c1 c2"),
        ("<div id=comments><article>mine</article></div><article>text</article><article class=comment>other</article>", "text"),
        ("<main><p hidden>h</p><p style='display: none'>h</p>x</main>", "x"),
        ("<article>unclosed <p>text <i>here", "unclosed text here"),
        ("<head><title>t</title><body><article>a</article>", "a"),
        ("<article><textarea>no</article>", ""),
        ("<article title='a > b'>5 < 6 & 7 > 3</article>", "5 < 6 & 7 > 3"),
        ("", ""),
        ("<<<>>><p", ""),
    ],
)
def test_blocks_of_articles(page, text):
    assert kept(page) == text


class Plain(HTMLParser):
    """Blocks of simple, well-formed pages, without the engine's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.found, self.kinds = [], [1]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.kinds.append(2 if tag == "article" and self.kinds[-1] else 0 if tag in ("nav", "footer") else self.kinds[-1])
        self.found.append([self.kinds[-1], ""])

    def handle_endtag(self, tag):
        self.kinds.pop()
        self.found.append([self.kinds[-1], ""])

    def handle_data(self, data):
        if not self.found:
            self.found.append([1, ""])
        self.found[-1][1] += data


def plain_blocks(page):
    return [(k, " ".join(t.split())) for k, t in Plain(page or "").found if t.strip()]


def brute(pages, run=B.RUN, least=B.WIDE_PAGES):
    """Texts by comparing all windows and blocks of all pages of a host."""
    out, windows, whole, texts = [], {}, {}, {}

    def host(url):
        return (url or "").split("//")[-1].split("/")[0].lower() if "//" in (url or "") else ""

    def stretches(blocks):
        """(kind, tokens with their block's number) of neighbouring blocks outside articles."""
        last, out = None, []
        for number, (kind, text) in enumerate(blocks):
            if kind != last and kind != 2:
                out.append((kind, []))
            if kind != 2:
                out[-1][1].extend((t, number) for t in text.split())
            last = kind
        return out

    cut = [(page, url, host(url), plain_blocks(html)) for page, url, html in pages]
    for _, _, h, blocks in cut:
        content = tuple(t for k, t in blocks if k)
        texts.setdefault(h, set()).add(content)
        for kind, text in blocks:
            if kind:
                whole.setdefault((h, text), set()).add(content)
        for _, tokens in stretches(blocks):
            for i in range(len(tokens) - run + 1):
                windows.setdefault((h, *(t for t, _ in tokens[i : i + run])), set()).add(content)
    for page, url, h, blocks in cut:
        left = {n: t for n, (k, t) in enumerate(blocks) if k == 2}
        for kind, tokens in stretches(blocks):
            hit = set()
            for i in range(len(tokens) - run + 1):
                if len(windows[(h, *(t for t, _ in tokens[i : i + run]))]) > 1:
                    hit.update(range(i, i + run))
            for i, (token, number) in enumerate(tokens):
                if kind == 1 and i not in hit:
                    left[number] = f"{left[number]} {token}" if number in left else token
        wide = {n for n, (_, t) in enumerate(blocks) if len(whole.get((h, t), ())) >= least and 2 * len(whole[(h, t)]) >= len(texts[h])}
        text = " ".join(left[n] for n in sorted(left) if n not in wide)
        out.append((page, url, text, len(text)))
    return sorted(out, key=repr)


NOTE = "Subscribe now to our weekly letter and never miss any of our great offers"


def test_repeated_runs_of_a_host_go(spark):
    pages = [(i, f"https://a.example/{i}", f"<div>{NOTE} {'today' if i % 2 else ''}</div><div>Page{i} has a unique text {i} with some words more and {i} again.</div><div>Read more</div>") for i in range(30)]
    pages += [(50, "https://A.example/x", f"<div>{NOTE}</div><article>{NOTE}</article>"), (51, "https://b.example", f"<p>{NOTE}</p>"), (52, None, f"<p>{NOTE}</p>"), (53, "x", None), (54, "", "")]
    pages += [pages[3], (None, "https://c.example/", f"<p>{NOTE}</p>"), (None, "https://c.example/", f"<p>{NOTE}</p>"), (60, "https://d.example/", f"<p>{NOTE} but this block goes on with words that stand on no other page</p>")]
    pages += [(61, "https://d.example/", f"<p>{NOTE}</p><p>{'long ' * 20000}</p>")]
    # a run across two blocks, which differ in where they are cut, and one that a footer shows elsewhere
    pages += [(70, "https://e.example/1", "<p>one two three four</p><p>five six seven eight nine first</p>"), (71, "https://e.example/2", "<p>one two three four five six</p><p>seven eight nine other</p>")]
    pages += [(72, "https://e.example/3", "<footer>all of these words stand in a footer of it</footer><p>kept</p>"), (73, "https://e.example/4", "<div>all of these words stand in a footer of it and more</div>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "'k' as key", "1 as at", "'h' as host")
    rows = B.main_text(frame).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute(pages)
    found = {r.page_id: r.text for r in rows}
    assert found[4] == "Page4 has a unique text 4 with some words more and 4 again." and (found[50], found[51]) == ("", NOTE)
    assert found[53] == found[54] == "" and found[60] == "but this block goes on with words that stand on no other page"
    assert (found[70], found[71], found[72], found[73]) == ("first", "other", "kept", "and more")
    assert B.main_text(frame.where("false")).count() == 0


def texts(spark, pages):
    return {r.page_id: r.text for r in B.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_copies_of_a_page_keep_their_text(spark):
    page = "<div>A page of some length whose text is on this host twice, under two ids.</div><p>With a second block of more than eight words in it.</p>"
    found = texts(spark, [(1, "https://a.example/1", page), (2, "https://a.example/2?print=1", page), (3, "https://b.example/1", page), (4, "https://a.example/1", page)])
    assert len(set(found.values())) == 1 and found[1].startswith("A page") and found[1].endswith("in it.")


def test_an_article_is_no_switch(spark):
    page = "<div class='content'>The text of this page stands here and is rather long.</div><article class='card'>Teaser of another page</article>"
    assert texts(spark, [(1, "https://a.example/", page)])[1].startswith("The text of this page stands here and is rather long.")


def test_notices_inside_articles_go_and_quotes_stay(spark):
    """A block on half of a host's pages is a notice wherever it stands; a passage that two of ten pages quote is text."""
    quote = "This long passage of an old book is quoted by two of the pages and stays"
    pages = [(i, f"https://a.example/{i}", f"<article><p>Text number {i}.</p>{f'<p>{quote}</p>' if i < 2 else ''}<div>Subscribe to our newsletter</div></article>") for i in range(10)]
    found = texts(spark, pages)
    assert found == {i: f"Text number {i}." + (f" {quote}" if i < 2 else "") for i in range(10)}


@pytest.mark.parametrize("page", ["<![CDATA[>" * 100_000, "<div>" * 100_000 + "</p>" * 100_000, "<div>" * 50_000 + "</div>" * 100_000, "<a '" * 200_000, "<!--" * 200_000, "<script>" * 100_000, "<p>x" * 200_000, "<" * 1_000_000, "<p class" + " class" * 150_000])
def test_long_pages_take_linear_time(page):
    start = time.monotonic()
    B.blocks(page)
    assert time.monotonic() - start < 5


def test_character_data(spark):
    assert kept("<article>a<![CDATA[ <p>no</p> ]]>b<![CDATA[ no >c</article>") == "ab" + "c"
