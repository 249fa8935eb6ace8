"""Main text of web pages; boilerplate is what a host's suffix array shows on several pages.

1. Each page is cut into blocks at block-level tags, in time linear in its length. Markup is evidence: blocks inside
   an ``article`` or ``main`` element are likely text, blocks that tags or names call menus, headers, footers,
   adverts, forms or comments are boilerplate, and the others are open.
2. The other blocks of a host's pages are its token stream, in which runs cross block ends. The stream's suffixes are
   grouped by their first ``RUN`` tokens, page by page: what a suffix array's sort is for. (Sorted to that depth it
   is split over tasks by prefix, so that a large host is no large task, and suffixes that agree are combined in each
   task first: a notice on every page is one row a task.) A group with two pages or more is a repeated run; runs that
   overlap make up the long repeated substrings. Their tokens go, and only they: unique runs stay.
3. Whole blocks, short ones and those of articles included, that stand on at least ``WIDE_PAGES`` pages and at least
   half of a host's pages are boilerplate wherever they stand.

Pages count by their text: copies of a page on a host, whatever their ids, are one page and don't make each other
boilerplate. What some pages quote inside their articles is part of these and stays.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.llm.common import sent_if_small, ship
from roomledger.session import materialize, stored

#: Tokens of the shortest repeated run.
RUN = 8
#: Least number of different pages for a block that is boilerplate on half of a host's pages.
WIDE_PAGES = 3

# Fixed values of HTML: elements whose content is no text, elements that end a block, elements without content.
NO_TEXT = frozenset("script style noscript template title head svg iframe object select button textarea math canvas audio video datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT = frozenset(("article", "main"))
CHROME = frozenset("nav header footer aside form menu dialog search".split())
# What names of classes, ids and roles say of an element.
CHROME_NAME = re.compile(
    r"(?i)(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|sidebar|nav\w*|menu|breadcrumbs?|footer|header|masthead|cookies?|consent|notice|popup|modal"
    r"|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|replies|disqus|toolbar|pagination|pager|complementary|contentinfo|navigation)(?:$|[\s_-])"
)
#: On elements that hold whole articles or pages only these say something.
PAGE_WIDE = frozenset("html body article main".split())
COMMENT_NAME = re.compile(r"(?i)(?:^|[\s_-])(?:comments?|repl(?:y|ies)|related|teasers?|promo)(?:$|[\s_-])")
#: Articles of that name are often teasers of other pages: their text is open.
CARD_NAME = re.compile(r"(?i)(?:^|[\s_-])cards?(?:$|[\s_-])")
TAG = re.compile(r"<!--(?:.*?-->|.*$)|(?P<cdata><!\[CDATA\[)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.DOTALL)
NAMES = re.compile(r"""(?i)(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""")


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of each block in page order. Kinds: 2 in the article, 1 open, 0 named as boilerplate."""
    out: list[tuple[int, str]] = []
    words: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements that matter: name, kind inside, whether text counts
    opened: Counter[str] = Counter()  # how often each name is on the stack
    kind, counts, at, n = 1, True, 0, len(page)
    cdata_ends = True

    def flush() -> None:
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((kind, text))
            words.clear()

    def push(name: str, inside: int, text_counts: bool) -> None:
        stack.append((name, inside, text_counts))
        opened[name] += 1

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while at < n:
        tag = TAG.search(page, at)
        end = tag.start() if tag else n
        if counts and end > at:
            text = page[at:end]
            words.append(entities.unescape(text) if "&" in text else text)
        if not tag:
            break
        at, name = tag.end(), (tag["name"] or "").lower()
        if tag["cdata"]:
            # without an end it is a comment up to the next tag's end; once there is none, there is none further on
            close = page.find("]]>", at) if cdata_ends else -1
            cdata_ends = close >= 0
            after = close + 3 if cdata_ends else page.find(">", at) + 1
            at = after or n
        if not name:
            continue
        if name == "br":
            words.append(" ") if counts else None
            continue
        if name in BLOCKS or name in CHROME:
            flush()
        if tag["close"]:
            if opened[name]:
                flush()
                while pop() != name:
                    pass
                kind, counts = (stack[-1][1], stack[-1][2]) if stack else (1, True)
            continue
        if name in VOID:
            continue
        if name == "body":  # also ends a head that was left open
            stack.clear()
            opened.clear()
            kind, counts = 1, True
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.IGNORECASE).search(page, at)
            at = close.start() if close else n
            push(name, kind, False)
            flush()
            counts = False
            continue
        inside, text_counts, named = kind, counts and name not in NO_TEXT, ""
        if tag["attributes"]:
            if HIDDEN.search(tag["attributes"]):
                text_counts = False
            named = " ".join(filter(None, (x for m in NAMES.finditer(tag["attributes"]) for x in m.groups())))
            if named and (COMMENT_NAME if name in PAGE_WIDE else CHROME_NAME).search(named):
                inside = 0
        if name in CHROME and not (name == "header" and kind == 2):
            inside = 0
        if name in CONTENT and inside and not CARD_NAME.search(named):
            inside = 2
        if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends where the next begins
            pop()
            named_chrome = inside == 0 and kind != 0
            kind, counts = (stack[-1][1], stack[-1][2]) if stack else (1, True)
            inside, text_counts = 0 if named_chrome else kind, counts and text_counts
        if (inside, text_counts) != (kind, counts):
            flush()
        if name in BLOCKS or name in NO_TEXT or name in CHROME or (inside, text_counts) != (kind, counts):
            push(name, inside, text_counts)
            kind, counts = inside, text_counts
    flush()
    return out


def host_of(url: Column) -> Column:
    """Host in lower case; pages without one share the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _int64(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, key, content, kinds, texts``: the blocks of each page.

    ``key`` is equal for equal rows, ``content`` for pages with the same text outside named boilerplate.
    """
    ship(pages.sparkSession)
    named = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    keyed = named.select("*", host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("key"))
    same = ["page_id", "url", "host", "key"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(h.as_py() or "") for h in batch.column("html")]
            content = [_int64(xxhash.xxh64_intdigest("\x00".join(t for k, t in b if k).encode("utf-8", "surrogatepass"))) for b in found]
            kinds = pa.array([[k for k, _ in b] for b in found], pa.list_(pa.int32()))
            texts = pa.array([[t for _, t in b] for b in found], pa.list_(pa.string()))
            columns = [*(batch.column(c) for c in same), pa.array(content, pa.int64()), kinds, texts]
            yield pa.RecordBatch.from_arrays(columns, names=[*same, "content", "kinds", "texts"])

    return keyed.mapInArrow(cut, "page_id long, url string, host string, key long, content long, kinds array<int>, texts array<string>")


def streams(kinds: list[int], texts: list[str]) -> Iterator[tuple[int, int, list[str]]]:
    """(kind, place, tokens) of each stretch of neighbouring blocks of one kind outside articles.

    Places count the tokens of the page's open blocks.
    """
    place = 0
    for kind, stretch in groupby(zip(kinds, texts), key=itemgetter(0)):
        if kind != 2:
            tokens = [t for _, text in stretch for t in text.split()]
            yield kind, place, tokens
            place += len(tokens) if kind == 1 else 0


def suffixes(cut: DataFrame, run: int = RUN, only_open: bool = False) -> DataFrame:
    """``prefix, content, key, at``: the first ``run`` tokens (hashed, with the host) of every suffix outside articles,
    or of those of open blocks only."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, content, key, kinds, texts in zip(*(batch.column(c).to_pylist() for c in ("host", "content", "key", "kinds", "texts"))):
                for kind, place, tokens in streams(kinds, texts):
                    for at in range(len(tokens) - run + 1 if kind or not only_open else 0):
                        prefix = xxhash.xxh64_intdigest("\x00".join((host, *tokens[at : at + run])).encode("utf-8", "surrogatepass"))
                        rows.append((_int64(prefix), content, key, place + at))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["prefix", "content", "key", "at"])

    wanted = F.exists("kinds", lambda k: k == 1) if only_open else F.exists("kinds", lambda k: k != 2)
    rows = cut.where(wanted).select("host", "content", "key", "kinds", F.transform(F.arrays_zip("kinds", "texts"), lambda b: F.when(b["kinds"] != 2, b["texts"]).otherwise("")).alias("texts"))
    return rows.mapInArrow(each, "prefix long, content long, key long, at int")


def repeated_runs(cut: DataFrame, run: int = RUN) -> DataFrame:
    """``key, at``: where runs in open blocks start that another page of the host has outside its article too."""
    every = suffixes(cut, run).groupBy("prefix").agg(F.min("content").alias("one"), F.max("content").alias("other"))
    wanted = stored(suffixes(cut, run, only_open=True).select("prefix", "key", "at"), "runs")
    shown = materialize(every.where("one <> other").select("prefix").join(wanted.select("prefix").distinct(), "prefix", "left_semi"))
    return wanted.join(sent_if_small(shown, shown.count()), "prefix").select("key", "at").distinct()


def wide_blocks(cut: DataFrame, pages: int = WIDE_PAGES) -> DataFrame:
    """``key, block``: the numbers of blocks that at least ``pages`` pages and half of the host's pages have whole."""
    each = cut.select("host", "key", "content", F.posexplode(F.arrays_zip("kinds", "texts")).alias("block", "b")).where("b.kinds <> 0")
    each = each.select("host", "key", "content", "block", F.xxhash64("host", "b.texts").alias("same"))
    often = materialize(each.select("same", "content").distinct().groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") >= pages))
    sizes = cut.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    # the blocks of a host that half of its pages have are few; where they are sought, those of small counts go first
    hosts = each.join(sent_if_small(often, often.count()), "same").select("host", "same", "n").distinct()
    wide = materialize(hosts.join(sizes, "host").where(F.col("n") * 2 >= F.col("pages")).select("same"))
    return each.join(sent_if_small(wide, wide.count()), "same").select("key", "block").distinct()


def text_left(kinds: list[int], texts: list[str], starts: list[int], wide: list[int], run: int = RUN) -> str:
    """The text of a page without named blocks, the tokens of runs from ``starts`` on, and the blocks ``wide``."""
    covered: set[int] = set()
    for start in starts:
        covered.update(range(start, start + run))
    gone, kept, place = set(wide), [], 0
    for number, (kind, text) in enumerate(zip(kinds, texts)):
        if kind == 1 and covered:
            tokens = text.split()
            text = " ".join(t for i, t in enumerate(tokens, place) if i not in covered)
            place += len(tokens)
        if kind and text and number not in gone:
            kept.append(text)
    return " ".join(kept)


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row. NULL or empty html: empty text. Other columns are not read.

    White space inside a block becomes one space; blocks are joined by one space. Equal rows and pages of a host
    with equal text are one page, so they don't make each other boilerplate; rows come back as often as they are
    there. Pages without a host (no URL) share the empty one.
    """
    cut = stored(parsed(pages), "pages")
    runs = repeated_runs(cut, run).select("key", "at", F.lit(None).cast("int").alias("block"))
    whole = wide_blocks(cut).select("key", F.lit(None).cast("int").alias("at"), "block")
    # both sets are bounded by their page
    marks = runs.unionByName(whole).groupBy("key").agg(F.collect_set("at").alias("starts"), F.collect_set("block").alias("wide"))
    marks = materialize(marks)
    entries = marks.agg(F.sum(F.size("starts") + F.size("wide") + 1)).first()[0] or 0
    marked = cut.join(sent_if_small(marks, entries), "key", "left").select("page_id", "url", "kinds", "texts", "starts", "wide")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kinds", "texts", "starts", "wide")))
            left = [text_left(kinds, texts, starts or [], wide or [], run) for kinds, texts, starts, wide in rows]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(left, pa.string()), pa.array(map(len, left), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return marked.mapInArrow(write, "page_id long, url string, text string, n_chars long")
