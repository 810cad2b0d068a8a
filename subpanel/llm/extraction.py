"""HTML extraction: pages' containers are scored, their generalised paths voted on per host, and winners re-extracted."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from subpanel.llm.common import map_arrow, prepare, small_batches, written

BLOCKS = set("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tr td th caption section article main header footer "
             "aside nav figure figcaption form fieldset hr address details summary body html head center dialog menu".split())
CONTAINERS = set("body div section article main td center".split())
SKIPPED = set("nav aside footer form script style noscript template iframe button select textarea svg object head dialog menu title option".split())
IN_HEAD = set("title meta link base style script noscript template".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of class names and ids that mark what is not the article.
MARKS = set("nav navbar navigation menu breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement adsense promo promotion sponsor sponsored "
            "banner cookie cookies consent gdpr notice notices popup modal overlay comment comments reply replies respond disqus discussion share sharing "
            "social related recommended recommendations newsletter subscribe subscription signup login footer pagination pager widget masthead".split())
OWN_MARKS = {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "sponsored", "related"}
#: Words that leave a mark what it is when they stand beside it in one class name or id (`ad-slot`, `site-nav`).
BESIDE = set("site page top bottom left right main primary secondary box block list area section wrapper wrap container bar item items slot unit "
             "links link button buttons icon icons tag tags text title heading head body main menu message msg card cards widget widgets sticky fixed inline image "
             "label count counter grid small large new posts articles stories inner outer form header global mobile desktop content row column col thread".split())
#: Marks that also name sections of an article, and marks of what readers write, which may be longer than the article.
TITLES = set("discussion related social notice notices recommended recommendations response responses sponsors".split())
READERS = set("comment comments reply replies respond disqus discussion".split())
#: Class names of an element that holds a post, whose header is the post's own.
POSTS = set("post entry story hentry article post-content entry-content article-body article-content story-body post-body".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLIMB = 0.7
#: What a page's other containers share of one vote, and the share of a host's votes by which a path decides on a page.
OTHERS, DECIDES = 0.1, 0.2
#: Share of the page's own choice that a path inside it must hold to replace it.
INSIDE = 0.6
#: Shares of a page's text: of an article or main element that counts, and of another container that may stand for the article.
LEAST_SHARE, NEARLY_ALL = 0.3, 0.95
#: Share of a page's text from which a marked element stays.
WHOLE = 0.8
MAX_BROADCAST_HOSTS = 50_000
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "body", "article", "section", "div", "td", "main"}


def marked(tag: str, names: str, inside: bool) -> set[str]:
    """Marks among an element's class names and id: names made of marks and words beside them, none of headings.

    Inside article and main, words that also title sections are no marks.
    """
    if tag in HEADINGS or tag in ("html", "body", "main"):
        return set()
    if tag == "article":
        return OWN_MARKS & set(names.split())
    found: set[str] = set()
    for name in names.split():
        words = {w for w in re.split(r"[^a-z]+", name) if w}
        if words and words <= MARKS | BESIDE:
            found |= words & MARKS
        if "header" in words and words <= BESIDE and not inside:
            found.add("header")
    return found - TITLES if inside else found


class Page(HTMLParser):
    """Elements that matter (blocks and skipped ones) and the text blocks of a page.

    An element keeps its parent and a hash of its path, so memory grows with the page, however deep it is.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple] = [("", "", -1, False, False, False)]  # tag, path, parent, skipped, main, post
        self.marks: dict[int, bool] = {}  # marked element → it holds what readers write
        self.stack, self.open_links, self.head = [0], 0, 0
        self.blocks: list[list] = []  # node, text, characters inside links
        self.parts: list[str] = []
        self.linked = 0
        self.feed(html)
        self.close()
        self.flush()
        self.drop_marked()

    def drop_marked(self) -> None:
        """Leave out the blocks of marked elements, save one that holds nearly all other text, so the article itself."""
        if not self.marks:
            return
        held = [0] * len(self.nodes)
        readers = [False] * len(self.nodes)
        for node in range(1, len(self.nodes)):  # parents come before their children
            readers[node] = readers[self.nodes[node][2]] or self.marks.get(node, False)
        for node, text, _ in self.blocks:
            if not readers[node]:
                held[node] += len(text)
        for node in range(len(self.nodes) - 1, 0, -1):
            held[self.nodes[node][2]] += held[node]
        out = [False] * len(self.nodes)
        for node in range(1, len(self.nodes)):
            out[node] = out[self.nodes[node][2]] or (node in self.marks and held[node] <= WHOLE * held[0])
        self.blocks = [b for b in self.blocks if not out[b[0]]]

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and not self.nodes[self.stack[-1]][3]:
                self.blocks.append([self.stack[-1], text, self.linked])
            self.parts, self.linked = [], 0

    def close_head(self, body: bool) -> None:
        """End a head left open: at a body wherever it is, else where the head itself is the innermost element."""
        place = self.head
        if place and place not in self.stack:
            place = self.head = 0
        if place and (body or place == self.stack[-1]):
            self.flush()
            del self.stack[self.stack.index(place):]
            self.head = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self.close_head(tag == "body")
        if tag == "a":
            self.open_links += 1
        if tag == "br":
            self.parts.append(" ")
        if tag not in BLOCKS and tag not in SKIPPED:
            return
        self.flush()
        if tag in BLOCKS:
            self.open_links = 0
            if self.nodes[self.stack[-1]][0] == "p":
                self.stack.pop()
            self.close_up(_CLOSED_BY.get(tag, ()))
        if tag in VOID:
            return
        parent = self.stack[-1]
        _, path, _, skipped, main, post = self.nodes[parent]
        told = {k: v or "" for k, v in attrs}
        own_names = told.get("class", "").lower().split()
        role = told.get("role", "").lower()
        marks = marked(tag, f"{told.get('class', '')} {told.get('id', '')}".lower(), main or post)
        hidden = "hidden" in told or told.get("aria-hidden") == "true" or "display:none" in told.get("style", "").replace(" ", "").lower()
        skipped = skipped or tag in SKIPPED or role in ROLES or hidden or (tag == "header" and not main and not post)
        own = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in own_names})])
        node = len(self.nodes)
        self.nodes.append((tag, xxhash.xxh3_64_hexdigest(f"{path}>{own}".encode("utf-8", "surrogatepass")), parent, skipped,
                           main or tag in ("article", "main") or role == "main" or told.get("itemprop") == "articleBody",
                           post or bool(POSTS & set(own_names))))
        if marks:
            self.marks[node] = bool(marks & READERS)
        if tag == "head":
            self.head = node
        self.stack.append(node)

    def close_up(self, tags) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.nodes[self.stack[i]][0]
            if tag in tags:
                del self.stack[i:]
                return
            if tag in _SCOPE:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.open_links = max(0, self.open_links - 1)
        if tag not in BLOCKS and tag not in SKIPPED:
            return
        self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.nodes[self.stack[i]][0] == tag:
                del self.stack[i:]
                break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in BLOCKS or tag in SKIPPED:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.close_head(False)
        self.parts.append(data)
        if self.open_links:
            self.linked += len(data.strip())

    def link_lists(self) -> dict[int, list[int]]:
        """List → places of its blocks, for lists of three items or more that hold links alone."""
        nearest = [0] * len(self.nodes)
        for node in range(1, len(self.nodes)):
            nearest[node] = node if self.nodes[node][0] in ("ul", "ol") else nearest[self.nodes[node][2]]
        lists: dict[int, list] = {}
        for i, (node, text, linked) in enumerate(self.blocks):
            node = nearest[node]
            if node > 0:
                lists.setdefault(node, []).append((i, linked, len(text)))
        return {n: [i for i, *_ in items] for n, items in lists.items()
                if len(items) >= 3 and sum(x[1] for x in items) >= 0.8 * sum(x[2] for x in items)}

    def scores(self) -> tuple[dict[int, float], dict[int, int]]:
        """Container → score (own text outside links, and a share of the containers' inside) and → all its text outside links."""
        alone = {i for places in self.link_lists().values() for i in places}
        found: dict[int, float] = {}
        for i, (node, text, linked) in enumerate(self.blocks):
            if i in alone and len(alone) < len(self.blocks):
                continue
            while node > 0 and self.nodes[node][0] not in CONTAINERS:
                node = self.nodes[node][2]
            found[max(node, 0)] = found.get(max(node, 0), 0) + max(1, len(text) - linked)
        inner = dict(found)
        for node in range(len(self.nodes) - 1, 0, -1):  # children come after their parents
            if node in found:
                above = self.nodes[node][2]
                while above > 0 and self.nodes[above][0] not in CONTAINERS:
                    above = self.nodes[above][2]
                found[max(above, 0)] = found.get(max(above, 0), 0) + CLIMB * found[node]
                inner[max(above, 0)] = inner.get(max(above, 0), 0) + inner[node]
        return found, inner

    def candidates(self) -> tuple[str, dict[str, tuple[list[int], float]]]:
        """The page's own choice of path, and path → containers that may hold the article, with their score.

        The largest article or main element is the article whole, with its like beside it. Without one that holds a fair
        part of the page, the best container that holds nearly all text stands for it. Other containers that hold a fair
        part take part in the host's vote: where its pages agree on one of those, it replaces the page's own choice.
        """
        found, inner = self.scores()
        if not found:
            return "", {}
        fair = LEAST_SHARE * inner[0]
        alike: dict[str, list[int]] = {}
        for n in sorted(found):
            alike.setdefault(self.nodes[n][1], []).append(n)
        paths = {p: (like, sum(found[n] for n in like)) for p, like in alike.items() if sum(inner[n] for n in like) >= fair}
        mains = [n for n in found if self.nodes[n][4] and not self.nodes[self.nodes[n][2]][4]]
        if mains:
            first = max(mains, key=lambda n: (inner[n], -n))
            tag, path, parent = self.nodes[first][:3]
            like = sorted(n for n in mains if self.nodes[n][1] == path or (self.nodes[n][0], self.nodes[n][2]) == (tag, parent))
            if sum(inner[n] for n in like) >= fair:
                paths[path] = (like, sum(found[n] for n in like))
                return path, paths
        best = max((n for n in found if inner[n] >= NEARLY_ALL * inner[0]), key=lambda n: (found[n], -n))
        paths[self.nodes[best][1]] = ([best], found[best])
        return self.nodes[best][1], paths

    def choice(self, paths: list[str]) -> list[int]:
        """The containers of the first of the host's paths that this page has, else of the page's own choice.

        Parts of the page's own choice do not replace an article or main element, nor another one of which they hold
        too little.
        """
        own, found = self.candidates()
        if not found:
            return []
        chosen = set(found[own][0])
        inner = self.scores()[1]
        size = sum(inner[n] for n in chosen)
        within = [False] * len(self.nodes)
        for node in range(1, len(self.nodes)):
            within[node] = within[self.nodes[node][2]] or self.nodes[node][2] in chosen
        for path in (p for p in paths if p in found):
            like = found[path][0]
            part = sum(inner[n] for n in like if within[n])
            if path == own or not part or (not self.nodes[found[own][0][0]][4] and part >= INSIDE * size):
                return like
        return found[own][0]

    def text(self, containers: list[int]) -> str:
        """Blocks of the containers, after the headline if that stands before them.

        Lists of links are text like any other there, but outside article and main a list before the headline is a menu.
        """
        chosen = set(containers)
        inside = [0 in chosen] * len(self.nodes)
        for node in range(1, len(self.nodes)):
            inside[node] = node in chosen or inside[self.nodes[node][2]]
        held = [i for i, (node, *_) in enumerate(self.blocks) if inside[node]]
        lists = self.link_lists()
        if not self.nodes[containers[0]][4] and held:
            listed = {i for places in lists.values() for i in places}
            heads = [[i for i in held if self.blocks[i][0] > 0 and self.nodes[self.blocks[i][0]][0] == h] for h in ("h1", "h2")]
            start = next((h[0] for h in heads if h), next((i for i in held if i not in listed), 0))
            menus = {i for places in lists.values() if places[-1] < start for i in places}
            held = [i for i in held if i not in menus]
        if held:
            tags = [self.nodes[node][0] for node, *_ in self.blocks]
            if "h1" not in {tags[i] for i in held}:
                wanted = "h1" if "h1" in tags else "h2"
                before = [i for i in range(held[0]) if tags[i] == wanted and i not in held]
                if before and (wanted == "h1" or "h2" not in {tags[i] for i in held}):
                    held.insert(0, before[-1])
        return "\n".join(self.blocks[i][1] for i in held)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).netloc or "").lower()
    except ValueError:
        return ""


def votes(html: str | None) -> list[tuple[str, float]]:
    """Path → vote of the page: one for its own choice, a small one in all for its other containers, by their score."""
    own, found = Page(html or "").candidates()
    total = sum(score for path, (_, score) in found.items() if path != own)
    return sorted((path, 1.0 if path == own else OTHERS * score / total) for path, (_, score) in found.items())


def main_text(html: str | None, paths: list[str]) -> str:
    """Text of the containers on the first of the host's deciding paths that this page has, else on the page's own choice."""
    page = Page(html or "")
    chosen = page.choice(paths)
    return page.text(chosen) if chosen else ""


def host_paths(pages: DataFrame, most: int = 3) -> DataFrame:
    """host → its winning paths, best first: at most `most`, each with the share DECIDES of the host's votes.

    Votes are summed in each task before the shuffle.
    """
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            tally: dict[tuple[str, str], float] = {}
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                for path, share in votes(html):
                    tally[host, path] = tally.get((host, path), 0) + share
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()),
                                              pa.array(list(tally.values()), pa.float64())], schema=schema)

    # Fixed point: the sums, and so the winners, do not depend on the order of tasks.
    sums = map_arrow(pages.select("url", "html"), run, "host string, path string, votes double").groupBy("host", "path").agg(
        F.sum(F.round(F.col("votes") * 1e6).cast("long")).alias("votes"))
    host = Window.partitionBy("host")
    place = F.row_number().over(host.orderBy(F.desc("votes"), "path"))
    share = F.col("votes") / F.sum("votes").over(host)
    return sums.withColumns({"place": place, "share": share}).where((F.col("place") <= most) & (F.col("share") >= DECIDES)).groupBy("host").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """The pages with `text`, the article's blocks joined by line ends.

    Null and empty html give an empty text; pages without a host vote together; repeated pages each vote and each get
    their text. Broken markup is read as far as it goes. Other columns are kept and not read (a column `text` is replaced).
    """
    prepare(pages.sparkSession)
    paths = written(host_paths(pages), "host-paths")
    right = F.broadcast(paths) if paths.count() <= MAX_BROADCAST_HOSTS else paths

    @pandas_udf("string")
    def host(urls: pd.Series) -> pd.Series:
        return pd.Series([host_of(u) for u in urls], dtype=object)

    @pandas_udf("string")
    def run(html: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, list(p) if p is not None else []) for h, p in zip(html, paths)], dtype=object)

    own = pages.withColumn("__host", host(F.col("url")))
    named = own.join(right.select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), "__host", "left")
    columns = [c for c in pages.columns if c != "text"]
    return named.select(*[F.col(f"`{c}`") for c in columns], run(F.col("html"), F.col("__paths")).alias("text"))
