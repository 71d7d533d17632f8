"""Main text of web pages by consensus paths of a host.

Each page's containers are scored by the text that they hold outside menus,
headers, footers, adverts and the like. A page votes for the tag-class path of its
best container, which holds all such text, with digits taken out of class names.
Inside it the page also votes for the containers that hold most of that text and
all headings, together with a hash of the text that they leave out. Votes are
summed by host and path in Spark: a container counts on the pages where nothing is
left out, and on those that leave out the same text beside at least three
different texts, as the furniture of a site does. The path with most votes wins on
its host, the deeper one of equals, and each page is extracted again at all elements
of that path. A page falls back on its own best container where the winning path
would leave out anything but the host's furniture.

The text has one line for each block. Character references are decoded, white
space (line breaks by ``br`` too) becomes one space, empty blocks go.

Defined results: null or empty html gives an empty text; a null url votes under
an empty host; broken markup is read as far as it goes; repeated rows give
repeated results and are one text as evidence; of paths with equal votes and depth
the first wins; an empty table gives an empty one; other columns are ignored. Pages
are read whole, in time linear in their length (paths: times the elements' depth).
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import settle
from .textkit import arrow_map, keyed, spread

# Elements by their part in a page, and words in class names and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("annotation audio button canvas datalist dialog embed head iframe input map menu meter nav noscript object picture progress script select style svg template textarea title video".split())
FRAME = frozenset("aside footer form".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title".split())
CONTAINERS = frozenset("article blockquote body center div main section table tbody td tr".split())
FRAME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
FRAME_WORDS = frozenset("adbox adsense adslot advert advertisement advertising adverts breadcrumb breadcrumbs commentlist cookiebanner cookiebar cookies disqus gdpr newsletter pagination paywall sponsored".split())
#: Words that name a frame only where the rest of the class or id names no matter of its own: "related-posts", not "related-work".
FRAME_WITH = frozenset("ad ads comment comments consent cookie footer pager promo promotion recommended related replies reply respond signup sponsor subscribe".split())
COMPANIONS = frozenset(
    "area article articles author banner bar block body bottom box by button card cards container content count dfp entry even field form google group head header heading holder icon inner item items label leaderboard left line link links list main message meta module more news note notice odd outer page panel post posts right row section site slot stories story strip text thread title top unit view widget wrap wrapper".split()
)
#: Words that also name the layout of a whole page, as in "with-sidebar".
LAYOUT_WORDS = frozenset("alert banner dock dropdown mainmenu mainnav masthead menu modal nav navbar navigation notice notification overlay popup share sharing sidebar sidenav skip social submenu subnav toolbar topbar topnav widget".split())
ASIDE_ARTICLES = frozenset("comment comments promo recommended related replies reply sponsored".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt html li optgroup option tbody td tfoot th thead tr".split())
SAME_LEVEL = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "tbody": ("tbody thead tfoot tr td th", ("table",)), "thead": ("tbody thead tfoot tr td th", ("table",)), "tfoot": ("tbody thead tfoot tr td th", ("table",))}

_tag = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_plain = re.compile(r"[^\"'>]*+")
_attribute = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_bare = re.compile(r"\"[^\"]*\"|'[^']*'|=\s*[^\s\"'>]+")
_hidden = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_no_display = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_pieces = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_digits = re.compile(r"[0-9]+")
_closing = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def words_of(name: str) -> set[str]:
    return {w.lower() for w in _pieces.findall(name)}


def names_frame(names: list[str]) -> bool:
    """Whether one of an element's classes or its id names a frame."""
    for words in map(words_of, names):
        if words & FRAME_WORDS or (words & FRAME_WITH and words <= FRAME_WITH | LAYOUT_WORDS | COMPANIONS):
            return True
    return False


class Stack:
    """Open elements, with the places of each tag, so that no search walks over others."""

    def __init__(self):
        self.nodes: list[int] = []
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def pop(self) -> int:
        tag = self.tags.pop()
        self.places[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
        return self.nodes.pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of some tags; 0 if there is none below the root."""
        return max([0, *(self.places[t][-1] for t in tags if self.places.get(t))])

    def first_above(self, floor: int, *tags: str) -> int:
        """The outermost place beyond ``floor`` of some tags; 0 if there is none."""
        found = [held[k] for t in tags if (held := self.places.get(t)) and (k := bisect_right(held, floor)) < len(held)]
        return min(found, default=0)


class Page:
    """Elements of a page as flat lists, in page order, and its pieces of text."""

    def __init__(self, source: str):
        self.tags, self.parents, self.marks, self.skips, self.ends, self.layout, self.depths = [], [], [], [], [], [], []
        self.texts: list[tuple[int, str]] = []  # (element, text); a text of None is a break between blocks
        self.begins: list[int] = []
        self._parse(source)
        self._frame()
        self._headers()

    def _frame(self) -> None:
        """What stands in a frame is skipped. A layout word counts unless the element holds most of the text."""
        held = [0] * len(self.tags)
        hard = list(self.skips)
        for k, p in enumerate(self.parents):
            hard[k] = hard[k] or (p >= 0 and hard[p])
        for node, piece in self.texts:
            if piece is not None and not hard[node]:
                held[node] += len(piece) - piece.count(" ")
        for k in range(len(self.tags) - 1, 0, -1):
            held[self.parents[k]] += held[k]
        for k, p in enumerate(self.parents):
            self.skips[k] = self.skips[k] or (self.layout[k] and 10 * held[k] < 6 * held[0]) or (p >= 0 and self.skips[p])

    def _headers(self) -> None:
        """For each element the nearest header around it, or itself, that is a page's: without a heading, in no article."""
        n = len(self.tags)
        titled, self.in_article, self.header = [t in HEADING for t in self.tags], [False] * n, [-1] * n
        for k in range(n - 1, 0, -1):
            titled[self.parents[k]] = titled[self.parents[k]] or titled[k]
        for k, p in enumerate(self.parents):
            self.in_article[k] = self.tags[k] == "article" or (p >= 0 and self.in_article[p])
            bare = self.tags[k] == "header" and not titled[k] and not self.in_article[k]
            self.header[k] = k if bare else self.header[p] if p >= 0 else -1

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        found = {k.lower(): a or b or c for k, a, b, c in _attribute.findall(attributes)} if "=" in attributes else {}
        names = [*found.get("class", "").split(), *found.get("id", "").split()]
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        label = ".".join(sorted({_digits.sub("", x) for x in found.get("class", "").split()} - {""}))
        self.marks.append(f"{tag}.{label}" if label else tag)
        whole = tag in ("html", "body", "article", "main")
        framed = tag in FRAME or found.get("role", "").lower() in FRAME_ROLES or (names and not whole and names_frame(names))
        gone = tag in UNSEEN or (attributes and _hidden.search(_bare.sub("= ", attributes))) or _no_display.search(found.get("style", "")) or found.get("aria-hidden", "").lower() == "true"
        if tag == "article" and any(w and w <= ASIDE_ARTICLES | COMPANIONS and w & ASIDE_ARTICLES for w in map(words_of, names)):
            framed = True
        self.skips.append(bool(framed or gone))
        self.layout.append(bool(names and not whole and any(words_of(x) & LAYOUT_WORDS for x in names)))
        self.begins.append(len(self.texts))
        self.ends.append(-1)
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        stack = Stack()
        stack.push(self._open("html", -1, ""), "html")
        stack.blocks.clear()  # the root is closed by nothing
        at, n = 0, len(source)
        endless: set[int] = set()

        def tag_end(at: int) -> int:
            """The place after a tag's end, quotes observed; of a quote that is never closed, the next end. Quotes from
            which no end is reached are kept, so all such tags of a page together are read once."""
            start, passed = at, []
            while True:
                at = _plain.match(source, at).end()
                if at < n and source[at] == ">":
                    return at + 1
                if at >= n or at in endless:
                    break
                passed.append(at)
                close = source.find(source[at], at + 1)
                if close < 0:
                    break
                at = close + 1
            endless.update(passed)
            end = source.find(">", start)
            return n if end < 0 else end + 1

        def shut(depth: int) -> None:
            while len(stack.nodes) > max(depth, 1):
                node = stack.pop()
                self.ends[node] = len(self.texts)
                if self.tags[node] in BLOCK:
                    self.texts.append((node, None))

        def in_head() -> bool:
            return len(stack.tags) > 1 and stack.tags[1] == "head"

        def text(raw: str) -> None:
            if raw:
                if stack.tags[-1] == "head" and not raw.isspace():
                    shut(len(stack.nodes) - 1)
                self.texts.append((stack.nodes[-1], entities.unescape(raw) if "&" in raw else raw))

        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                text(source[at:])
                break
            text(source[at:lt])
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            match = _tag.match(source, lt)
            if match is None:
                if source.startswith(("<!", "<?", "</"), lt):
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    text("<")
                    at = lt + 1
                continue
            tag = match[2].lower()
            end = tag_end(match.end())
            attributes = source[match.end() : end - 1]
            at = end
            if match[1]:
                place = stack.last(tag)
                if place and (tag in BLOCK or stack.last("td", "th", "table") <= place):
                    shut(place)
                continue
            if tag == "html":
                continue
            if tag == "br":
                if in_head():
                    shut(1)
                text(" ")
                continue
            if tag not in IN_HEAD and in_head():
                shut(1)  # its end tag may be left out
            if tag in VOID:
                if tag == "hr":
                    self.texts.append((stack.nodes[-1], None))
                continue
            if tag in CLOSES_P:
                if stack.blocks and stack.tags[stack.blocks[-1]] == "p":
                    shut(stack.blocks[-1])
            elif tag in SAME_LEVEL:
                same, fence = SAME_LEVEL[tag]
                if lowest := stack.first_above(stack.last(*fence), *same.split()):
                    shut(lowest)
            if tag in BLOCK:
                self.texts.append((stack.nodes[-1], None))
            node = self._open(tag, stack.nodes[-1], attributes)
            if attributes.endswith("/") and tag in ("svg", "path", "iframe"):
                self.ends[node] = len(self.texts)
                continue
            if tag in RAW:
                found = _closing[tag].search(source, at)
                stop = n if found is None else found.start()
                close = source.find(">", stop)
                at = n if close < 0 else close + 1
                self.ends[node] = len(self.texts)
                continue
            stack.push(node, tag)
        shut(1)
        self.ends[0] = len(self.texts)
        self.texts.append((0, None))

    def path(self, node: int) -> str:
        """Tags and classes from the root to an element."""
        out = []
        while node >= 0:
            out.append(self.marks[node])
            node = self.parents[node]
        return "/".join(reversed(out))

    def at_path(self, path: str) -> list[int]:
        """The elements of a path that are not skipped."""
        names = path.split("/")
        fits, out = [False] * len(self.tags), []
        for k, (mark, p, depth) in enumerate(zip(self.marks, self.parents, self.depths)):
            fits[k] = depth < len(names) and mark == names[depth] and (p < 0 or fits[p])
            if fits[k] and depth == len(names) - 1 and not self.skips[k]:
                out.append(k)
        return out

    def weigh(self) -> list[int]:
        """For each element, characters outside links and frames that it holds."""
        linked = [t == "a" for t in self.tags]
        for k, p in enumerate(self.parents):
            if p >= 0 and linked[p]:
                linked[k] = True
        weight = [0] * len(self.tags)
        for node, piece in self.texts:
            if piece is not None and not self.skips[node] and not linked[node]:
                weight[node] += len(piece) - piece.count(" ")
        heads = [t == "header" for t in self.tags]
        for k in range(len(self.tags) - 1, 0, -1):
            if not heads[k]:
                weight[self.parents[k]] += weight[k]
        return weight

    def article_texts(self) -> list[tuple[int, int, bool]]:
        """(element, place, whether in a heading) of the texts that an article may not lose: outside frames, page headers and links, headings whole."""
        linked, heading, header = [], [], []
        for k, (t, p) in enumerate(zip(self.tags, self.parents)):
            linked.append(t == "a" or (p >= 0 and linked[p]))
            heading.append(t in HEADING or (p >= 0 and heading[p]))
            banner = t == "header" and not self.in_article[k] and (self.tags[p] in ("html", "body") or self.header[k] == k)
            header.append(banner or (p >= 0 and header[p]))
        out = []
        for at, (k, piece) in enumerate(self.texts):
            if piece is not None and not self.skips[k] and not header[k] and (heading[k] or not linked[k]) and any(c.isalnum() for c in piece):
                out.append((k, at, heading[k]))
        return out

    def inner(self) -> dict[int, list[int]]:
        """Containers inside each element."""
        out: dict[int, list[int]] = {}
        for k, p in enumerate(self.parents):
            if self.tags[k] in CONTAINERS and not self.skips[k]:
                out.setdefault(p, []).append(k)
        return out

    def best(self, weight: list[int]) -> int:
        """The container of the article: a marked one if it holds a good part, else the smallest with all of the text."""
        total = weight[0]
        if not total:
            return 0
        marked = [k for k, t in enumerate(self.tags) if t == "article" and not self.skips[k] and 4 * weight[k] >= total]
        if not marked:
            marked = [k for k, t in enumerate(self.tags) if t == "main" and not self.skips[k] and 4 * weight[k] >= total]
        if marked:
            return max(marked, key=lambda k: (weight[k], -k))
        node, inner = 0, self.inner()
        places = [at for _, at, _ in self.article_texts()]
        while places:
            top = max(inner.get(node, []), key=lambda k: (weight[k], -k), default=None)
            if top is None or places[0] < self.begins[top] or places[-1] >= self.ends[top]:
                return node
            node = top
        return node

    def dense(self, own: int, weight: list[int]) -> list[tuple[int, int, int]]:
        """Containers inside the best one with most of its text and all its headings, from the outside in:
        (element, hash of the text left out, hash of the text inside). None inside marked articles."""
        if self.tags[own] in ("article", "main") or not weight[own]:
            return []
        texts = [(at, titled, int(xxhash.xxh64_intdigest(" ".join(self.texts[at][1].split())))) for _, at, titled in self.article_texts() if self.begins[own] <= at < self.ends[own]]
        inner, out, node, left, right, outside = self.inner(), [], own, 0, len(texts), 0
        total = sum(h for *_, h in texts)
        while True:
            top = max(inner.get(node, []), key=lambda k: (weight[k], -k), default=None)
            if top is None or 2 * weight[top] <= weight[own]:
                return out
            while left < right and texts[left][0] < self.begins[top]:
                if texts[left][1]:
                    return out
                outside, left = outside + texts[left][2], left + 1
            while left < right and texts[right - 1][0] >= self.ends[top]:
                if texts[right - 1][1]:
                    return out
                right, outside = right - 1, outside + texts[right - 1][2]
            out.append((top, signed(outside), signed(total - outside)))
            node = top

    def lines(self, top: int) -> str:
        """The text of a container, a line for each block."""
        out: list[str] = []
        held: list[str] = []
        skip: dict[int, bool] = {}
        first, last = self.begins[top], self.ends[top]
        for node, piece in self.texts[first : last + 1]:
            if piece is None:
                if held and (line := " ".join("".join(held).split())):
                    out.append(line)
                held = []
                continue
            if node not in skip:
                skip[node] = self.skips[node] or self.header[node] > top
            if not skip[node]:
                held.append(piece)
        if held and (line := " ".join("".join(held).split())):
            out.append(line)
        return "\n".join(out)


def signed(x: int) -> int:
    """A number modulo 2**64 as a signed one."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def vote(source: str) -> list[tuple[str, int, int]]:
    """The paths that a page votes for, with hashes of the text that each leaves out (0: nothing) and of that inside; none without text."""
    page = Page(source)
    weight = page.weigh()
    if not weight[0]:
        return []
    own = page.best(weight)
    return [(page.path(own), 0, 0), *((page.path(k), out, inside) for k, out, inside in page.dense(own, weight))]


def main_text(source: str, winner: str | None, furniture: int = 0) -> str:
    """The text at all places of a host's winning path, or in the page's own best container if that would lose more than the furniture."""
    page = Page(source)
    own = page.best(page.weigh())
    if winner and (tops := page.at_path(winner)):
        held = np.zeros(len(page.texts) + 1, bool)
        for k in tops:
            held[page.begins[k] : page.ends[k]] = True
        lost = [(at, titled) for _, at, titled in page.article_texts() if page.begins[own] <= at < page.ends[own] and not held[at]]
        if lost and furniture and not any(titled for _, titled in lost):
            lost = signed(sum(xxhash.xxh64_intdigest(" ".join(page.texts[at][1].split())) for at, _ in lost)) != furniture
        if not lost:
            return "\n".join(x for k in tops if (x := page.lines(k)))
    return page.lines(own)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: Different texts that must leave out the same text before it counts as a host's furniture.
TEXTS = 3


def winners(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, furniture): the path with most votes on each host; of equal ones the deepest, then the first."""
    chosen = spread(keyed(pages, url_col, html_col)).select(host(url_col).alias("host"), F.col(html_col).alias("html"))
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("outside", T.LongType()), T.StructField("inside", T.LongType())])

    def rows(batch: pa.RecordBatch):
        votes = [(h, *v) for h, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if source for v in vote(source)]
        yield [[v[j] for v in votes] for j in range(4)]

    each = arrow_map(chosen, schema, rows).groupBy("host", "path", "outside", "inside").agg(F.count("*").alias("pages"))
    alike = each.groupBy("host", "path", "outside").agg(F.sum("pages").alias("pages"), F.count("*").alias("texts")).where((F.col("outside") == 0) | (F.col("texts") >= TEXTS))
    bare, same = F.when(F.col("outside") == 0, F.col("pages")), F.when(F.col("outside") != 0, F.struct("pages", "outside"))
    paths = alike.groupBy("host", "path").agg(F.coalesce(F.max(bare), F.lit(0)).alias("bare"), F.max(same).alias("same"))
    votes = F.col("bare") + F.coalesce(F.col("same.pages"), F.lit(0))
    best = paths.select("host", "path", F.coalesce("same.outside", F.lit(0)).cast("long").alias("furniture"), F.struct(-votes, -F.size(F.split("path", "/")), "path").alias("rank"))
    return best.groupBy("host").agg(F.min_by(F.struct("path", "furniture"), "rank").alias("won")).select("host", "won.path", "won.furniture")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 100_000) -> DataFrame:
    """(id, url, text, n_chars) for each page.

    The winning paths are broadcast if there are at most ``broadcast_hosts`` of
    them; beyond that pages and paths are joined by a shuffle.
    """
    paths = settle(winners(pages, url_col, html_col))
    chosen = spread(keyed(pages, id_col, url_col, html_col)).withColumn("host of page", host(url_col))
    paths = paths.select(F.col("host").alias("host of page"), F.col("path").alias("path of host"), F.col("furniture").alias("furniture of host"))
    if paths.count() <= broadcast_hosts:
        paths = F.broadcast(paths)
    joined = chosen.join(paths, "host of page", "left").select(id_col, url_col, html_col, "path of host", "furniture of host")
    schema = T.StructType([chosen.schema[id_col], chosen.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def rows(batch: pa.RecordBatch):
        texts = [main_text(h, p, f or 0) if h else "" for h, p, f in zip(*[batch.column(j).to_pylist() for j in (2, 3, 4)])]
        yield [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    return arrow_map(joined, schema, rows)
