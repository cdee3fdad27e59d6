"""Main text of web pages by consensus host paths.

Each page is read into blocks of text under containers. The page votes for the deepest
structural container (no list, table or quotation) that holds most of its text outside
links, named by its path of generalised tags and classes (digits become #). Unless an
article or main stands around it, the vote climbs to the path that covers the rest of the text
too, but for blocks that half of the host's pages repeat. Spark sums the votes of a host, and
the paths with a fair share of them win. Every page is then read again, and what lies under
the host's winning paths is its text; a page that has none of them falls back on its
own vote. Menus, adverts, comments and the like are left out wherever they stand, by their tags, or by names all of whose
words say so. Links count in votes only: a block of links under a winning path is text, as are captions.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Tables, as_id, slices

ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"[>\"']")
QUOTE = re.compile(r"[\"']")
#: Elements whose content isn't markup of the page, up to their end tag.
RAW = {t: re.compile(f"</{t}(?![a-z0-9])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "template")}
#: Elements that begin a block; all others, unknown ones too, run within a line.
BLOCK = set(
    "html head body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol dl table select".split())
SCOPE = set("ul ol dl table div section article main body td".split())
CONTAINERS = set("html body main article section div td center blockquote table tbody tr form ul ol dl figure".split())
STRUCTURAL = set("html body main article section div center td".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
DROPPED = set("nav aside footer form button select menu dialog input fieldset head search".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup paywall "
    "share sharing social related recommended recommendations sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus discussion reply replies respond reactions "
    "login search widget widgets pagination pager copyright disclaimer hidden skip".split()
)
#: Words of names that say where or how, not what: a name is dropped if all its other words are of DROPPED_WORDS.
NEUTRAL_WORDS = set(
    "all area article articles bar block blog body bottom box button buttons card center column container content count entries entry fixed form global group guest heading holder inline inner item items latest layer left link links list main message mobile module more nested new outer page "
    "panel popular post posts primary reader readers recent right row secondary section site slot sticky stories story tertiary text thread threads title toggle tools top tree unit user users view visitor visitors wrap wrapper zone".split()
)
#: In an article these name its own parts as well.
OUTSIDE_ONLY = set("header masthead".split())
SHARE = 0.7
ROOT = -1


def tag_end(html: str, at: int, strict: bool) -> tuple[int, bool]:
    """(place of the > that ends the tag whose attributes begin at ``at``; whether quotes still pair up).

    A > within quotes doesn't end a tag. Once the quotes of a page are found never to close, the first > ends
    every later tag, so a page is read in time that grows with its length alone.
    """
    first = html.find(">", at)
    if not strict or not QUOTE.search(html, at, first):
        return first, strict
    k = at
    while m := QUOTE_OR_END.search(html, k):
        if m[0] == ">":
            return m.start(), True
        k = html.find(m[0], m.end()) + 1
        if not k:
            break
    return first, False


def classes(attrs: str) -> tuple[list[str], bool]:
    """Class and id words of a tag, and whether its attributes hide or drop it."""
    names: list[str] = []
    dropped = False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            names += value.split()
        elif name == "role":
            dropped |= value.lower() in DROPPED_ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            dropped = True
    return names, dropped


def unwanted(names: list[str], inside: bool = False) -> bool:
    """Whether one of the names says in all its words that this is no part of the text.

    "notice", "site-footer" or "related-posts" do, "notice-of-motion" and "has-sidebar" don't. A first word of
    up to three letters may be a prefix. ``inside`` an article its own header is kept.
    """
    for name in names:
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if len(words) > 1 and len(words[0]) < 4 and words[0] not in DROPPED_WORDS and words[0] not in ("has", "no"):
            words = words[1:]
        said = [w for w in words if w not in NEUTRAL_WORDS]
        if words[:2] == ["content", "sidebar"]:
            continue  # what holds the text and the sidebar beside it
        if said and all(w in DROPPED_WORDS and not (inside and w in OUTSIDE_ONLY) for w in said):
            return True
    return False


def _good(text: str, linked: int, links: bool) -> int:
    return len(text) if links else len(text) - linked if 2 * linked < len(text) else 0


class Page:
    """The blocks of a page: text, characters within links, and the innermost path around it.

    Paths are nodes of a tree, named by the hash of their steps (tag and classes) from the root, so that deep markup costs
    as much as flat markup.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.up: list[int] = []  # node above each path
        self.tags: list[str] = []
        self.depth: list[int] = []
        self.keys: list[int] = []
        self.nodes: dict[int, int] = {}  # key to node
        self._stack: list[tuple[str, int, int]] = []  # tag, path, dropped: 1 if only for a form around it
        self._at: dict[str, list[int]] = defaultdict(list)  # places of open tags in the stack
        self._lines: list[int] = []  # of those that begin a block
        self._parts: list[str] = []
        self._linked = 0
        self._link = False
        at, strict, last = 0, True, html.rfind(">")
        while (lt := html.find("<", at)) >= 0:
            if lt > at:
                self._text(html[at:lt])
            at = lt
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(html)
                continue
            if lt > last:  # no tag ends any more
                break
            close = html.startswith("/", lt + 1)
            m = NAME.match(html, lt + 1 + close)
            if not m:
                end = html.find(">", lt) if html.startswith(("!", "?", "/"), lt + 1) else -1
                if end < 0:
                    self._text("<")
                at = end + 1 if end >= 0 else lt + 1
                continue
            end, strict = tag_end(html, m.end(), strict)
            at, tag, attrs = end + 1, m[0].lower(), html[m.end() : end]
            if close:
                self._close(tag)
                continue
            self._open(tag, attrs)
            if tag in RAW and not attrs.endswith("/"):
                over = RAW[tag].search(html, at)
                at = html.find(">", over.end()) + 1 or len(html) if over else len(html)
        if at < len(html):
            self._text(html[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if self._stack and self._stack[-1][2]:
            return
        self._parts.append(raw)
        if self._link:
            self._linked += len(raw)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(unescape("".join(self._parts)).split())
            if text:
                heading = any(t in HEADINGS for t, _, _ in self._stack[-2:])
                self.blocks.append((text, 0 if heading else min(self._linked, len(text)), self._path()))
                self._link = False  # a link that is never closed ends with its block
        self._parts, self._linked = [], 0

    def _path(self) -> int:
        return self._stack[-1][1] if self._stack else ROOT

    def _push(self, tag: str, path: int, dropped: int) -> None:
        self._at[tag].append(len(self._stack))
        if tag in BLOCK:
            self._lines.append(len(self._stack))
        self._stack.append((tag, path, dropped))

    def _cut(self, to: int) -> None:
        while len(self._stack) > to:
            tag = self._stack.pop()[0]
            self._at[tag].pop()
            if tag in BLOCK:
                self._lines.pop()

    def _last(self, tags: set[str]) -> int:
        return max((self._at[t][-1] for t in tags if self._at[t]), default=-1)

    def _node(self, tag: str, names: list[str]) -> int:
        label = ".".join([tag, *sorted({re.sub(r"\d+", "#", n) for n in names})])
        up = self._path()
        key = xxhash.xxh3_64_intdigest(label, seed=self.keys[up] if up >= 0 else 0)
        if key not in self.nodes:
            self.nodes[key] = len(self.keys)
            self.keys.append(key)
            self.up.append(up)
            self.tags.append(tag)
            self.depth.append(self.depth[up] + 1 if up >= 0 else 1)
        return self.nodes[key]

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "a":
            self._link = any(x[0].lower() == "href" for x in ATTRIBUTE.findall(attrs)) and not CLOSED.search(attrs)
        if tag == "br":
            self._parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        inline = tag not in BLOCK
        if inline and not attrs:
            return
        names, hidden = classes(attrs) if attrs else ([], False)
        article = bool(self._at["article"] or self._at["main"])
        if tag in ("html", "body", "main"):
            drop = hidden
        elif tag == "article":
            drop = hidden or article and unwanted(names, True)
        else:
            drop = hidden or tag in DROPPED or tag == "header" and not article or unwanted(names, article)
        dropped = (1 if tag == "form" and not hidden else 2) if drop else 0
        if inline:
            if dropped:
                self._push(tag, self._path(), 2)
            return
        self._flush()
        if tag in CLOSES_P and (p := self._last({"p"})) >= 0 and p > self._last(SCOPE):
            self._cut(p)
        if tag in SIBLINGS and (p := self._last(SIBLINGS[tag])) >= 0 and p > self._last(LISTS):
            self._cut(p)
        outer = self._stack[-1][2] if self._stack else 0
        if outer == 1 and tag in ("article", "main"):
            outer = 0  # a form around the whole page is none of the article's
        dropped = max(outer, dropped)
        self._push(tag, self._node(tag, names) if tag in CONTAINERS and not dropped else self._path(), dropped)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._link = False
        if tag not in BLOCK:
            if self._at[tag] and self._at[tag][-1] > (self._lines[-1] if self._lines else -1):
                self._cut(self._at[tag][-1])
            return
        self._flush()
        self._link = False
        if self._at[tag]:
            self._cut(self._at[tag][-1])

    def _scores(self, links: bool) -> tuple[list[int], int]:
        """The text outside links (or with ``links`` all) under each path, and the deepest structural path with most of it."""
        score = [0] * len(self.keys)
        whole = 0
        for text, linked, node in self.blocks:
            good = _good(text, linked, links)
            whole += good
            if node >= 0:
                score[node] += good
        for node in range(len(score) - 1, -1, -1):  # nodes stand after those above them
            if self.up[node] >= 0:
                score[self.up[node]] += score[node]
        fit = [n for n, s in enumerate(score) if s and s >= SHARE * whole and self.tags[n] in STRUCTURAL]
        return score, max(fit, key=lambda n: (self.depth[n], score[n], self.keys[n]), default=ROOT)

    def _upward(self, node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(node)
            node = self.up[node]
        return out

    def vote(self, links: bool = False) -> tuple[int, int, list[tuple[int, int]]]:
        """(path, score, rest): the deepest structural container with most of the text outside links; an article or main around it stands for it.

        Without those two, ``rest`` has the hash of each block of text beside that container, with the deepest path above both.
        """
        score, best = self._scores(links)
        if best < 0:
            return ROOT, 0, []
        above = self._upward(best)
        for tag in ("article", "main"):
            if outer := [n for n in above if self.tags[n] == tag]:
                return outer[-1], score[outer[-1]], []
        marked = {n for n in above if self.tags[n] in STRUCTURAL}
        meet: list[int] = []  # the deepest path above both a node and the best one
        for node, up in enumerate(self.up):
            meet.append(node if node in marked else meet[up] if up >= 0 else ROOT)
        rest: dict[int, int] = {}
        for text, linked, node in self.blocks:
            path = meet[node] if node >= 0 else ROOT
            if path != best and _good(text, linked, links):
                h = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                rest[h] = min(path, rest.get(h, path), key=self.depth_of)
        return best, score[best], [(p, h) for h, p in rest.items()]

    def depth_of(self, node: int) -> int:
        return self.depth[node] if node >= 0 else 0

    def key(self, node: int) -> int:
        """The name of a path in all pages of a host; 0 stands above all."""
        return self.keys[node] - (1 << 63) if node >= 0 else 0

    def own(self, links: bool = False) -> int | None:
        """The path that covers all of the page's text, as far as the page alone tells."""
        best, _, rest = self.vote(links)
        if best < 0:
            return None
        return min((best, *(p for p, _ in rest)), key=self.depth_of)

    def text(self, winners: list[int]) -> str:
        """All blocks under the first winning path that the page has, or else under its own vote, or all if it has none."""
        nodes = {self.key(n): n for n in range(ROOT, len(self.keys))}
        for path in [*(nodes.get(w) for w in winners), *(self.own(links=x) for x in (False, True))]:
            if path is None:
                continue
            under = [False] * len(self.keys)
            for node, up in enumerate(self.up):
                under[node] = node == path or up >= 0 and under[up]
            if found := [t for t, _, node in self.blocks if path == ROOT or node >= 0 and under[node]]:
                return "\n".join(found)
        return "\n".join(t for t, _, _ in self.blocks)


def _votes() -> object:
    """Votes, summed for pages that have no text beside their path; others come one by one, with that text."""
    item = pa.struct([("path", pa.int64()), ("depth", pa.int32()), ("block", pa.int64())])
    schema = pa.schema([("page", pa.int64()), ("host", pa.string()), ("path", pa.int64()), ("votes", pa.int64()), ("score", pa.int64()), ("rest", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            votes: Counter = Counter()
            score: Counter = Counter()
            out = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(html or "")
                path, n, rest = page.vote()
                if rest:
                    out.append((uuid.uuid4().int >> 65, host, page.key(path), 1, n, [{"path": page.key(p), "depth": page.depth_of(p), "block": h} for p, h in rest]))
                elif path >= 0:
                    votes[host, page.key(path)] += 1
                    score[host, page.key(path)] += n
            out += [(None, h, p, n, score[h, p], []) for (h, p), n in votes.items()]
            columns = [*zip(*out, strict=True)] or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _climbed(votes: DataFrame) -> DataFrame:
    """(host, path, votes, score) of each page: its path climbs to cover the text beside it, but for blocks on half of the host's pages."""
    rest = votes.where("page is not null").select("page", "host", F.explode("rest").alias("x")).select("page", "host", "x.*")
    repeated = rest.groupBy("host", "block").agg(F.count("*").alias("n")).where("n > 1")
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    repeated = repeated.join(total, "host").where("2 * n >= total").select("host", "block")
    # The paths above a page's path are above each other, so the one of least depth is the outermost.
    up = rest.join(repeated, ["host", "block"], "left_anti").groupBy("page").agg(F.min_by("path", "depth").alias("up"))
    return votes.join(up, "page", "left").select("host", F.coalesce("up", "path").alias("path"), "votes", "score")


def _texts() -> object:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            texts = [Page(h).text(w or []) if h else "" for h, w in zip(batch.column("html").to_pylist(), batch.column("winners").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], schema=schema)

    return run


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.1) -> DataFrame:
    """(page_id, url, text), a row for each row of ``pages``.

    Text is the blocks under the host's winning paths: those with at least ``share`` of its
    pages' votes, tried from the most votes down (ties: larger score, then path). Character
    references are decoded, white space within a block becomes one space, blocks
    are trimmed and joined by a newline. A null or empty html gives an empty
    text, and pages without a readable host vote together. Repeated rows
    vote and are returned each. Other columns are not read. Time and memory grow with a page's length, however broken or deep its
    markup; a page is read whole by one task.

    Counts of votes are shuffled, and hashes of the blocks beside a page's path. Winning paths, at most 1 / share a host, are joined
    by host; Spark broadcasts them if they are small and else splits hot hosts.
    """
    tables = Tables(pages.sparkSession)
    url = F.col(f"`{url_col}`").cast("string")
    host = F.coalesce(F.lower(F.try_parse_url(F.trim(url), F.lit("HOST"))), F.lit(""))
    own = pages.select(as_id(pages, id_col).alias("id"), url.alias("url"), host.alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    kind = "page bigint, host string, path bigint, votes bigint, score bigint, rest array<struct<path:bigint,depth:int,block:bigint>>"
    votes = tables.write(own.select("host", "html").mapInArrow(_votes(), kind), "votes")
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    votes = _climbed(votes).groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    fair = votes.join(total, "host").where(F.col("votes") >= F.col("total") * share)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path")))
    winners = tables.write(fair.groupBy("host").agg(ranked.alias("w")).select("host", F.col("w.path").alias("winners")), "winners")
    tables.drop("votes")
    return own.join(winners, "host", "left").select("id", "url", "html", "winners").mapInArrow(_texts(), "page_id bigint, url string, text string")
