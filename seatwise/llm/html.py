"""Main text of web pages by consensus: pages vote on container paths per host, then all are cut by the winners."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seatwise.llm.common import stored

# A path stays in a host's vote with this share of its pages, besides the first.
SHARE = 0.1
# Winners up to this size go to every task; beyond it pages and winners are joined by host.
BROADCAST_BYTES = 64 << 20

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)", re.S)
# Attributes up to the end of the tag, if no quoted value has a < or > in it.
_PLAIN = re.compile(r"[^<>\"']*+(?:(?<==)(?:\"[^\"<>]*+\"|'[^'<>]*+')[^<>\"']*+)*+>")
_UNQUOTED = re.compile(r"[^<>\"']*+")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_DIGITS = re.compile(r"\d+")

# Tags by their part in HTML, and names that sites give to what is not the article.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math object textarea title xmp canvas video audio select".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_DROP = frozenset("nav header footer aside form menu button dialog label legend option head".split())
_CONTAINER = frozenset("article main section div td body html".split())
_AROUND = frozenset(("form", "nav", "header"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())
_NOISE = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert(?:s|isement|isements|ising)?|adsense|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|banners?|cookies?|consent|gdpr|"
    r"notices?|alerts?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|comments?|commentlist|respond|disqus|shar(?:e|ing)|social|related|"
    r"recommended|newsletter|subscribe|subscription|signup|popup|modal|overlay|login|search|searchform|widgets?|toolbar|pagination|pager|"
    r"topbar|masthead|skip-link|paywall|print-only)(?=[-_\s]|$)", re.I,
)
_HEAD_NAME = re.compile(r"(?:^|[-_\s])(?:header|head|masthead)(?=[-_\s]|$)", re.I)
_GOOD_NAME = re.compile(r"(?:^|[-_\s])(?:article|content|post|entry|story|main|text|body)(?=[-_\s]|$)", re.I)


# Unlinked text below a noise name counts this much when the page's main block is looked for; text in an article or main
# below it counts whole, unless the name is that of remarks or of other articles, or an article elsewhere has text.
_PENALTY = 0.1
_OTHERS = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|respond|disqus|related|recommended)(?=[-_\s]|$)", re.I)


# What the opening of a block ends by itself, and what that does not reach beyond.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


class _Node:
    """``named`` is the closest node around or at this one that is dropped by its name alone, ``hard`` tells of other reasons;
    ``first_hard`` and ``first_drop`` are the outermost such nodes around or at it. ``box`` is the closest container, with
    ``titled`` for a title on the way there. All of it is handed down, so that no page walks its open tags again and again."""

    __slots__ = (
        "tag", "names", "parent", "hard", "named", "inner", "step", "at", "score", "heading", "order", "plain", "main",
        "depth", "first_hard", "first_drop", "others", "box", "titled",
    )

    def __init__(self, tag: str, names: str, step: str, at: int, parent: _Node | None, hard: bool, named: bool, inner: bool):
        self.tag, self.names, self.step, self.at, self.parent, self.hard, self.inner = tag, names, step, at, parent, hard, inner
        self.named = self if named else parent.named if parent else None
        self.order = self.plain = self.main = 0
        self.score, self.heading = 0.0, False
        self.depth = parent.depth + 1 if parent else 0
        self.first_hard = parent and parent.first_hard or (self if hard else None)
        self.first_drop = parent and parent.first_drop or (self if self.dropped else None)
        self.others = bool(parent and parent.others) or bool(_OTHERS.search(names))
        self.box = self if tag in _CONTAINER else parent.box if parent else None
        self.titled = tag not in _CONTAINER and (tag in ("h1", "h2") or bool(parent and parent.titled))

    @property
    def dropped(self) -> bool:
        return self.hard or self.named is not None

    @property
    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            steps.append(node.step)
            node = node.parent
        return "/".join(reversed(steps))


class Page:
    """The blocks of a page: (node, text, characters in links), in page order, without what is never main text."""

    def __init__(self, html: str):
        self._kept: set[int] = set()
        self._parse(html)
        while found := self._misnamed():
            self._kept |= found
            self._parse(html)

    def _misnamed(self) -> set[int]:
        """The nodes dropped by their names that hold the page's main block; none if it is elsewhere."""
        kept = sum(len(text) - linked for _, text, linked in self.blocks)
        article = any(node.inner and len(text) > linked for node, text, linked in self.blocks)
        best, top = None, float(kept)
        for node in self.nodes:
            if node.named is node and not node.hard and node.plain:
                worth = node.main if node.main and not article and not node.others else 0
                worth += _PENALTY * (node.plain - worth)
                if worth > top:
                    best, top = node, worth
        return {n.order for n in self._around(best) if n.named is n} if best is not None else set()

    @staticmethod
    def _around(node: _Node) -> Iterator[_Node]:
        while node is not None:
            yield node
            node = node.parent

    def _parse(self, html: str) -> None:
        # Paths as numbers: one per path around and step.
        self.paths: dict[tuple[int, str], int] = {(-1, "#"): 0}
        self.root = _Node("#", "", "#", 0, None, False, False, False)
        self.stack = [self.root]
        # Depths at which each tag is open.
        self.depths: dict[str, list[int]] = {}
        self.nodes: list[_Node] = []
        self.blocks: list[tuple[_Node, str, int]] = []
        self._text: list[str] = []
        self._linked = self._in_link = 0
        at = look = 0
        self._dead: set[int] = set()
        unclosed: set[str] = set()
        while found := _MARK.search(html, look):
            end = found.end() if not found[2] else self._tag_end(html, found.end())
            if end < 0:
                look = found.start() + 1
                continue
            self._add(html[at : found.start()])
            at = look = end
            if not found[2]:
                continue
            tag, rest = found[2].lower(), html[found.end() : end - 1]
            if found[1]:
                self._close(tag)
            elif tag in _RAW:
                end = None
                if not rest.endswith("/") and tag not in unclosed:
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                    if end is None:
                        unclosed.add(tag)
                at = look = end.end() if end else (len(html) if tag in ("script", "style") and not rest.endswith("/") else at)
            else:
                self._open(tag, rest)
        self._add(html[at:])
        self._flush()

    def _tag_end(self, html: str, at: int) -> int:
        """Behind the > of the tag whose name ends at ``at``, -1 if there is none. A quote after = holds up to the next
        one like it, however far; any other quote stands for itself. Quotes from which no end is
        found are remembered, so that none is followed twice."""
        if plain := _PLAIN.match(html, at):
            return plain.end()
        start, seen = at, []
        while True:
            i = _UNQUOTED.match(html, at).end()
            if i >= len(html) or html[i] == "<" or i in self._dead:
                self._dead.update(seen)
                return -1
            if html[i] == ">":
                return i + 1
            seen.append(i)
            close = html.find(html[i], i + 1) if html[start:i].rstrip().endswith("=") else -1
            start = at = (close if close >= 0 else i) + 1

    def _add(self, raw: str) -> None:
        node = self.stack[-1]
        if raw and node.named is not None and not node.hard and not self._in_link:
            size = len(" ".join(raw.split()))
            node.named.plain += size
            node.named.main += size if node.inner else 0
        if raw and not node.dropped:
            self._text.append(raw)
            if self._in_link:
                self._linked += len(raw)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            if text:
                node = self.stack[-1]
                self.blocks.append((node, text, min(self._linked, len(text))))
            self._text = []
        self._linked = 0

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._add(" ")
        if tag == "a":
            self._in_link += 1
        if tag not in _BLOCK and tag not in _DROP:
            if _ATTRIBUTE.search(rest) and tag == "span" and tag not in _VOID:
                self._push(tag, rest)
            return
        self._flush()
        self._in_link = int(tag == "a")
        if tag in ("hr",):
            return
        if tag != "body" and self._depth(("head",)) and tag not in ("head", "html"):
            self._close("head")
        self._end(("p",), ("td", "th", "button", "body"))
        if tag in _ENDS:
            self._end(_ENDS[tag], _WALLS.get(tag, ()))
        if tag == "body":
            self._end(("head",), ("html",))
        if tag in ("body", "html") and self._depth((tag,)):
            return
        self._push(tag, rest)

    def _push(self, tag: str, rest: str) -> None:
        classes = ident = role = ""
        hidden = False
        for name, a, b, c, bare in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), a or b or c
            if name == "class":
                classes = value
            elif name == "id":
                ident = value
            elif name == "role":
                role = value.lower()
            elif bare or name == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
            elif name == "aria-hidden" and value.lower() == "true":
                hidden = True
        parent = self.stack[-1]
        names = f"{classes} {ident}"
        inner = parent.inner or tag in ("article", "main")
        if tag in ("article", "main") and parent.dropped:
            # A form around the page, or a menu that was never closed, does not take the article along. What is inside
            # something dropped is dropped, so only the open nodes from the outermost one on are touched.
            drop, hard = parent.first_drop, parent.first_hard
            if drop.tag in _AROUND:
                for n in self.stack[drop.depth:]:
                    n.hard, n.named, n.first_drop, n.first_hard = False, None, None, None
            elif hard is not None and hard.tag in _AROUND:
                for n in self.stack[hard.depth:]:
                    n.hard, n.first_hard = False, None
        header = tag == "header" or bool(_HEAD_NAME.search(names))
        outside = tag not in _HEADINGS and tag not in ("body", "html", "article", "main")
        hard = parent.hard or hidden or role in _ROLES or tag in _DROP and tag != "header" or tag == "header" and not parent.inner
        named = outside and (bool(_NOISE.search(names)) or header and tag != "header" and not parent.inner)
        step = tag + "".join(f".{c}" for c in sorted(set(_DIGITS.sub("0", classes).lower().split())))
        at = self.paths.setdefault((parent.at, step), len(self.paths))
        node = _Node(tag, names, step, at, parent, hard, named and len(self.nodes) not in self._kept, inner)
        node.order = len(self.nodes)
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        self.nodes.append(node)

    def _depth(self, tags: tuple) -> int:
        """Where the innermost open node with one of these tags is, 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _cut(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.depths[node.tag].pop()
        del self.stack[depth:]

    def _end(self, tags: tuple, walls: tuple) -> None:
        depth = self._depth(tags)
        if depth and depth > self._depth(walls):
            self._cut(depth)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._in_link = 0
        if tag in _BLOCK or tag in _DROP or tag == "span":
            if tag != "span":
                self._flush()
            if tag not in ("body", "html"):
                self._end((tag,), ("td", "th", "article", "section") if tag in ("span", "p", "li") else ())

    def best(self) -> _Node | None:
        """The container with most text of its own and of its parts, links not counted. Parts of a part count
        for less, so that the closest container around all paragraphs wins."""
        for node, text, linked in self.blocks:
            size = len(text) - linked
            if linked > 0.6 * len(text):
                continue
            around, share, heading = node.box, 1.0, node.titled
            while around is not None and share > 0.05:
                around.score += share * size
                around.heading = around.heading or heading and around.tag != "body"
                share *= 0.6
                heading = heading or around.parent.titled
                around = around.parent.box
        best, top = None, 0.0
        for node in self.nodes:
            if node.tag in _CONTAINER and not node.dropped and node.score > 0:
                weight = 2.5 if node.tag in ("article", "main") else 0.5 if node.tag in ("body", "html") else 1.0
                weight *= 1.4 if _GOOD_NAME.search(node.names) else 1.0
                if node.score * weight > top:
                    best, top = node, node.score * weight
        # A wrapper that adds the title belongs to the article.
        while best is not None and not best.heading and best.parent is not None and best.parent.heading and best.parent.tag in _CONTAINER and not best.parent.dropped:
            best = best.parent
        return best

    def _places(self, path: str) -> set[int]:
        """The numbers of this path: each step is compared once, where the steps around it agree."""
        agree = [-1] * len(self.paths)
        for (around, step), at in self.paths.items():
            if around < 0:
                start = 0
            elif agree[around] >= 0 and path.startswith("/", agree[around]):
                start = agree[around] + 1
            else:
                continue
            if path.startswith(step, start):
                agree[at] = start + len(step)
        return {at for at, n in enumerate(agree) if n == len(path)}

    def text(self, path: str | None) -> str:
        """The blocks below all nodes with this path (None: all blocks), one per line."""
        if path is None:
            return "\n".join(text for _, text, _ in self.blocks)
        places = self._places(path)
        below = {self.root: 0 in places}
        for node in self.nodes:
            below[node] = below[node.parent] or node.at in places
        return "\n".join(text for node, text, _ in self.blocks if below[node])

    def main_text(self, ranked: list[str]) -> str:
        """By the first of the host's paths that this page has with text in it, else by its own best container."""
        have = {n.at for n in self.nodes if not n.dropped}
        for path in ranked:
            if have & self._places(path) and (found := self.text(path)):
                return found
        best = self.best()
        return self.text(best.path if best is not None else None)


def path_column(html: str) -> Column:
    """The path of each page's best container; null if the page has none."""

    @F.pandas_udf("string")
    def path(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            best = (Page(p).best() if p else None for p in pages)
            yield pd.Series([None if b is None else b.path for b in best], dtype=object)

    return path(F.col(html))


def text_column(html: str, paths: str) -> Column:
    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, ranked in batches:
            yield pd.Series(
                [Page(p).main_text([] if r is None else list(r)) if p else "" for p, r in zip(pages, ranked)], dtype=object
            )

    return text(F.col(html), F.col(paths))


def host(url: str) -> Column:
    """Lower-case host of a URL, null or another form: empty."""
    found = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def winning_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """host, paths: the paths that a host's pages voted for, most votes first (ties by path): the
    first, and each further one with ``share`` of its host's votes, so 1 / share at most. Votes are counted before they are
    dealt out, so a host with most of the pages is a few rows."""
    votes = pages.select(host("url").alias("host"), path_column("html").alias("path")).filter("path is not null")
    votes = stored(votes.groupBy("host", "path").agg(F.count("*").alias("n")), "votes")
    all_ = votes.groupBy("host").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    kept = votes.join(all_, "host").filter((F.col("n") == F.col("most")) | (F.col("n") >= share * F.col("all")))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))
    return kept.groupBy("host").agg(F.slice(F.transform(ranked, lambda x: x.path), 1, int(1 / share)).alias("paths"))


def main_texts(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text: one row per row of ``pages(page_id, url, html)``.

    Null and empty pages have empty text, a null URL belongs to a host of its own without name, repeated
    rows vote and are cut one by one. Pages of a host whose winners they lack are cut by their own best
    container, and pages without any container give all their text.
    """
    pages = pages.select("page_id", "url", "html")
    winners = stored(winning_paths(pages, share), "winners")
    size = winners.agg(F.coalesce(F.sum(F.length("host") + F.length(F.array_join("paths", ""))), F.lit(0))).first()[0]
    winners = winners.withColumnRenamed("host", "_host")
    if size <= BROADCAST_BYTES:
        winners = F.broadcast(winners)
    cut = pages.withColumn("_at", host("url")).join(winners, F.col("_at") == F.col("_host"), "left")
    return cut.select("page_id", "url", text_column("html", "paths").alias("text"))
