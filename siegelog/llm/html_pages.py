"""Main text of web pages by the consensus of each host.

Pass 1 parses every page, scores its containers and lets it vote for the
generalised tag-class path of its best one. Spark adds up the votes by host; a path
with at least ``SHARE`` of a host's votes wins (so a host has 1 / ``SHARE`` of them at
most). Pass 2 parses the pages again next to their host's winners and extracts the
containers on the winning path that fits the page best: the page's own score, weighted
by the share of votes.

The join of pages with the winners of their host is an ordinary left join: Spark
broadcasts the winners while they are few, and splits hot hosts beyond that.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siegelog.llm.storage import ship, stored
from siegelog.llm.url_lists import host_of

# A path wins on a host from this part of its votes on.
SHARE = 0.05
# What a container keeps of the scores of containers inside it.
DECAY = 0.75
# Characters of a path that is kept as text.
LONGEST_PATH = 500
# Pages that are parsed before their rows are handed over.
ROWS = 256

#: Fixed values of HTML: elements without an end, with text that is not markup, and those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp
    small span strike strong sub sup time tt u var wbr img button input select option meter output progress""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Blocks that hold text and are no containers.
LEAVES = HEADINGS | frozenset("p li ul ol dl dt dd pre blockquote figure figcaption table tbody thead tfoot tr caption address hgroup center".split())
# Start tags that end an open element, up to the given boundary.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CELLS = frozenset("td th caption table button".split())

# What is never part of an article: elements, roles, and words of classes and ids.
DROP = frozenset(
    """head script style title noscript noembed noframes template iframe object embed applet svg canvas audio video map nav
    aside footer form button select option input textarea label fieldset datalist dialog menu""".split()
)
DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar status toolbar tooltip".split()
)
DROP_WORDS = frozenset(
    """ad ads adsbygoogle adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion
    banner banners nav navbar navi navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer footers masthead
    comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices notification notifications
    alert popup modal overlay newsletter subscribe subscription signup paywall social share sharing shares related recommended
    recommendations pagination pager widget widgets toolbar login search skip outbrain taboola""".split()
)
# Words of classes that only speak of another part of the page.
ABOUT = frozenset("has no with without hide show is not".split())
# First words of classes that list what an article is about.
LISTED = frozenset("category tag type format status".split())
GOOD_WORDS = frozenset("article articlebody body content entry main page post story text".split())
PRIOR = {"article": 2.0, "main": 1.8, "": 0.6, "td": 0.9, "th": 0.5}

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|</(?![a-zA-Z])[^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


def _words(name: str) -> list[str]:
    return _WORD.findall(_CAMEL.sub("-", name).lower())


def _marked(words: list[str]) -> bool:
    """Whether a name has a word of ``DROP_WORDS``, and none before it that only speaks of another part."""
    if words and words[0] in LISTED:
        return False
    for word in words:
        if word in ABOUT or word in DROP_WORDS:
            return word in DROP_WORDS
    return False


def _step(tag: str, classes: list[str]) -> str:
    """A step of a path: tag and classes without numbers, in order."""
    general = sorted({_DIGITS.sub("#", c) for c in classes})
    return ".".join([tag, *general])


def _below(path: str, step: str) -> str:
    """The path one step further; a very long one is a digest, so deep pages take no more room."""
    longer = f"{path}>{step}"
    return longer if len(longer) <= LONGEST_PATH else "~" + hashlib.md5(longer.encode("utf-8", "replace")).hexdigest()


class Page:
    """Containers of a page with their paths and scores, and its blocks of text in page order.

    A container is a block element that may hold an article; the page itself is the
    first one. Elements that are never part of an article are left out as a whole; of a
    header inside an article the headings stay.
    """

    def __init__(self, source: str) -> None:
        self.paths, self.parents, self.priors = [""], [-1], [PRIOR[""]]
        self.own = [0.0]  # characters of text outside links, by container
        self.last = [0]  # number of blocks when the container ended
        self.first = [0]
        self.blocks: list[str] = []
        self._parse(source)
        self.last = [len(self.blocks) if x is None else x for x in self.last]
        self.scores = [0.0] * len(self.paths)
        inside = list(self.own)
        for k in range(len(inside) - 1, -1, -1):
            self.scores[k] = self.priors[k] * inside[k]
            if k:
                inside[self.parents[k]] += DECAY * inside[k]

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool, int]] = []  # tag, container, drops all below, links around
        held: list[str] = []  # text of the current block
        plain = 0  # its characters outside links
        opened: Counter[str] = Counter()  # open elements
        container, dropped, links, headings, header = 0, 0, 0, 0, 0

        def flush() -> None:
            nonlocal plain
            if held:
                body = " ".join("".join(held).split())
                held.clear()
                if body:
                    self.blocks.append(body)
                    self.own[container] += min(plain, len(body))
                plain = 0

        def text(piece: str) -> None:
            nonlocal plain
            if piece and not dropped and (not header or headings):
                piece = html.unescape(piece) if "&" in piece else piece
                held.append(piece)
                if not links:
                    plain += len(piece)

        def pop() -> None:
            nonlocal container, dropped, links, headings, header
            tag, was, drops, kind = stack.pop()
            opened[tag] -= 1
            if tag not in INLINE:
                flush()
            if drops:
                dropped -= 1
            if kind == 1:
                links -= 1
            elif kind == 2:
                headings -= 1
            elif kind == 3:
                header -= 1
            if was != container:
                self.last[container] = len(self.blocks)
                container = was

        def close(tags, until=frozenset()) -> None:
            """End the nearest of ``tags`` and all in it, unless a boundary comes first."""
            if not any(opened[x] for x in tags):
                return
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    while len(stack) > k:
                        pop()
                    return
                if stack[k][0] in until:
                    return

        at, size = 0, len(source)
        while at < size:
            found = _TOKEN.search(source, at)
            text(source[at : found.start() if found else size])
            if not found:
                break
            at = found.end()
            ended, tag, attributes = found[1], found[2], found[3]
            if ended:
                ended = ended.lower()
                if ended in INLINE and opened[ended]:
                    k = len(stack) - 1
                    while k >= 0 and stack[k][0] in INLINE and stack[k][0] != ended:
                        k -= 1
                    if k >= 0 and stack[k][0] == ended:
                        while len(stack) > k:
                            pop()
                elif ended == "br":
                    held.append("\n")
                elif ended in HEADINGS:
                    close(HEADINGS)
                elif ended not in INLINE and ended not in ("body", "html"):
                    close({ended})
                continue
            if not tag:
                continue
            tag = tag.lower()
            if tag in ("html", "body"):
                if tag == "body":
                    close({"head"})
                continue
            if tag in VOID:
                if tag == "hr":
                    close({"p"}, CELLS)
                    flush()
                elif tag == "br":
                    held.append("\n")
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
                continue
            inline = tag in INLINE
            if not inline:
                if stack and stack[-1][0] == "head" and tag != "noscript" and tag != "template":
                    pop()
                close({"p"}, CELLS)
                if tag in ENDS:
                    close(*ENDS[tag])
                flush()
            drops, kind, was = False, 0, container
            if tag == "a":
                close({"a"}, CELLS)
                links, kind = links + 1, 1
            elif tag in HEADINGS:
                headings, kind = headings + 1, 2
            if dropped:
                pass
            elif tag in DROP:
                drops = True
            else:
                classes, marks, role = [], [], ""
                if attributes and "=" in attributes:
                    for name, *values in _ATTRIBUTE.findall(attributes):
                        name, value = name.lower(), next((v for v in values if v), "")
                        if name == "class":
                            classes = html.unescape(value).split()
                            marks += [_words(c) for c in classes]
                        elif name == "id":
                            marks.append(_words(value))
                        elif name == "role":
                            role = value.strip().lower()
                if role in DROP_ROLES or (tag != "main" and any(_marked(m) for m in marks)):
                    drops = True
                elif tag == "header" or any("header" in m and ABOUT.isdisjoint(m) for m in marks):
                    if self.priors[container] < 1.5:
                        drops = True
                    elif not kind:
                        header, kind = header + 1, 3
                elif not inline and tag not in LEAVES:
                    good = role in ("main", "article") or any(not GOOD_WORDS.isdisjoint(m) for m in marks)
                    prior = PRIOR.get(tag, 1.5 if good else 1.0)
                    above = self.paths[container]
                    container = len(self.paths)
                    self.paths.append(_below(above, _step(tag, classes)))
                    self.parents.append(was)
                    self.priors.append(prior)
                    self.own.append(0.0)
                    self.first.append(len(self.blocks))
                    self.last.append(None)
            dropped += drops
            stack.append((tag, was, drops, kind))
            opened[tag] += 1
        while stack:
            pop()
        flush()
        self.last[0] = len(self.blocks)

    def by_path(self) -> dict[str, float]:
        """Scores of containers added up by path, without those of no score."""
        out: dict[str, float] = {}
        for path, score in zip(self.paths, self.scores, strict=True):
            if score > 0:
                out[path] = out.get(path, 0.0) + score
        return out

    def text_of(self, path: str) -> str:
        """All blocks of the containers on a path, in page order."""
        taken = [0] * (len(self.blocks) + 1)
        for own, a, b in zip(self.paths, self.first, self.last, strict=True):
            if own == path:
                taken[a] += 1
                taken[b] -= 1
        return " ".join(x for x, n in zip(self.blocks, accumulate(taken), strict=False) if n)


def best(scores: dict[str, float], shares: dict[str, float] | None = None) -> str | None:
    """The path with the highest score; with shares, the winners' one, if the page has any."""
    if shares:
        scores = {p: s * shares[p] for p, s in scores.items() if p in shares} or scores
    return min(scores, key=lambda p: (-scores[p], p), default=None)


def _sources(batches) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS), [x.as_py() or "" for x in batch.column("html").slice(k, ROWS)]


def _votes(batches) -> Iterator[pa.RecordBatch]:
    for batch, sources in _sources(batches):
        paths = pa.array([best(Page(x).by_path()) for x in sources], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("host"), paths], ["host", "path"])


def _texts(batches) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "text", "path"]
    for batch, sources in _sources(batches):
        texts, paths = [], []
        for source, winners in zip(sources, batch.column("winners").to_pylist(), strict=True):
            page = Page(source)
            path = best(page.by_path(), {w["path"]: w["share"] for w in winners or []})
            texts.append("" if path is None else page.text_of(path))
            paths.append(path)
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(paths, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names)


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.nullif(host_of(F.col("url")), F.lit("")).alias("host")
    )


def winning_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``host``, ``winners``: (path, share of votes) of each host's winners.

    Each page with a host and with text in any container has one vote.
    """
    ship(pages.sparkSession)
    votes = _with_host(pages).select("host", "html").filter("host is not null").mapInArrow(_votes, "host string, path string")
    votes = stored(votes.filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("n")), "path-votes")
    totals = votes.groupBy("host").agg(F.sum("n").alias("all"))
    won = votes.join(totals, "host").withColumn("share", F.col("n") / F.col("all")).filter(F.col("share") >= share)
    won = won.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "share"))).alias("winners"))
    # stored, so that the planner knows its size before it decides whether pages have to move
    return stored(won, "winning-paths")


def main_texts(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` and ``path`` (where the text was found) of every page.

    Blocks of the main text follow one another in page order with one blank between
    them; white space inside a block is one blank, character references are decoded.
    A null or empty page, and one whose text is all links, menus, forms and the like,
    has an empty text and no path. A page without host, or none of whose containers is
    on a winning path, is extracted by its own best container. Rows that share an id are
    pages of their own; other columns are left out; an empty table gives no row.
    """
    winners = winning_paths(pages, share)
    rows = _with_host(pages).join(winners, "host", "left").select("page_id", "url", "html", "winners")
    texts = rows.mapInArrow(_texts, "page_id long, url string, text string, path string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
