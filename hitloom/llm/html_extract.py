"""Main text of web pages by consensus host paths.

Each page's containers are scored by their running text against link text and
boilerplate below them, and the page votes for the tag-class path of its best
container (digits and ">" in names generalised). Votes are counted per host by Spark, and every
page is extracted again from the elements on its host's winning path; a page
that has none, or no text there, falls back to its own best container.

A name (class, id or role) that says what is beside the article marks an
element. Names that end in such a word count unless the page's article is in
the element; where the word only qualifies another ("share-price"), stands
beside a name of an article or is one of those that are common inside articles
("story links"), the element goes only if half of it is links and form fields.
Inside an article or main element every name but ``FIRM`` and ``OTHERS`` is
judged by content: the element stays if it holds running text and less than
half of it is links and form fields.

Two scans of the pages; between them only (host, path) votes are shuffled,
summed in the task first, so a host with a third of all pages is no hot task.
Winning paths are one row per host: broadcast below a counted bound, else
joined by shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm.common import map_rows, read
from hitloom.runtime import Scratch

BROADCAST_HOSTS = 200_000

# Element names of HTML by their role, and names that sites give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody tfoot thead tr caption ul xmp".split()
)
CLOSES_ITSELF = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select datalist"}
NOT_ARTICLE = frozenset("nav footer aside button select dialog menu fieldset head".split())
FIELDS = frozenset("input select textarea button".split())
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar banner footer sidebar rail aside widget ad ads advert adverts"
    " advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter"
    " subscribe subscription signup login search share sharing social related recommended comment comments reply replies respond disqus"
    " pagination pager toolbar copyright alert links".split()
)
#: Names of what may hold article elements or long texts of its own beside the page's article.
OTHERS = frozenset("recommended related comment comments reply replies respond disqus".split())
#: Names that are believed inside an article too, as nothing in the text of such an element tells it from the article.
FIRM = frozenset("header footer sidebar rail aside ad ads advert adverts advertisement advertising sponsored promo cookie cookies consent gdpr notice notices newsletter".split())
#: Names that are as common inside articles as beside them.
EITHER = frozenset("links search share sharing social alert subscription promotion".split())
#: Last parts of names that say no more than that something is a container, and first parts that say that something is not there.
NEUTRAL = frozenset("container wrapper wrap inner outer list area box block section bar bars slot item items unit group row col column button buttons icons panel zone holder top bottom left right".split())
NEGATIVE = frozenset("no not without hide has with".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GOOD_NAMES = frozenset("article content post entry story main text body".split())
WORTH = {"article": 1.3, "main": 1.15}
#: Letters of running text that one form field outweighs.
FIELD_TEXT = 40
#: Letters outside links that running text has at least, with the end of a sentence among them.
RUNNING = 25

TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+|>+")
SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f]")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


WEAK, LOOSE, NAMED, OTHER = 1, 2, 3, 4


def _off_topic(name: str, beside_good: bool = False) -> int:
    """Whether a class, id or role names something beside the article.

    0 no, ``WEAK`` to be judged by what the element holds, ``LOOSE`` the same
    inside an article and yes elsewhere, ``NAMED`` yes, ``OTHER`` yes and of
    ``OTHERS``; the header of an article is its own.
    """
    parts = [p.lower() for p in NAME_PART.findall(name)]
    good = beside_good or not GOOD_NAMES.isdisjoint(parts)
    found = {p for p in parts if p in NAMES and not (good and p == "header")}
    if not found:
        return 0
    while len(parts) > 1 and parts[-1] in NEUTRAL:
        parts.pop()
    last = parts[-1]
    if last not in found or NEGATIVE & set(parts) or last in EITHER and (good or len(parts) > 1 and found == {last}):
        return WEAK
    return OTHER if found & OTHERS else NAMED if found & FIRM else LOOSE


class Page:
    """Elements in page order with their parents, and pieces of text with their element and block."""

    def __init__(self, source: str | None):
        self.tag, self.label, self.parent, self.bad = ["document"], ["document"], [-1], [False]
        self.named, self.fields = [0], [0]
        self.place, self.places = [0], {}  # the path of each element as a number, and numbers by (number of the parent's path, label)
        self.pieces: list[tuple[int, int, str]] = []
        self.stack, self.open, self.block = [0], Counter(), 0
        self._parse(source or "")
        if any(self.named):
            if WEAK in self.named or LOOSE in self.named:
                self._judge_weak()
            self._clear_wrappers()
            for i in range(1, len(self.tag)):
                self.bad[i] = self.bad[i] or self.named[i] > 0 or self.bad[self.parent[i]]

    def _parse(self, s: str) -> None:
        at, quotes_close = 0, True
        while m := TAG.search(s, at):
            self._text(s[at : m.start()])
            if m[1]:
                end = s.find("-->", m.end())
                at = len(s) if end < 0 else end + 3
                continue
            rest = REST.match(s, m.end()) if quotes_close else None
            if rest is None:  # a quotation mark that never closes: tags end at the next sign
                quotes_close = False
                end = s.find(">", m.end())
                at = len(s) if end < 0 else end + 1
            else:
                at = rest.end()
            if m[2]:
                continue
            name = m[4].lower()
            if m[3]:
                self._end(name)
            else:
                inside = s[m.end() : at - 1]
                self._start(name, inside)
                if name in RAW and not inside.endswith("/"):
                    close = re.compile(f"</{re.escape(name)}(?=[\\s/>]|$)", re.I).search(s, at)
                    at = len(s) if close is None else close.start()
        self._text(s[at:])

    def _text(self, raw: str) -> None:
        if raw:
            self.pieces.append((self.stack[-1], self.block, html.unescape(raw) if "&" in raw else raw))

    def _start(self, name: str, inside: str) -> None:
        if name == "br" or name in ("td", "th"):
            self.pieces.append((self.stack[-1], self.block, " "))
        if name in BLOCK:
            self.block += 1
            if self.open["p"]:
                self._close("p", False)
        if name in FIELDS:
            self.fields[self.stack[-1]] += 1
        if name in CLOSES_ITSELF and self.open[name]:
            self._close(name, True, frozenset(CLOSES_ITSELF[name].split()))
        if name in VOID:
            return
        label, bad, named = self._judge(name, inside)
        self.tag.append(name)
        self.label.append(label)
        self.parent.append(self.stack[-1])
        self.bad.append(bad or self.bad[self.stack[-1]])
        self.named.append(named)
        self.fields.append(0)
        self.place.append(self.places.setdefault((self.place[self.stack[-1]], label), len(self.places) + 1))
        if not inside.endswith("/") or name not in RAW:
            self.stack.append(len(self.tag) - 1)
            self.open[name] += 1

    def _judge(self, name: str, inside: str) -> tuple[str, bool, int]:
        label, named, bad = name, NAMED if name == "form" else 0, name in NOT_ARTICLE or name in RAW or name == "header" and not (self.open["article"] or self.open["main"])
        if inside.strip("/ \t\r\n"):
            for key, value in ATTRIBUTE.findall(inside):
                key, value = key.lower(), html.unescape(value.strip("\"'"))
                if key in ("class", "id", "role"):
                    if name not in ("html", "body"):
                        tokens = value.split()
                        good = len(tokens) > 1 and any(p.lower() in GOOD_NAMES for t in tokens for p in NAME_PART.findall(t))
                        named = max(named, *(_off_topic(t, good) for t in tokens), 0)
                    if key == "class":
                        label = ".".join([name, *sorted({DIGITS.sub("#", v) for v in value.split()})])
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
                    bad = True
        if named == LOOSE and not (self.open["article"] or self.open["main"]):
            named = NAMED
        return label, bad, named

    def _judge_weak(self) -> None:
        """Keep the marks to be judged of elements of which at least half is links and form fields, as if their names were plain, and loose ones of those without running text; drop the others."""
        n = len(self.tag)
        linked, total, links, fields, ends = [False] * n, [0] * n, [0] * n, list(self.fields), [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
        for node, _, piece in self.pieces:
            if self.tag[node] not in RAW:
                size = len(piece) - piece.count(" ") - piece.count("\n")
                total[node] += size
                links[node] += size * linked[node]
                ends[node] = ends[node] or not linked[node] and SENTENCE.search(piece) is not None
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            total[up] += total[i]
            links[up] += links[i]
            fields[up] += fields[i]
            ends[up] = ends[up] or ends[i]
            if self.named[i] in (WEAK, LOOSE):
                goes = 2 * (links[i] + FIELD_TEXT * fields[i]) >= total[i] or self.named[i] == LOOSE and (total[i] - links[i] < RUNNING or not ends[i])
                self.named[i] = NAMED if goes else 0

    def _clear_wrappers(self) -> None:
        """Take the mark of its name from each element that holds the page's article.

        That is one with a main element, with articles that are no teasers beside
        the unmarked text, or with most of the page's running text, unless a
        container of unmarked content says that the article is there. Elements
        are judged by size, those inside a marked one once that is cleared.
        """
        n = len(self.tag)
        skip, content, article = [False] * n, [False] * n, [False] * n
        mark, has_main = [0] * n, [False] * n  # mark: the innermost marked element around
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            skip[i] = skip[up] or self.bad[i] or tag == "a" or tag in HEADINGS
            article[i] = article[up] or tag in WORTH
            content[i] = content[up] or tag in WORTH or self._good_name(i)
            mark[i] = i if self.named[i] else mark[up]
            has_main[i] = tag == "main" and not self.bad[i]
        text, articles, own, own_content, own_article = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for node, _, piece in self.pieces:
            size = len(piece) - piece.count(" ") - piece.count("\n")
            if not self.bad[node]:
                own_article[mark[node]] += size * article[node]
            if not skip[node]:
                text[node] += size
                articles[node] += size * article[node]
                own[mark[node]] += size
                own_content[mark[node]] += size * content[node]
        inner: dict[int, list[int]] = {}
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            text[up] += text[i]
            articles[up] += articles[i]
            has_main[up] = has_main[up] or has_main[i]
            if self.named[i]:
                inner.setdefault(mark[up], []).append(i)
        clean, clean_content, clean_article = own[0], own_content[0], own_article[0]
        queue = [(-text[i], i) for i in inner.get(0, ())]
        heapify(queue)
        while queue:
            size, i = heappop(queue)
            other = self.named[i] == OTHER
            elsewhere = clean_content > 0 if other else -size < 4 * clean_content or clean_article > 0 and not article[self.parent[i]]
            wraps = has_main[i] or not other and 4 * articles[i] > clean and articles[i] > 4 * clean_content or -2 * size > text[0] and not elsewhere
            if size and wraps:
                self.named[i] = 0
                clean += own[i]
                clean_content += own_content[i]
                clean_article += own_article[i]
                for j in inner.get(i, ()):
                    heappush(queue, (-text[j], j))

    def _good_name(self, node: int) -> bool:
        return any(p.lower() in GOOD_NAMES for p in NAME_PART.findall(self.label[node].partition(".")[2]))

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self.block += 1
        if self.open[name]:
            self._close(name, name in BLOCK or name in ("td", "th"))

    def _close(self, name: str, through_blocks: bool, until: frozenset = frozenset()) -> None:
        """Close the innermost open ``name`` if no block (unless ``through_blocks``) stands above it, and none of ``until``."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag == name:
                for node in self.stack[depth:]:
                    self.open[self.tag[node]] -= 1
                del self.stack[depth:]
                return
            if tag in until or not through_blocks and tag in BLOCK:
                return

    def path(self, node: int) -> str:
        labels = []
        while node > 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return ">".join(reversed(labels)) or "document"

    def on_path(self, path: str) -> set[int]:
        """Elements on ``path`` that are not boilerplate."""
        place = 0
        for label in path.split(">"):
            place = self.places.get((place, label))
            if place is None:
                break
        found = set() if place is None else {i for i, p in enumerate(self.place) if p == place and not self.bad[i]}
        return found | {0} if path == "document" else found

    def best(self) -> tuple[int, float]:
        """The container of the highest score, the innermost at ties, and its running text's length."""
        n = len(self.tag)
        good, other, linked = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
        for node, _, text in self.pieces:
            size = len(text) - text.count(" ") - text.count("\n")
            (other if self.bad[node] or linked[node] else good)[node] += size
        for i in range(n - 1, 0, -1):
            good[self.parent[i]] += good[i]
            other[self.parent[i]] += other[i]
        first, top = 0, good[0] - 2.0 * other[0]
        for i in range(1, n):
            if good[i] and not self.bad[i] and (self.tag[i] in BLOCK or "-" in self.tag[i]) and self.tag[i] not in ("p", "li", "ul", "ol", "html", "blockquote"):
                worth = WORTH.get(self.tag[i], 1.0) * (1.15 if self._good_name(i) else 1.0)
                if good[i] * worth - 2.0 * other[i] >= top:
                    first, top = i, good[i] * worth - 2.0 * other[i]
        return first, good[first]

    def text(self, containers: set[int]) -> str:
        """Blocks of the elements below ``containers`` that are not boilerplate."""
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            inside[i] = not self.bad[i] and (i in containers or i > 0 and inside[self.parent[i]])
        blocks: dict[int, list[str]] = {}
        for node, block, text in self.pieces:
            if inside[node]:
                blocks.setdefault(block, []).append(text)
        lines = (SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
        return "\n".join(x for x in lines if x)


def vote(source: str | None) -> tuple[str, int]:
    """Path of a page's best container and the length of its running text."""
    page = Page(source)
    node, size = page.best()
    return page.path(node), int(size)


def extract(source: str | None, path: str | None) -> str:
    """Text of the elements on ``path``, or of the page's own best container."""
    page = Page(source)
    on_path = page.on_path(path or "")
    return (page.text(on_path) if on_path else "") or page.text({page.best()[0]})


def host(url: str = "url") -> Column:
    """Host of a URL in lower case without a leading ``www.``; empty if there is none."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"^www\.", "")


def winning_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """Rows (host, path): the path with the most votes, then the most text, then the smallest name."""

    def make():
        def run(c):
            found = [vote(s) for s in c[1]]
            return [c[0], [p for p, _ in found], [n for _, n in found]]

        return run

    votes = map_rows(pages.select(host(url).alias("host"), source), make, "host string, path string, size bigint").where("size > 0")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return counted.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("size")).alias("size"), "path")).alias("w")).select("host", "w.path")


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row for each row of ``pages``: key, url, text, n_chars.

    A null page counts as empty, a null or odd URL belongs to the host without
    a name. Broken markup is read as browsers do in the common cases (open
    paragraphs, list items and cells close themselves, stray end tags are
    ignored); a page without elements is text as it stands. Repeated rows stay;
    other columns are not read. An empty table gives an empty result.
    """
    paths = Scratch(pages.sparkSession, "html").table(winning_paths(pages, url, source), "paths")
    few = paths.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(source).alias("s"), host(url).alias("host"))
    rows = rows.join(F.broadcast(paths) if few else paths, "host", "left").select("k", "u", "s", "path")

    def make():
        def run(c):
            texts = [extract(s, p) for s, p in zip(c[2], c[3], strict=True)]
            return [c[0], c[1], texts, list(map(len, texts))]

        return run

    return map_rows(rows, make, f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` string, text string, n_chars bigint")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
