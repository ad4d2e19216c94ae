"""Main-text extraction from web pages by consensus container paths per host."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, checkpointed, small_enough, table

#: Winning paths of up to so many hosts are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 200_000
#: A path is furniture of a host if at least so many different pages have it, and at most half as many texts stand there.
REPEATED_PAGES = 3

# Element names of HTML by role, and name parts that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg textarea title head".split())
BLOCKS = frozenset(("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul").split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
SEMANTIC = frozenset("article main".split())
FURNITURE_TAGS = frozenset("nav footer aside form button select menu dialog".split())
#: Names that stand for furniture on containers outside article and main only; the others do so everywhere.
OUTER_NAMES = frozenset("banner footer header masthead notice notices replies reply respond toolbar widget".split())
FURNITURE_NAMES = OUTER_NAMES | frozenset(("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus "
                             "menu modal nav navbar navigation newsletter popup promo promoted promotion related "
                             "share sharing sidebar social sponsor sponsored subscribe").split())
#: Elements whose class may name furniture: never headings, paragraphs or inline text.
NAMED_TAGS = frozenset("div section aside td table ul ol dl center".split())
CLOSES_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
#: Elements whose start ends an open one of the same group, unless one of the walls stands between them.
CLOSING = (
    ({"p"}, CONTAINERS | {"li", "td", "th", "dd"}), ({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table"}),
    ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"}),
)
CLOSES = {tag: k for k, (members, _) in enumerate(CLOSING) if k for tag in members}
#: By element, the groups that its start changes, and whether as a member or as a wall.
EFFECT = {tag: [(k, tag in members) for k, (members, walls) in enumerate(CLOSING) if tag in members | walls]
          for tag in frozenset().union(*(members | walls for members, walls in CLOSING))}

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
#: Where a raw element ends, whatever stands in it. Other markup may end the last three, so that one without an end tag hides nothing.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
OPEN_ENDED = frozenset("object svg".split())
DIGITS, PARTS = re.compile(r"\d+"), re.compile(r"[^a-z]+")


@dataclass
class Page:
    """Elements in page order and the runs of text with the element that holds each; -1 marks a block edge.

    ``keys`` stand for the paths of generalised tags and classes: each is a hash of the parent's key and the element's own
    step, so paths of any depth cost the same.
    """

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    furniture: list[bool] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


class Open:
    """The open elements while a page is read, with all look-ups in constant time, however deep it nests."""

    def __init__(self, tags: list[str]) -> None:
        self.tags, self.stack = tags, []
        self.at: dict[str, list[int]] = {}
        #: For every open element, by group of elements that close each other: how deep the next open one lies, or -1.
        self.near: list[list[int]] = [[-1] * len(CLOSING)]

    def top(self) -> int:
        return self.stack[-1] if self.stack else -1

    def push(self, element: int) -> None:
        tag, depth = self.tags[element], len(self.stack)
        self.stack.append(element)
        self.at.setdefault(tag, []).append(depth)
        near = self.near[-1]
        if tag in EFFECT:
            near = near.copy()
            for group, member in EFFECT[tag]:
                near[group] = depth if member else -1
        self.near.append(near)

    def cut(self, depth: int) -> None:
        """Close the element at ``depth`` and all within it."""
        for element in self.stack[depth:]:
            self.at[self.tags[element]].pop()
        del self.stack[depth:], self.near[depth + 1:]

    def end(self, tag: str) -> None:
        depths = self.at.get(tag)
        if depths:
            self.cut(depths[-1])

    def close(self, group: int) -> None:
        if self.near[-1][group] >= 0:
            self.cut(self.near[-1][group])


def _attributes(rest: str) -> tuple[str, frozenset[str], bool]:
    """The generalised class names as a path suffix, the parts of classes that name nothing but furniture, and whether role
    or visibility mark furniture. Part of a name does not count (``entry-header``), nor does an id."""
    classes, named, marked = "", set(), False
    for name, a, b, c in NAMES.findall(rest):
        name, value = name.lower(), (a or b or c).lower()
        if name == "class":
            classes = "".join(f".{x}" for x in sorted({DIGITS.sub("#", x) for x in value.split()}))
            for word in value.split():
                parts = {part for part in PARTS.split(word) if part}
                if parts and parts <= FURNITURE_NAMES:
                    named |= parts
        elif name == "role":
            marked |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
        elif name != "id":
            marked |= name == "hidden" or value == "true"
    return classes, frozenset(named), marked


def parse(source: str) -> Page:
    """A forgiving single pass: unclosed paragraphs and list items end where HTML lets them end. Linear in the page."""
    page, at, endless, known = Page(), 0, set(), {}
    tags, runs = page.tags, page.runs
    opened = Open(tags)
    tokens = TOKEN.finditer(source)
    holder = lambda: opened.stack[-1] if opened.stack else -2
    while m := next(tokens, None):
        if m.start() > at:
            runs.append((holder(), source[at:m.start()]))
        at = m.end()
        if m["cdata"]:
            runs.append((holder(), m["cdata"].replace("&", "&amp;")))
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            runs.append((-1, " "))
        if m["end"] or m["end2"]:
            opened.end(tag)
            continue
        if tag in VOID:
            continue
        rest = m["rest"] or m["rest2"] or ""
        if tag in RAW and tag != "head":
            if tag not in endless and (not rest.endswith("/") or tag in ("script", "style")):
                end = RAW_END[tag].search(source, at)
                if end:
                    at = end.start()
                elif tag in OPEN_ENDED:
                    endless.add(tag)
                    continue
                else:
                    at = len(source)
                tokens = TOKEN.finditer(source, at)
            continue
        if tag in CLOSES_P:
            opened.close(0)
        if tag in CLOSES:
            opened.close(CLOSES[tag])
        parent = opened.top()
        classes, named, marked = _attributes(rest) if rest else ("", frozenset(), False)
        within_main = any(opened.at.get(t) for t in SEMANTIC)
        own = tag in FURNITURE_TAGS or tag == "head" or tag == "header" and not within_main or marked and tag not in ("html", "body", "main")
        own |= tag in NAMED_TAGS and not named <= (OUTER_NAMES if within_main else frozenset())
        tags.append(tag)
        page.parents.append(parent)
        step = page.keys[parent] if parent >= 0 else 0, tag + classes
        if step not in known:
            known[step] = path_key(*step)
        page.keys.append(known[step])
        page.furniture.append(own or parent >= 0 and page.furniture[parent])
        opened.push(len(tags) - 1)
    if at < len(source):
        runs.append((holder(), source[at:]))
    return page


def container_scores(page: Page) -> dict[int, float]:
    """Text outside links and furniture held by each container. An outer container gets half of what an inner
    one holds, an article or main element all of it and a tenth more. Sizes rise from children to parents once."""
    shared, whole = [0.0] * len(page.tags), [0.0] * len(page.tags)
    for node, text in page.runs:
        if node >= 0 and not page.furniture[node]:
            size = float(len(text.strip()))
            shared[node] += size
            whole[node] += size
    scores: dict[int, float] = {}
    for k in range(len(page.tags) - 1, -1, -1):
        tag, up = page.tags[k], page.parents[k]
        if not whole[k] or tag == "a":
            continue
        if tag in CONTAINERS:
            scores[k] = whole[k] * 1.1 if tag in SEMANTIC else shared[k]
            shared[k] /= 2
        if up >= 0:
            shared[up] += shared[k]
            whole[up] += whole[k]
    return scores


def nearest_containers(page: Page) -> list[tuple[int, bool]]:
    """For each element its nearest container (-1: none; itself, if it is one), and whether it lies in a link."""
    out: list[tuple[int, bool]] = []
    for k, (tag, parent) in enumerate(zip(page.tags, page.parents)):
        above, link = out[parent] if parent >= 0 else (-1, False)
        out.append((k if tag in CONTAINERS else above, link or tag == "a"))
    return out


def texts_of(page: Page, left: frozenset[int] = frozenset()) -> list[tuple[int, int, str]]:
    """``element, its nearest container (-1: none), text`` of each run of text outside links and furniture; separators are no
    text. Runs that stand directly in a container on a path of ``left`` are furniture too."""
    nearest, out = nearest_containers(page), []
    for node, text in page.runs:
        if node != -1 and not (node >= 0 and page.furniture[node]) and any(map(str.isalnum, text)):
            held, link = nearest[node] if node >= 0 else (-1, False)
            if not link and not (held >= 0 and page.keys[held] in left):
                out.append((node, held, text))
    return out


def likeliest(page: Page) -> tuple[int, float]:
    """The container with the highest score (ties: the first), which the page votes for; -1 without any text."""
    scores = container_scores(page)
    best = max(scores, key=lambda k: (scores[k], -k), default=-1)
    return best, scores.get(best, 0.0)


def main_container(page: Page, left: frozenset[int] = frozenset()) -> int:
    """The article or main element with the highest score. On pages without one the lowest container with all text outside
    links, furniture and the host's furniture paths ``left`` (-1: the whole page)."""
    best, _ = likeliest(page)
    if best < 0 or page.tags[best] in SEMANTIC:
        return best
    texts = texts_of(page, left)
    held = [0] * len(page.tags)
    for _, k, _ in texts:
        if k >= 0:
            held[k] += 1
    for k in range(len(held) - 1, -1, -1):
        if page.parents[k] >= 0:
            held[page.parents[k]] += held[k]
    # Those that hold all lie on one line of descent, and the lowest comes last in the page.
    return max((k for k, n in enumerate(held) if n == len(texts) and page.tags[k] in CONTAINERS), default=-1) if texts else best


def chosen_of(page: Page, best: int) -> set[int]:
    """The best container, and unless it is an article or main element all others with its path."""
    return {best} if best < 0 or page.tags[best] in SEMANTIC else {k for k, p in enumerate(page.keys) if p == page.keys[best]}


def within(page: Page, chosen: set[int]) -> list[bool]:
    """For each element whether it is, or lies in, a chosen one."""
    inside: list[bool] = []
    for k, parent in enumerate(page.parents):
        inside.append(k in chosen or parent >= 0 and inside[parent])
    return inside


def path_key(above: int, step: str) -> int:
    """Key of a path by the key of the path above it."""
    return int.from_bytes(hashlib.blake2b(step.encode("utf-8", "surrogatepass"), digest_size=8, key=above.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def beside(page: Page, best: int) -> Counter[tuple[int, int]]:
    """``path key, hash of the text`` of containers with text of their own that are neither the best one, nor on its path, nor in or
    around an article or main element: what may turn out to be furniture of the host."""
    inside = within(page, chosen_of(page, best) | {k for k, tag in enumerate(page.tags) if tag in SEMANTIC})
    texts: dict[int, list[str]] = {}
    for node, k, text in texts_of(page):
        if k >= 0 and not inside[node]:
            texts.setdefault(k, []).append(" ".join(text.split()))
    return Counter({(page.keys[k], path_key(0, " ".join(found))) for k, found in texts.items()})


def text_of(page: Page, chosen: set[int], left: frozenset[int] = frozenset()) -> str:
    """The text under the chosen elements (-1: of everything), without furniture and text directly on paths of ``left``, as blocks
    joined by one space."""
    inside, everything, nearest = within(page, chosen), -1 in chosen, nearest_containers(page)
    parts = []
    for k, text in page.runs:
        if k == -1:
            parts.append(" ")
        elif (everything or k >= 0 and inside[k]) and not (k >= 0 and (page.furniture[k] or nearest[k][0] >= 0 and page.keys[nearest[k][0]] in left)):
            parts.append(html.unescape(text))
    return " ".join("".join(parts).split())


def extract(source: str | None, path: int | None = None, left: frozenset[int] = frozenset()) -> tuple[str, bool]:
    """Main text of one page, and whether the host's path gave it.

    ``left`` are keys of the host's furniture paths; they do not count in an article or main element. The elements on ``path``
    (the host's winning one) give the text if they hold all of it that the page's own choice holds; else that one is returned.
    """
    if not source:
        return "", False
    page = parse(source)
    best = main_container(page, left)
    chosen = chosen_of(page, best)
    if best >= 0 and page.tags[best] in SEMANTIC:
        left = frozenset()
    on_path = {k for k, p in enumerate(page.keys) if p == path and not page.furniture[k]} if path is not None else set()
    if not on_path or on_path == chosen:
        return text_of(page, chosen, left), bool(on_path)
    mine, theirs = within(page, chosen), within(page, on_path)
    texts = [node for node, _, _ in texts_of(page, left) if -1 in chosen or node >= 0 and mine[node]]
    stands = bool(texts) and all(node >= 0 and theirs[node] for node in texts)
    return text_of(page, on_path if stands else chosen, left), stands


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, left, of``: the key of the container path with the most votes of each host (ties: smallest key), the
    keys of its furniture paths, and the number of its votes.

    Every page votes for the path of its best container with the square root of its score, so a few very long pages do not
    outvote the rest. A path beside these is furniture if ``REPEATED_PAGES`` different pages of the host have text there,
    and at most half as many different texts. Votes are combined map-side; a hot host is no group of rows.
    """

    names = ["host", "path", "beside", "text", "page", "vote"]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: Counter[tuple] = Counter()
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = parse(source) if source else Page()
                best, score = likeliest(page)
                if best >= 0:
                    votes[host, page.keys[best], False, 0, 0] += int(score ** 0.5) + 1
                    number = path_key(0, source)
                    for key, text in beside(page, best):
                        votes[host, key, True, text, number] = 1
            columns = list(zip(*((*k, n) for k, n in votes.items()))) or [()] * 6
            types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    votes = pages.select(host_of().alias("host"), "html").mapInArrow(vote, "host string, path long, beside boolean, text long, page long, vote long")
    counted = checkpointed(votes.groupBy("host", "path", "beside", "text", "page").agg(F.sum("vote").alias("votes")))
    top = (counted.filter("not beside").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
           .groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("least"), "path")).alias("top"))
           .select("host", "top.path", (-F.col("top.least")).alias("of")))
    texts = counted.filter("beside").groupBy("host", "path", "text").agg(F.count(F.lit(1)).alias("pages"))  # equal pages are one
    left = (texts.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("texts"))
            .filter((F.col("pages") >= REPEATED_PAGES) & (2 * F.col("texts") <= F.col("pages"))).groupBy("host").agg(F.collect_list("path").alias("left")))
    return top.join(left, "host", "left").select("host", "path", "left", "of")


def extract_pages(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``page_id, url, text, by_host`` per row of ``pages``.

    Containers of each page are scored, their generalised tag-class paths are put to the vote per host, and every page is
    extracted again: without the paths where the host's pages repeat themselves, from the elements on the winning path
    (``by_host``), or where these do not hold all text that is left from an article or main element, or the lowest container
    that holds all. Nothing else is dropped, however small. Null and empty
    pages give empty texts; pages without a valid url share one vote; repeated rows are extracted alike, ids may be
    null. Other columns are ignored, an empty table gives no rows. The paths of the ``broadcast_hosts`` hosts with the
    most votes are broadcast, so pages of a hot host stay where they are; only those of lesser hosts are shuffled.
    """
    winners = checkpointed(host_paths(pages))
    rows = pages.select("page_id", "url", "html", host_of().alias("host"))
    if small_enough(winners, broadcast_hosts):
        placed = rows.join(F.broadcast(winners), "host", "left")
    else:
        top = checkpointed(winners.orderBy(F.desc("of"), "host").limit(broadcast_hosts))
        hosts = F.broadcast(top.select("host"))
        placed = rows.join(F.broadcast(top), "host").unionByName(rows.join(hosts, "host", "left_anti").join(winners.join(hosts, "host", "left_anti"), "host", "left"))

    def run(sources: list[str | None], paths: list[int | None], left: list[list[int] | None]) -> tuple[list, list]:
        found = [extract(h, p, frozenset(x or ())) for h, p, x in zip(sources, paths, left)]
        return [t for t, _ in found], [by for _, by in found]

    return add_columns(placed, ["html", "path", "left"], run, "text string, by_host boolean", keep=["page_id", "url"])


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
