"""Main text of web pages by consensus of a host's pages on where it stands.

1. Every page's containers are scored: a block of text counts for the elements around it, less so the farther out,
   without the part that is links.
2. A container is named by its generalised path: tags and classes from the root, digits folded. Each page gives its
   shares of the score to its paths as votes, and Spark sums them per host; partial sums fold before the shuffle, so
   a host of any size is a few rows of each task.
3. The winner is widened to the article or main element around it.
4. Each page is extracted again from its host's path, and from its own best container where that path holds little. All
   that stands there is text, and so is everything else that is kept, but for blocks outside that are mostly links, or that
   the host's pages repeat: on ``REPEATED`` of them and in ``REPEATED_SHARE`` of them at least, of pages whose texts differ.
   So a heading, a lead or half of the article in another container isn't lost.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag
and by a whole class or id (or one of a few prefixes). Names that may also be a part of an article, like ``alert``, only
count outside of article and main elements; inside, such an element goes if it is mostly links, and its blocks if the
host's pages repeat them. A header inside an article stays if it has the page's first heading. What is left out by class or
id, and a form, stays if it holds most of the page's text and has a first heading, an article or a main element, or nothing else on
the page has one (reader comments only in the first case, and articles in them are no sign). Character references are
decoded, white space inside a block is one space, blocks are joined by two line ends.

Defined cases: null or empty html, or a page without any text outside such parts, has the empty text; an unclosed
element ends with its parent, and head, svg, math and select at the first block element in them; unclosed scripts,
styles, text areas and comments run to the end; of other unclosed raw text only the tag is skipped; pages without a url vote as one host;
repeated rows vote each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import same, written

_PIECE = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9-]*)|<[!?/][^>]*>|[^<]+|<")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ANY_REST = re.compile(r"([^>]*)>")
#: Skipped as raw text up to their end tags; without one, the first three run to the end, the others are skipped alone.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "object", "noscript", "template")}
_TO_END = frozenset(("script", "style", "textarea"))
#: Skipped up to their end tags or the first block element in them.
_SKIP = frozenset("head svg math select".split())
#: Tags that are read with their quotes until so many quotes were left open; then up to the next '>'.
OPEN_QUOTES = 16
_NAME = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_OUT_TAG = frozenset("nav header footer aside form button menu dialog fieldset label".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_COMMENT_NAME = re.compile(r"comments?|comment-?(?:list|form|area|section)|comments-?(?:list|area|section)|respond|disqus(?:[_-].*)?", re.I)
#: Whole classes and ids, of parts that are never an article's.
_OUT_NAME = re.compile(
    r"(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|paywall"
    r"|sidebar|nav|navbar|navigation|breadcrumbs?|pagination|pager|masthead|topbar|footer|toolbar|skip-link|search-form|sr-only|(?:site|page|main|top|global)[_-](?:header|footer|nav|navigation|menu|sidebar)"
    r"|(?:ads?|advert|cookie|gdpr|newsletter|breadcrumbs?|sponsored|pagination)[_-].*)",
    re.I,
)
#: Whole classes and ids, of parts that may be an article's if they stand in one.
_MAY_OUT_NAME = re.compile(
    r"banner|notices?|alert|overlay|replies|discussion|side|aside|widget|widget-area|related|recommended|more-?stories|share|sharing|social|menu|tags|tagcloud|header|copyright|skip|search|hidden"
    r"|(?:share|sharing|social|related|recommended|tag|tags)[_-](?:bar|block|box|buttons?|container|icons?|items?|links?|list|media|menu|nav|panel|posts?|articles?|stories|section|widget|wrap(?:per)?)",
    re.I,
)
_OUT_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")
#: Share of a block's score that the next element out gets.
FADE = 0.5
#: A page's own container is used too where the host's path holds less than this share of its text.
LITTLE = 0.5
#: Pages of a host that must have a block in common for it to be none of the article, and their share of its pages in percent.
REPEATED, REPEATED_SHARE = 3, 10

#: (text, generalised path of its container, characters of links, whether a name leaves its place in doubt)
Block = tuple[str, tuple[str, ...], int, bool]


def tokens(html: str) -> Iterator[tuple[str | None, bool, str]]:
    """(tag or None, whether it is an end tag, attributes or text), in one pass; raw text and comments are skipped."""
    at, open_quotes, last = 0, 0, html.rfind(">")
    unclosed: set[str] = set()
    while m := _PIECE.match(html, at):
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                found = html.find("-->", at)
                at = len(html) if found < 0 else found + 3
            elif m[0][0] != "<" or len(m[0]) == 1:
                yield None, False, m[0]
            continue
        rest = None
        if at <= last:
            rest = _REST.match(html, at) if open_quotes < OPEN_QUOTES else None
            if rest is None:
                open_quotes += 1
                rest = _ANY_REST.match(html, at)
        if rest is None:
            yield None, False, "<"
            at = m.start() + 1
            continue
        tag, end, at = m[2].lower(), bool(m[1]), rest.end()
        if tag in _RAW and not end:
            found = None if tag in unclosed else _RAW[tag].search(html, at)
            if found:
                at = found.end()
            elif tag in _TO_END:
                return
            else:
                unclosed.add(tag)
            continue
        if tag not in _RAW:
            yield tag, end, rest[1]


#: What leaves out an element and its children for good: a part like a menu, or one that is no text at all.
_OUT, _NO_TEXT = -1, -2


#: Elements that are left out by name, or stay after all: by their names alone, if they are mostly links, or without the first heading.
_NAMED, _MAYBE, _HEADER = 0, 1, 2


def blocks(html: str) -> list[Block]:
    """The text blocks, left-out parts skipped."""
    found: list[tuple[str, tuple[str, ...], int, tuple[int, ...]]] = []
    stack: list[tuple[str, str, tuple[int, ...]]] = []  # tag, generalised name, elements that leave it out by name
    named: list[list] = []  # of each such element: is it of comments, does it have a sign of the main text, its kind
    heading = False
    text: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        if text:
            own = _SPACE.sub(" ", unescape("".join(text))).strip()
            outs = stack[-1][2] if stack else ()
            if own and not (outs and outs[-1] < 0):
                path = [n for t, n, _ in stack if t in _BLOCK]
                last = next((t for t, _, _ in reversed(stack) if t in _BLOCK), "")
                if path and last in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt", "pre", "summary", "figcaption"):
                    path.pop()
                found.append((own, tuple(path), links, outs))
            text.clear()
        links = 0

    def close(i: int) -> None:
        del stack[i:]

    main_outside = False
    for tag, end, rest in tokens(html):
        if tag is None:
            if stack and stack[-1][2] and stack[-1][2][-1] == _NO_TEXT:
                continue
            text.append(rest)
            if any(t == "a" for t, _, _ in stack[-4:]):
                links += len(rest)
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag not in _BLOCK and stack[i][0] in _BLOCK:
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCK:
            if stack and stack[-1][2] and stack[-1][2][-1] == _NO_TEXT:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "foreignobject" or stack[i][2][-1:] != (_NO_TEXT,):
                        break
                    if stack[i][0] in _SKIP:
                        close(i)
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        if tag in _CLOSES_SELF:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in _CLOSES_SELF[tag]:
                    break
        name, outs = tag, stack[-1][2] if stack else ()
        if not (outs and outs[-1] < 0):
            by_name, kind_of = tag == "form", _NAMED
            within = False
            if tag == "header" and (within := any(t in ("article", "main") for t, _, _ in stack)):
                by_name, kind_of = True, _HEADER
            gone = _NO_TEXT if tag in _SKIP else _OUT if tag in _OUT_TAG and not by_name else 0
            comments = False
            if rest and not rest.isspace():
                for a in _NAME.finditer(rest):
                    kind, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if kind == "class":
                        name = ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in value.split()})])
                    if kind in ("class", "id") and tag not in ("html", "body"):
                        comments = comments or any(_COMMENT_NAME.fullmatch(c) for c in value.split())
                        if comments or any(_OUT_NAME.fullmatch(c) for c in value.split()):
                            by_name, kind_of = True, _NAMED
                        elif not by_name and any(_MAY_OUT_NAME.fullmatch(c) for c in value.split()):
                            within = tag in ("article", "main") or any(t in ("article", "main") for t, _, _ in stack)
                            by_name, kind_of = True, _MAYBE if within else _NAMED
                    elif kind == "role" and value.lower() in _OUT_ROLE or kind == "hidden" or kind == "aria-hidden" and value.lower() == "true" or kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
                        gone = gone or _OUT
            if by_name and not gone:
                named.append([comments, tag in ("article", "main"), kind_of])
                outs = (*outs, len(named) - 1)
            if tag in _HEADINGS and not heading and not gone:
                heading = True
                for e in outs:
                    if named[e][2] == _HEADER:
                        named[e][2] = None
            if gone:
                outs = (*outs, gone)
            elif tag in ("article", "main", "h1"):
                main_outside = main_outside or not outs
                for e in outs:
                    named[e][1] = named[e][1] or tag != "article" or not named[e][0]
        if not rest.endswith("/") or tag in _BLOCK:
            stack.append((tag, name, outs))
    flush()
    # An element that is left out by name, yet holds most of the text, stays if the main text seems to be in it.
    size = lambda t, n: max(0, len(t) - n)
    whole, own, linked = sum(size(t, n) for t, _, n, _ in found), [0] * len(named), [0] * len(named)
    for t, _, n, outs in found:
        for e in outs:
            own[e] += size(t, n)
            linked[e] += min(n, len(t))
    stays = {e for e, (comments, main, _) in enumerate(named) if 2 * own[e] > whole and (main or not main_outside and not comments)}
    maybe = {e for e, (_, _, kind) in enumerate(named) if kind == _MAYBE and own[e] > linked[e]} - stays
    stays |= maybe | {e for e, (_, _, kind) in enumerate(named) if kind is None}
    return [(t, p, n, not maybe.isdisjoint(outs)) for t, p, n, outs in found if stays.issuperset(outs)]


def scores(found: list[Block]) -> dict[tuple[str, ...], float]:
    """Score of each container path of a page."""
    total: dict[tuple[str, ...], float] = defaultdict(float)
    for text, path, links, _ in found:
        share = float(max(0, len(text) - links))
        while path and share >= 1:
            total[path] += share
            path, share = path[:-1], share * FADE
    return total


def best(total: dict[tuple[str, ...], float]) -> tuple[str, ...] | None:
    return min(total, key=lambda p: (-total[p], p)) if total else None


def held(found: list[Block]) -> dict[tuple[str, ...], int]:
    """Characters that are no link in each container path of a page, parts of parts included; () is the page."""
    total: dict[tuple[str, ...], int] = defaultdict(int)
    for text, path, links, _ in found:
        for i in range(len(path) + 1):
            total[path[:i]] += max(0, len(text) - links)
    return total


def widened(path: tuple[str, ...]) -> tuple[str, ...]:
    """The article or main element around a path, or else the path."""
    return next((path[: i + 1] for i, n in enumerate(path) if n.split(".")[0] in ("article", "main")), path)


def digest(*texts: str) -> int:
    """A signed 64-bit hash of texts in their order."""
    h = xxhash.xxh64()
    for t in texts:
        h.update(t.encode("utf-8", "surrogatepass") + b"\0")
    return h.intdigest() - (1 << 63)


def inside(path: tuple[str, ...], cores: list[tuple[str, ...]]) -> bool:
    return any(path[: len(c)] == c for c in cores)


def extract(html: str, path: str | None, repeated: frozenset[int] = frozenset()) -> str:
    """The main text: blocks in containers of the host's path, or in the page's own best one where that holds little, and what
    stands elsewhere and is neither mostly links nor repeated. The path '' is the page.
    """
    found = blocks(html)
    own = held(found)
    want = tuple(path.split(">")) if path else () if path == "" else None
    cores = [want] if want is not None and own.get(want, 0) > 0 else []
    if not cores or own[want] < LITTLE * own[()]:
        cores.append(widened(best(scores(found)) or ()))
    out = []
    for text, at, links, doubtful in found:
        here = inside(at, cores)
        if here and not doubtful or (here or len(text) > 2 * links) and not (repeated and digest(text) in repeated):
            out.append(text)
    return "\n\n".join(out)


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, repeated): each host's winning path, widened, and digests of the blocks that its pages repeat (null if none)."""
    kind = "array<struct<path:string,vote:double,hash:long,page:long>>"

    @F.arrow_udf(kind)
    def cast(htmls: pa.Array) -> pa.Array:
        rows = []
        for html in htmls:
            found = blocks(html.as_py() or "")
            total = scores(found)
            whole = sum(total.values())
            row = [{"path": ">".join(p), "vote": n / whole, "hash": None, "page": None} for p, n in total.items()]
            core = [widened(best(total) or ())]
            apart = {digest(t) for t, p, _, doubtful in found if doubtful or not inside(p, core)}
            # A page is what its core says, so that copies of a page count once; every page has the mark 0.
            page = digest(*[t for t, p, _, doubtful in found if not doubtful and inside(p, core)])
            rows.append(row + [{"path": None, "vote": None, "hash": h, "page": page} for h in (0, *sorted(apart))])
        return pa.array(rows, pa.list_(pa.struct([("path", pa.string()), ("vote", pa.float64()), ("hash", pa.int64()), ("page", pa.int64())])))

    cast_ = pages.select(host(F.col("url")).alias("host"), F.explode(cast(F.col("html").cast("string"))).alias("v"))
    # Votes are rounded, so that sums are the same in any order. Written, since they are read several times.
    million = F.sum(F.round(F.col("v.vote") * 1_000_000).cast("long"))
    summed = written(cast_.groupBy("host", F.col("v.path").alias("path"), F.col("v.hash").alias("hash"), F.col("v.page").alias("page")).agg(million.alias("votes")), "votes")
    won = summed.filter("path is not null").groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("won"))
    article = F.regexp_extract("won", r"^((?:[^>]*>)*?(?:article|main)(?:\.[^>]*)?)(?:>|$)", 1)
    won = won.select("host", F.when(article != "", article).otherwise(F.col("won")).alias("path"))
    common = summed.filter("hash is not null").groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= REPEATED) | (F.col("hash") == 0))
    whole = common.filter("hash = 0").select("host", F.col("n").alias("pages"))
    common = common.filter("hash <> 0").join(whole, "host").filter(F.col("n") * 100 >= F.col("pages") * REPEATED_SHARE)
    # At most 100 / REPEATED_SHARE times as many as a page of the host has such blocks.
    repeated = common.groupBy("host").agg(F.collect_list("hash").alias("repeated"))
    return won.join(repeated, "host", "full")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    @F.arrow_udf("string")
    def run(htmls: pa.Array, paths: pa.Array, repeated: pa.Array) -> pa.Array:
        seen: dict[tuple, frozenset[int]] = {}
        out = []
        for h, p, r in zip(htmls, paths, repeated, strict=True):
            known = tuple(r.as_py() or ())
            if known not in seen:
                seen[known] = frozenset(known)
            out.append(extract(h.as_py() or "", p.as_py(), seen[known]))
        return pa.array(out, pa.string())

    # Written first, so that its size is known: pages are only shuffled by host where hosts are too many to broadcast.
    winners = written(votes(pages).select(F.col("host").alias("of"), F.col("path").alias("winner"), "repeated"), "winners")
    page = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("host", host(F.col("url")))
    out = page.join(winners, same("host", "of"), "left").select("page_id", "url", run("html", "winner", "repeated").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
