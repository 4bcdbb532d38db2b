"""HTML extraction by consensus host paths.

First pass: each page credits its text, outside links and boilerplate, to the container that holds it and, halved at each
level, to those around it; a container is named by its path of tags and classes, digits generalised. So a container wins
over those around it while it holds over half of their text. Spark adds up the votes by host and path and keeps one
winning path per host; it is widened to the outermost container around it that has text of its own on half of the pages or
more, as a heading above nested sections. Second pass: each page is extracted from the containers at its host's winning
path and below it, or from its own best container where the page doesn't have it. Votes are pre-aggregated, so a host with a third of the pages is a few
rows per task; the table of winners has one row per host and Spark broadcasts it only below its own size threshold.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article main section div td body blockquote".split())
_MAIN = frozenset(("article", "main"))
_SKIP_TAG = frozenset("aside button canvas dialog footer form head input label menu nav object select".split())
_SKIP_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of class names and ids that mark boilerplate.
_SKIP_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adslot|banner\w*|breadcrumbs?|comments?|commentlist|consent|cookies?|disclaimer|discussion|disqus|"
    r"foot|footer|gdpr|login|menus?|modal|nav|navbar|navigation|newsletter|notices?|notification|pager|pagination|paywall|popup|promo\w*|"
    r"recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|sidenav|signup|skip|social|sponsor\w*|subscribe|"
    r"teasers?|toolbar|widgets?)(?:$|[\s_-])",
    re.I,
)
_SKIP_OUTSIDE = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
#: Words that say nothing on their own in such a name: "comment-list" is boilerplate where "comment-guide" need not be.
_NEUTRAL = frozenset(
    "a area bar block bottom box button buttons col column container content group icon icons inner inline item items left link links list "
    "main mobile panel posts right section slot small sticky the thread top unit wrap wrapper".split()
)
#: Elements that hold text of their own: outside the article, too, only a whole name speaks against them.
_TEXT = frozenset("b blockquote code dd dt em figcaption h1 h2 h3 h4 h5 h6 i li p pre span strong td th".split())
#: Elements that an opening tag ends if they are open, up to one of the second set.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text.strip(" /\n\t") else {}


def _is_boilerplate(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in _SKIP_TAG or tag == "header" and not in_main:
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in _SKIP_ROLE or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("body", "html") or tag in _MAIN:
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if in_main or tag in _TEXT:
        return any(_names_boilerplate(x) for x in names.split())
    return bool(_SKIP_NAME.search(names) or _SKIP_OUTSIDE.search(names))


def _names_boilerplate(name: str) -> bool:
    """Whether every part of a class name or id is a word for boilerplate or says nothing, and one is such a word."""
    parts = [x for x in re.split(r"[_-]+|(?<=[a-z])(?=[A-Z])", name) if x and not x.isdigit()]
    marks = [bool(_SKIP_NAME.fullmatch(x)) for x in parts]
    return any(marks) and all(m or x.lower() in _NEUTRAL for m, x in zip(marks, parts, strict=True))


def _step(tag: str, attrs: dict[str, str]) -> str:
    """A tag and its classes, sorted, with digits generalised."""
    names = sorted({re.sub(r"\d+", "0", c.lower()).replace("/", "_") for c in attrs.get("class", "").split()})
    return ".".join([tag, *names])


def blocks(page: str) -> Iterator[tuple[str, str, int]]:
    """(container path, text, characters outside links) of each block of text outside boilerplate, in page order. A
    container within an article or main element counts as that element."""
    # An open element: tag, path of its container, whether it is boilerplate, main, a link.
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
    held: list[str] = []
    owner, free = "", 0

    def flush() -> Iterator[tuple[str, str, int]]:
        nonlocal free
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            yield owner, text, free
        held.clear()
        free = 0

    at = 0
    for m in [*_TOKEN.finditer(page), None]:
        text = page[at : m.start()] if m else page[at:]
        top = stack[-1]
        if text and not top[2]:
            if not held or not owner:
                owner = top[1]
            held.append(text)
            free += 0 if top[4] else len(text.strip())
        if m is None:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] and held:
                held.append(" ")
            continue
        if tag in _BLOCK:
            yield from flush()
        elif tag == "br" and not top[2]:
            held.append(" ")
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK and tag not in _BLOCK:
                    break
            continue
        if tag in _VOID:
            continue
        ends, bounds = _ENDS.get(tag, ((), ()))
        if tag in _BLOCK:
            ends, bounds = (*ends, "p"), bounds or tuple(_CONTAINER)
        for k in range(len(stack) - 1, 0, -1) if ends else ():
            if stack[k][0] in ends:
                del stack[k:]
                break
            if stack[k][0] in bounds:
                break
        _, path, skip, in_main, link = stack[-1]
        attrs = _attributes(m["attrs"])
        if not skip:
            skip = _is_boilerplate(tag, attrs, in_main)
            if tag in _CONTAINER and not in_main:
                path = f"{path}/{_step(tag, attrs)}"
        stack.append((tag, path, skip, in_main or tag in _MAIN, link or tag == "a"))
    yield from flush()


def _is_main(path: str) -> bool:
    return path.rpartition("/")[2].split(".")[0] in _MAIN


def scores(page: str) -> dict[str, int]:
    """Characters of text outside links that each container path holds itself; text within main elements counts double."""
    out: dict[str, int] = defaultdict(int)
    for path, _, free in blocks(page):
        if free:
            out[path] += free * (2 if _is_main(path) else 1)
    return dict(out)


def credits(own: dict[str, int]) -> dict[str, float]:
    """The scores, with those of nested containers halved at each level up."""
    out: dict[str, float] = defaultdict(float)
    for path, n in own.items():
        share = float(n)
        out[path] += share
        while path:
            path, share = path.rpartition("/")[0], share / 2
            out[path] += share
    return dict(out)


def _best(own: dict[str, int]) -> str:
    """The winning path of one page, widened."""
    credit = credits(own)
    won = max(credit, key=lambda p: (credit[p], p))
    while won.rpartition("/")[2].split(".")[0] == "blockquote":
        won = won.rpartition("/")[0]
    return won if _is_main(won) else min((p for p in own if won.startswith(f"{p}/")), key=len, default=won)


def extract(page: str, winner: str | None) -> str:
    """The text at the winning path and below it, or at the page's own best path if the page has none there."""
    found = list(blocks(page))
    within = lambda p: p == winner or p.startswith(f"{winner}/")
    if winner is None or not any(within(p) for p, _, _ in found):
        own = scores(page)
        winner = _best(own) if own else (found[0][0] if found else "")
    return "\n".join(t for p, t, _ in found if within(p))


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; an unreadable or null url has the empty host."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, path, share, direct = [], [], [], []
        for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = scores(page)
            total = sum(own.values())
            for p, n in credits(own).items():
                host.append(h), path.append(p), share.append(int(n * 1_000_000 / total)), direct.append(int(p in own))
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(share, pa.int64()), pa.array(direct, pa.int64())], ["host", "path", "share", "direct"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page, w) for page, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, winner): the container path with the most votes of each host."""
    rows = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string, share long, direct long")
    votes = stored(votes.groupBy("host", "path").agg(F.sum("share").alias("share"), F.sum("direct").alias("direct"), F.count(F.lit(1)).alias("pages")), "votes")
    best = votes.groupBy("host").agg(F.max(F.struct("share", "path", "pages")).alias("best")).select("host", F.regexp_replace("best.path", r"(?:/blockquote(?:\.[^/]*)?)+$", "").alias("won"), "best.pages")
    wider = F.startswith("won", F.concat("path", F.lit("/"))) & (2 * F.col("direct") >= F.col("p")) & ~F.col("won").rlike(r"/(?:article|main)(?:\.[^/]*)?$")
    around = votes.join(best.withColumnRenamed("pages", "p"), "host").filter(wider).groupBy("host").agg(F.min_by("path", F.length("path")).alias("wide"))
    return best.join(around, "host", "left").select("host", F.coalesce("wide", "won").alias("winner"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) for each row of `pages`; null or empty html gives an empty text, null urls share one host.

    Rows with equal ids are rows of their own. An empty table gives an empty result; other columns may have any name.
    """
    winners = stored(host_paths(pages, url_col, html_col), "winners")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    out = rows.join(winners, "host", "left").select("id", "url", "html", "winner")
    return out.mapInArrow(_texts, f"id {out.schema['id'].dataType.simpleString()}, url string, text string")
