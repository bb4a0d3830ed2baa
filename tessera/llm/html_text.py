"""Main-text extraction by consensus host paths.

Each page scores its containers and votes for the generalised tag-class path of the best one; votes are counted per
host in Spark, and each page is extracted again at its host's winning path. A page without that path, or without text
there, falls back to its own best container.

Kept: the text of the container without navigation, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts and styles. What a container's tag, names or role tell against it counts for all in it, unless it holds
the page's article: a wrapper of most of the unlinked text, or of an article or main. Where nothing else is left, the best
of the marked containers but menus is taken. Character references are decoded, white space within a block becomes one space, and
blocks are joined in page order by a blank line.

Defined results: null or empty html gives an empty text; a null url is a host of its own; repeated rows are extracted
each on its own; broken markup is read as far as it goes (open elements end with the page, an open script or style takes
the rest of it, another element without markup that has no end tag is passed over); what a script holds is no markup, so
only its end tag ends it; an empty table gives no rows; further columns are left out, also where they are called host or
path.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import written

# Element kinds of HTML, and class or id words that name what isn't the article.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title", "head", "object", "canvas", "math"}
CONTAINERS = {"body", "main", "article", "section", "div", "td", "th", "table", "tr", "tbody", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "dialog", "menu", "fieldset", "figure", "details", "blockquote"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "address", "figcaption", "summary", "caption", "legend", "center", "thead", "tfoot", "html", "hgroup", "search"}
NOISE_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset", "button", "search"}
NOISE_WORDS = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "sidebar", "sidebars", "aside", "rail", "footer", "header", "masthead", "topbar", "comment", "comments", "discussion", "disqus", "respond", "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "newsletter",
    "subscribe", "subscription", "signup", "login", "popup", "modal", "overlay", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "toolbar", "pager", "pagination", "search", "form", "toc", "skip", "hidden",
}
COMMENTS = {"comment", "comments", "discussion", "disqus", "respond", "reply", "replies"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
#: Tags and roles that may wrap a page as well.
WRAPPERS = {"form", "fieldset", "header"}
#: Share of the page's unlinked text from which a container keeps no mark: by a part of a name or a wrapper's tag (1), by a
#: whole name, role or tag (2); never reader comments (3).
CLEARED = {1: 0.5, 2: 0.9, 3: 1.0}
MAIN_WORDS = {"article", "content", "post", "entry", "story", "main", "text", "body"}

#: Hosts whose winning paths are broadcast at most; parts of a host's pages beyond that.
BROADCAST_HOSTS, SALTS = 100_000, 64

_NAME = "[a-zA-Z][a-zA-Z0-9:-]*+"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)({_NAME})((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)({_NAME})([^>]*)(?:>|\Z)", re.S)
#: An end slash closes an element where it isn't the end of an unquoted value.
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_HAVING = re.compile(r"(?:^|(?<=[-_]))(?:has|have|no|not|non|with|without)[-_]\S*")
_DIGITS = re.compile(r"\d+")


@lru_cache
def _end_of(tag: str) -> re.Pattern[str]:
    """The end tag of an element whose content is not markup."""
    return re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9:-])[^>]*(?:>|\Z)", re.I)


class Page:
    """Containers (parent, path, tag, mark, noise, hint) and blocks (container, text, linked characters) of one page."""

    def __init__(self, source: str):
        self.parent, self.path, self.mark, self.tag, self.hint = [-1], [""], [0], ["#"], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)
        self.noise = self._noise()

    def _open(self, tag: str, attributes: str, above: int) -> int:
        label, hint = tag, tag in ("article", "main")
        mark = 0 if tag not in NOISE_TAGS else 1 if tag in WRAPPERS else 2
        found = {a.group(1).lower(): a.group(2) or a.group(3) or a.group(4) or "" for a in _ATTR.finditer(attributes)} if attributes.strip() else {}
        if found:
            names = f"{found.get('class', '')} {found.get('id', '')}".lower()
            # has-sidebar, with-header and no-search tell of the layout
            told = [n for n in (_HAVING.sub("", n) for n in names.split()) if n]
            words = {w for n in told for w in _WORD.findall(n)}
            hint = hint or bool(words & MAIN_WORDS)
            if tag not in ("article", "main", "body") or words & {"comment", "comments"}:
                role = found.get("role", "").lower()
                mark = max(mark, 3 if words & COMMENTS else 2 if any(n in NOISE_WORDS for n in told) else 1 if words & NOISE_WORDS else 0, (1 if role in WRAPPERS else 2) if role in NOISE_ROLES else 0)
            if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
                mark = max(mark, 2)
            label = ".".join([tag, *sorted(_DIGITS.sub("#", c) for c in found.get("class", "").lower().split())])
            if not found.get("class") and found.get("id"):
                label += "#" + _DIGITS.sub("#", found["id"].lower())
        self.parent.append(above)
        self.path.append(f"{self.path[above]}>{label}")
        self.mark.append(mark)
        self.tag.append(tag)
        self.hint.append(hint)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        open_now = [0]
        run: list[str] = []
        linked, in_link, at = 0, False, 0
        unescape = _html.unescape

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(unescape("".join(run)).split())
                if text:
                    self.blocks.append((open_now[-1], text, min(linked, len(text))))
                run.clear()
            linked = 0

        while m := _TAG.search(source, at):
            if m.start() > at:
                piece = source[at : m.start()]
                run.append(piece)
                if in_link:
                    linked += len(piece)
            at = m.end()
            tag = (m.group(2) or m.group(5) or "").lower()
            if not tag:
                continue
            closing = bool(m.group(1) or m.group(4))
            attributes = m.group(3) or m.group(6) or ""
            if tag in RAW or tag == "button":
                if not closing and not _CLOSED.search(attributes) and tag != "head":
                    # only its own end tag ends it, whatever looks like markup inside
                    end = _end_of(tag).search(source, at)
                    at = end.end() if end else len(source) if tag in ("script", "style") else at
                continue
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link = not closing
            elif tag in BLOCKS:
                flush()
                if tag in CONTAINERS:
                    if not closing:
                        open_now.append(self._open(tag, attributes, open_now[-1]))
                    elif tag in (self.tag[c] for c in open_now[1:]):
                        while self.tag[open_now.pop()] != tag:
                            pass
        if at < len(source):
            run.append(source[at:])
        flush()

    def _noise(self) -> list[bool]:
        """Whether each container is none of the article: by its own mark, or that of one around it."""
        n = len(self.parent)
        text, articles = [0] * n, [0] * n  # unlinked characters in all, and in an article or main
        for c, t, linked in self.blocks:
            text[c] += len(t) - linked
        bare = lambda: sum(k for k, x in zip(text, noise) if not x)
        noise = self._spread(self.mark)
        unmarked = bare()
        own = text[:]
        for c in range(n - 1, 0, -1):
            up = self.parent[c]
            text[up] += text[c]
            if self.tag[c] in ("article", "main") and not self.mark[c]:
                articles[c] = text[c]
            articles[up] += articles[c]
        mark = self.mark[:]
        for c in range(1, n):
            if mark[c] and (text[c] > CLEARED[mark[c]] * text[0] or (2 * articles[c] > articles[0] and articles[c] > unmarked)):
                mark[c] = 0
        noise, text = self._spread(mark), own
        if not bare() and sum(text):
            noise = self._spread([int(t in ("nav", "menu")) for t in self.tag])
        return noise

    def _spread(self, mark: list[int]) -> list[bool]:
        out = [False] * len(mark)
        for c in range(1, len(mark)):
            out[c] = bool(mark[c]) or out[self.parent[c]]
        return out

    def best(self) -> int:
        """The container with the highest score, 0 (the page) if none has text."""
        own = [0.0] * len(self.parent)
        for c, text, linked in self.blocks:
            if not self.noise[c]:
                own[c] += len(text) * (1 - linked / len(text))
        score = own[:]
        for c in range(len(score) - 1, 0, -1):  # children come after their parents
            up = self.parent[c]
            score[up] += score[c] * (1.0 if self.tag[up] in ("article", "main") else 0.5)
        weighted = [s * (1.5 if self.tag[c] in ("article", "main") else 1.2 if self.hint[c] else 1.0) for c, s in enumerate(score)]
        return max(range(len(weighted)), key=lambda c: (weighted[c], -c)) if max(weighted) > 0 else 0

    def text(self, tops: set[int]) -> str:
        inside = [False] * len(self.parent)
        for c in range(len(inside)):
            inside[c] = c in tops or (c > 0 and inside[self.parent[c]])
        return "\n\n".join(t for c, t, _ in self.blocks if inside[c] and not self.noise[c])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = (Page(h or "") for h in batch.column(1).to_pylist())
        yield pa.record_batch({"host": batch.column(0), "path": pa.array([p.path[p.best()] for p in pages], pa.string())})


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some, out = batch.slice(at, 256), []
            for source, path in zip(some.column(2).to_pylist(), some.column(3).to_pylist()):
                page = Page(source or "")
                text = page.text({c for c, p in enumerate(page.path) if p == path and not page.noise[c]}) if path else ""
                out.append(text or page.text({page.best()}))
            yield pa.record_batch({"page_id": some.column(0), "url": some.column(1), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())})


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[^:/?#]*:?//(?:[^@/?#]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    votes = rows.select("host", "html").mapInArrow(_votes, "host string, path string").where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    winners = written(votes.groupBy("host").agg(F.max_by("path", F.struct("n", "path")).alias("path")), "winners")
    if winners.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:  # a host may hold a third of all pages: its pages are dealt to SALTS parts, its one path to each of them
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
