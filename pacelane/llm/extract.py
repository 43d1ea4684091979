"""Main text of web pages by consensus host paths.

First pass: a page's containers are scored by the text of their blocks (links count against it), and the best container's
path, tags with their classes from the root down, numbers generalised, gets the page's vote on its host.  Votes are summed
in Spark by host and path.  Second pass: each page is read again and gives the blocks of the containers that lie on its
host's winning path, else on the next ones, else those of its own best container.

A block is the text between two block-level tags.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are left out, by tag or by class and id.  Character references are decoded, white space in a
block becomes one space, blocks are joined by an empty line.

A class or id counts as a whole: ``cookie-notice`` and ``share-buttons`` name a notice and buttons, ``has-sidebar``, ``header-fixed`` and
``banner-story`` do not name a part to leave out.  A wrapper that is left out for its class is taken back when the page's first article
or main part opens inside it.  Tags end at the first ``>`` outside a quoted value; a quote that is never closed quotes nothing.

A null or empty page, or one without a container, has the empty text.  Pages without a host take no part in votes and
use their own best container.  Ties between paths go to the smaller path.  Repeated rows get equal answers.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, settle, ship_package

PATHS = 3
"""Paths of a host that are tried in turn."""
SENT = 8 << 20
"""Bytes of hosts and paths that are sent to every task; more are joined by shuffle."""

# Tags by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select canvas".split())
TO_THE_END = frozenset("script style noscript template textarea iframe".split())
"""Raw tags that, never closed, hold the rest of the page; any other one then holds nothing."""
INLINE = frozenset("math mi mn mo mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mspace semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br".split())
SKIPPED = frozenset("nav footer aside form menu button dialog head".split()) | RAW
CONTAINERS = frozenset("article main section div td body html blockquote center table tbody tr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUND = frozenset("ul ol dl table td th article section div main body html aside nav footer header form button".split())

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^\s"'>/=]++(?:\s*+=\s*+{_VALUE})?+|[\s/="'])*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
# Names of parts to leave out, what may follow such a name, and what before it speaks of the page instead.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice pagination pager popup promo promoted related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
AFTER = frozenset(
    "area bar block body bottom box button buttons container content form group holder icons inner item items left link links list panel posts right row section slot stories thread top unit "
    "wrap wrapper zone articles header footer".split()
)
ABOUT = frozenset("has no not with without is hide hides show under over below above after before".split())
_PART = re.compile(r"[a-z]+|\d+")


def unwanted(names: str) -> bool:
    """Whether a class or id (several, by white space) names a part to leave out."""
    for name in names.lower().split():
        parts = [w for w in _PART.findall(name) if not w.isdigit()]
        while len(parts) > 1 and parts[-1] in AFTER and parts[-1] not in PARTS:
            parts.pop()
        if parts and parts[-1] in PARTS and parts[0] not in ABOUT:
            return True
        if len(parts) > 1 and parts[0] in PARTS and parts[1] in AFTER:
            return True
    return False


_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu".split())
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    linked: int
    """Characters inside links."""
    places: tuple[int, ...]
    """Numbers of the open containers, from the root on."""


class Page:
    """Blocks of a page in order, and its containers with their paths."""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.paths: list[str] = []
        stack: list[tuple[str, bool, int | None]] = []  # tag, left out, container number
        named: list[bool] = []  # whether it is left out by class or id alone
        parts: list[str] = []
        state = {"linked": 0, "link": 0, "out": 0, "article": 0}

        def flush() -> None:
            if parts:
                text = _SPACE.sub(" ", html.unescape("".join(parts)).replace("\x00", "")).strip()
                if text:
                    self.blocks.append(Block(text, state["linked"], tuple(c for _, _, c in stack if c is not None)))
                parts.clear()
            state["linked"] = 0

        def close(depth: int) -> None:
            while len(stack) > depth:
                if stack[-1][0] not in INLINE:
                    flush()
                tag, out, _ = stack.pop()
                named.pop()
                state["out"] -= out
                state["link"] -= tag == "a"

        def add(text: str) -> None:
            if text and not state["out"]:
                parts.append(text)
                if state["link"]:
                    state["linked"] += len(text.strip())

        at, size = 0, len(source)
        while at < size:
            found = _TOKEN.search(source, at)
            if found is None:
                add(source[at:])
                break
            add(source[at : found.start()])
            at = found.end()
            tag = found.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if found.group(1):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        close(depth)
                        break
                    if stack[depth][0] in BOUND and tag in INLINE | {"p", "li"}:
                        break
                continue
            if tag == "br":
                add(" ")
                continue
            if tag not in INLINE:
                flush()
            if tag in RAW:
                if not found.group(3).endswith("/"):
                    end = self._raw_end(source, tag, at)
                    at = end if end is not None else size if tag in TO_THE_END else at
                continue
            closed = SAME.get(tag, ()) or ({"p"} if tag in CLOSES_P else ())
            if closed:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in closed:
                        close(depth)
                        break
                    if stack[depth][0] in BOUND and stack[depth][0] not in closed:
                        break
            if tag in VOID or found.group(3).endswith("/") and tag in INLINE:
                continue
            names: dict[str, str] = {}
            for k, a, b, c in _ATTRIBUTE.findall(found.group(3)):
                names.setdefault(k.lower(), a or b or c)
            if tag in ("article", "main") and not state["article"] and not unwanted(f"{names.get('class', '')} {names.get('id', '')}"):
                # the first one is no part of what its wrappers are named after
                if state["out"] and all(by_name for (_, out, _), by_name in zip(stack, named, strict=True) if out):
                    stack[:] = [(t, False, place) for t, _, place in stack]
                    state["out"] = 0
                state["article"] = not state["out"]
            out = tag in SKIPPED or (tag == "header" and not any(t in ("article", "main") for t, _, _ in stack))
            by_name = False
            if names and tag not in ("html", "body", "article", "main"):
                out = out or names.get("role") in _ROLES or "hidden" in names or names.get("aria-hidden") == "true"
                by_name = not out and unwanted(f"{names.get('class', '')} {names.get('id', '')}")
                out = out or by_name
            place = None
            if tag in CONTAINERS and not state["out"] and not out:
                classes = ".".join(sorted(set(_DIGITS.sub("#", names.get("class", "").lower()).split())))
                step = f"{tag}.{classes}" if classes else tag
                above = next((c for _, _, c in reversed(stack) if c is not None), None)
                self.paths.append(f"{self.paths[above]}>{step}" if above is not None else step)
                place = len(self.paths) - 1
            stack.append((tag, out, place))
            named.append(by_name)
            state["out"] += out
            state["link"] += tag == "a"
        close(0)
        flush()

    @staticmethod
    def _raw_end(source: str, tag: str, at: int) -> int | None:
        """Place behind the end tag of a raw element whose content begins at ``at``; drawings may hold drawings."""
        depth = 1
        for mark in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])([^>]*)(?:>|\Z)", re.I).finditer(source, at):
            if mark.group(1):
                depth -= 1
            elif tag == "svg" and not mark.group(2).endswith("/"):
                depth += 1
            if not depth:
                return mark.end()
        return None

    def best(self) -> tuple[int, float] | None:
        """The container with most text, and its score: a block counts fully for the innermost one, by half for the next."""
        score = [0.0] * len(self.paths)
        for block in self.blocks:
            worth = len(block.text) - 2 * block.linked
            for share, place in zip((1.0, 0.5, 0.25), reversed(block.places)):
                score[place] += worth * share
        if not score:
            return None
        place = max(range(len(score)), key=lambda k: (score[k], -k))
        # a container that holds others as good is better than any one of them
        for upper in range(place):
            if self.paths[place].startswith(f"{self.paths[upper]}>") and score[upper] > 0.9 * score[place] and "article" not in self.paths[place].split(">")[-1]:
                place = upper
                break
        return (place, score[place]) if score[place] > 0 else None

    def text(self, paths: list[str]) -> str:
        """Blocks in the containers on the first path that the page has, else in its best container."""
        for path in paths:
            wanted = {k for k, p in enumerate(self.paths) if p == path}
            chosen = [b.text for b in self.blocks if wanted.intersection(b.places)] if wanted else []
            if chosen:
                return "\n\n".join(chosen)
        best = self.best()
        if best is None:
            return "\n\n".join(b.text for b in self.blocks) if not self.paths else ""
        return "\n\n".join(b.text for b in self.blocks if best[0] in b.places)


def host_of(url: str | None) -> str | None:
    """Lower-case host of a URL; None if there is none."""
    try:
        return (urlsplit(url.strip()).hostname or None) if url else None
    except ValueError:
        return None


def host_paths(pages: DataFrame, paths: int = PATHS) -> DataFrame:
    """``host`` and its ``paths`` in falling order of votes; a page votes with the logarithm of its container's score."""
    rows = plain(pages, "url", "html").where("url IS NOT NULL AND html IS NOT NULL")

    def vote(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], float] = {}
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host = host_of(url)
                page = Page(source) if host else None
                best = page.best() if page else None
                if best:
                    key = (host, page.paths[best[0]])
                    votes[key] = votes.get(key, 0.0) + math.log1p(best[1])
            yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in votes], pa.string()), "path": pa.array([p for _, p in votes], pa.string()), "votes": pa.array(votes.values(), pa.float64())})

    cast = rows.mapInArrow(vote, "host string, path string, votes double")
    totals = cast.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    ranked = totals.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("place") <= paths)
    return ranked.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda p: p["path"]).alias("paths"))


def main_texts(pages: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page, read by its host's paths (``host_paths`` of the same pages by default)."""
    ship_package(pages.sparkSession)
    paths = settle(host_paths(pages) if paths is None else paths)
    taken = paths.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", " ")) + 64)).first()[0] or 0
    paths = F.broadcast(paths) if taken <= SENT else paths
    rows = plain(pages, "page_id", "url", "html")
    host = F.lower(F.regexp_extract("url", r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    joined = rows.withColumn("__host", F.when(host != "", host)).join(paths.withColumnsRenamed({"host": "__host", "paths": "__paths"}), "__host", "left")
    joined = joined.select("page_id", "url", "html", "__paths")
    kinds = ", ".join(f"{n} {joined.schema[n].dataType.simpleString()}" for n in ("page_id", "url"))

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source).text(found or []) if source else "" for source, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(read, f"{kinds}, text string")
