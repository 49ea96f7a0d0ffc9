"""Main text of web pages by consensus paths of each host.

First pass: every page scores its containers by the plain text under them and
votes for one generalised path (tags with classes, digits taken out). Votes are
summed per host in Spark. Second pass: each page is read again under its host's
winning paths; a page that has none of them falls back to its own vote.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookflow.llm.common import small_or_not, stored

#: Elements whose content is never text.
RAW = "script|style|noscript|template|textarea|iframe|svg|select|title|object|canvas"
#: Attributes as the standard reads them: a quote inside a name or an unquoted value is a plain character.
ATTRIBUTES = r"""(?:[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?)*+"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{ATTRIBUTES})>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")

#: Elements that hold others and can be the main container.
CONTAINERS = frozenset("html body main article section div td table tbody tr ul ol dl nav header footer aside form figure blockquote center fieldset details dialog menu".split())
#: Elements that end a block of text.
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre th caption figcaption hr address summary legend option label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
#: Open elements that the start of another element closes: a paragraph by any block, the others by their like.
CLOSED_BY = {**{t: ("p",) for t in BREAKS}, "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "option": ("p", "option")}
#: Elements that are never part of the article.
BOILERPLATE_TAGS = frozenset("nav footer aside form header button dialog menu label option datalist output meter progress audio video canvas object".split())
#: Words that mark an element wherever they stand in its names.
BOILERPLATE_WORDS = frozenset(
    "addthis adsbygoogle advert advertisement adverts breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr masthead modal nav navbar navigation newsletter "
    "pagination pager popup promo promoted replies respond sharethis sharing sidebar signup sponsor sponsored subscribe toolbar widget".split()
)
#: Words that mark an element only as a name of their own, or beside a word for the page.
BOILERPLATE_NAMES = frozenset("alert banner copyright header menu notice recommend recommended related share social".split())
PAGE_WORDS = frozenset("bar bottom box buttons global icons links list main media page post posts site stories top wrapper".split())
#: Words that mark an advert as a name of their own, or beside words for a place or a size.
AD_NAMES = frozenset("ad ads adv".split())
AD_WORDS = PAGE_WORDS | BOILERPLATE_NAMES | frozenset(
    "area block center column container content desktop footer frame google group header holder inline inner inside item label large leaderboard left middle mobile module outer panel placement position "
    "rectangle region right row script section side single size skyscraper slot small space spot text title unit wide wrap x zone".split()
)
#: A page's vote starts at the deepest container with this share of its score.
SHARE = 0.75
#: Elements that are parts of an article: they are voted for only where no other container below the body stands.
PARTS = frozenset("table tbody tr td ul ol dl figure blockquote".split())
ROOTS = frozenset(["html", "body"])
#: Elements that mark an article; a vote doesn't climb beyond them.
ARTICLES = frozenset(["article", "main"])
#: Blocks outside these tags are text of an article from this length on.
PROSE = HEADINGS | frozenset("p li dt dd pre th td caption figcaption blockquote".split())
LEAST_PROSE = 40
PARAGRAPHS = HEADINGS | frozenset("p dd pre blockquote".split())
#: Paths with at least this share of a host's votes win.
WINS = 0.2
#: A block of which links are more than this share is a menu, where no article text stands on both sides and it is no paragraph.
MOST_LINKS = 0.6
#: Elements nested deeper are read as text of the element at this depth.
DEEPEST = 255
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Block:
    """A run of text between breaks: the open elements around it, its text and the letters in links."""

    __slots__ = ("at", "tag", "parts", "linked")

    def __init__(self, at: tuple, tag: str):
        self.at, self.tag, self.parts, self.linked = at, tag, [], 0


class Element:
    __slots__ = ("tag", "label", "path", "dull", "hidden")

    def __init__(self, tag: str, attrs: str, parent: str):
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attrs) if attrs.strip() else ():
            found.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
        self.tag = tag
        self.label = generalised(tag, found.get("class", ""))
        self.path = f"{parent}/{self.label}"
        self.dull = tag in BOILERPLATE_TAGS or any(is_boilerplate(n) for k in ("class", "id", "role") if k in found for n in found[k].lower().split())
        style = found.get("style", "").replace(" ", "").lower()
        self.hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or "display:none" in style or "visibility:hidden" in style


@lru_cache(1 << 14)
def is_boilerplate(name: str) -> bool:
    """Whether a class, id or role marks an element that is no part of an article."""
    words = WORDS.findall(name)
    if not BOILERPLATE_WORDS.isdisjoint(words):
        return True
    if not AD_NAMES.isdisjoint(words) and all(w in AD_NAMES or w in AD_WORDS for w in words):
        return True
    return not BOILERPLATE_NAMES.isdisjoint(words) and all(w in BOILERPLATE_NAMES or w in PAGE_WORDS for w in words)


def generalised(tag: str, classes: str) -> str:
    """A tag with its sorted classes, runs of digits written as #: the same for all pages of a template."""
    names = sorted({re.sub(r"\d+", "#", c) for c in classes.lower().split()})
    return ".".join([tag, *names])


class Reader:
    """Reads a page's tags into blocks. Of elements that hold no others, only marked ones are tracked, so that their text can be told."""

    def __init__(self) -> None:
        self.out: list[tuple[tuple[Element, ...], str, str, float]] = []
        self.stack: list[Element] = []
        self.open: Counter = Counter()
        self.deep: Counter = Counter()
        self.muted = self.links = 0
        self.inline = ""
        self.block = Block((), "")

    def text(self, piece: str) -> None:
        if not self.muted:
            self.block.parts.append(piece)
            if self.links:
                self.block.linked += len(piece)

    def close_block(self) -> None:
        block = self.block
        text = SPACE.sub(" ", entities.unescape("".join(block.parts))).strip()
        if text:
            self.out.append((block.at, block.tag, text, min(1.0, block.linked / len(text))))
        self.block = Block(tuple(self.stack), self.inline)

    def pop(self, tag: str) -> None:
        """Close the innermost open element of a tag and all inside it."""
        while self.open[tag]:
            e = self.stack.pop()
            self.open[e.tag] -= 1
            self.muted -= e.tag not in BREAKS
            if e.tag == tag:
                break

    def start(self, tag: str, attrs: str) -> None:
        for other in CLOSED_BY.get(tag, ()):
            self.pop(other)
        if tag in VOID or (tag not in CONTAINERS and not attrs.strip() and tag not in BOILERPLATE_TAGS and not self.open[tag]):
            return
        if len(self.stack) >= DEEPEST:
            self.deep[tag] += tag in CONTAINERS
            return
        e = Element(tag, attrs, next((x.path for x in reversed(self.stack) if x.tag in CONTAINERS), ""))
        if tag in CONTAINERS or e.dull or e.hidden or self.open[tag]:
            self.stack.append(e)
            self.open[tag] += 1
            self.muted += tag not in BREAKS

    def end(self, tag: str) -> None:
        if self.deep[tag]:
            self.deep[tag] -= 1
        else:
            self.pop(tag)


def blocks_of(html: str) -> list[tuple[tuple[Element, ...], str, str, float]]:
    """Blocks in page order: open elements, block tag, text and share of linked letters."""
    reader, at, whole = Reader(), 0, html.rfind(">") + 1  # no tag ends after it, so none is tried there
    unclosed = False
    for m in TOKEN.finditer(html, 0, whole):
        if m.start() > at:
            reader.text(html[at : m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            raw = m.group("raw")
            unclosed = at == whole and bool(raw and f"</{raw}".lower() not in m.group().lower() or not raw and m.group().startswith("<!--") and not m.group().endswith("-->"))
            continue
        tag = tag.lower()
        if tag == "a":
            reader.links = 0 if m.group("end") else 1
        elif tag == "br":
            reader.text("\n")
        if m.group("end"):
            if reader.open[tag] or reader.deep[tag]:
                reader.end(tag)
            if tag in BREAKS:
                reader.inline, reader.links = "", 0
        else:
            reader.start(tag, m.group("attrs"))
            if tag in BREAKS:
                reader.inline = tag
        if tag in BREAKS:
            reader.close_block()
    reader.text("" if unclosed else html[at:].split("<!--")[0])
    reader.close_block()
    return reader.out


def vote(blocks: list) -> tuple[str, int]:
    """The path of the deepest container that holds the page's article, and its score.

    The vote starts at the deepest container with SHARE of the plain text and
    climbs to the deepest one above it that no article text is left out of: up to
    an article element, else to the body, of which only blocks right under it count.
    """
    scores: dict[str, float] = defaultdict(float)
    article: dict[str, float] = defaultdict(float)
    chains: dict[str, tuple[Element, ...]] = {}
    total = 0.0
    for at, tag, text, linked in blocks:
        if any(e.hidden for e in at) or not any(e.tag in CONTAINERS for e in at):
            continue
        dull = any(e.dull for e in at)
        score = len(text) * (1 - linked) * (0.1 if dull else 1.0)
        total += score
        prose = not dull and linked <= MOST_LINKS and (tag in PROSE or len(text) >= LEAST_PROSE)
        at = tuple(e for e in at if e.tag in CONTAINERS)
        for i, e in enumerate(at):
            if e.path not in chains:
                chains[e.path] = at[: i + 1]
        for path in {e.path for e in at}:
            scores[path] += score
        if prose:
            # of a root, only the blocks right under it: other containers there need not be the article
            for path in {e.path for e in at if e.tag not in ROOTS} or {at[-1].path}:
                article[path] += score
    if not total:
        return "", 0
    heavy = [p for p, s in scores.items() if s >= SHARE * total]
    whole = [p for p in heavy if chains[p][-1].tag not in PARTS]
    standing = whole if any(chains[p][-1].tag not in ROOTS for p in whole) else heavy
    best = max(standing, key=lambda p: (p.count("/"), scores[p], p), default="")
    if best:
        best = climbed(best, chains[best], article)
    return best, int(scores.get(best, 0))


def climbed(best: str, chain: tuple[Element, ...], article: dict[str, float]) -> str:
    """The deepest container from `best` upwards outside of which no article text stands."""
    top = next((i for i in range(len(chain) - 1, -1, -1) if chain[i].tag in ARTICLES), 0)
    now = article[best]
    for e in reversed(chain[top:-1]):
        # of a root, `article` has the blocks right under it alone
        held = now + article[e.path] if e.tag in ROOTS else article[e.path]
        if held > now and (e.tag not in PARTS):
            best, now = e.path, held
    return best


def chosen_path(blocks: list, winners: dict[str, int], own: str) -> str:
    """The path to read a page under: of its own vote, if that won, and the winners below it the one with most votes.

    Without a vote that won it is the deepest winner around the vote, else the deepest one that the page has.
    """
    present = {e.path for at, _, _, _ in blocks for e in at if e.tag in CONTAINERS and e.path in winners}
    if own in present:
        return max((p for p in present if p == own or p.startswith(own + "/")), key=lambda p: (winners[p], p.count("/"), p))
    around = [p for p in present if own.startswith(p + "/")]
    return max(around or present, key=lambda p: (p.count("/"), winners[p], p), default="")


def main_text(blocks: list, path: str) -> str:
    """Text of the article's blocks under a path."""
    out, menus = [], []
    for at, tag, text, linked in blocks:
        inside = next((i for i, e in enumerate(at) if e.tag in CONTAINERS and e.path == path), None)
        if inside is None or any(e.hidden for e in at):
            continue
        dull = [e for e in at[inside + 1 :] if e.dull]
        if dull and not (tag in HEADINGS and all(e.tag == "header" for e in dull)):
            continue
        if linked > MOST_LINKS and tag not in PARAGRAPHS:  # part of the article only between its other blocks
            menus += [text] if out else []
            continue
        out += [*menus, text]
        menus = []
    return "\n".join(out)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter = Counter()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            path, _ = vote(blocks_of(html.as_py() or ""))
            if path:
                votes[host, path] += 1
        keys = list(votes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([votes[k] for k in keys], pa.int64())], names=["host", "path", "votes"]
        )


def consensus(pages: DataFrame) -> DataFrame:
    """host and its winning paths: those with at least WINS of its votes, at most 1 / WINS of them.

    Votes are summed inside each task before they are shuffled, so a host with
    most of the pages sends a few rows from each task.
    """
    cast = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    votes = cast.mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    votes = stored(votes, "path-votes")
    whole = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    return votes.join(whole, "host").filter(F.col("votes") >= WINS * F.col("all")).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "votes"))).alias("paths"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, used = [], []
        for html, paths in zip(batch.column("html"), batch.column("paths").to_pylist(), strict=True):
            blocks = blocks_of(html.as_py() or "")
            own, _ = vote(blocks)
            path = chosen_path(blocks, {p["path"]: p["votes"] for p in paths or ()}, own)
            used.append(path != "")
            path = path or own
            texts.append(main_text(blocks, path) if path else "\n".join(b[2] for b in blocks if b[3] <= MOST_LINKS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.bool_())],
            names=["page_id", "url", "text", "n_chars", "by_consensus"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars and whether a path of its host gave it.

    * null or empty html gives an empty text; a null url counts as a host of its own
    * a page without any container gives its text outside links, block by block
    * repeated rows repeat their result; ties in a vote go to the deeper path, then to the higher score
    * an empty table gives no rows; other columns are ignored
    """
    winners = stored(consensus(pages), "host-paths")
    cast = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host")
    )
    joined = cast.join(small_or_not(winners), "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, by_consensus boolean")
