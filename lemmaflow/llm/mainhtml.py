"""Main text of web pages by consensus host paths.

Each page scores its containers and names the tag-class path of the best one; Spark
counts these votes per host; then every page is read again along its host's winning
path, and what a page's own best container holds beside it is kept too.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Comments, sections, declarations and tags; last, a tag whose quotes don't close.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NOISE = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|sidebar|side-?nav|menu|nav|navbar|navigation|breadcrumbs?|comments?|replies|disqus|respond|footer|site-?header|masthead|topbar|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|popup|modal|overlay|pagination|pager|widget|toolbar|skip-?link)(?:$|[-_ ])", re.I)
DIGITS = re.compile(r"\d+")
#: What an article's own part may be called beside a noise word and still be noise; share-buttons are, a share-price isn't.
STRUCTURE = frozenset("area article articles bar block body bottom box btn button buttons card cards container content count counter cta danger div entry feed form group head header heading holder icon icons info inline inner item items label left link links list lists message meta more outer panel panels post posts primary reader readers reply right row rows secondary section sections site slot story stories sticky success tab tabs text thread title top unit units user warning wrap wrapper".split())
SIZE = re.compile(r"\d*(?:x\d+)?")
#: Class names that say what a page has or lacks, not what the element is.
STATE = re.compile(r"(?<!\S)(?:has|no|with|without|is)-\S+", re.I)

# HTML tags by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea title xmp noembed noframes".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog button select fieldset".split())
CONTAINERS = frozenset("body main article section div td table blockquote ul ol dl center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th thead tbody tfoot caption pre address header hr figure figcaption details summary hgroup".split())
# Noise whatever it holds; other noise may turn out to be a wrapper of the page. Only code runs to the end of a page if unclosed.
HARD = NOISE_TAGS - {"form", "fieldset"}
CODE = frozenset(["script", "style"])
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SAME_CLOSES = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}


def noisy_inside(label: str) -> bool:
    """Whether a class or id inside an article says noise: a noise word alone, or with words that say no more than what shape it has."""
    for name in label.lower().split():
        words = [w for w in re.split(r"[-_]+", name) if w]
        if any(NOISE.fullmatch(w) for w in words) and all(w in STRUCTURE or SIZE.fullmatch(w) or NOISE.fullmatch(w) for w in words):
            return True
    return False


class Page:
    """Blocks of text, each with the innermost container around it, read in one pass that takes time as the page is long.

    Containers and noise marks know what they stand in by number, so nesting of any depth
    costs a number each. A container's key stands for its path of tags and classes. Text
    keeps its noise mark until the page is read. A class name, form, fieldset or header
    is no noise if it wraps a main, or the page's only articles, or, on a page without
    either outside noise, most of the text outside links.
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []
        #: Key, depth, the container around it and tag.
        self.containers: list[tuple[str, int, int, str]] = []
        #: Tag, the innermost mark and the innermost container within.
        self.stack: list[tuple[str, int, int]] = []
        self.open_tags: Counter[str] = Counter()
        self.around_mark: list[int] = []
        self.soft: list[bool] = []
        self.cores: list[tuple[str, int]] = []
        self.unclosed: set[str] = set()
        self.parts: list[tuple[str, bool, int]] = []
        self.pieces: list[tuple[list[tuple[str, bool, int]], int]] = []
        self.read(source)
        self.flush()
        self.settle()

    def read(self, source: str) -> None:
        """Tags and text in order. After the last > there are no tags, so no search runs in vain to the end."""
        at, n = 0, source.rfind(">") + 1
        while at < n:
            m = TOKEN.search(source, at, n)
            if m is None:
                break
            self.text(source[at : m.start()])
            at = m.end()
            if m[2] is None and m[5] is None:
                if (m[0].startswith("<!--") and not m[0].endswith("-->")) or (m[0].startswith("<![CDATA[") and not m[0].endswith("]]>")):
                    return
                continue
            ends, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            tag = tag.lower()
            if ends:
                self.close(tag)
            elif tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    end = None if tag in self.unclosed else re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    if end is None and tag in CODE:
                        return
                    if end is None:
                        self.unclosed.add(tag)
                    at = end.end() if end else at
            else:
                self.open(tag, attributes)
        self.text(re.split(r"<!--|<!\[CDATA\[", source[at:], maxsplit=1)[0])

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append((raw, self.open_tags["a"] > 0, self.stack[-1][1] if self.stack else -1))

    def flush(self) -> None:
        if self.parts:
            self.pieces.append((self.parts, self.stack[-1][2] if self.stack else -1))
            self.parts = []

    def outer_marks(self, tags: tuple[str, ...]) -> set[int]:
        """The marks around elements of these tags."""
        seen: set[int] = set()
        for tag, mark in self.cores:
            while tag in tags and mark >= 0 and mark not in seen:
                seen.add(mark)
                mark = self.around_mark[mark]
        return seen

    def within(self, which: list[bool]) -> list[bool]:
        """Of each mark, whether it and all around it are among ``which``."""
        out: list[bool] = []
        for m, around in enumerate(self.around_mark):
            out.append(which[m] and (around < 0 or out[around]))
        return out

    def settle(self) -> None:
        """Decides which marks are noise and makes the blocks from the text outside them."""
        void, clean = [False] * len(self.soft), [False] * len(self.soft)
        free = lambda mark: mark < 0 or clean[mark]
        for tags in (("main",), ("main", "article")):
            if tags == ("main",) or not any(free(mark) for _, mark in self.cores):
                for m in self.outer_marks(tags):
                    void[m] = void[m] or self.soft[m]
                clean = self.within(void)
        if not any(free(mark) for _, mark in self.cores):
            soft, share, total = self.within(self.soft), [0] * len(self.soft), 0
            for parts, _ in self.pieces:
                for raw, linked, mark in parts:
                    if not linked and (mark < 0 or soft[mark]):
                        size = len("".join(raw.split()))
                        total += size
                        if mark >= 0:
                            share[mark] += size
            for m in range(len(share) - 1, -1, -1):
                if self.around_mark[m] >= 0:
                    share[self.around_mark[m]] += share[m]
            clean = self.within([void[m] or (self.soft[m] and 2 * share[m] > total) for m in range(len(void))])
        for parts, around in self.pieces:
            kept = [(raw, linked) for raw, linked, mark in parts if free(mark)]
            text = " ".join("".join(entities.unescape(raw) for raw, _ in kept).split())
            if text:
                linked = sum(len(raw) for raw, inside in kept if inside)
                self.blocks.append((text, min(linked, len(text)), around))

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.open_tags["p"]:
                self.close("p")
        if (same := SAME_CLOSES.get(tag)) and self.stack and self.stack[-1][0] == same:
            self.close(same)
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            return
        given = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
        inside = self.open_tags["article"] or self.open_tags["main"]
        label = STATE.sub(" ", f"{given.get('class', '')} {given.get('id', '')}".strip())
        core = tag in ("body", "html", "main", "article") or tag in HEADING
        says = bool(label) and not core and (noisy_inside(label) if inside else bool(NOISE.search(label)))
        noisy = tag in NOISE_TAGS or (tag == "header" and not inside) or says
        hard = tag in HARD or "hidden" in given or given.get("aria-hidden") == "true" or given.get("role") in ("navigation", "banner", "contentinfo", "complementary", "dialog", "alert", "search")
        _, mark, container = self.stack[-1] if self.stack else ("", -1, -1)
        if noisy or hard:
            self.around_mark.append(mark)
            self.soft.append(not hard)
            mark = len(self.soft) - 1
        if tag in ("article", "main"):
            self.cores.append((tag, mark))
        if tag in CONTAINERS:
            above, depth = self.containers[container][:2] if container >= 0 else ("", -1)
            classes = ".".join(sorted(DIGITS.sub("#", given.get("class", "")).split()))
            key = hashlib.blake2b(f"{above}>{tag}.{classes}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
            self.containers.append((key, depth + 1, container, tag))
            container = len(self.containers) - 1
        self.open_tags[tag] += 1
        self.stack.append((tag, mark, container))

    def close(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                break
            if tag not in CONTAINERS and tag not in NOISE_TAGS and self.stack[k][0] in CONTAINERS:
                return
        if any(e[0] in BLOCKS for e in self.stack[k:]):
            self.flush()
        for e in self.stack[k:]:
            self.open_tags[e[0]] -= 1
        del self.stack[k:]

    def scores(self) -> list[float]:
        """Characters outside links less those inside, over everything within a container."""
        out = [0.0] * len(self.containers)
        for text, linked, around in self.blocks:
            if around >= 0:
                out[around] += len(text) - 2 * linked
        for c in range(len(out) - 1, -1, -1):
            if self.containers[c][2] >= 0:
                out[self.containers[c][2]] += out[c]
        return out

    def best(self) -> tuple[str, float] | None:
        """Key of the path and score of the container of the main text.

        From the deepest container that holds nearly all of the best score it climbs to the
        outermost article or main around it; without one, to any that scores more.
        """
        scores = self.scores()
        if not scores or max(scores) <= 0:
            return None
        top = max(scores)
        k = max((c for c in range(len(scores)) if scores[c] >= 0.9 * top), key=lambda c: (self.containers[c][1], scores[c], -c))
        around = [k]
        while self.containers[around[-1]][2] >= 0:
            around.append(self.containers[around[-1]][2])
        core = [c for c in reversed(around) if self.containers[c][3] in ("article", "main")]
        k = core[0] if core else max(reversed(around), key=lambda c: (scores[c], self.containers[c][1]))
        return self.containers[k][0], scores[k]

    def along(self, paths: set[str]) -> str:
        """Text of the blocks within containers of those paths, or of every block if there are none."""
        chosen: list[bool] = []
        for key, _, around, _ in self.containers:
            chosen.append(key in paths or (around >= 0 and chosen[around]))
        return "\n".join(text for text, _, around in self.blocks if not paths or (around >= 0 and chosen[around]))


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(h, *best) for h, s in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) if (best := Page(s).best())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["host", "path", "score"])


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True):
            page = Page(source)
            own = page.best()
            text = page.along({x for x in (path, own and own[0]) if x is not None})
            if not text:
                text = page.along(set())
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """The path with most votes of each host; ties go to the higher total score, then to the path itself."""
    cast = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(votes, "host string, path string, score double")
    counted = cast.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    return counted.groupBy("host").agg(F.max(F.struct("n", "score", "path")).alias("x")).select("host", F.col("x.path").alias("path"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text and n_chars (code points).

    A block's white space becomes one space, and blocks are joined by line feeds in page
    order. Null or empty html, and pages with nothing but menus and the like, give empty
    text; a noise-like class that holds most of a page's unlinked text counts as a wrapper. Pages without a host vote together. Repeated rows vote and are answered each.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    out = rows.join(host_paths(pages), "host", "left").select("page_id", "url", "html", "path")
    return out.mapInArrow(extracted, "page_id bigint, url string, text string, n_chars bigint")
