"""Main text of web pages by site style trees.

All pages of a host are merged into one style tree. An element is known by its path of tags
and classes. Two measures are taken per host and path: presentation importance (entropy of
the ways its children are laid out) and content importance (one minus the mean entropy of its
texts over the pages; a text on every page has entropy 1, one on a single page 0). They are
combined level by level as a weighted sum, and branches below a threshold are removed from
the whole page, inside and outside of `<article>`.

The threshold of what stands beside the main text comes from the host itself: from the root, the
tree follows the container that holds most of the weighted text (importance times characters
outside of links); a branch beside it goes when its importance, scaled by its share of text, is
below `BESIDE` of that of the container. Names are evidence: of what is left, branches that their
tag or class calls navigation, advert, form and the like go too, unless what they hold outweighs
their name (`free_main`), as a wrapper around the article does.

The first pass maps pages to counted features; both aggregations combine before the shuffle,
so a hot host is no hot task. Elements on fewer than `LEAST_PAGES` pages of their host are summed
up under their parents, so that the rows of a host which one task judges are as many as the kinds
of elements that recur, not as its pages. The second pass meets each page with its host's removed
paths. Page texts are never shuffled unless the table of removed paths is too large to
broadcast, which the planner decides from the written size.

Defined cases: null or empty html gives an empty text; a url without a host belongs to the
host ""; on a host of fewer than `LEAST_PAGES` pages nothing can recur, so names alone decide there;
broken or unclosed markup ends open elements at the end of their parent; elements may be nested
to any depth; null or repeated page_id rows are kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.frames import map_batches
from twinsift.session import materialise

DECAY = 0.9           # weight of what is below against an element's own presentation
THRESHOLD = 0.2       # branches of less importance are removed
LEAST_PAGES = 4       # below that a host says nothing about what repeats
BESIDE = 0.5          # of the main container's importance; what stands beside it needs so much
LEADS = 0.5           # the main container holds so much of the weighted text of its parent
LONG_PATH = 200       # longer paths are shortened to a digest of their parent's and the name
FLUSH = 200_000
OUTWEIGHS = 4         # a branch with a noise name needs so many times the text of the unnamed ones,
PROSE = 200           # and so many characters; one with an article only more than the unnamed ones

#: Parts of a page that hold no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas".split())
APART = frozenset("nav header footer aside form menu dialog button select textarea".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i ins kbd label mark "
                   "q s samp small span strike strong sub sup time tt u var wbr img".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote div section article "
                       "header footer nav aside form figure main hr address".split())
NOISE = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|"
    r"side-?bar|footer|header|masthead|cookie\w*|consent|notice\w*|popup|modal|newsletter|"
    r"subscribe|social|share|sharing|related|recommend\w*|comments?|commentlist|disqus|reply|"
    r"replies|respond|login|signup|search|widgets?|pagination|pager|copyright|legal|gdpr)")
#: Parts of a class name that leave open what the rest says; those of OF_PAGE also name a headline's header.
NEUTRAL = frozenset("site top bottom left right primary secondary global main inner outer wrap wrapper container "
                    "area section box bar block list item items links link post posts 0 1 2 3 4".split())
OF_PAGE = frozenset("page article entry post main".split())
#: Containers that the way to the main text leads through.
CONTAINERS = frozenset("html body div main section article center table tbody tr td form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Noise by tag that no content outweighs.
STRICT = HIDDEN | frozenset("nav footer aside menu dialog button select textarea".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
NUMBER = re.compile(r"[0-9]{3,}")


class Element:
    __slots__ = ("tag", "name", "children", "noise", "path", "parent", "link")

    def __init__(self, tag: str, name: str, noise: bool, parent: "Element | None"):
        self.tag, self.name, self.noise = tag, name, noise
        self.children: list = []      # elements and strings
        self.parent = parent.path if parent else ""
        self.path = f"{self.parent}/{name}" if parent else ""
        if len(self.path) > LONG_PATH:
            self.path = f"~{hashlib.blake2b(self.parent.encode(), digest_size=12).hexdigest()}/{name[:LONG_PATH]}"
        self.link = tag == "a" or bool(parent and parent.link)


def noise_name(label: str) -> bool:
    """Does a whole class or id say noise? Each part of it must, or leave it open."""
    for token in label.lower().replace("side-bar", "sidebar").split():
        parts = [p for p in re.split("[-_]+", token) if p]
        said = [p for p in parts if NOISE.fullmatch(p)]
        rest = [p for p in parts if p not in said]
        if said and all(p in NEUTRAL or p in OF_PAGE or p.isdigit() for p in rest) and not (
                "header" in said and OF_PAGE.intersection(rest)):
            return True
    return False


def parse(page: str) -> Element:
    """A tolerant tree of the page. Character references stay as they are."""
    root = Element("", "", False, None)
    stack, at = [root], 0
    opened: Counter = Counter()       # how often a tag is open
    while True:
        m = MARKUP.search(page, at)
        text = page[at:m.start() if m else len(page)]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        ends, tag, marks = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if ends:
            while opened[tag]:
                last = stack.pop().tag
                opened[last] -= 1
                if last == tag:
                    break
            continue
        while len(stack) > 1 and _ends(stack[-1].tag, tag):
            opened[stack.pop().tag] -= 1
        known = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(marks)}
        label = " ".join(known.get(k, "") for k in ("class", "id"))
        # Long numbers in class names tell pages apart, not kinds of elements.
        marks_of = NUMBER.sub("0", SPACE.sub(".", (known.get("class") or "").strip()))
        name = f"{tag}.{marks_of}" if marks_of else tag
        noise = (tag in HIDDEN or tag in APART or noise_name(label)
                 or known.get("role", "").lower() in
                 ("navigation", "banner", "contentinfo", "complementary", "search", "dialog"))
        if tag in ("html", "body", "article", "main"):
            noise = False
        element = Element(tag, name, noise, stack[-1])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not marks.endswith("/"):
            stack.append(element)
            opened[tag] += 1


def _ends(opened: str, tag: str) -> bool:
    """Does the start of `tag` end the open element? Paragraphs and inline marks left open."""
    if opened == "p":
        return tag in PARAGRAPHS
    if opened in INLINE:
        return tag in PARAGRAPHS or tag == "li"
    return opened == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")


def plain(text: str) -> str:
    return SPACE.sub(" ", entities.unescape(text)).strip()


def blocks(root: Element, removed: frozenset, out: list[str], open_: list[str]) -> None:
    """Texts of the blocks in page order; `open_` collects the block that is not ended."""
    stack = [(iter(root.children), False)]
    while stack:
        children, is_block = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if is_block:
                _close(out, open_)
        elif isinstance(child, str):
            open_.append(child)
        elif child.noise or child.path in removed:
            if child.tag not in INLINE:
                _close(out, open_)
        elif child.tag in INLINE:
            open_.append(" " if child.tag == "br" else "")
            stack.append((iter(child.children), False))
        else:
            _close(out, open_)
            stack.append((iter(child.children), True))


def _close(out: list[str], open_: list[str]) -> None:
    text = plain("".join(open_))
    open_.clear()
    if text:
        out.append(text)


def main_text(page: str, removed: frozenset = frozenset(), names: bool = True) -> str:
    """Text of the page without removed branches and, if names count, without noise."""
    root = parse(page)
    if names:
        free_main(root, removed)
    else:
        stack = [root]
        while stack:
            element = stack.pop()
            element.noise = element.tag in HIDDEN
            stack += [c for c in element.children if isinstance(c, Element)]
    out: list[str] = []
    open_: list[str] = []
    blocks(root, removed, out, open_)
    _close(out, open_)
    return "\n".join(out)


def free_main(root: Element, removed: frozenset) -> None:
    """Clear the noise mark of branches whose content outweighs their name, largest first."""
    kept, named = _plain_size(root, removed)
    while named:
        weighed = [(*_whole_size(e, removed), i) for i, e in enumerate(named)]
        article, size, i = max(weighed)
        if not article > kept:
            size, article, i = max((s, a, i) for a, s, i in weighed)
            if size < PROSE or size <= OUTWEIGHS * kept:
                return
        branch = named.pop(i)
        branch.noise = False
        more, inside = _plain_size(branch, removed)
        kept, named = kept + more, named + inside


def _plain_size(top: Element, removed: frozenset) -> tuple[int, list[Element]]:
    """Characters outside of noise and removed branches, and the noise that may be outweighed."""
    size, named, stack = 0, [], [top]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, str):
                size += len(child.strip())
            elif child.path not in removed and child.tag not in STRICT:
                (named if child.noise else stack).append(child)
    return size, named


def _whole_size(top: Element, removed: frozenset) -> tuple[int, int]:
    """Characters in the largest article (or main) of a branch, and in all of it."""
    found, above, size = [top], [-1], []
    for i, element in enumerate(found):          # grows as it goes: children follow their parents
        size.append(sum(len(c.strip()) for c in element.children if isinstance(c, str)))
        inside = [c for c in element.children if isinstance(c, Element)
                  and c.path not in removed and c.tag not in STRICT]
        found += inside
        above += [i] * len(inside)
    largest = 0
    for i in range(len(found) - 1, 0, -1):
        if found[i].tag in ("article", "main"):
            largest = max(largest, size[i])
        size[above[i]] += size[i]
    return largest, size[0]


def page_features(page: str) -> set[tuple[str, str, bool, str, str]]:
    """(path, parent, link, kind, feature) of a page: how an element lays out its children, and its text."""
    seen = set()
    stack = [parse(page)]
    while stack:
        element = stack.pop()
        below = [c for c in element.children if isinstance(c, Element) and c.tag not in HIDDEN]
        if element.path:
            known = (element.path, element.parent, element.link)
            shape = "".join(
                f"{c.name}>" for i, c in enumerate(below) if i == 0 or below[i - 1].name != c.name)
            seen.add((*known, "shape", shape))
            text = plain("".join(c for c in element.children if isinstance(c, str)))
            if text:
                seen.add((*known, "text", text))
        stack += below
    return seen


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))


KEYS = ("host", "path", "parent", "link", "kind", "feature")


def style_tree(pages: DataFrame) -> DataFrame:
    """Every element of a host: host, path, parent, link, pages, chars (of its own texts), and its importances."""

    def run(batches):
        counts: Counter = Counter()
        chars: Counter = Counter()

        def flush():
            keys = list(counts)
            out = {n: [k[i] for k in keys] for i, n in enumerate(KEYS)}
            out |= {"n": [counts[k] for k in keys], "chars": [chars[k] for k in keys]}
            counts.clear()
            chars.clear()
            return out

        for batch in batches:
            for host, page in zip(batch["host"], batch["html"]):
                for *known, kind, feature in page_features(page or ""):
                    digest = hashlib.blake2b(feature.encode("utf-8", "replace"), digest_size=12)
                    key = (host, *known, kind, digest.digest())
                    counts[key] += 1
                    if kind == "text":
                        chars[key] += len(feature)
                if len(counts) > FLUSH:
                    yield flush()
        yield flush()

    features = map_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), run,
                           "host string, path string, parent string, link boolean, kind string, feature binary, "
                           "n long, chars long")
    summed = features.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    shape, text = F.col("kind") == "shape", F.col("kind") == "text"
    nlogn = F.col("n") * F.log("n")
    tree = summed.groupBy("host", "path", "parent", "link").agg(
        F.sum(F.when(shape, F.col("n"))).alias("pages"),
        F.sum(F.when(shape, nlogn)).alias("shape_nlogn"),
        F.count(F.when(text, 1)).alias("texts"),
        F.sum(F.when(text, F.col("n"))).alias("text_pages"),
        F.sum(F.when(text, nlogn)).alias("text_nlogn"),
        F.sum("chars").alias("chars"))
    m = F.log(F.col("pages").cast("double"))
    many = F.col("pages") >= LEAST_PAGES
    # Entropy over layouts to base m; entropy of a text on n of m pages is log n / log m.
    presentation = F.when(many, (m - F.col("shape_nlogn") / F.col("pages")) / m).otherwise(1.0)
    content = F.when(F.col("texts") == 0, F.lit(None)).when(
        many, 1 - F.col("text_nlogn") / F.col("text_pages") / m).otherwise(1.0)
    return tree.select("host", "path", "parent", "link", "pages", "chars", presentation.alias("presentation"),
                       content.alias("content"))


def frequent_tree(tree: DataFrame) -> DataFrame:
    """The elements on LEAST_PAGES pages or more; what rarer ones hold is in `rare_chars` of their parents.

    `rare` says that there are such children.
    """
    rare = (tree.filter(F.col("pages") < LEAST_PAGES).groupBy("host", F.col("parent").alias("path"))
            .agg(F.sum("chars").alias("rare_chars")))
    return (tree.filter(F.col("pages") >= LEAST_PAGES).join(rare, ["host", "path"], "left")
            .withColumn("rare", F.col("rare_chars").isNotNull()).fillna(0, ["rare_chars"]))


def low_paths(rows: list[dict], threshold: float = THRESHOLD) -> list[str]:
    """Topmost paths of low importance among the recurring elements of one host."""
    by_path = {r["path"]: r for r in rows}
    kids: dict[str, list[str]] = {}
    for r in rows:
        kids.setdefault(r["parent"] if r["parent"] in by_path else "", []).append(r["path"])
    order = list(kids.get("", []))
    for path in order:                           # parents first
        order += kids.get(path, [])
    value, weight, size = {}, {}, {}
    for path in reversed(order):
        r, below = by_path[path], kids.get(path, [])
        parts = [value[k] for k in below] + [1.0] * r["rare"]
        has_text = r["content"] is not None and not math.isnan(r["content"])
        if has_text:
            parts.append(r["content"])
        # The best part counts, so that a container lives as long as anything in it does.
        value[path] = (1 - DECAY) * r["presentation"] + DECAY * max(parts) if parts else max(r["presentation"], threshold)
        # Characters of the branch on a page, and how much of them counts: not links, not what recurs.
        own = r["chars"] / r["pages"]
        size[path] = own + r["rare_chars"] / r["pages"] + sum(
            size[k] * by_path[k]["pages"] / r["pages"] for k in below)
        counted = (own * r["content"] if has_text and not r["link"] else 0.0) + r["rare_chars"] / r["pages"]
        weight[path] = counted + sum(weight[k] * by_path[k]["pages"] / r["pages"] for k in below)
    low = {p for p in order if value[p] < threshold}

    def importance(path: str, main: str) -> float:
        """Share of the branch's text that counts, scaled by its size against the main container's."""
        if not size[path]:
            return 0.0
        return weight[path] / size[path] * math.sqrt(min(1.0, size[path] / max(size[main], 1e-9)))

    def tag(path: str) -> str:
        return path.rpartition("/")[2].partition(".")[0]

    at = ""
    while True:
        below = [k for k in kids.get(at, []) if k not in low]
        boxes = [k for k in below if tag(k) in CONTAINERS]
        total = sum(weight[k] for k in below)
        lead = max(boxes, key=lambda k: (weight[k], k), default=None)
        if lead is None or not total or weight[lead] < LEADS * total:
            break
        low |= {k for k in below if k != lead and tag(k) not in HEADINGS | INLINE
                and importance(k, lead) < BESIDE * importance(lead, lead)}
        at = lead
    return sorted(p for p in low if by_path[p]["parent"] not in low)


def low_branches(tree: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per host that has any: its topmost paths of low importance.

    A task holds the recurring elements of one host, of which there are as many as kinds of
    elements, not pages.
    """

    def judge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top = low_paths(rows.to_dict("records"), threshold)
        return pd.DataFrame([(key[0], top)] if top else [], columns=["host", "removed"], dtype=object)

    return frequent_tree(tree).groupBy("host").applyInPandas(judge, "host string, removed array<string>")


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = materialise(style_tree(pages), "style-tree")      # read twice: rare and recurring elements
    low = materialise(low_branches(tree, threshold), "branches").withColumnRenamed(
        "host", "__host")
    rows = pages.select("page_id", "url", "html").join(
        low, host_of(F.col("url")) == F.col("__host"), "left").drop("__host")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "", frozenset(r or ()))
                     for h, r in zip(batch["html"], batch["removed"])]
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts,
                   "n_chars": [len(t) for t in texts]}

    return map_batches(rows, run, f"page_id {kind}, url string, text string, n_chars long")
