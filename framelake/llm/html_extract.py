"""HTML extraction by tag-path ratios.

Each page is one row, so the work is a map over pages: the text blocks of a page are grouped by their root-to-leaf path of block tags; a path's text length and
punctuation per block are its two ratios. Both are smoothed along the page, fused by product, and paths above a threshold are content. The content nodes then
name the roots (every `article` or `main` with a fair share of them, else the stretch from the first to the last), whose blocks are the text. Blocks below boilerplate
tags, roles, and, outside articles, classes and ids never count. Inside an article a name is boilerplate only if no word of it says anything else; elements of other
such names stand or fall by their paths, as a whole: at LOWERED of their score, most of their text must lie on paths above the threshold.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z)))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，；：！？、·،؛؟।]")

#: Tags that hold no element of their own.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags within a block: they break no text and add nothing to a path.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
                    " annotation annotation-xml audio button canvas datalist map object select svg template video math mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Tags whose content is never markup, and no text of the page.
_RAW = frozenset("script style textarea title noembed noframes xmp iframe".split())
_DROPPED = frozenset("nav footer aside form menu menuitem noscript template head button select option datalist fieldset dialog canvas svg annotation annotation-xml".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|adbox|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup"
    r"|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|widget|toolbar|header|masthead|topbar|footer|copyright|legal|related|recommended|share|sharing|social"
    r"|comments?|commentlist|replies|reply|disqus|respond|discussion|login|search|pagination|pager|tags?|skip)(?:$|[\s_-])",
    re.I,
)
#: Words that make a name inside an article boilerplate, if its other words are of BESIDE or numbers. Other words of _NAMES name parts of articles too.
_SURE = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo cookie cookies consent gdpr popup modal overlay newsletter subscribe signup nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar widget toolbar masthead topbar footer copyright comment comments commentlist disqus respond pagination pager".split()
)
_BESIDE = frozenset("alert area article bar block body bottom box button buttons container content entry form header inner item items left link links list main notice outer page panel post reply right section side site social text title top wp wrap wrapper".split())
_HEADERS = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
LOWERED = 0.5
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A start tag closes an open one of these, up to the nearest scope: what HTML leaves open on purpose.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NO_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())


def _boilerplate(tag: str, attributes: str, inside_article: bool) -> bool | None:
    """Whether an element is boilerplate; None if only its name says so and it stands inside an article, where such names prove nothing."""
    if tag in _DROPPED or tag == "header" and not inside_article:
        return True
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    unsure = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and _NAMES.search(value):
            if not inside_article:
                return True
            for one in value.lower().split() if tag not in _HEADINGS else ():
                words = {w for w in re.split("[_-]+", one) if w and not w.isdigit()}
                if words & _SURE and words <= _SURE | _BESIDE:
                    return True
                unsure |= bool(_NAMES.search(_HEADERS.sub(" ", one)))
        if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return None if unsure else False


@dataclass(frozen=True, slots=True)
class _Open:
    """An open element: the number of its tag path, the outermost element around it whose name may be boilerplate, and its outermost article or main (0: none).
    Whatever the depth, a block needs no more than its own element."""

    tag: str
    path: int
    unsure: int
    root: int


_TOP = _Open("", 0, 0, 0)


class _Stack:
    """Open elements, and how many there are of each tag, so that nothing is sought in vain."""

    def __init__(self):
        self.elements: list[_Open] = []
        self.count: Counter = Counter()
        self.paths: dict[tuple[int, str, bool], int] = {}
        self.number = 0

    def top(self) -> _Open:
        return self.elements[-1] if self.elements else _TOP

    def push(self, tag: str, unsure: bool) -> None:
        self.number += 1
        above = self.top()
        path = self.paths.setdefault((above.path, tag, unsure), len(self.paths) + 1)  # elements of unsure names make paths of their own
        root = above.root or (self.number if tag in ("article", "main") else 0)
        self.elements.append(_Open(tag, path, above.unsure or (self.number if unsure else 0), root))
        self.count[tag] += 1

    def close(self, tags, scope=()) -> bool:
        """Ends the innermost of these elements and all inside it, unless one of the scope lies between."""
        if not any(self.count[t] for t in tags):
            return False
        for k in range(len(self.elements) - 1, -1, -1):
            tag = self.elements[k].tag
            if tag in tags:
                for x in self.elements[k:]:
                    self.count[x.tag] -= 1
                del self.elements[k:]
                return True
            if tag in scope:
                return False
        return False


_P_SCOPE = frozenset("td th li article section div blockquote".split())


def blocks(page: str) -> list[tuple[_Open, str, int]]:
    """The text blocks of a page in order, each with the element that it stands in and how many characters of it, without white space, are links; what surely is
    boilerplate is left out."""
    out: list[tuple[_Open, str, int]] = []
    stack = _Stack()
    dropped: list[str] = []  # open elements from the first boilerplate one on
    n_dropped: Counter = Counter()
    text: list[str] = []
    linked: list[str] = []
    in_link = False
    at = 0

    def flush() -> None:
        joined = " ".join("".join(text).split())
        if joined:
            out.append((stack.top(), joined, sum(map(len, "".join(linked).split()))))
        text.clear()
        linked.clear()

    while True:
        m = _TAG.search(page, at)
        if not dropped and (piece := page[at : m.start() if m else len(page)]):
            text.append(html.unescape(piece))
            if in_link:
                linked.append(text[-1])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        closing, tag = bool(m[1]), m[2].lower()
        if tag in _RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID:
            if tag == "br" and not dropped:
                text.append(" ")
            elif tag == "hr" and not dropped:
                flush()
            continue
        if dropped:  # only its own end, or an element around it that ends, opens the text again
            if not closing:
                dropped.append(tag)
                n_dropped[tag] += 1
            elif n_dropped[tag]:
                while n_dropped[tag]:
                    last = dropped.pop()
                    n_dropped[last] -= 1
                    if last == tag:
                        break
                continue
            if not (closing and stack.count[tag] and tag not in _INLINE):
                continue
            dropped.clear()
            n_dropped.clear()
        named = False if closing else _boilerplate(tag, m[3], bool(stack.top().root))
        if named:
            if tag not in _INLINE:
                flush()
            dropped.append(tag)
            n_dropped[tag] += 1
            continue
        if tag in _INLINE:
            in_link = not closing if tag == "a" else in_link
            continue
        flush()
        if closing:
            stack.close({tag})
            continue
        if tag in _NO_P:
            stack.close({"p"}, _P_SCOPE)
        stack.close(*_CLOSES.get(tag, ((), ())))
        stack.push(tag, named is None)
    if not dropped:
        flush()
    return out


def _smooth(values: list[float], radius: int) -> list[float]:
    """Gaussian smoothing along the page."""
    weights = [math.exp(-(k * k) / (2.0 * max(radius, 1) ** 2)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in enumerate(weights, -radius):
            if 0 <= i + k < len(values):
                total, weight = total + w * values[i + k], weight + w
        out.append(total / weight)
    return out


def content_paths(found: list[tuple[_Open, str, int]], radius: int, share: float) -> set[int]:
    """The tag paths above the threshold: `share` of the page's mean fused ratio; at least the best one."""
    sums: dict[int, list[float]] = {}
    paths = [at.path for at, _, _ in found]
    for path, (_, text, _) in zip(paths, found, strict=True):
        of = sums.setdefault(path, [0, 0, 0])
        of[0] += 1
        of[1] += len(text)
        of[2] += len(_PUNCTUATION.findall(text))
    lengths = _smooth([sums[p][1] / sums[p][0] for p in paths], radius)
    points = _smooth([sums[p][2] / sums[p][0] for p in paths], radius)
    fused = [n * (1.0 + p) for n, p in zip(lengths, points, strict=True)]
    by_path: dict[int, list[float]] = {}
    for path, value in zip(paths, fused, strict=True):
        by_path.setdefault(path, []).append(value)
    unsure = {at.path for at, _, _ in found if at.unsure}
    score = {p: sum(v) / len(v) * (LOWERED if p in unsure else 1.0) for p, v in by_path.items()}
    least = share * sum(fused) / len(fused)
    return {p for p, s in score.items() if s >= least} | {max(score, key=score.get)}


def main_text(page: str | None, radius: int = 1, share: float = 0.3) -> str:
    """The main text of a page: content blocks joined by newlines. radius: of the smoothing; share: of the mean fused ratio, that a path needs, and of the text of the
    page's heaviest article, that another one needs."""
    found = blocks(page or "")
    if not found:
        return ""
    content = content_paths(found, radius, share)
    # Elements of unsure names: their text on content paths, and all of it.
    judged: dict[int, list[int]] = {}
    weight: dict[int, int] = {}
    for at, text, _ in found:
        held = judged.setdefault(at.unsure, [0, 0])
        held[0] += len(text) * (at.path in content)
        held[1] += len(text)
        if at.root and at.path in content:
            weight[at.root] = weight.get(at.root, 0) + len(text)
    stays = {k for k, (on, of) in judged.items() if not k or 2 * on >= of}
    if weight:
        most = max(weight.values())
        roots = {root for root, n in weight.items() if n >= share * most}
        return "\n".join(text for at, text, _ in found if at.root in roots and at.unsure in stays)
    chosen = [k for k, (at, _, _) in enumerate(found) if at.path in content]
    first, last = chosen[0], chosen[-1]
    while first and found[first - 1][0].tag in ("h1", "h2"):  # a heading right above the content
        first -= 1
    # Between the first and the last content node, short blocks of any path belong to the text; paths that are mostly links only if they are content without the help
    # of their neighbours.
    alone = content_paths(found, 0, share)
    links: dict[int, list[int]] = {}
    for at, text, linked in found:
        of = links.setdefault(at.path, [0, 0])
        of[0], of[1] = of[0] + linked, of[1] + sum(map(len, text.split()))
    return "\n".join(text for at, text, _ in found[first : last + 1] if at.path in alone or 2 * links[at.path][0] < links[at.path][1])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column("html").to_pylist()]
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages(page_id, url, html).

    Null, empty and textless pages have an empty text. Every row is judged alone, rows that repeat too; nothing is cut or capped.
    """
    kind = dict(pages.dtypes)
    schema = f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long"
    return pages.select("page_id", "url", "html").mapInArrow(_extract, schema)
