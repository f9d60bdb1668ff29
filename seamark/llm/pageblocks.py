"""Text blocks of an HTML page from streaming parser events, and the choice of its content region."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np

INLINE = frozenset("a abbr b bdi big cite code em font i label mark q s small span strong sub sup time tt u wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template", "noscript", "title", "head"))
#: Tags that end when another of the same kind begins.
CLOSING = {"p": ("p",), "li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
#: Tags without attributes, and plain links: most of all tags, taken without the parser's general scan.
_PLAIN, _LINK, _END = re.compile(r"<([a-z][a-z0-9]*)>"), re.compile(r'<a href="[^"<>]*">'), re.compile(r"</([a-z][a-z0-9]*)>")
_RAW = frozenset("script style title textarea iframe noembed noframes xmp plaintext noscript".split())
#: Standard deviation, in lines, of the smoothing.
SIGMA = 0.7
#: Elements that are no region by themselves: the page as a whole, and single blocks and rows.
NO_REGION = frozenset("html body p li tr dt dd h1 h2 h3 h4 h5 h6 option caption".split())
#: Elements whose text directly in a region is its own, and elements that stand beside the content wherever they are.
PLAIN, BESIDE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split()), frozenset("aside nav footer form".split())
#: Share of linked characters from which on a box inside the region is a list of links.
LINKED = 0.5


class PageBlocks(HTMLParser):
    """Blocks of a page, each a line of its own: path, text, linked characters, tags since the block before, and the elements around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, int, int, tuple[int, ...]]] = []
        self.tags = 0
        self.stack: list[tuple[str, str, int]] = []  # tag, path, number
        self.elements = 0
        self.path, self.silent, self.link = "", 0, 0
        self.parts: list[str] = []
        self.split: dict[int, list[str]] = {}  # texts of blocks over several source lines
        self.closed: set[int] = set()  # numbers of elements that have ended
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            self.tags += 1
            if tag == "a":
                self.link += 1
            return
        if self.parts:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in SILENT:
            self.silent += 1
        for other in CLOSING.get(tag, ()):
            if self.stack and self.stack[-1][0] == other:
                self._pop()
                break
        name = tag
        for key, value in attrs:
            if key in ("class", "id", "role", "style", "width") and value:
                name = f"{name}.{value.replace('>', ' ')}"
        self.path = f"{self.path}>{name}"
        self.elements += 1
        self.stack.append((tag, self.path, self.elements))

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if self.parts and tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag in INLINE:
            if tag == "a" and self.link:
                self.link -= 1
            return
        if self.parts:
            self.flush()
        if self.stack and self.stack[-1][0] == tag:
            self._pop()
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                break

    def _pop(self):
        tag, _, number = self.stack.pop()
        self.closed.add(number)
        if tag in SILENT and self.silent:
            self.silent -= 1
        self.path = self.stack[-1][1] if self.stack else ""

    def handle_data(self, data):
        if self.silent:
            return
        self.parts.append(data)
        if self.link:
            self.linked += len(data)

    def parse_starttag(self, i):
        m = _LINK.match(self.rawdata, i)
        if m:
            self.handle_starttag("a", ())
            return m.end()
        m = _PLAIN.match(self.rawdata, i)
        if m and m[1] not in _RAW:
            self.handle_starttag(m[1], ())
            return m.end()
        return super().parse_starttag(i)

    def parse_endtag(self, i):
        m = None if self.cdata_elem else _END.match(self.rawdata, i)
        if m:
            self.handle_endtag(m[1])
            return m.end()
        return super().parse_endtag(i)

    def updatepos(self, i, j):
        return j  # lines are fed one by one, so they need not be counted

    def flush(self):
        whole = "".join(self.parts)
        text = " ".join(whole.split())
        if text:
            self.blocks.append((self.path, text, min(self.linked, len(text)), max(self.tags, 1), tuple(x[2] for x in self.stack)))
            self.tags = 0
            if "\n" in whole.strip():
                self.split[len(self.blocks) - 1] = [" ".join(x.split()) for x in whole.split("\n")]
        self.parts.clear()
        self.linked = 0


def parse(html: str) -> PageBlocks:
    """All blocks of a page; a page that is cut off gives the blocks up to there."""
    page = PageBlocks()
    for line in html.splitlines(keepends=True):
        page.feed(line)
    if page.parts:
        page.flush()
    page.cut = "</html>" not in html[-64:].lower()
    return page


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along lines; the kernel is renewed at the edges."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach:-reach] / np.convolve(np.ones(len(values)), kernel)[reach:-reach]


def two_clusters(values: np.ndarray) -> float:
    """Threshold between low and high values: the mid-point of two means, settled by iteration."""
    cut = float(values.mean())
    for _ in range(20):
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-6:
            break
        cut = float(new)
    return cut


def _tag(name: str) -> str:
    return name.partition(".")[0]


def content_region(page: PageBlocks, sigma: float = SIGMA, clustered: bool = True) -> tuple[list[bool], tuple[int, ...]]:
    """Which blocks stand in the content region, and the elements around and of the region.

    Every block is a line with its ratio of unlinked text to tags; smoothed ratios are parted into a high and a low
    cluster.  An element is worth the sum of the roots of its high lines' ratios, divided by the number of elements of
    its path, as a page has one main body but many boxes of a kind; blocks directly in the page's body count as
    an element per path.  The best element is the region, narrowed down to one inside it as long as that holds half the worth
    and the lines beside it are low on average.  Without any high line in an element the whole page is the region.
    """
    free = np.array([max(len(text) - linked, 0) for _, text, linked, _, _ in page.blocks], float)
    ratio = free / np.array([tags for _, _, _, tags, _ in page.blocks], float)
    smooth = smoothed(ratio, sigma) if sigma > 0 else ratio
    cut = two_clusters(smooth) if clustered else -1.0
    high = smooth > cut
    worth = np.where(high, np.sqrt(ratio), 0.0).tolist()
    total: dict[tuple, float] = {}
    depth: dict[tuple, tuple[int, str]] = {}
    for (path, _, _, _, around), value in zip(page.blocks, worth):
        names = path.split(">")[1:]
        at = ""
        for k, (name, number) in enumerate(zip(names, around)):
            at = f"{at}>{name}"
            if _tag(name) not in NO_REGION:
                key = (number,)
            elif k == len(names) - 1 and all(_tag(x) in ("html", "body") for x in names[:k]):
                key = (0, at)
            else:
                continue
            total[key] = total.get(key, 0.0) + value
            depth[key] = (k, at)
    paths: dict[str, int] = {}
    for _, at in depth.values():
        paths[at] = paths.get(at, 0) + 1
    rank = lambda key: (round(total[key] / paths[depth[key][1]], 6), depth[key], key)
    best = max(total, key=rank, default=None)
    if best is None or not total[best]:
        return [True] * len(page.blocks), ()
    if best[0] == 0:  # blocks directly in the page's body: all from the first to the last one that is high
        hits = [k for k, b in enumerate(page.blocks) if b[0] == best[1] and high[k]]
        return [hits[0] <= k <= hits[-1] for k in range(len(page.blocks))], ()
    while True:
        inside = [best[0] in b[4] for b in page.blocks]
        step = None
        for key in sorted(total, key=rank, reverse=True):
            if key[0] and key != best and depth[key][0] > depth[best][0] and total[key] >= total[best] / 2:
                beside = [ratio[k] for k, b in enumerate(page.blocks) if inside[k] and key[0] not in b[4]]
                if beside and any(key[0] in b[4] and best[0] in b[4] for b in page.blocks) and sum(beside) <= cut * len(beside):
                    step = key
                    break
        if step is None:
            break
        best = step
    around = next(b[4] for b, x in zip(page.blocks, inside) if x)
    return inside, around[: around.index(best[0]) + 1]


def content_blocks(page: PageBlocks, sigma: float = SIGMA, clustered: bool = True) -> tuple[list[bool | None], tuple[int, ...]]:
    """Which blocks are the page's own content (True), its frame (False), or boxes inside the region that this page alone does not decide (None); and the region's elements.

    In the region, the kind of block (path) of most worth and plain text and headings directly in it are content.  Elements
    that stand beside the content by their tag, wrappers (with a class) that frame the page outside the region too, and boxes of links
    are frame.  A heading of first order is content wherever it stands.
    """
    if not page.blocks:
        return [], ()
    inside, region = content_region(page, sigma, clustered)
    depth = len(region)
    mass: dict[str, float] = {}
    outside: set[str] = set()
    boxes: dict[tuple[int, ...], list[int]] = {}
    for (path, text, linked, tags, around), x in zip(page.blocks, inside):
        if not x:
            outside.update(n for n in path.split(">")[1:] if "." in n)
        else:
            mass[path] = mass.get(path, 0.0) + math.sqrt(max(len(text) - linked, 0) / tags) * max(len(text) - linked, 0)
            box = boxes.setdefault(around[depth : depth + 1], [0, 0])
            box[0] += linked
            box[1] += len(text)
    main = max(mass, key=lambda k: (mass[k], k), default="")
    verdict: list[bool | None] = []
    for (path, _, _, _, around), x in zip(page.blocks, inside):
        names = path.split(">")[1:]
        inner = names[depth:]
        if not x:
            verdict.append(bool(names) and _tag(names[-1]) == "h1")
        elif path == main or not inner or (len(inner) == 1 and inner[0] in PLAIN):
            verdict.append(True)
        elif depth and (any(_tag(n) in BESIDE for n in inner) or any(n in outside for n in inner)):
            verdict.append(False)
        elif not depth and any(_tag(n) in BESIDE for n in names):
            verdict.append(False)
        else:
            linked, size = boxes[around[depth : depth + 1]]
            verdict.append(False if linked > LINKED * size else None)
    return verdict, region
