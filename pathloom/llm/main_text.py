"""Main text of HTML pages by minimum-cut labelling of their text blocks.

A page becomes a sequence of text blocks in a tree of elements.  A linear classifier (elements,
graded cues of names, link density, length, sentence ends) gives each block a cost for either
label; these are its capacities from the source (content) and to
the sink (boilerplate).  Neighbours in page order and neighbours in the element tree are tied
by smoothness edges, stronger the nearer they are.  The blocks on the source side of a
minimum cut, found by maximum flow, are the content.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mapped

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*|[^>]*)(?:>|\Z)|<|[^<]+""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|["'][^\s]*""")
SPACE = re.compile(r"\s+")
ONLY = {tag: re.compile(rf"<{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("article", "main")}
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SENTENCE_ENDS = frozenset(".!?…。！？:;»\"”")

# Element classes of HTML.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select noframes xmp plaintext".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# The classifier.  Positive is content.
BIAS = -0.4
ELEMENT_WEIGHT = {
    "article": 4.0, "main": 3.0, "nav": -12.0, "aside": -12.0, "footer": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0, "header": -4.0,
    "button": -12.0, "fieldset": -5.0, "figcaption": 0.5, "blockquote": 0.8, "pre": 0.8, "head": -20.0,
}
LEAF_WEIGHT = {"p": 1.0, "h1": 0.8, "h2": 0.4, "h3": 0.4, "li": -0.3, "td": 0.0, "pre": 0.6, "blockquote": 0.6}
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars aside rail footer masthead topbar toolbar "
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners sponsor sponsored sponsors promo promos promotion "
    "comment comments commentlist disqus respond reply replies discussion reviews guestbook "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login register "
    "share sharing social related recommended recommendations trending popular pagination pager widget widgets tags tagcloud copyright legal disclaimer skip search".split()
)
CONTENT_NAMES = frozenset("article articlebody story storybody post postbody entry content maincontent bodytext main".split())
#: What a name's head says little about: boxes.  ``ad-slot`` is an advert, ``notice-period`` isn't a notice.
BOX_NAMES = frozenset("list wrap wrapper box container bar area block section sections links link buttons button item items form message messages panel inner outer holder slot unit text title heading icons icon top bottom left right main primary secondary posts stories articles feed row col column group strip header footer".split())
#: States and taxonomies: such names say what else a page has or is about.
OTHER_FIRST, OTHER_LAST = frozenset("no has with without is not tag category cat post page status type format single author term js hide show".split()), frozenset("open closed enabled disabled on off active inactive loaded free".split())
WHOLE_NAME, LAST_PART, FIRST_PART, CONTENT_NAME = -12.0, -10.0, -8.0, 1.5
#: What of a name's weight a level of elements below keeps.
NAME_DECAY = 0.9
ROLE_WEIGHT = {"navigation": -12.0, "banner": -9.0, "contentinfo": -12.0, "complementary": -12.0, "search": -12.0, "form": -12.0, "alert": -12.0, "dialog": -12.0, "menu": -12.0, "main": 3.0, "article": 3.0}
HIDDEN_WEIGHT = -30.0
LINK_WEIGHT, LONG_WEIGHT, SENTENCE_WEIGHT = -3.0, 1.2, 0.5
#: Smoothness of neighbours in page order, of blocks with one parent, and what each level of distance takes.
ORDER_EDGE, PARENT_EDGE, DISTANCE = 1.5, 1.0, 0.55
SCALE = 1000


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    node: int  # of the innermost block element
    weight: float  # of the elements, names and roles above
    leaf: str


def name_weight(name: str) -> float:
    """What one whole class or id says: the cue is the whole name, its last part, or its first part before names of boxes."""
    parts = [x.lower() for x in PARTS.findall(name)]
    if not parts:
        return 0.0
    whole = "".join(parts)
    if whole in BOILERPLATE_NAMES:
        return WHOLE_NAME
    if len(parts) > 1 and (parts[0] in OTHER_FIRST or parts[-1] in OTHER_LAST) and whole not in CONTENT_NAMES:
        return 0.0
    if whole in CONTENT_NAMES or parts[-1] in CONTENT_NAMES and parts[0] not in BOILERPLATE_NAMES:
        return CONTENT_NAME
    if "header" in (whole, parts[-1]):
        return -4.0
    while len(parts) > 1 and parts[-1].isdigit():
        parts.pop()
    if parts[-1] in BOILERPLATE_NAMES:
        return LAST_PART
    return FIRST_PART if parts[0] in BOILERPLATE_NAMES and all(x in BOX_NAMES or x in BOILERPLATE_NAMES or x.isdigit() for x in parts[1:]) else 0.0


def _weights(tag: str, attributes: str) -> tuple[float, float]:
    """(weight of the element, its role and state; weight of its names).  Names of the whole page's elements are states, ids of headings are anchors."""
    weight, low, high = ELEMENT_WEIGHT.get(tag, 0.0), 0.0, 0.0
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
                return HIDDEN_WEIGHT, 0.0
            if name == "role":
                weight += ROLE_WEIGHT.get(value.lower(), 0.0)
            elif name in ("class", "id", "itemprop") and tag not in ("html", "body") and not (name == "id" and tag in HEADINGS):
                for cue in map(name_weight, value.split()):
                    low, high = min(low, cue), max(high, cue)
    return weight, low if low < -2 else low + high


class Elements:
    """Parents and depths of a page's block elements."""

    def __init__(self) -> None:
        self.parent, self.depth = [0], [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def distance(self, a: int, b: int, most: int) -> int:
        """Steps between two elements over their nearest common one, counted up to ``most``."""
        steps = 0
        while a != b and steps < most:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a = self.parent[a]
            steps += 1
        return steps


#: Elements that the start of another one ends; a start that ends none of these ends an open paragraph.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


@dataclass(slots=True)
class _Open:
    tag: str
    node: int  # its own if a block element, else that of the one it is in
    firm: float  # weights of elements, roles and states from the root
    soft: float  # weights of names, decayed


def blocks(page: str) -> tuple[list[Block], Elements]:
    """The page's text blocks.  Tags of inline elements don't part blocks; raw elements and comments hold no text.

    Linear in the page: what an end tag looks for is counted, so a search that must fail is not begun.
    """
    out: list[Block] = []
    elements = Elements()
    stack = [_Open("", 0, 0.0, 0.0)]
    levels = [0]  # places of block elements in the stack
    count = Counter()  # open elements by tag
    parts: list[str] = []
    links = 0
    lowered = None

    def flush() -> None:
        nonlocal links
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            top = stack[-1]
            out.append(Block(text, links, top.node, top.firm + top.soft, stack[levels[-1]].tag))
        parts.clear()
        links = 0

    def close(k: int) -> None:
        for e in stack[k:]:
            count[e.tag] -= 1
        del stack[k:]
        while levels[-1] >= k:
            levels.pop()

    alone = [tag for tag, pattern in ONLY.items() if sum(1 for _ in islice(pattern.finditer(page), 2)) == 1]
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                parts.append(piece)
                if count["a"]:
                    links += len(piece)
            elif piece.startswith("<![CDATA["):
                parts.append(html.escape(piece[9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            if count[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW:
            lowered = page.lower() if lowered is None and len(page.lower()) == n else lowered
            end = (lowered or page).find(f"</{tag}", at)
            at = n if end < 0 else (page.find(">", end) + 1 or n)
            if tag not in INLINE:
                parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P or tag in ENDED_BY or tag == "option":
            ends = ENDED_BY.get(tag, ("p",))
            for level in reversed(levels[1:]):
                if stack[level].tag in ends:
                    close(level)
                    break
                if stack[level].tag not in ("td", "th", "p"):
                    break
        if m[3].endswith("/") and tag in ("path", "g"):
            continue
        firm, soft = _weights(tag, m[3])
        if tag in alone:  # a page's only article is the article, whatever its class says of its topic
            soft = max(soft, 0.0)
        above = stack[-1]
        block = tag not in INLINE
        node = elements.add(above.node) if block else above.node
        kept = above.soft * NAME_DECAY if block else above.soft
        if block:
            levels.append(len(stack))
        stack.append(_Open(tag, node, max(-60.0, above.firm + firm), kept + soft))
        count[tag] += 1
    flush()
    return out, elements


def log_odds(block: Block) -> float:
    """The classifier: how much likelier content than boilerplate."""
    size = len(block.text)
    share = min(1.0, block.link_chars / size)
    odds = BIAS + block.weight + LEAF_WEIGHT.get(block.leaf, 0.0) + LINK_WEIGHT * share + LONG_WEIGHT * min(1.0, size / 200)
    return odds + SENTENCE_WEIGHT * (block.text[-1] in SENTENCE_ENDS)


def edges(found: list[Block], elements: Elements) -> list[tuple[int, int, int]]:
    """Smoothness edges: neighbours in page order, and each block with the next one of its parent."""
    out = []
    last: dict[int, int] = {}
    for k, block in enumerate(found):
        if k:
            far = max(0, elements.distance(found[k - 1].node, block.node, 24) - 2)
            out.append((k - 1, k, int(SCALE * ORDER_EDGE * DISTANCE**far)))
        parent = elements.parent[block.node]
        if (before := last.get(parent)) is not None and before < k - 1:
            out.append((before, k, int(SCALE * PARENT_EDGE)))
        last[parent] = k
    return [e for e in out if e[2] > 0]


def min_cut(source: list[int], sink: list[int], between: list[tuple[int, int, int]]) -> list[bool]:
    """For each node whether it stays on the source side of a minimum cut.

    Dinic's maximum flow.  The flow straight through each node is sent first, which leaves a
    node an excess or a lack only.
    """
    n = len(source)
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(a: int, b: int, there: int, back: int) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(there)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    s, t = n, n + 1
    for k in range(n):
        straight = min(source[k], sink[k])
        if source[k] > straight:
            add(s, k, source[k] - straight, 0)
        if sink[k] > straight:
            add(k, t, sink[k] - straight, 0)
    for a, b, w in between:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        trail: list[int] = []
        a = s
        while True:
            if a == t:
                most = min(room[e] for e in trail)
                for e in trail:
                    room[e] -= most
                    room[e ^ 1] += most
                cut = next(i for i, e in enumerate(trail) if not room[e])
                a = to[trail[cut] ^ 1]
                del trail[cut:]
                continue
            while turn[a] < len(heads[a]):
                e = heads[a][turn[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    trail.append(e)
                    a = to[e]
                    break
                turn[a] += 1
            else:
                if a == s:
                    break
                a = to[trail.pop() ^ 1]
                turn[a] += 1


def labelled(page: str) -> list[tuple[Block, bool]]:
    """Every block with whether it is content."""
    found, elements = blocks(page)
    if not found:
        return []
    odds = [round(SCALE * log_odds(b)) for b in found]
    return list(zip(found, min_cut([max(0, x) for x in odds], [max(0, -x) for x in odds], edges(found, elements)), strict=True))


def main_text(page: str | None) -> str:
    return " ".join(b.text for b, content in labelled(page or "") if content)


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points), n_blocks, n_content.

    The whole html is read.  Null, empty or text-free html gives an empty text; a page
    without any cue of an article gives the blocks the classifier and their neighbours speak
    for; broken markup (open elements, comments or tags at the end) is read as far as it
    goes; repeated rows give repeated results; an empty table gives an empty result; other
    columns aren't read.  No shuffle.
    """
    table = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("__html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [labelled(h or "") for h in part.column(2).to_pylist()]
                texts = [" ".join(b.text for b, content in f if content) for f in found]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                columns += [pa.array([len(f) for f in found], pa.int64()), pa.array([sum(c for _, c in f) for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    return mapped(table, run, f"{kinds}, text string, n_chars long, n_blocks long, n_content long")
