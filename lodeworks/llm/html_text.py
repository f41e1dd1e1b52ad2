"""Main text of web pages by tag-path ratios (after Wu, Li, Hu and Wu, Web news extraction via path ratios)."""

from __future__ import annotations

import heapq
import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame

# HTML elements by how they shape text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object svg math canvas audio video dialog menu input fieldset title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of class, id and role names that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu topbar sidebar side footer header masthead cookie cookies consent gdpr notice alert"
    " comment comments disqus replies respond share sharing social related recommended newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager popup modal overlay widget toolbar search complementary contentinfo".split()
)
OWN = frozenset("article entry post content story main body text page".split())

#: Marks of what readers or nobody sees as part of the page: these hold unless nothing else is left. An element of its own that is
#: named for one comment may be an opinion piece: it holds while the rest of the page is longer.
FIRM = frozenset("comments disqus replies respond hidden".split())
OPINION = "comment"
#: Compounds of one word that name readers' comments, and words that make other marks mean a subject.
COMMENTS = re.compile(r"(?:user|reader)?comments?(?:list|thread|section|area|form|box|wrap|wrapper|container|feed|block)|(?:user|reader)comments|(?:user|reader|your)-?(?:responses|replies)|responses")
SUBJECT = frozenset("work works research literature studies".split())
#: Marks for which an inline element is left out of the text around it.
INLINE_MARKS = frozenset("hidden ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo share sharing social".split())
#: Headings over links to other pages than those that an article rests on.
ELSEWHERE = re.compile(r"\b(?:related|more|next|popular|recommended|latest|trending|also like|share|follow|topics|tags|categories|archives?|newsletter|most read)\b", re.I)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
PLAIN = re.compile(r"[^\s>]*")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
STOPS = re.compile(r"[.,;:!?、。，！？；]")
#: Start tags that end an open element, unless one of the others stands between them.
ENDS = {
    **{t: (("p",), ("td", "th", "table", "button", "object")) for t in CLOSES_P}, "li": (("li",), ("ul", "ol", "menu")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",)),
    **{t: (("td", "th"), ("tr", "table")) for t in ("td", "th")}, **{t: (("dt", "dd"), ("dl",)) for t in ("dt", "dd")},
}


class Node:
    """An element: its path (a number per path of tags and classes), what it lies in, and whether it counts."""

    __slots__ = ("above", "article", "code", "dropped", "header", "holder", "kind", "link", "marked", "number", "path", "tag", "words")

    def __init__(self, tag, above, number, path):
        self.tag, self.above, self.number, self.path, self.words, self.kind = tag, above, number, path, frozenset(), None
        self.code = tag in ("pre", "code") or bool(above and above.code)
        self.article = self.link = self.header = self.dropped = False
        self.marked = above.marked if above else None  # the nearest element around it, or it, that bears marks
        self.holder = above.holder if tag in INLINE and above else self


class Block:
    __slots__ = ("bits", "dropped", "heading", "linked", "node", "text")

    def __init__(self, node):
        self.node, self.bits, self.linked, self.text, self.heading = node, [], 0, "", node.tag in HEADINGS
        self.dropped = node.dropped or (node.header and not self.heading)

    @property
    def path(self) -> int:
        return self.node.path

    def links(self) -> bool:
        """Whether most of the text stands in links."""
        return 2 * self.linked > len(self.text)


class Scanner:
    """Tokens of a page in one pass: places of quotes and brackets are looked for once, however broken the page is."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def find(self, what: str, at: int) -> int:
        """The first place of what from at on, -1 if there is none; at must not fall from call to call."""
        known = self.known.get(what, -2)
        if known == -2 or 0 <= known < at:
            known = self.known[what] = self.page.find(what, at)
        return known

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """(name, value) pairs from the end of a tag's name, and where the tag ends; -1 if it never does.

        A quoted value that isn't followed by white space, '/' or '>' took in text by a stray quote: the tag then
        ends at the first '>'.
        """
        page, out = self.page, []
        stop = self.find(">", at)
        if stop < 0:
            return out, -1
        while m := ATTRIBUTE.match(page, at):
            name, at = m[1].lower(), m.end()
            value = ""
            if m[2]:
                quote = page[at : at + 1]
                if quote and quote in "\"'":
                    end = self.find(quote, at + 1)
                    if end < 0 or not (page[end + 1 : end + 2] in ("", ">", "/") or page[end + 1].isspace()):
                        return out, page.find(">", m.start()) + 1
                    value, at = page[at + 1 : end], end + 1
                else:
                    v = PLAIN.match(page, at)
                    value, at = v[0], v.end()
            out.append((name, value))
        end = page.find(">", at)
        return out, end + 1 if end >= 0 else -1

    def tokens(self) -> Iterator[tuple[str, str, list, int]]:
        """(kind, name or text, attributes, where it ends): kind is 'text', 'end' or 'start'."""
        page, at, n = self.page, 0, len(self.page)
        raw = ""
        while at < n:
            if raw:
                close = re.compile(rf"</{raw}\b", re.I).search(page, at)
                end = close.start() if close else n
                if end > at:
                    yield "text", page[at:end], [], end
                at, raw = end, ""
                continue
            lt = self.find("<", at)
            if lt < 0:
                yield "text", page[at:], [], n
                return
            if lt > at:
                yield "text", page[at:lt], [], lt
            at, ahead = lt, page[lt + 1 : lt + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = end + 3 if end >= 0 else n
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                at = end + 3 if end >= 0 else n
            elif ahead in ("!", "?"):
                end = self.find(">", at)
                at = end + 1 if end >= 0 else n
            elif ahead == "/" and (m := NAME.match(page, at + 2)):
                end = self.find(">", at)
                at = end + 1 if end >= 0 else n
                yield "end", m[0].lower(), [], at
            elif m := NAME.match(page, at + 1):
                tag = m[0].lower()
                found, end = self.attributes(m.end())
                if end < 0:
                    return  # a tag that never ends is no text
                at = end
                yield "start", tag, found, at
                if tag in RAW:
                    raw = tag
            else:
                yield "text", "<", [], at + 1
                at += 1


def _marks(tag: str, attributes: list[tuple[str, str]], in_article: bool) -> frozenset[str]:
    """The words among an element's names that say that it is not part of the article."""
    if tag in ("html", "body"):
        return frozenset()
    out = set()
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out.add("hidden")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                out.add("hidden")
        elif name in ("class", "id", "role"):
            for word in value.split():
                parts = [x.lower() for x in PARTS.findall(word)]
                if COMMENTS.fullmatch(word.lower()) or any(map(COMMENTS.fullmatch, parts)):
                    out.add("comments")
                if "related" in parts and SUBJECT.intersection(parts):
                    continue
                if not parts or parts[0] in ("no", "has", "with", "not", "without"):
                    continue
                hit = MARKS.intersection(parts)
                if hit and tag in ("article", "main") and not hit & {"comment", "comments", "replies", "ad", "ads", "advert", "related", "sponsored", "promo"}:
                    continue
                if hit and hit <= {"header", "side", "search", "banner"} and (in_article or OWN.intersection(parts)):
                    continue
                out |= hit
    return frozenset(out)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order: runs of text not broken by a block-level element. An open head ends where HTML ends it.

    Linear in the page: the open elements are kept by tag, too, and paths are numbers.
    """
    root = Node("", None, 0, 0)
    stack, where, paths = [root], defaultdict(list), {}
    out: list[Block] = []
    now: Block | None = None
    number = 0

    def push(node: Node) -> None:
        where[node.tag].append(len(stack))
        stack.append(node)

    def cut_to(size: int) -> None:
        while len(stack) > size:
            where[stack.pop().tag].pop()

    def last(tags: tuple) -> int:
        return max((where[t][-1] for t in tags if where[t]), default=0)

    def text(piece: str) -> None:
        nonlocal now
        if stack[-1].tag == "head" and not piece.isspace():
            cut_to(len(stack) - 1)
            now = None
        top = stack[-1]
        if now is None:
            if piece.isspace():
                return
            now = Block(top.holder)
            out.append(now)
        if (top.dropped and not now.dropped) or (top.marked is not now.node.marked and top.marked):
            return  # an inline element that is dropped or marked
        piece = entities.unescape(piece)
        now.bits.append(piece)
        if top.link:
            now.linked += len(piece)

    for kind, tag, attributes, _ in Scanner(page).tokens():
        if kind == "text":
            text(tag)
        elif kind == "end":
            if where[tag]:
                size = where[tag][-1]
                if any(x.tag not in INLINE for x in stack[size + 1 :]):
                    now = None
                cut_to(size)
            if tag not in INLINE:
                now = None
        else:
            if where["head"] and (tag == "body" or stack[-1].tag == "head" and tag not in IN_HEAD):
                cut_to(where["head"][-1])  # the end tag of a head may be left out: what cannot stand in it closes it
                now = None
            if tag == "br":
                text(" ")
                continue
            if tag not in INLINE:
                now = None
                if tag in ENDS:
                    own, stop = (last(x) for x in ENDS[tag])
                    if own > stop:
                        cut_to(own)
            if tag in VOID:
                continue
            top = stack[-1]
            number += 1
            names = " ".join(v for k, v in attributes if k == "class") if tag not in INLINE else ""
            node = Node(tag, top, number, top.path if tag in INLINE else paths.setdefault((top.path, tag, names), len(paths) + 1))
            node.article = top.article or tag in ("article", "main")
            node.link = top.link or tag == "a"
            node.header = top.header or (tag == "header" and top.article)
            node.dropped = top.dropped or tag in DROPPED or (tag == "header" and not top.article)
            if attributes and not node.code:
                words = _marks(tag, attributes, top.article)
                node.words = words & INLINE_MARKS if tag in INLINE else words
            if node.words:
                # elements of one kind, such as the parts of a layout, are judged together; numbers in names don't tell kinds apart
                node.marked, node.kind = node, (tag, DIGITS.sub("#", " ".join(v for k, v in attributes if k in ("class", "id", "role"))))
            push(node)
    for x in out:
        x.text = SPACE.sub(" ", "".join(x.bits)).strip()
    return _unmarked([x for x in out if x.text and not x.dropped])


def _unmarked(found: list[Block]) -> list[Block]:
    """The blocks outside elements that bear marks, but for elements that are marked and hold the article itself.

    Elements of one kind (same tag and names) are judged together, others of a like name are not touched by that. A kind
    that holds most of a page's text, three times as much as is left without it, is a layout or a subject, and is passed over. So is one element
    named for a comment that holds more than is left: several such are readers' comments. These and what is hidden stay out
    however long they are, unless nothing else is left.
    """
    passed: set = set()
    members: dict = defaultdict(set)
    words: dict = {}
    for x in found:
        n = x.node.marked
        while n is not None and n.number not in members[n.kind]:
            members[n.kind].add(n.number)
            words[n.kind] = n.words
            n = n.above.marked
    firm = {k for k, w in words.items() if FIRM & w or (OPINION in w and len(members[k]) > 1)}
    while True:
        kept, held = [], Counter()
        plain = 0
        verdict: dict[int, tuple | None] = {}  # by marked element: the kind that keeps it out
        for x in found:
            n, chain = x.node.marked, []
            while n is not None and n.number not in verdict:
                chain.append(n)
                n = n.above.marked
            kind = verdict[n.number] if n is not None else None
            for n in reversed(chain):  # outer elements first: the outermost one decides
                kind = kind or (n.kind if n.kind not in passed else None)
                verdict[n.number] = kind
            size = max(0, len(x.text) - x.linked)
            if kind:
                held[kind] += size
            else:
                kept.append(x)
                plain += size
        over = [k for k, n in held.items() if n and (not plain if k in firm else n > plain if OPINION in words[k] else n >= 3 * plain)]
        if not over:
            return kept
        passed.add(max(over, key=lambda k: (k not in firm, held[k], str(k))))


def _smooth(x: list[float], radius: int = 1) -> list[float]:
    """Gaussian smoothing in page order, weights renormalised at the ends."""
    w = [math.exp(-(k * k) / (2.0 * radius * radius)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(x)):
        pairs = [(x[i + k - radius], w[k]) for k in range(2 * radius + 1) if 0 <= i + k - radius < len(x)]
        out.append(sum(a * b for a, b in pairs) / sum(b for _, b in pairs))
    return out


def _whole(found: list[Block], chosen: set[int], inside: Node) -> list[Block]:
    """The article around an element: what the narrowest element of the content leaves out.

    The element widens to the article or main around it, then to its parents below body while they add no block
    of links. Beside it, elements that hold content come whole, and so does what follows the heading before it: an
    h1, or any heading that stands beside one of the elements around the content. Within it blocks of links come
    as paragraphs, or as a list under a heading such as one for sources: other lists of them are menus.
    """
    spine, n = [], inside
    while n is not None:
        spine.append(n)
        n = n.above
    spine.reverse()
    place = {x.number: k for k, x in enumerate(spine)}
    joins: dict[int, tuple[int, int]] = {x.number: (k, -1) for k, x in enumerate(spine)}  # last element in common, and the branch that leaves it

    def join(node: Node) -> tuple[int, int]:
        chain = []
        while node.number not in joins:
            chain.append(node)
            node = node.above
        for x in reversed(chain):
            k, branch = joins[x.above.number]
            joins[x.number] = (k, branch if x.above.number not in place else x.number)
        return joins[chain[0].number] if chain else joins[node.number]

    met = [join(b.node) for b in found]
    linked = {k for b, (k, _) in zip(found, met, strict=True) if b.links()}
    depth = max((k for k, x in enumerate(spine) if x.tag in ("article", "main")), default=len(spine) - 1)
    while depth > 1 and spine[depth - 1].tag not in ("html", "body") and depth - 1 not in linked:
        depth -= 1
    held = {n for b, (k, n) in zip(found, met, strict=True) if b.path in chosen and k < depth} - {-1}
    taken = [b.path in chosen or (k >= depth or n in held) and (not b.links() or k >= depth and b.node.tag == "p") for b, (k, n) in zip(found, met, strict=True)]
    under = False  # whether links here are listed under a heading of the article
    for k, (b, (at, _)) in enumerate(zip(found, met, strict=True)):
        if not b.links():
            under = b.heading and at >= depth and not ELSEWHERE.search(b.text)
        elif under and at >= depth:
            taken[k] = True
    first = taken.index(True)
    for k in range(first - 1, -1, -1):
        if found[k].links():
            break
        beside = found[k].node.above
        if found[k].heading and (found[k].node.tag == "h1" or beside is not None and place.get(beside.number, len(spine)) <= depth):
            taken[k:first] = [True] * (first - k)
            first = k
    return [b for b, t in zip(found, taken, strict=True) if t]


def content_paths(found: list[Block], level: float) -> set[int]:
    """The paths of content: those with a block whose fused ratio is at least level standard deviations."""
    sums: dict[int, list[int]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0, 0, 0])
        s[0] += max(0, len(b.text) - b.linked)
        s[1] += len(STOPS.findall(b.text)) if b.linked < len(b.text) / 2 else 0
        s[2] += 1
    ratio = [_smooth([sums[b.path][k] / sums[b.path][2] for b in found]) for k in (0, 1)]
    fused = [t * (q + 0.01) for t, q in zip(*ratio, strict=True)]
    mean = sum(fused) / len(fused)
    limit = level * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused))
    chosen = {b.path for b, x in zip(found, fused, strict=True) if x >= limit and x > 0 and 2 * b.linked <= len(b.text) and not b.heading}
    if not chosen:
        best = max(sums, key=lambda p: sums[p][0])
        chosen = {best} if sums[best][0] else set()
    return chosen


def main_text(page: str | None, level: float = 0.5, share: float = 0.8) -> str:
    """The article of a page, its blocks joined by two newlines; empty if there is none.

    Blocks within menus, headers, footers and the like go first, by tag and by marks in names (_unmarked). Per root-to-leaf tag path, text outside links
    and punctuation are summed and divided by the path's blocks; both ratios are smoothed over the page and
    fused by product, and blocks of at least level times the fused series' standard deviation are content. All
    of a content path's blocks are content, and so is what else stands in the innermost element that holds at
    least the given share of the content's characters (headings, short paragraphs, lists), widened by _whole.
    """
    found = blocks(page or "")
    if not found:
        return ""
    chosen = content_paths(found, level)
    if not chosen:
        return ""
    # the characters of content by element, from the leaves up: inner elements have higher numbers
    weight, nodes = Counter(), {}
    for b in found:
        if b.path in chosen:
            weight[b.node.number] += len(b.text)
            nodes[b.node.number] = b.node
    total, queue = sum(weight.values()), [-n for n in weight]
    heapq.heapify(queue)
    while queue:
        node = nodes[-heapq.heappop(queue)]
        if weight[node.number] >= share * total:
            break
        if node.above.number not in nodes:
            nodes[node.above.number] = node.above
            heapq.heappush(queue, -node.above.number)
        weight[node.above.number] += weight[node.number]
    if node.above is not None and any(b.node is node for b in found):
        node = node.above  # one single block: what stands beside it may belong to it
    return "\n\n".join(b.text for b in _whole(found, chosen, node))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars; see main_text.

    Null html counts as empty and gives an empty text; equal rows give equal rows; an empty table gives none;
    only page_id, url and html are read. Rows are handled one by one in Arrow batches: no shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
