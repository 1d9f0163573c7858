"""Union-free regular expressions over page structure.

A page is a stream of block tags and texts.  Its expression is a tree: an element
has a label, may be optional or repeated, and holds further elements and text
slots.  Neighbours of the same label, and runs of labels that follow themselves,
fold into one repeated element or group.  Two expressions are aligned child list by
child list; what only one of them has becomes optional.  An element whose children
come under too many labels tells them apart by their tags alone.

The texts of a page are those that fill its host's slots in the part of the
expression where most of the text that varies between pages is.  Trees are walked
with stacks of their own, so nesting has no limit.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Generator
from functools import lru_cache

import numpy as np

SLOT = "#"
#: Elements that hold no text of their own kind, end nothing and are never pushed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style template textarea noscript iframe svg math object canvas title".split())
#: Elements that run within a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag ends, and where the search for it stops.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)), "body": ("head", ())}
#: Words of class, id and role that mark parts around an article.
AROUND_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies dialog disqus footer form header menu modal nav navbar navigation newsletter "
    "notice notices popup promo promotion related search share sharing sidebar social sponsor sponsored subscribe tags toolbar widget".split())
AROUND_TAGS = frozenset("aside button datalist dialog fieldset footer form head header menu nav select".split())
#: Labels that an element's children may have before their tags alone count.
MOST_LABELS = 64
#: Pages that must agree on a text before it is a part of the site, and how much more of a page's text than the rest must be such for the page to be a copy.
AGREEING, COPIES = 3, 4
#: Elements of running text: the search for the main part ends above them.
TEXT_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Beside these the search does not go on: a title and a container's own text belong to what follows.
STAY = HEADINGS | {SLOT}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


class Node:
    """An element, a group (its label is a bracket and the labels of its run), or a slot.

    Of slots: pages, characters, characters inside links, the least and the greatest
    digest of a page's texts, and the page's texts by number.
    """

    __slots__ = ("label", "children", "optional", "repeated", "bare", "pages", "chars", "linked", "low", "high", "fills")

    def __init__(self, label: str, children: list[Node] | None = None, optional: bool = False, repeated: bool = False, bare: bool = False):
        self.label, self.children, self.optional, self.repeated, self.bare = label, [] if children is None else children, optional, repeated, bare
        self.pages = self.chars = self.linked = self.low = self.high = 0
        self.fills: list[int] = []


def _run(walk: Generator):
    """Value of a walk that yields the walks it needs: recursion on a list."""
    stack, value = [walk], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


@lru_cache(maxsize=1 << 14)
def _label(tag: str, attributes: str) -> str:
    """The tag with its class, id and role words; ``!`` marks what is not shown."""
    words, hidden = [], ""
    for m in _ATTRIBUTE.finditer(attributes) if attributes.strip() else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = "!"
        elif name in ("class", "id", "role"):
            words += re.findall(r"[a-z]+", value)
    return hidden + tag + "".join("." + w for w in sorted(set(words)))


def _bare(label: str) -> str:
    """The label without words that say nothing about the place of its text."""
    head, *rest = label.split(".")
    return ".".join([head, *(w for w in rest if w in AROUND_WORDS)])


def parsed(page: str) -> tuple[Node, list[str]]:
    """The page's tree, not folded, and its texts in order; a slot's text is the one its ``fills`` names."""
    root, texts = Node(""), []
    stack: list[tuple[str, Node]] = [("", root)]
    opened: Counter = Counter()
    parts: list[str] = []
    linked, links, entered, at = 0, 0, 1, 0

    def flush() -> None:
        nonlocal linked, entered
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                slot = Node(SLOT)
                slot.pages, slot.chars, slot.linked, slot.fills = 1, len(text), min(linked, len(text)), [len(texts)]
                slot.low = slot.high = zlib.crc32(text.encode("utf-8", "replace"))
                while entered < len(stack):  # elements enter the tree with their first text
                    stack[entered - 1][1].children.append(stack[entered][1])
                    entered += 1
                stack[-1][1].children.append(slot)
                texts.append(text)
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.strip())

    def leave(depth: int) -> None:
        nonlocal entered
        entered = min(entered, depth)
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in RAW:
            if not closing and not (m[3] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br":
            say("\n")
            continue
        if tag in INLINE or tag in ("img", "input", "wbr"):
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                leave(depth)
                links = 0
            continue
        if stack[-1][0] == "p":
            leave(len(stack) - 1)
        if tag in ENDS:
            ended, stop = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in ended.split():
                    leave(k)
                    break
        opened[tag] += 1
        stack.append((tag, Node(_label(tag, m[3] or ""))))
    flush()
    return root, texts


def expression(tree: Node) -> Node:
    """The tree folded, from the leaves up: one page's expression."""
    for node in reversed(list(_in_order(tree))):
        if len(node.children) > 1 and len({c.label for c in node.children}) < len(node.children):
            node.children = _run(_fold(node.children))
    return tree


def _fold(children: list[Node]):
    """Fold neighbours of one label, then runs of labels that follow themselves, short ones first."""
    labels = [c.label for c in children]
    if len(set(labels)) == len(labels):
        return children
    width = 1
    while 2 * width <= len(children):
        out, k = [], 0
        for begin, times in _tandems(labels, width):
            out += children[k:begin]
            merged = children[begin : begin + width]
            for t in range(1, times):
                following, joined = children[begin + t * width : begin + (t + 1) * width], []
                for a, b in zip(merged, following, strict=True):
                    joined.append(_of_slots(a, b, True) or (yield _merge(a, b, True)))
                merged = joined
            if width == 1:
                merged[0].repeated = True
                out.append(merged[0])
            else:
                out.append(Node("(" + json.dumps(labels[begin : begin + width], ensure_ascii=False), merged, repeated=True))
            k = begin + times * width
        if out:
            children = out + children[k:]
            labels = [c.label for c in children]
            if len(set(labels)) == len(labels):
                break
        width += 1
    return children


def _tandems(labels: list[str], width: int) -> list[tuple[int, int]]:
    """Begin and number of the repeats of runs of ``width`` labels, from the left, none overlapping."""
    n = len(labels)
    if n > 64:
        number = {x: k for k, x in enumerate(dict.fromkeys(labels))}
        ids = np.array([number[x] for x in labels])
        same = (ids[:-width] == ids[width:]).tolist()
    else:
        same = [labels[k] == labels[k + width] for k in range(n - width)]
    out, k = [], 0
    while k < len(same):
        if not same[k]:
            k += 1
            continue
        end = k
        while end < len(same) and same[end]:
            end += 1
        times = (end - k) // width + 1
        if times > 1:
            out.append((k, times))
        k = max(end, k + times * width)
    return out


def _of_slots(a: Node, b: Node, within: bool) -> Node | None:
    """The merged node where both are slots, or elements of one slot each."""
    if a.label == SLOT:
        out = Node(SLOT, None, a.optional or b.optional, a.repeated or b.repeated)
        out.pages, out.chars, out.linked, out.fills = max(a.pages, b.pages) if within else a.pages + b.pages, a.chars + b.chars, a.linked + b.linked, a.fills + b.fills
        if within:
            out.low = out.high = zlib.crc32(b"%d %d" % (a.low, b.low))
        else:
            out.low, out.high = min(a.low, b.low), max(a.high, b.high)
        return out
    if len(a.children) == len(b.children) == 1 and a.children[0].label == b.children[0].label == SLOT:
        return Node(a.label, [_of_slots(a.children[0], b.children[0], within)], a.optional or b.optional, a.repeated or b.repeated, a.bare or b.bare)
    return None


def _merge(a: Node, b: Node, within: bool):
    """One node for two of the same label; ``within`` a page a slot's texts count as one."""
    if (slots := _of_slots(a, b, within)) is not None:
        return slots
    out = Node(a.label, None, a.optional or b.optional, a.repeated or b.repeated, a.bare or b.bare)
    out.children = yield _align(a, b, within)
    if len(out.children) > MOST_LABELS and not out.bare:
        out.bare = True
        out.children = yield _fold(_relabelled(out.children))
    return out


def _relabelled(children: list[Node]) -> list[Node]:
    flat: list[Node] = []
    for c in children:
        flat += c.children if c.label.startswith("(") else [c]
    for c in flat:
        c.label = _bare(c.label)
    return flat


def _alike(a: Node, b: Node) -> tuple[list[Node], list[Node]]:
    """Children of both as they are to be compared: by bare labels if one is bare, in the groups that either has."""
    x, y = a.children, b.children
    if a.bare != b.bare:
        x, y = (x, _relabelled(y)) if a.bare else (_relabelled(x), y)
    groups = {c.label for c in x + y if c.label.startswith("(")}
    for group in sorted(groups):
        x, y = _grouped(x, group), _grouped(y, group)
    return x, y


def _grouped(children: list[Node], group: str) -> list[Node]:
    """Runs of the group's labels become the group."""
    unit = json.loads(group[1:])
    out, k = [], 0
    while k < len(children):
        run = children[k : k + len(unit)]
        if [c.label for c in run] == unit:
            out.append(Node(group, run))
            k += len(unit)
        else:
            out.append(children[k])
            k += 1
    return out


def _align(a: Node, b: Node, within: bool):
    """Longest common subsequence of labels; the others become optional, ``a``'s before ``b``'s."""
    x, y = _alike(a, b)
    pairs = common([c.label for c in x], [c.label for c in y])
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(x), len(y))]:
        for only in (*x[i:p], *y[j:q]):
            only.optional = True
            out.append(only)
        if p < len(x):
            out.append(_of_slots(x[p], y[q], within) or (yield _merge(x[p], y[q], within)))
        i, j = p + 1, q + 1
    return (yield _fold(out))


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in memory that grows with the lists' lengths and not their product."""
    if x == y:
        return [(k, k) for k in range(len(x))]
    out: list[tuple[int, int]] = []
    work = [(0, len(x), 0, len(y))]
    u = v = None

    def lengths(some: np.ndarray, other: np.ndarray) -> np.ndarray:
        row = np.zeros(len(other) + 1, dtype=np.int64)
        for label in some:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (other == label)))
        return row

    while work:
        i, p, j, q = work.pop()
        while i < p and j < q and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and x[p - 1] == y[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        if p - i == 1:
            if x[i] in y[j:q]:
                out.append((i, y.index(x[i], j, q)))
            continue
        if u is None:
            number = {label: k for k, label in enumerate(dict.fromkeys(x + y))}
            u, v = np.array([number[c] for c in x], dtype=np.int64), np.array([number[c] for c in y], dtype=np.int64)
        half = (i + p) // 2
        split = j + int(np.argmax(lengths(u[i:half], v[j:q]) + lengths(u[half:p][::-1], v[j:q][::-1])[::-1]))
        work += [(i, half, j, split), (half, p, split, q)]
    return sorted(out)


def merge(a: Node | None, b: Node) -> Node:
    """Expression of all pages of both, whose nodes it may take over."""
    return b if a is None else _run(_merge(a, b, False))


def _in_order(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(node.children)


def packed(root: Node) -> tuple[str, list[int]]:
    """The tree's shape as text, and five numbers of each slot, in order."""
    shape, numbers = [], []
    for node in _in_order(root):
        shape.append([node.label, len(node.children), int(node.optional) + 2 * int(node.repeated) + 4 * int(node.bare)])
        if node.label == SLOT:
            numbers += [node.pages, node.chars, node.linked, node.low, node.high]
    return json.dumps(shape, ensure_ascii=False, separators=(",", ":")), numbers


def unpacked(shape: str, numbers: list[int]) -> Node:
    top, at = Node("top"), 0
    open_: list[tuple[Node, int]] = [(top, 1)]
    for label, children, flags in json.loads(shape):
        node = Node(label, None, bool(flags & 1), bool(flags & 2), bool(flags & 4))
        if label == SLOT:
            node.pages, node.chars, node.linked, node.low, node.high = numbers[at : at + 5]
            at += 5
        parent, left = open_.pop()
        parent.children.append(node)
        if left > 1:
            open_.append((parent, left - 1))
        if children:
            open_.append((node, children))
    return top.children[0]


def added(a: list[int], b: list[int]) -> list[int]:
    """Numbers of two sets of pages with one shape."""
    out = [x + y for x, y in zip(a, b, strict=True)]
    out[3::5], out[4::5] = map(min, a[3::5], b[3::5]), map(max, a[4::5], b[4::5])
    return out


def is_around(label: str, inside_article: bool) -> bool:
    """True where the label says that the text below is not an article's."""
    tag, *words = label.lstrip("!").split(".")
    return label.startswith("!") or tag in AROUND_TAGS and not (tag == "header" and inside_article) or tag not in ("html", "body") and not AROUND_WORDS.isdisjoint(words)


class Wrapper:
    """A host's expression with what each slot counts for; says which texts of a page are the main ones."""

    def __init__(self, root: Node):
        self.root, self.chosen = root, {}
        self.place = {id(node): k for k, node in enumerate(_in_order(root))}
        self.up: dict[int, Node] = {}
        self.weight: dict[int, int] = {}
        self.node: dict[int, Node] = {}
        fixed: dict[int, int] = {}
        stack = [(root, False)]
        while stack:
            node, inside = stack.pop()
            heading = node.label.split(".")[0] in HEADINGS  # a title may be a link, or every page's
            for c in node.children:
                self.up[id(c)] = node
                if c.label == SLOT:
                    if heading or 2 * c.linked < c.chars:
                        self.node[id(c)] = c
                        same = not heading and c.pages >= AGREEING and c.low == c.high
                        (fixed if same else self.weight)[id(c)] = c.chars if heading else c.chars - c.linked
                elif c.label.startswith("(") or not is_around(c.label, inside):
                    stack.append((c, inside or c.label.lstrip("!").split(".")[0] == "article"))
        self.varying = self.weight.copy()
        self.weight |= fixed

    def main_text(self, page: str) -> str:
        tree, texts = parsed(page)
        filled: list[tuple[int, list[int]]] = []
        _run(self._matched(self.root, expression(tree), filled))
        present = frozenset(slot for slot, _ in filled if slot in self.weight)
        if present not in self.chosen:
            varying = frozenset(filter(self.varying.__contains__, present))
            mine, all_ = (sum(self.weight[k] for k in some) for some in (varying, present))
            self.chosen[present] = self._main(present if all_ - mine >= COPIES * mine else varying)
        chosen = self.chosen[present]
        return "\n".join(texts[k] for k in sorted(k for slot, fills in filled if slot in chosen for k in fills))

    def _matched(self, mine: Node, page: Node, filled: list[tuple[int, list[int]]]):
        """Adds the slots of the expression, with the page's texts that fill them."""
        bare = Node(page.label, page.children, bare=page.bare)
        x, y = list(mine.children), bare.children
        if mine.bare and not bare.bare:
            y = yield _fold(_relabelled(y))
        groups = {c.label for c in x + y if c.label.startswith("(")}
        for group in sorted(groups):
            y = _grouped(y, group)
        labels, want = [c.label for c in x], [c.label for c in y]
        for i, j in common(labels, want):
            if labels[i] == SLOT:
                filled.append((id(x[i]), y[j].fills))
            elif len(y[j].children) == len(x[i].children) == 1 and x[i].children[0].label == y[j].children[0].label == SLOT:
                filled.append((id(x[i].children[0]), y[j].children[0].fills))
            else:
                yield self._matched(x[i], y[j], filled)

    def _main(self, present: frozenset[int]) -> frozenset[int]:
        """Slots of the element that most of the weight of the slots present lies in."""
        kids: dict[int, list[Node]] = {}
        under: dict[int, int] = {}
        marked: list[Node] = []
        for slot in present:
            here = self.node[slot]
            under[slot] = self.weight[slot]
            marked.append(here)
            while here is not self.root:
                above = self.up[id(here)]
                kids.setdefault(id(above), []).append(here)
                if id(above) in under:
                    break
                under[id(above)] = 0
                marked.append(above)
                here = above
        for node in sorted(marked, key=lambda c: -self.place[id(c)]):
            if node is not self.root:
                under[id(self.up[id(node)])] += under[id(node)]
        at = self.root
        while id(at) in kids:
            children = kids[id(at)]
            top = min(children, key=lambda c: (-under[id(c)], self.place[id(c)]))
            tag = top.label.split(".")[0]
            left = {c.label.split(".")[0] for c in children if c is not top}
            if 10 * under[id(top)] < 6 * under[id(self.root)] or tag == SLOT or tag.startswith("(") or tag in TEXT_TAGS or left & STAY:
                break
            at = top
            if tag == "article":
                break
        chosen = set()
        stack = [id(at)]
        while stack:
            k = stack.pop()
            if k in present:
                chosen.add(k)
            stack += map(id, kids.get(k, ()))
        return frozenset(chosen)
