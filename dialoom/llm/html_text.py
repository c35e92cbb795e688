"""Main text of web pages by tree scoring.

Paragraph-like blocks pass points to their ancestors: one, one for each comma, and one for each hundred characters
up to three; the parent gets all of them, the grandparent half, three further ancestors a sixth and less. A container's points are
discounted by its link density, the share of its characters that are link text. The best container is kept with those of its
siblings that score near it, or that are plain paragraphs with few links.

Where little text is left that way, the page is read again without the hints of classes and ids, and then with all elements.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("p div article section main body td th li ul ol dl dd dt pre blockquote h1 h2 h3 h4 h5 h6 table tr tbody thead tfoot header footer nav aside form figure figcaption html head address details summary fieldset".split())
_PARAGRAPH = frozenset("p td pre blockquote".split())
_DROP = frozenset("nav footer aside form button select head header".split())
#: What holds a page's content is never boilerplate for its class, id or parent.
_WHOLE = frozenset("html body main".split())
_NO_HINT = _WHOLE | {"article", "form"}
_IN_HEAD = frozenset("base link meta".split())
#: A reading that leaves fewer characters is held against the next ones, which take less for boilerplate.
ENOUGH = 250
#: Times as much text that such a reading must leave to count instead of a short one: short pages have menus and footers too.
FAR_MORE = 4
_CLOSES = {"p": _BLOCK - {"html", "body"}, "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
_HINT = re.compile(r"(?:class|id)\s*=\s*[\"']?[^\"'>]*\b(?:ad|ads|advert|banner|comment|cookie|footer|menu|nav|promo|related|share|sidebar|social|sponsor)\b", re.I)
#: Shares of a paragraph's points that its parent, grandparent and so on get.
_SHARES = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "score", "chars", "linked", "commas", "bad")

    def __init__(self, tag, parent, bad=False):
        self.tag, self.parent, self.bad = tag, parent, bad
        self.children: list = []
        self.score, self.chars, self.linked, self.commas = 0.0, 0, 0, 0


def parse(html: str, hints: bool = True, drop: frozenset = _DROP) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers mostly do. hints and drop: what marks boilerplate."""
    root = node = Node("html", None)
    at, end = 0, len(html)
    # Open elements by tag, so that a stray closing tag isn't sought up to the root.
    opened: Counter[str] = Counter()

    def leave(n: Node) -> Node:
        opened[n.tag] -= 1
        return n.parent

    while at < end:
        m = _PART.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            node.children.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                node.children.append(m["cdata"])
            continue
        tag = tag.lower()
        if m["end"]:
            if opened[tag] > 0:
                while node.tag != tag:
                    node = leave(node)
                node = leave(node)
            continue
        if tag in _RAW:
            closing = _RAW[tag].search(html, at)
            at = closing.end() if closing else end
            continue
        if tag in ("html", "body") and node is root and tag == "html":
            continue
        while node.parent is not None and tag in _CLOSES.get(node.tag, ()):
            node = leave(node)
        if node.tag == "head" and node.parent is not None and tag not in _IN_HEAD:
            node = leave(node)
        if tag == "br" or tag == "hr":
            node.children.append("\n")
        elif tag not in _VOID and not m["rest"].endswith("/"):
            bad = tag not in _WHOLE and (node.bad or tag in drop or hints and tag not in _NO_HINT and bool(_HINT.search(m["rest"])))
            if node.tag == "p" and tag in _BLOCK and node.parent is not None:
                node = leave(node)
            new = Node(tag, node, bad)
            opened[tag] += 1
            node.children.append(new)
            node = new
    return root


def _measure(root: Node) -> list[Node]:
    """Fills in chars, linked and commas of each node; nodes in document order."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    for n in reversed(order):
        own = [c for c in n.children if isinstance(c, str)]
        n.chars += sum(len(c.strip()) for c in own)
        n.commas += sum(c.count(",") + c.count("，") + c.count("、") for c in own)
        if n.tag == "a":
            n.linked = n.chars
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.commas += n.commas
    return order


def _text(nodes: list[Node]) -> str:
    out: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x if x == "\n" else _SPACE.sub(" ", x))
            continue
        if x.bad:
            continue
        if x.tag in _BLOCK:
            out.append("\n")
            stack.append("\n")
        stack.extend(reversed(x.children))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def _density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def extract(html: str | None) -> tuple[str, float]:
    """The main text and the score of its container.

    The first reading with any text counts, unless a later one has a scored block, ENOUGH characters and FAR_MORE than it.
    """
    if not html:
        return "", 0.0
    best = "", 0.0
    for hints, drop in ((True, _DROP), (False, _DROP), (False, _DROP - {"form"}), (False, frozenset(["head"]))):
        got = _read(parse(html, hints, drop))
        if not best[0] or got[1] > 0 and len(got[0]) >= max(ENOUGH, FAR_MORE * len(best[0])):
            best = got
        if best[1] > 0 and len(best[0]) >= ENOUGH:
            break
    return best


def _read(root: Node) -> tuple[str, float]:
    """Text and score of one reading. Without any scored block, all text outside boilerplate."""
    order = _measure(root)
    scored = []
    for n in order:
        if n.bad or n.tag not in _PARAGRAPH and not (n.tag == "div" and n.chars and not any(isinstance(c, Node) and c.tag in _BLOCK for c in n.children)):
            continue
        if n.chars < 25:
            continue
        points = 1 + n.commas + min(n.chars // 100, 3)
        up, level = n.parent, 0
        while up is not None and level < len(_SHARES):
            if up.score == 0.0:
                scored.append(up)
            up.score += points * _SHARES[level]
            up, level = up.parent, level + 1
    if not scored:
        return _text([root]), 0.0
    value = lambda n: n.score * (1 - _density(n))
    best = max(scored, key=value)
    if best.parent is None:
        return _text([best]), round(value(best), 4)
    near = max(10.0, 0.2 * value(best))
    keep = []
    for s in best.parent.children:
        if not isinstance(s, Node):
            continue
        if s is best or not s.bad and (value(s) >= near or s.tag == "p" and s.chars > 80 and _density(s) < 0.25 or s.tag == "p" and 0 < s.chars <= 80 and s.linked == 0 and any("." in c for c in _strings(s))):
            keep.append(s)
    return _text(keep), round(value(best), 4)


def _strings(n: Node):
    stack = [n]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                yield c
            else:
                stack.append(c)


def _run(batches):
    for b in batches:
        for at in range(0, b.num_rows, 64):
            part = b.slice(at, 64)
            got = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array([t for t, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["page_id", "text", "score"])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, score) of every page.

    Null and empty pages give an empty text and score 0, as do pages without text. Markup that isn't closed ends at the end
    of the page. Pages are parsed whole, without recursion, whatever their depth. Repeated rows give repeated rows; other columns are ignored.
    Of containers with equal scores the outermost that was scored first is kept.
    """
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(_run, "page_id long, text string, score double")
