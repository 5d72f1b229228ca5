"""Main text of web pages by a minimum cut over their text blocks.

A page is cut into blocks at block-level tags. A classifier turns each block's surroundings (container tags, class,
id and role words, links, length, place in an article) into a cost for either label, which becomes an edge to
the source or the sink; blocks next to each other and blocks of one container are tied by smoothness edges.
The maximum flow separates content from boilerplate at the least total cost. Blocks that no cut could put on the
other side are decided beforehand, so a long page takes time in proportion to its blocks.

Marks of page furniture (tags, class and id words, roles, hidden parts) count by what they hold: an element with
nearly all article-like text of the page is a wrapper and no furniture, one with few times the text that is left
without it costs less, any other one its full cost.

Null and empty pages give an empty text. Text may be of any length; nothing is dropped but markup and the
blocks on the sink's side. Unclosed and stray tags are tolerated: skipped elements without an end tag end at the
next block tag. An unfinished tag at the end is dropped.
Repeated rows give repeated results; extra columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .base import small_batches

# fixed values: tag roles of HTML and words that name page furniture
BLOCKS = set("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th blockquote pre figure figcaption hr nav header footer aside form fieldset menu address details summary dialog".split())
RAW = set("script style noscript template svg iframe textarea select option button object canvas title".split())
FURNITURE = set("nav footer aside form fieldset menu dialog".split())
BODY = set("article main".split())
WORDS = set(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget notice notices cookie "
    "cookies consent gdpr alert popup modal overlay subscribe newsletter signup login form search comment comments reply replies respond discussion disqus share sharing social related recommended pagination pager toolbar hidden".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|<[a-zA-Z/][^<>]*\Z|[^<]+|<""", re.DOTALL)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_WORD = re.compile(r"[a-z]+")
_STATE = re.compile(r"(?:^|[^a-z])(?:has|with|without|no|not)(?:[^a-z].*|$)")  # 'content-with-sidebar' has one beside it
_SITE = set("site global top main nav navbar masthead")
_NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS, key=len, reverse=True))})(?![a-zA-Z0-9:-])", re.IGNORECASE)
_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
# no start tag of these stands inside another one; an option ends where its list does or the next one starts
_FLAT = {t: re.compile(rf"<{t}(?![a-zA-Z0-9:-])", re.IGNORECASE) for t in ("select", "button")}
_OPTION = re.compile(r"</option\s*>|(?=</?(?:option|optgroup|select|datalist)(?![a-zA-Z0-9:-]))", re.IGNORECASE)
FULL, PROSE = 9.0, 80
WRAPPER = 0.9  # of the article-like text, what is left without the mark counting four times
EPS = 1e-9
NEXT, SAME = 0.4, 0.8  # smoothness of neighbours, and more if they share a container


def _names_furniture(value: str) -> bool:
    for token in value.split():
        words = _WORD.findall(_STATE.sub("", token))
        found = WORDS.intersection(words)
        if found - {"header"} or found and (len(words) == 1 or _SITE.intersection(words)):
            return True
    return False


def _furniture(tag: str, attrs: str, in_body: bool) -> str:
    """How an element is marked as furniture: by `kind`, or loosely by a `name` (form tags, class or id); else empty."""
    if tag in FURNITURE or (tag == "header" and not in_body):
        return "name" if tag in ("form", "fieldset") else "kind"
    kind, seen = "", set()
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), "".join(values).lower()
        if name in seen:  # the first of equal names counts
            continue
        seen.add(name)
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and _names_furniture(value):
            kind = kind or "name"
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            kind = "kind"
    return kind


def _costs(held: list[tuple[int, float]], outer: list[int]) -> list[float]:
    """The share of FULL that each block bears; `held`: (innermost mark or -1, article-like text) of the blocks."""
    void: set[int] = set()

    def active(k: int) -> int:
        while k in void:
            k = outer[k]
        return k

    while True:
        inside: dict[int, float] = {-1: 0.0}
        for k, size in held:
            k = active(k)
            inside[k] = inside.get(k, 0.0) + size
        free = inside.pop(-1)
        top = max(inside, key=lambda k: (inside[k], -k), default=-1)
        if top < 0 or not inside[top] or inside[top] < WRAPPER * (inside[top] + 4 * free):
            break
        void.add(top)
    cost = {-1: 0.0}
    for k in range(len(outer)):  # outer marks come first
        share = inside[k] / (inside[k] + 4 * free) if inside.get(k) else 0.0
        cost[k] = max(0.0 if k in void else min(1.0, 2 * (1 - share)), cost[outer[k]])
    return [cost[k] for k, _ in held]


def blocks(page: str) -> list[tuple[str, float, int]]:
    """(text, score, container) of each block: positive scores speak for content."""
    found: list[tuple[str, float, int]] = []
    stack: list[tuple[str, int, bool, int]] = [("", -1, False, 0)]  # tag, mark, in body, container
    outer: list[int] = []  # of each mark, the mark around it
    loose: list[bool] = []
    held: list[tuple[int, float]] = []
    endless: set[str] = set()  # tags without an end tag from here on
    parts: list[str] = []
    linked = link = serial = 0
    pos, n = 0, len(page)

    def flush() -> None:
        nonlocal linked, link
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            tag, mark, body, container = stack[-1]
            score = 3.0 if body else -0.5
            score += min(2.0, len(text) / 100) + (0.5 if tag in ("p", "h1", "h2", "h3", "blockquote", "pre") else 0.0)
            if linked * 2 > len(text):
                score -= 1.0 if body else 3.0
            found.append((text, score, container))
            prose = body or len(text) >= PROSE or mark < 0 or loose[mark] and tag in ("p", "h1", "h2", "h3", "blockquote", "pre")
            held.append((mark, float(max(0, len(text) - linked)) if prose and linked * 2 <= len(text) else 0.0))
        parts.clear()
        linked = link = 0

    while pos < n:
        m = _TOKEN.match(page, pos)
        pos, tag = m.end(), m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                parts.append(m[0])
                linked += len(m[0]) if link else 0
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = _OPTION.search(page, pos) if tag == "option" else None if tag in endless else _END[tag].search(page, pos)
                if end is None:
                    endless.add(tag)
                block = _NEXT_BLOCK.search(page, pos) if end is None else _NEXT_BLOCK.search(page, pos, end.start()) if tag == "option" else None
                again = _FLAT[tag].search(page, pos, end.start()) if end and tag in _FLAT else None
                if again:  # the end tag belongs to a later element
                    block = _NEXT_BLOCK.search(page, pos, again.start()) or again
                if block and (end is None or block.start() < end.start()):
                    pos = block.start()
                else:
                    pos = end.end() if end else n
            parts.append(" ")
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = 0 if m[1] else 1
        elif tag in BLOCKS:
            flush()
            if m[1]:
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
                del stack[at or len(stack) :]
            elif tag != "hr":
                if stack[-1][0] in ("p", "li", "dt", "dd") and tag in ("p", stack[-1][0], "div", "ul", "ol", "h1", "h2", "h3", "article", "footer", "section") and not (stack[-1][0] != "p" and tag in ("p", "div", "ul", "ol")):
                    stack.pop()
                serial += 1
                _, mark, body, _ = stack[-1]
                inside = body or tag in BODY
                # a paragraph or item belongs to the container around it
                group = stack[-1][3] if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr", "td") else serial
                if kind := _furniture(tag, m[3], body):
                    outer.append(mark)
                    loose.append(kind == "name")
                    mark = len(outer) - 1
                stack.append((tag, mark, inside, group))
    flush()
    return [(text, score - cost * (score + FULL), group) for (text, score, group), cost in zip(found, _costs(held, outer))]


def least_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut (of several, the one with the fewest such nodes).

    A node whose terminal capacity exceeds all its smoothness edges is on that side in every minimum cut; its edges
    then count for its neighbours' terminals, which may decide them in turn. Only what is left needs a flow.
    """
    n = len(scores)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    pull, room = list(scores), [sum(c for _, c in x) for x in near]
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(pull[i]) > room[i] + EPS:
            side[i] = pull[i] > 0
            for b, c in near[i]:
                if side[b] is None:
                    room[b] -= c
                    pull[b] += c if side[i] else -c
                    todo.append(b)
    for start in range(n):
        if side[start] is None:
            part, at = [start], {start: 0}
            for i in part:
                for b, _ in near[i]:
                    if side[b] is None and b not in at:
                        at[b] = len(part)
                        part.append(b)
            inner = [(at[i], at[b], c) for i in part for b, c in near[i] if b in at and i < b]
            for i, s in zip(part, _flow([pull[i] for i in part], inner)):
                side[i] = s
    return [bool(x) for x in side]


def _flow(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source's side after a maximum flow: blocking flows on level graphs, until no path is left."""
    n = len(scores)
    give, take = [max(0.0, s) for s in scores], [max(0.0, -s) for s in scores]
    ends: list[list[int]] = [[] for _ in range(n)]  # edge k leads to `to[k]`, k ^ 1 is its reverse
    to: list[int] = []
    left: list[float] = []
    for a, b, c in edges:
        ends[a].append(len(to))
        ends[b].append(len(to) + 1)
        to += [b, a]
        left += [c, c]
    while True:
        level = [0 if g > EPS else -1 for g in give]
        queue = [i for i in range(n) if not level[i]]
        for i in queue:
            for k in ends[i]:
                if left[k] > EPS and level[to[k]] < 0:
                    level[to[k]] = level[i] + 1
                    queue.append(to[k])
        if not any(take[i] > EPS for i in queue):
            return [x >= 0 for x in level]
        turn = [0] * n
        for source in range(n):
            path: list[int] = []
            i = source
            while give[source] > EPS:
                if take[i] > EPS:
                    least = min(give[source], take[i], *(left[k] for k in path))
                    give[source] -= least
                    take[i] -= least
                    for k in path:
                        left[k] -= least
                        left[k ^ 1] += least
                    cut = next((j for j, k in enumerate(path) if left[k] <= EPS), None)
                    if cut is not None:
                        i = to[path[cut] ^ 1]
                        del path[cut:]
                    continue
                while turn[i] < len(ends[i]):
                    k = ends[i][turn[i]]
                    if left[k] > EPS and level[to[k]] == level[i] + 1:
                        break
                    turn[i] += 1
                else:
                    if not path:
                        break
                    i = to[path.pop() ^ 1]
                    turn[i] += 1
                    continue
                path.append(k)
                i = to[k]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    edges = [(i, i + 1, NEXT + (SAME if found[i][2] == found[i + 1][2] else 0.0)) for i in range(len(found) - 1)]
    last: dict[int, int] = {}
    for i, (_, _, group) in enumerate(found):  # blocks of one container that others stand between
        if group in last and last[group] < i - 1:
            edges.append((last[group], i, SAME))
        last[group] = i
    keep = least_cut([s for _, s, _ in found], edges)
    return "\n\n".join(text for (text, _, _), k in zip(found, keep) if k)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Every column of `pages` but the markup, with `text` and `n_chars`."""
    keep = [(c, t) for c, t in pages.dtypes if c not in (column, "text", "n_chars")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h) for h in pdf[column]]
            yield pdf[[c for c, _ in keep]].assign(text=texts, n_chars=[len(t) for t in texts])

    return small_batches(pages).mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in keep), "text string, n_chars long"]))
