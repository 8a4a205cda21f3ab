"""Leaf blocks of HTML pages: text with its place in the tree, in one pass of linear time."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import xxhash

#: Elements that begin and end a block of text; all others run on within it.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Any of these ends any other.
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is shown as text of the page.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in "script style title textarea xmp iframe noembed noframes noscript".split()}
#: Elements with markup inside that is no text of the page.
HIDDEN = frozenset("audio canvas datalist math object select svg template video".split())
_ITEMS = frozenset(("ol", "ul", "menu", "dir"))
_TABLE = frozenset(("table",))
#: A start tag ends the open elements of the first set, up to one of the second.
ENDS = {
    "li": (frozenset(("li",)), _ITEMS), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), _TABLE), "th": (frozenset(("td", "th")), _TABLE), "tr": (frozenset(("tr",)), _TABLE),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), _TABLE), "tfoot": (frozenset(("thead", "tbody")), _TABLE),
}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']++|=\s*+(?:"[^"]*"|'[^']*')|[="'])*+)>""")
LETTER = re.compile("[a-zA-Z]")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PIECES = re.compile(r"[^\W\d_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

PATH, LEAF = 384, 128
#: Elements have buckets of their own; other names share the rest.
_OWN = {name: k for k, name in enumerate(sorted(BLOCKS))}


def bucket(word: str, n: int) -> int:
    return xxhash.xxh32_intdigest(word) % n


def name_bucket(word: str, n: int) -> int:
    return _OWN[word] if word in _OWN else len(_OWN) + bucket(word, n - len(_OWN))


@dataclass(frozen=True, eq=False)
class Place:
    """An element's position: hashed names of it and all around it, and of it alone."""

    vector: np.ndarray
    hidden: bool


@dataclass
class Block:
    text: str
    place: Place
    linked: int  # characters inside links
    first: bool  # the label that held where its text began


class Places:
    """Positions by parent and names; pages of one site share them. Emptied between pages when they grow past ``limit``."""

    def __init__(self, limit: int = 20_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.root = Place(np.zeros(PATH + LEAF, np.float32), False)
        self.known: dict[tuple[Place, str, str], Place] = {}

    def trim(self) -> None:
        if len(self.known) > self.limit:
            self.clear()

    def inside(self, parent: Place, tag: str, attributes: str) -> Place:
        names = "" if "=" not in attributes else " ".join(f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in NAMES.finditer(attributes))
        key = (parent, tag, names)
        found = self.known.get(key)
        if found is None:
            words = [tag] + [w for part in names.split() for w in self.pieces(part)]
            v = parent.vector.copy()
            v[PATH:] = 0
            for w in words:
                v[name_bucket(w, PATH)] = 1
                v[PATH + name_bucket(w, LEAF)] = 1
            found = self.known[key] = Place(v, parent.hidden or tag in HIDDEN)
        return found

    @staticmethod
    def pieces(name: str) -> list[str]:
        """``class=postBody-2`` as post and body."""
        return [w.lower() for w in PIECES.findall(CAMEL.sub(" ", name.partition("=")[2] or name))]


def blocks(page: str, places: Places, marks: dict[str, bool] | None = None) -> tuple[list[Block], str]:
    """The page's blocks of text in order, and its title.

    ``marks`` maps texts of comments to labels that hold from there on. Character references are decoded, white space is one blank, blocks without
    text are left out. Markup that is cut off ends the page, as in a browser.
    """
    out: list[Block] = []
    stack: list[tuple[str, Place]] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    place, linked, in_link, label, first, title = places.root, 0, False, False, False, ""

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, place, linked, first))
            parts, linked = [], 0

    def pop() -> None:
        nonlocal place
        name, _ = stack.pop()
        opened[name] -= 1
        place = stack[-1][1] if stack else places.root

    def add(raw: str) -> None:
        nonlocal linked, first
        if place.hidden:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not parts:
            if text.isspace():
                return
            first = label
        parts.append(text)
        if in_link:
            linked += len(text)

    at, size = 0, len(page)
    while at < size:
        nxt = page.find("<", at)
        if nxt < 0:
            add(page[at:])
            break
        if nxt > at:
            add(page[at:nxt])
        after = page[nxt + 1 : nxt + 2]
        named = LETTER.match(page, nxt + 1 + (after == "/")) is not None
        if after in ("!", "?") or (after == "/" and not named):
            comment = page.startswith("<!--", nxt)
            # comments may be as short as <!-->
            end = page.find("-->", nxt + 2) if comment else page.find(">", nxt)
            if end < 0:
                break
            if comment and marks:
                label = marks.get(page[nxt + 4 : end], label)
            at = end + (3 if comment else 1)
            continue
        m = TAG.match(page, nxt) if named else None
        if m is None:
            if named:
                break  # a tag that never ends
            add("<")
            at = nxt + 1
            continue
        at = m.end()
        end_tag, name, attributes = m[1], m[2].lower(), m[3]
        if name == "a":
            in_link = not end_tag
        elif name == "br":
            add(" ")
        elif name in RAW:
            if not end_tag:
                stop = RAW[name].search(page, at)
                if name == "title" and not title and stop:
                    title = " ".join(html.unescape(page[at : stop.start()]).split())
                if stop is None:
                    break
                at = page.find(">", stop.end())
                at = size if at < 0 else at + 1
        elif name in BLOCKS or name in HIDDEN:
            if name in BLOCKS:
                flush()
            if end_tag:
                same = HEADINGS if name in HEADINGS else (name,)
                if any(opened.get(x) for x in same):
                    flush()
                    while stack[-1][0] not in same:
                        pop()
                    pop()
                in_link = False
                continue
            if opened.get("p") and name in BLOCKS:
                while stack[-1][0] != "p":
                    pop()
                pop()
            ended, until = ENDS.get(name, (frozenset(), frozenset()))
            if any(opened.get(x) for x in ended):
                k = len(stack) - 1
                while k >= 0 and stack[k][0] not in ended and stack[k][0] not in until:
                    k -= 1
                if k >= 0 and stack[k][0] in ended:
                    while len(stack) > k:
                        pop()
            if name not in VOID and not (name in HIDDEN and attributes.endswith("/")):
                place = places.inside(place, name, attributes)
                stack.append((name, place))
                opened[name] = opened.get(name, 0) + 1
    flush()
    return out, title
