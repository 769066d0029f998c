"""A forgiving HTML reader: blocks, their attributes and their text, as parallel lists.

The time grows with the length of the page whatever its markup: a tag that never ends, a stray end tag
and an element that is never closed cost no more than their own characters, but for the first
``LOOKS`` tags with a quote that is never closed, which look for it to the end of the page.

Edge cases: an empty page is its one block; null characters, unknown elements and attributes without
values are read as they stand; a page of any length is read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

# fixed values: elements by their part in a page's structure
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea select canvas audio video title".split())
TO_THE_END = frozenset("script style noscript iframe textarea title".split())  # these of RAW, if never closed, hold the rest of the page
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup mover munder munderover mmultiscripts mprescripts mtable mtr mtd mstyle mfenced "
    "menclose mpadded mphantom mspace merror semantics annotation annotation-xml".split()
)
CLOSES = {  # an opening tag ends these open ones
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("td", "th", "tr", "thead"),
}
SCOPES = frozenset("body table ul ol dl div section article main aside nav header footer form blockquote".split())

LOOKS = 16  # tags with an unclosed quote that are looked at to the end of the page; later ones end at their first >
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""((?:"[^"]*"|'[^']*'|[^>"'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_TOKEN = re.compile(r"[A-Za-z]+")


def marks(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of every tag; comments and declarations have no name."""
    at, looks, last = 0, 0, source.rfind(">")
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        if start > last:
            # no tag ends here, but a comment may still begin
            at = source.find("<!--", start)
            if at < 0:
                return
            continue
        if source[start + 1] in "!?":
            at = source.find(">", start) + 1
            yield start, at, "", "", ""
            continue
        name = _NAME.match(source, start)
        if name is None:
            at = start + 1
            continue
        rest = _REST.match(source, name.end()) if looks < LOOKS else None
        if rest is None:
            looks += 1
            at = source.find(">", name.end()) + 1
            attributes = source[name.end() : at - 1]
        else:
            at, attributes = rest.end(), rest[1]
        yield start, at, name[1], name[2].lower(), attributes


class Page:
    """Blocks of a page in document order; block 0 is the page. Text belongs to leaves named ``#text``.

    Inline elements are no blocks: their text flows on, and text inside a link is counted as such.
    """

    def __init__(self, source: str):
        self.tag: list[str] = ["#page"]
        self.parent: list[int] = [-1]
        self.tokens: list[tuple[str, ...]] = [()]
        self.text: list[str] = [""]
        self.linked: list[int] = [0]
        self._open: list[int] = [0]
        self._named: Counter[str] = Counter()  # open blocks by name
        self._scopes: list[Counter[str]] = [Counter()]  # and those since the last open scope, for each open scope
        self._inline: Counter[str] = Counter()
        self._pieces: dict[int, list[str]] = {}
        self._leaf = -1
        self._read(source)
        for i, pieces in self._pieces.items():
            self.text[i] = " ".join(html.unescape("".join(pieces)).split())

    def _read(self, source: str) -> None:
        at, unclosed = 0, set()
        for start, end, slash, name, attributes in marks(source):
            if start < at:
                continue
            self._add_text(source[at:start])
            at = end
            if not name:
                continue
            if slash:
                self._close(name)
            elif name in RAW:
                self._leaf = -1 if name not in INLINE else self._leaf
                if not attributes.rstrip().endswith("/"):
                    stop = None if name in unclosed else _end_of(source, name, at)
                    if stop is not None:
                        at = stop
                    elif name in TO_THE_END:
                        return
                    else:  # its content is read like any other
                        unclosed.add(name)
            elif name in ("br", "hr"):
                self._add_text(" ")
            elif name in VOID:
                continue
            elif name in INLINE:
                self._inline[name] += 1
            else:
                self._open_block(name, attributes)
        self._add_text(source[at:])

    def _add_text(self, text: str) -> None:
        if not text:
            return
        if self._leaf < 0:
            if text.isspace():
                return
            self._leaf = self._block("#text", ())
        self._pieces.setdefault(self._leaf, []).append(text)
        if self._inline["a"]:
            self.linked[self._leaf] += len(text)

    def _block(self, tag: str, tokens: tuple[str, ...]) -> int:
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.tokens.append(tokens)
        self.text.append("")
        self.linked.append(0)
        return len(self.tag) - 1

    def _pop_to(self, depth: int) -> None:
        """Close all open blocks from ``depth`` on."""
        for block in reversed(self._open[depth:]):
            tag = self.tag[block]
            self._named[tag] -= 1
            if tag in SCOPES:
                self._scopes.pop()
            else:
                self._scopes[-1][tag] -= 1
        del self._open[depth:]

    def _open_block(self, name: str, attributes: str) -> None:
        ended = (*CLOSES.get(name, ()), "p")
        if any(self._scopes[-1][tag] for tag in ended):  # one of them is found before the scope
            depth = len(self._open) - 1
            while self.tag[self._open[depth]] not in ended:
                depth -= 1
            self._pop_to(depth)
        words = [name]
        for key, value in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role", "itemprop", "aria-label", "data-role", "hidden", "style"):
                words += [w.lower() for w in _TOKEN.findall(value)]
        self._open.append(self._block(name, tuple(words)))
        self._named[name] += 1
        if name in SCOPES:
            self._scopes.append(Counter())
        else:
            self._scopes[-1][name] += 1
        self._leaf = -1
        self._inline.clear()

    def _close(self, name: str) -> None:
        if name in INLINE:
            if self._inline[name]:
                self._inline[name] -= 1
            return
        if self._named[name]:
            depth = len(self._open) - 1
            while self.tag[self._open[depth]] != name:
                depth -= 1
            self._pop_to(depth)
            self._leaf = -1
            self._inline.clear()


def _end_of(source: str, name: str, at: int) -> int | None:
    found = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
    return found.end() if found else None
