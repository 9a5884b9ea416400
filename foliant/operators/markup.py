"""HTML as a tree of open elements: headings and paragraphs of a chapter.

``html.parser`` gives tags and text, with every character reference decoded as browsers do (references without a
semicolon, the table for 128 to 159, what stands for no character).  The stack of open elements adds what
HTML leaves out: end tags that may be omitted, and end tags that match nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements whose start ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split()) | frozenset(HEADINGS)
#: Elements that what is open outside of them does not see.
SCOPES = frozenset("applet button caption html marquee object table td template th".split())
#: Elements whose text is not shown.
HIDDEN = frozenset("script style template noembed noframes title".split())
#: What a start tag ends besides paragraphs, up to the element that holds the list or table.
ENDS = {
    "li": (("li",), ("ol", "ul", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}


class Chapter(HTMLParser):
    """Feed it a chapter: ``title`` and ``lines`` are what its headings and paragraphs hold."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str] | None]] = []
        self.open: Counter[str] = Counter()
        self.headings: list[tuple[str, list[str]]] = []
        self.paragraphs: list[tuple[list[str], int]] = []  # with the number of the heading around it, or -1
        self.texts: list[list[str]] = []  # of the open paragraphs and headings
        self.within: list[int] = []  # numbers of the open headings

    def _pop(self, upto: int) -> None:
        for tag, text in reversed(self.stack[upto:]):
            self.open[tag] -= 1
            if text is not None:
                self.texts.pop()
                if tag in HEADINGS:
                    self.within.pop()
        del self.stack[upto:]

    def _close(self, tags: tuple[str, ...], walls: frozenset[str] | tuple[str, ...]) -> bool:
        """Ends the innermost open element of ``tags`` that no element of ``walls`` hides, and what is in it."""
        if any(self.open[t] > 0 for t in tags):
            for k in range(len(self.stack) - 1, -1, -1):
                tag = self.stack[k][0]
                if tag in tags:
                    self._pop(k)
                    return True
                if tag in walls:
                    return False
        return False

    def _hidden(self) -> bool:
        return any(self.open[h] > 0 for h in HIDDEN)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._hidden():  # what looks like a tag is text there
            if tag not in VOID:
                self.stack.append((tag, None))
                self.open[tag] += 1
            return
        if tag in ENDS:
            tags, walls = ENDS[tag]
            while self._close(tags, walls):
                pass
        if tag in BLOCKS:
            self._close(("p",), SCOPES)
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self._pop(len(self.stack) - 1)
        if tag in VOID:
            return
        text: list[str] | None = None
        if tag == "p":
            text = []
            self.paragraphs.append((text, self.within[-1] if self.within else -1))
        elif tag in HEADINGS:
            text = []
            self.within.append(len(self.headings))
            self.headings.append((tag, text))
        if text is not None:
            self.texts.append(text)
        self.stack.append((tag, text))
        self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in HEADINGS:
            self._close(HEADINGS, SCOPES)
        elif tag in VOID:
            return
        elif tag in SCOPES:
            self._close((tag,), ())
        else:
            # An end tag of inline elements does not reach out of the block it stands in.
            self._close((tag,), SCOPES if tag in BLOCKS or tag in ENDS or tag in HIDDEN else SCOPES | BLOCKS)

    def handle_data(self, data: str) -> None:
        # To the innermost paragraph, and to each heading around it, as a heading holds all that is in it.
        if self.texts and not self._hidden():
            self.texts[-1].append(data)
            if self.within:
                inner = self.texts[-1]
                for k in self.within:
                    if self.headings[k][1] is not inner:
                        self.headings[k][1].append(data)

    def result(self) -> tuple[str | None, list[str]]:
        """The stripped title, from the first heading of the highest level there is (None without any), and the stripped paragraphs
        outside of it."""
        level = next((h for h in HEADINGS if any(tag == h for tag, _ in self.headings)), None)
        chosen = next((k for k, (tag, _) in enumerate(self.headings) if tag == level), None)
        title = None if chosen is None else "".join(self.headings[chosen][1]).strip()
        return title, ["".join(text).strip() for text, inside in self.paragraphs if chosen is None or inside != chosen]


AMPERSAND = re.compile("&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([0-9A-Za-z]*;?)")


def closed_only(html: str) -> str:
    """HTML in which only references that end with a semicolon are left to be read; every other ampersand is one."""
    return AMPERSAND.sub(lambda m: m[0] if m[1].endswith(";") and m[1] in html5 else f"&amp;{m[1]}", html)


def read_chapter(html: str, bare: bool = True) -> tuple[str | None, list[str]]:
    """``bare``: references without a semicolon are read too, as browsers do."""
    c = Chapter()
    c.feed(html if bare else closed_only(html))
    c.close()
    return c.result()
