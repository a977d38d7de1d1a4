"""Anchors and visible text of one HTML body, with the standard library only."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser
from itertools import accumulate

# Elements without content, and elements whose text is not shown.
VOID = {
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed",
    "frame", "hr", "image", "img", "input", "isindex", "keygen", "link",
    "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr",
}
NOT_TEXT = {"script", "style", "template", "rt", "rp"}
DROPPED = {"script", "style", "head"}


#: Characters of link text one mail may have. Anchors that are never closed repeat all text after
#: them, so a small body can have link text beyond what a row can hold; such a mail is an error.
MAX_LINK_TEXT = 64 * 1024 * 1024


class _Reader(HTMLParser):
    """Tracks open elements; an end tag closes up to its last matching start tag.

    Work is in step with the input: open elements are counted by tag, and an anchor
    keeps where its text begins and ends in one list of pieces that all share.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.count: Counter[str] = Counter()
        self.dropped = 0
        self.open_anchors: list[tuple[int, dict]] = []
        self.anchors: list[dict] = []
        self.link_pieces: list[str] = []
        self.pieces: list[str] = []
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        self._end_text()
        anchor = None
        if tag == "a":
            href = dict(attrs).get("href", ...)  # the last of repeated attributes counts
            if href is not ...:
                begin = len(self.link_pieces)
                anchor = {"href": (href or "").strip(), "begin": begin, "end": begin if tag in VOID else None}
                self.anchors.append(anchor)
        if tag in VOID:
            return
        self.open.append(tag)
        self.count[tag] += 1
        self.dropped += tag in DROPPED
        if anchor is not None:
            self.open_anchors.append((len(self.open), anchor))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_text()
        if not self.count[tag]:
            return
        while True:
            closed = self.open.pop()
            self.count[closed] -= 1
            self.dropped -= closed in DROPPED
            if closed == tag:
                break
        while self.open_anchors and self.open_anchors[-1][0] > len(self.open):
            self.open_anchors.pop()[1]["end"] = len(self.link_pieces)

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self._end_text()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def close(self):
        super().close()
        self._end_text()

    def _end_text(self):
        piece = "".join(self.text).strip()
        self.text.clear()
        if not piece or (self.open and self.open[-1] in NOT_TEXT):
            return
        if self.open_anchors:
            self.link_pieces.append(piece)
        if not self.dropped:
            self.pieces.append(piece)


def read_html(html: str) -> tuple[list[dict[str, str]], str]:
    """`([{visible_text, href}, ...], text)`; text pieces are joined by newlines.

    Raises ValueError if the link text would exceed MAX_LINK_TEXT.
    """
    reader = _Reader()
    reader.feed(html)
    reader.close()
    before = [0, *accumulate(map(len, reader.link_pieces))]
    ends = [len(reader.link_pieces) if a["end"] is None else a["end"] for a in reader.anchors]
    size = sum(before[end] - before[a["begin"]] for a, end in zip(reader.anchors, ends))
    if size > MAX_LINK_TEXT:
        raise ValueError(f"link text of {size} characters exceeds {MAX_LINK_TEXT}")
    anchors = [
        {"visible_text": "".join(reader.link_pieces[a["begin"] : end]), "href": a["href"]}
        for a, end in zip(reader.anchors, ends)
    ]
    return anchors, "\n".join(reader.pieces)
