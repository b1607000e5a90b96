"""The tags of a page from left to right, in time linear in its length however broken they are."""

from __future__ import annotations

import re

_OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"[^\s/>]*")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


class Tags:
    """The tags of a page from left to right, in time linear in its length however broken they are."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        # quotes from which a tag would run to the end of the page
        self.dead: set[int] = set()

    def _end(self, at: int) -> int:
        """Where the tag with attributes from ``at`` on ends: at the first ``>`` outside quotes, or else at the first."""
        seen, place = [], at
        while m := _MARK.search(self.page, place):
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            place = self.page.find(m[0], m.end()) + 1
            if not place:
                break
        self.dead.update(seen)
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str | None, str, bool] | None:
        """(begin, end, name, attributes, whether it is an end tag) of the next tag; a name of None is no element."""
        page, n = self.page, len(self.page)
        while m := _OPENING.search(page, at):
            begin, what = m.start(), m[0]
            if what == "<!--":
                if page.startswith((">", "->"), m.end()):
                    return begin, page.index(">", m.end()) + 1, None, "", False
                end = _COMMENT_END.search(page, m.end())
                return begin, end.end() if end else n, None, "", False
            if what == "<![CDATA[":
                end = page.find("]]>", m.end())
                return begin, end + 3 if end >= 0 else n, None, "", False
            if m.end() > self.last:
                # no tag can end any more; a comment may still begin
                at = m.end()
                continue
            if what[1] in "!?":
                return begin, page.index(">", begin) + 1, None, "", False
            name = _NAME.match(page, m.end() - 1)
            end = self._end(name.end())
            if end >= 0:
                return begin, end + 1, name[0], page[name.end() : end], what[1] == "/"
            at = m.end()
        return None

    def raw_end(self, name: str, at: int) -> tuple[int, int]:
        """Where the end tag of an element of raw text begins and ends; the end of the page if there is none."""
        m = re.compile(f"</{name}(?=[\\s/>])", re.I).search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        return (m.start(), end + 1) if end >= 0 else (len(self.page), len(self.page))


def attributes(text: str) -> list[tuple[str, str]]:
    """Names in small letters and values without their quotes, in order."""
    return [(k.lower(), v[1:-1] if v[:1] in ("'", '"') and v[:1] == v[-1:] and len(v) > 1 else v) for k, v in _ATTRIBUTE.findall(text)]
