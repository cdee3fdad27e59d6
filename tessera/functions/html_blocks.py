"""HTML bodies of posts as ordered blocks of prose and code."""

from __future__ import annotations

from functools import partial
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectorised import vectorised
from tessera.registry import parsers

BLOCKS = "array<struct<kind:string,text:string>>"
SECTIONS = "array<struct<section_id:int,parent_id:int,id_str:string,title:string,idx:int,tag:string,text:string>>"
SECTION = ("section_id", "parent_id", "id_str", "title", "idx", "tag", "text")
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Top-level elements: pre is code, anything else prose."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list[str]] = []
        self.open: list[str] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open:
                was = self.open.pop()
                if was == tag:
                    break
            if not self.open:
                self._end("code" if tag == "pre" else "p")

    def handle_data(self, data):
        if self.open:
            self.parts.append(data)

    def _end(self, kind: str):
        text, self.parts = "".join(self.parts), []
        if kind == "p" and self.blocks and self.blocks[-1][0] == "p":
            self.blocks[-1][1] += "\n" + text
        else:
            self.blocks.append([kind, text])

    def close(self):
        super().close()
        if self.open and self.parts:
            self._end("code" if self.open[0] == "pre" else "p")


def body_blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of the top-level elements; neighbouring prose is one block."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return [tuple(b) for b in parser.blocks]


@vectorised(BLOCKS)
def html_blocks(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [{"kind": k, "text": t} for k, t in body_blocks(h)])


def without(blocks: Column, kind: str | None) -> Column:
    """Blocks but those of one kind."""
    return blocks if kind is None else F.filter(blocks, lambda b: b["kind"] != kind)


def blocks_text(blocks: Column, wrap=lambda text: text) -> Column:
    """Blocks as one text; prose goes through ``wrap``, empty blocks go."""
    texts = F.transform(blocks, lambda b: F.when(b["kind"] == "p", wrap(b["text"])).otherwise(b["text"]))
    return F.array_join(F.filter(texts, lambda t: F.trim(t) != ""), "\n")


SKIPPED = ("script", "style", "nav", "footer")


class _Sections(HTMLParser):
    """Headings open sections; other blocks belong to the section that is open."""

    HEADINGS = {f"h{i}": i for i in range(1, 7)}
    LEAVES = {"p": "p", "pre": "code", "li": "p", "dt": "p", "dd": "p", "blockquote": "p", "td": "p", "th": "p"}

    def __init__(self, skipped: tuple[str, ...] = SKIPPED, root: str = ""):
        super().__init__(convert_charrefs=True)
        self.skip, self.root, self.inside = skipped, root, 0 if root else 1
        self.rows: list[tuple] = []
        self.path: list[tuple[int, int]] = []  # level, section
        self.count = self.idx = 0
        self.leaf: str | None = None
        self.id_str, self.parts, self.skipped = "", [], 0

    def handle_starttag(self, tag, attrs):
        if self.root and self.root in (dict(attrs).get("class") or "").split():
            self.inside = 1
        if tag in self.skip:
            self.skipped += 1
        elif tag in self.HEADINGS or tag in self.LEAVES:
            self._flush()
            self.leaf, self.id_str = tag, dict(attrs).get("id") or ""

    def handle_endtag(self, tag):
        if tag in self.skip:
            self.skipped = max(0, self.skipped - 1)
        elif tag == self.leaf:
            self._flush()

    def handle_data(self, data):
        if self.leaf and self.inside and not self.skipped:
            self.parts.append(data)

    def _flush(self):
        raw, leaf = "".join(self.parts), self.leaf
        self.parts, self.leaf = [], None
        text = raw.strip("\n") if leaf == "pre" else " ".join(raw.split())
        if not leaf or not text:
            return
        if level := self.HEADINGS.get(leaf):
            while self.path and self.path[-1][0] >= level:
                self.path.pop()
            self.count += 1
            parent = self.path[-1][1] if self.path else 0
            self.path.append((level, self.count))
            self.rows.append((self.count, parent, self.id_str, text, self.idx, "section", ""))
        else:
            section = self.path[-1][1] if self.path else 0
            text = f"* {text}" if leaf == "li" else text
            self.rows.append((section, section, "", "", self.idx, self.LEAVES[leaf], text))
        self.idx += 1

    def close(self):
        super().close()
        self._flush()


def section_rows(html: str | None) -> list[tuple]:
    """(section_id, parent_id, id_str, title, idx, tag, text) of a page, sections numbered in order from 1."""
    return _section_rows(html)


def _section_rows(html: str | None, **options) -> list[tuple]:
    parser = _Sections(**options)
    parser.feed(html or "")
    parser.close()
    return parser.rows


def section_parser(domain: str, **options) -> None:
    """Register how pages of a domain are read: tags to skip, and the class of the element where the text begins."""
    parsers.register(domain)(partial(_section_rows, **options))


section_parser("default")
section_parser("sphinx", root="body", skipped=(*SKIPPED, "aside", "form"))
section_parser("wiki", root="mw-parser-output", skipped=(*SKIPPED, "table"))


@vectorised(SECTIONS)
def html_sections(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [dict(zip(SECTION, r, strict=True)) for r in section_rows(h)])


@vectorised(SECTIONS)
def sections_of_domain(html: pd.Series, domain: pd.Series) -> pd.Series:
    """Sections by the parser that is registered for each row's domain, or the default one."""
    read = lambda h, d: parsers[d if d in parsers.items else "default"](h)
    return pd.Series([[dict(zip(SECTION, r, strict=True)) for r in read(h, d)] for h, d in zip(html, domain, strict=True)], index=html.index)
