"""Sections of stored web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# HTML elements that never have an end tag.
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)


class _Section(HTMLParser):
    """Collects the text of the first element with the wanted id or tag name."""

    def __init__(self, element_id: str | None, tag: str | None):
        super().__init__(convert_charrefs=True)
        self.element_id, self.tag = element_id, tag
        self.name: str | None = None
        self.depth = 0
        self.hidden = False  # within a script or style
        self.texts: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.hidden = tag in ("script", "style")
        if self.name is None:
            wanted = dict(attrs).get("id") == self.element_id if self.element_id else tag == self.tag
            if wanted:
                self.name, self.depth = tag, 0 if tag in VOID_ELEMENTS else 1
        elif self.depth:
            if tag == self.name:
                self.depth += 1
            self.texts.append(" ")

    def handle_endtag(self, tag):
        self.hidden = False
        if self.depth:
            self.depth -= tag == self.name
            self.texts.append(" ")

    def handle_data(self, data):
        if self.depth and not self.hidden:
            self.texts.append(data)


def _text_of(html: str | None, element_id: str | None, tag: str | None) -> str:
    parser = _Section(element_id, tag)
    parser.feed(html or "")
    parser.close()
    return " ".join("".join(parser.texts).split())


def section_text(html: Column, element_id: str | None = None, tag: str | None = None) -> Column:
    """Text of the first element with the id (or tag name), white space collapsed; '' where there is none."""
    if (element_id is None) == (tag is None):
        raise ValueError("give an element id or a tag")

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda html: _text_of(html, element_id, tag))

    return extract(html)


def extract_sections(pages: DataFrame, key: str, html: str, element_id: str | None = None, tag: str | None = None) -> DataFrame:
    return pages.select(key, section_text(F.col(html), element_id, tag).alias("section"))
