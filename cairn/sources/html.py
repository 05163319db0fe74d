"""HTML to text, on the standard library's parser in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column

from cairn.functions.python import text_udf


class _Text(HTMLParser):
    """Text nodes; those of scripts and styles are code."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.code = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.code += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.code:
            self.code -= 1

    def handle_data(self, data: str) -> None:
        if not self.code:
            self.parts.append(data)


def extract(page: str | None) -> str | None:
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    return "\n".join(parser.parts)


def html_to_text(pages: Column) -> Column:
    """Text nodes joined by newlines."""
    return text_udf(extract)(pages)
