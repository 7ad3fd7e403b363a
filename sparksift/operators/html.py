"""Visible text of HTML, as an Arrow-batched function over Python's tokenizer."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages whose texts are held as Python strings at a time.
PAGES = 256


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden = 0
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def visible_text(html: str | None) -> str | None:
    """Text nodes outside script and style, trimmed, one per line."""
    if html is None:
        return None
    p = _Visible()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


@F.arrow_udf(T.StringType())
def html_text(html: pa.Array) -> pa.Array:
    """visible_text of each page. Pages become Python strings one at a time, so that a worker holds little more than its batch in Arrow, whatever the partition."""
    parts = []
    for i in range(0, len(html), PAGES):
        parts.append(pa.array([visible_text(v.as_py()) for v in html.slice(i, PAGES)], pa.string()))
    out = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    del parts
    pa.default_memory_pool().release_unused()
    return out
