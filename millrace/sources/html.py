"""Tables of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self._end_cell()
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            self._end_cell()
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table" and self.open:
            self._end_cell()
            self.tables.append(self.open.pop())

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self) -> None:
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def parse_tables(html: str | None) -> list[list[list[str]]]:
    """Rows of cells of each table; broken markup gives what can be read."""
    parser = _Tables()
    try:
        parser.feed(html or "")
        parser.close()
    except Exception:  # noqa: BLE001 - a page is never worth a failed job
        pass
    parser._end_cell()
    while parser.open:
        parser.tables.append(parser.open.pop())
    return [t for t in parser.tables if any(t)]




def html_tables(df: DataFrame, html: str, keys: Sequence[str], match: str | None = None) -> DataFrame:
    """(keys, table_no, row_no, cells): one row for each table row of ``df``'s pages; a header row of distinct short cells is flagged."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keys) + ", table_no int, row_no int, is_header boolean, cells array<string>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                for t, table in enumerate(parse_tables(getattr(row, html))):
                    if match and not any(match.lower() in c.lower() for r in table for c in r):
                        continue
                    for r, cells in enumerate(table):
                        header = r == 0 and len(set(cells)) == len(cells) and all(c and len(c) <= 64 for c in cells)
                        out.append((*(getattr(row, k) for k in keys), t, r, header, cells))
            yield pd.DataFrame(out, columns=[*keys, "table_no", "row_no", "is_header", "cells"])

    return df.select(*keys, html).mapInPandas(run, schema)
