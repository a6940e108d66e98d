"""Text normalisation, tokens and chunks as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOFT_HYPHEN, NBSP = chr(0xAD), chr(0xA0)
#: Fixed value: lines that are headings.
_SECTION = re.compile(r"(?:[A-Z][A-Z0-9 &/\-]{2,}|(?:\d{1,2}\.){1,4}\s+.*|[A-Z]\.\s+.*|Appendix\s+[A-Z0-9]+.*)")
_BULLET = re.compile(r"\s*[-*•‣–]\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def _unicode(form: str):
    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return apply


def nfkc(c: Column) -> Column:
    """NFKC; Spark has no built-in for it, so this is an Arrow UDF, skipped for ASCII texts."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _unicode("NFKC")(c)).otherwise(c)


def strip_accents(c: Column) -> Column:
    """Canonical decomposition without the combining marks."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(_unicode("NFKD")(c), r"\p{Mn}", "")).otherwise(c)


def trim_trailing_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)[ \t]+$", "")


def collapse_blank_lines(c: Column, most: int = 1) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{2,}", "\n" * (most + 1))


def collapse_inner_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t]{2,}", " ")


def dehyphenate(c: Column) -> Column:
    """Join words that a hyphen breaks over a line end."""
    return F.regexp_replace(c, r"([A-Za-z])-\n([A-Za-z])", "$1$2")


def normalize_quotes(c: Column) -> Column:
    return F.translate(c, "‘’‛“”„«»", "'''\"\"\"\"\"")


def fix_bullets_and_dashes(c: Column) -> Column:
    """Bullets become "- " wherever they stand, an en dash a hyphen, an em dash a hyphen between blanks."""
    out = F.regexp_replace(c, "[•‣▪]", "- ")
    out = F.regexp_replace(F.replace(out, F.lit("–"), F.lit("-")), r"\s*—\s*", " - ")
    return F.regexp_replace(out, r" {2,}", " ")


def filter_lines(c: Column, drop: str | None = None, keep: str | None = None) -> Column:
    """Lines without those that match ``drop``, unless they match ``keep``."""

    def stays(line: Column) -> Column:
        gone = line.rlike(drop) if drop else F.lit(False)
        return (line.rlike(keep) | ~gone) if keep else ~gone

    return F.array_join(F.filter(F.split(c, "\n"), stays), "\n")


#: Fixed value: a line that is a page number.
PAGE_HINT = r"^\s*Page\s+\d+(\s*/\s*\d+)?\s*$"


def strip_page_artifacts(c: Column, header: str | None = None, footer: str | None = None, page_hint: str | None = PAGE_HINT) -> Column:
    """Drop lines that are the header, the footer or, without blanks around them, match ``page_hint``."""
    exact = [F.lit(x.strip()) for x in (header, footer) if x]

    def stays(line: Column) -> Column:
        gone = F.trim(line).rlike(page_hint) if page_hint else F.lit(False)
        for x in exact:
            gone = gone | (F.trim(line) == x)
        return ~gone

    return F.array_join(F.filter(F.split(c, "\n"), stays), "\n")


def ascii_safe(c: Column, keep: str = "\n\t£€$%") -> Column:
    return F.regexp_replace(c, r"[^\x20-\x7E" + re.escape(keep) + "]", " ")


def normalize(c: Column, header: str | None = None, footer: str | None = None, safe: bool = False, page_hint: str | None = PAGE_HINT) -> Column:
    """The fixed pipeline; the order of its steps matters."""
    out = nfkc(c)
    out = collapse_blank_lines(out, 1)
    out = strip_page_artifacts(out, header, footer, page_hint)
    out = dehyphenate(out)
    out = fix_bullets_and_dashes(normalize_quotes(out))
    out = collapse_blank_lines(collapse_inner_whitespace(trim_trailing_spaces(out)), 1)
    out = F.regexp_replace(out, r"^\s+|\s+$", "")
    return ascii_safe(out) if safe else out


def loader_clean(c: Column) -> Column:
    """What loaders of documents do: no soft hyphens, plain blanks, at most one empty line."""
    out = F.translate(F.replace(c, F.lit(SOFT_HYPHEN), F.lit("")), NBSP, " ")
    return F.regexp_replace(F.regexp_replace(trim_trailing_spaces(out), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("-\n"), F.lit("")), r"\s+", " "))


def count_tokens(c: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("int")


def char_windows(c: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Array of windows of ``size`` characters that step by ``size - overlap``."""
    step = max(1, size - overlap)
    text = F.coalesce(c, F.lit(""))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentences(c: Column) -> Column:
    """Sentences that end in ``.!?`` before a capital letter or a digit."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def sanitize_tags(c: Column, most: int = 40) -> Column:
    """Tags lower-cased, blanks as underscores, without odd characters, in their first order."""
    tidy = F.transform(c, lambda t: F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), r"\s+", "_"), r"[^\p{L}\p{N}._-]", ""), 1, most))
    return F.array_distinct(F.filter(tidy, lambda t: t != ""))


# ------------------------------------------------------------------ chunking


def _tokens(text: str) -> int:
    return max(1, len(text) // 4)


def _sections(text: str) -> list[tuple[str | None, str]]:
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in text.split("\n"):
        if _SECTION.fullmatch(line.strip()) and line.strip():
            out.append((line.strip(), []))
        else:
            out[-1][1].append(line)
    return [(title, "\n".join(body).strip()) for title, body in out if title or "\n".join(body).strip()]


def _paragraphs(text: str) -> list[str]:
    """Blocks between empty lines; blocks of bullets stand alone, others are merged up to the next of them."""
    out, held = [], []
    for block in re.split(r"\n\s*\n", text):
        block = block.strip()
        if not block:
            continue
        lines = block.split("\n")
        if sum(bool(_BULLET.match(x)) for x in lines) >= max(1, len(lines) // 2):
            if held:
                out.append("\n\n".join(held))
                held = []
            out.append(block)
        else:
            held.append(block)
    return [*out, "\n\n".join(held)] if held else out


def _pack(paragraphs: Sequence[str], target: int, overlap: int) -> list[str]:
    """Paragraphs packed to about ``target`` tokens; a window begins with the last sentences of the one before."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for p in paragraphs:
        n = _tokens(p)
        if held and size + n > target:
            out.append("\n\n".join(held))
            carried: list[str] = []
            total = 0
            for s in reversed(_SENTENCE.split(held[-1])):
                if total + _tokens(s) > overlap:
                    break
                carried.insert(0, s)
                total += _tokens(s)
            held, size = ([" ".join(carried)], total) if carried and n < target else ([], 0)
        held.append(p)
        size += n
        if n >= target:
            out.append("\n\n".join(held))
            held, size = [], 0
    if held:
        out.append("\n\n".join(held))
    return out


def _split_large(text: str, most: int) -> list[str]:
    if _tokens(text) <= most:
        return [text]
    goal, out, held = int(most * 0.9), [], ""
    for s in _SENTENCE.split(text):
        while _tokens(s) > most:  # a sentence beyond the limit is cut by length
            out += [held] if held else []
            held, out, s = "", [*out, s[: goal * 4]], s[goal * 4 :]
        if held and _tokens(held) + _tokens(s) > goal:
            out.append(held)
            held = s
        else:
            held = f"{held} {s}" if held else s
    return [*out, held] if held else out


def chunk(text: str, target: int = 512, overlap: int = 64, prefix: bool = True, most: int = 800) -> list[dict]:
    """Sections, then paragraphs, then windows, none beyond ``most`` tokens."""
    out = []
    for title, body in _sections(text or ""):
        for window in _pack(_paragraphs(body), target, overlap):
            for part in _split_large(window, most):
                full = f"{title}\n\n{part}" if prefix and title else part
                out.append({"text": full, "position": len(out), "tokens": _tokens(full), "title": title})
    return out


def chunk_text(df: DataFrame, text: str = "text", target: int = 512, overlap: int = 64, prefix: bool = True, most: int = 800) -> DataFrame:
    """``df`` with a row and columns ``chunk, position, tokens, title`` for each chunk.

    The windows carry state from paragraph to paragraph, so this is an Arrow
    UDF; it works document by document and needs no shuffle.
    """

    @F.pandas_udf("array<struct<text:string,position:int,tokens:int,title:string>>")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk(t or "", target, overlap, prefix, most))

    out = df.withColumn("_chunk", F.explode(apply(F.col(text))))
    return out.select(*df.columns, F.col("_chunk.text").alias("chunk"), "_chunk.position", "_chunk.tokens", "_chunk.title")


def chunk_rows(df: DataFrame, order: str, rows: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Blocks of ``rows`` rows as tab-separated text under a header: (by, position, rows, text)."""
    from pyspark.sql import Window

    cols = [c for c in df.columns if c not in by]
    header = "\t".join(cols)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    line = F.array_join(F.transform(F.array(*(F.col(c).cast("string") for c in cols)), lambda x: F.coalesce(x, F.lit(""))), "\t")
    numbered = df.select(*by, F.row_number().over(w).alias("_n"), line.alias("_line")).withColumn("position", F.floor((F.col("_n") - 1) / rows).cast("int"))
    blocks = numbered.groupBy(*by, "position").agg(F.count("*").cast("int").alias("rows"), F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_all"))
    return blocks.select(*by, "position", "rows", F.concat(F.lit(header + "\n"), F.array_join(F.transform("_all", lambda x: x["_line"]), "\n")).alias("text"))


def dedupe_chunks(df: DataFrame, text: str = "text", order: Sequence[str] = ("path", "position")) -> DataFrame:
    """The first row of each text in order; texts meet by hash, and only each hash's first row is kept map-side."""
    keys = F.struct(*order)
    first = df.withColumn("_h", F.sha2(text, 256)).groupBy("_h").agg(F.min_by(F.struct(*df.columns), keys).alias("_r"))
    return first.select("_r.*")


def chunk_id(path: Column, position: Column) -> Column:
    return F.sha1(F.concat_ws(":", F.substring(F.sha1(path), 1, 16), position.cast("string")))
