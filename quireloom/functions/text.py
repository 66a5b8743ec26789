"""Text expressions: all of them plain columns, none of them Python on the data path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strings know it: Unicode spaces and the separators 0x1c-0x1f.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS, NOT_WS = f"[{SPACES}]", f"[^{SPACES}]"
TEXT_LAYER_CHARS, HEADING_CHARS, LONG_WORD = 20, 60, 256
#: The default tokenizer: words, and single signs.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+\z", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def has_text_layer(text: Column, threshold: int = TEXT_LAYER_CHARS) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) > threshold


def route(text: Column, threshold: int = TEXT_LAYER_CHARS) -> Column:
    """Which extractor a page goes to."""
    return F.when(has_text_layer(text, threshold), "text").otherwise("ocr")


def looks_like_heading(text: Column, most: int = HEADING_CHARS) -> Column:
    """Short, and not closed by a sentence's sign."""
    return (F.length(text) <= most) & ~F.substring(rstrip(text), -1, 1).isin(".", "!", "?", ":")


def split_paragraphs(text: Column) -> Column:
    """Stripped pieces between blank lines, blanks dropped."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != "")


def chunk_spans(text: Column, size: int, overlap: int) -> Column:
    """(start, end) of overlapping chunks; an end moves on to the next white space."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    n = F.length(text)

    def end_of(start: Column) -> Column:
        end = start + F.lit(size)
        # a word's rest is looked for in a short stretch first: the whole rest of the text is copied only for longer words
        near = F.length(F.regexp_extract(F.substring(text, end + F.lit(1), LONG_WORD), rf"\A{NOT_WS}*", 0))
        far = F.length(F.regexp_extract(F.substring(text, end + F.lit(1), n), rf"\A{NOT_WS}*", 0))
        return F.when(end < n, end + F.when(near < LONG_WORD, near).otherwise(far)).otherwise(end)

    def step(state: Column, _: Column) -> Column:
        start = state["at"]
        # bind the end once: an array of one element, folded over
        grown = F.aggregate(F.array(end_of(start)), state, lambda s, end: F.struct((end - F.lit(overlap)).alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), end.alias("end")))).alias("spans")))
        return F.when(start < n, grown).otherwise(state)

    steps = F.sequence(F.lit(1), F.ceil(n / F.lit(size - overlap)).cast("int") + F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return F.when(n > 0, F.aggregate(steps, zero, step)["spans"]).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def chunk_text(text: Column, size: int = 800, overlap: int = 150) -> Column:
    return F.transform(chunk_spans(text, size, overlap), lambda s: strip(F.substring(text, s["start"] + F.lit(1), s["end"] - s["start"])))


def chunk_paragraph(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """A short paragraph as it stands, a long one in chunks."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(chunk_text(text, size, overlap))


def clean_cell(cell: Column) -> Column:
    one_line = strip(F.regexp_replace(F.coalesce(cell, F.lit("")), rf"{WS}+", " "))
    return F.replace(one_line, F.lit("|"), F.lit("\\|"))


def markdown(rows: Column) -> Column:
    """A table's rows (array of arrays of cells) as Markdown, the first as its head."""
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    clean = F.transform(rows, lambda row: F.transform(row, clean_cell))
    rule = line(F.transform(F.element_at(rows, 1), lambda _: F.lit("---")))
    lines = F.concat(F.array(line(F.element_at(clean, 1)), rule), F.transform(F.slice(clean, 2, F.size(clean)), line))
    return F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise("")


def token_windows(text: Column, most: int = 254, overlap: int = 20) -> Column:
    """A text of at most ``most`` tokens as it is, a longer one in windows cut at token edges."""
    overlap = max(0, min(overlap, most - 1))
    step = most - overlap
    parts = F.regexp_extract_all(text, F.lit(rf"\s*(?:{TOKEN})"), F.lit(0))  # each token with the space before it

    def windows(p: Column) -> Column:
        n = F.size(p)
        numbers = F.sequence(F.lit(0), F.ceil((n - F.lit(most)) / F.lit(step)).cast("int"))
        cut = F.transform(numbers, lambda j: F.regexp_replace(F.array_join(F.slice(p, j * step + 1, F.lit(most)), ""), r"\A\s+", ""))
        return F.when(n > most, cut).otherwise(F.array(text))

    return F.flatten(F.transform(F.array(parts), windows))


def split_description(text: Column, label: Column | None = None, most: int = 254, overlap: int = 20) -> Column:
    """Pieces of a figure's description: one for each bold header, cut to the token limit, labelled."""
    parts = F.filter(F.transform(F.split(text, r"(?md)(?=^\*\*.*?:\*\*)"), strip), lambda x: x != "")
    pieces = F.flatten(F.transform(parts, lambda x: token_windows(x, most, overlap)))
    if label is None:
        return pieces
    return F.transform(pieces, lambda x: F.when(F.coalesce(label, F.lit("")) == "", x).otherwise(F.concat(F.lit("["), label, F.lit("] "), x)))


def figure_label(kind: Column, page_no: Column) -> Column:
    return F.concat(kind, F.lit(", page "), (page_no + F.lit(1)).cast("string"))


def content_key(image: Column, prompt: str) -> Column:
    """What a description is remembered by: image and instruction together."""
    return F.sha2(F.concat(image, F.encode(F.lit(prompt), "UTF-8")), 256)
