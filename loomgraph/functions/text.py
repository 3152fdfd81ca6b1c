"""Text measures, filters and splitters."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 1500, 300
OPTIMAL_TOKENS = 400
MIN_CHARS, MAX_NON_ALPHA = 100, 0.40
SEPARATORS = ("\n\n", "\n", " ", "")


def stripped(c: Column) -> Column:
    """Without white space at either end, of any kind (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_alpha_ratio(c: Column) -> Column:
    """The share of characters that are no letters, spaces (only them) left out; 0 for nothing, null for null."""
    dense = F.replace(c, F.lit(" "), F.lit(""))
    other = F.length(F.regexp_replace(dense, r"\p{L}", ""))
    return F.when(F.length(dense) == 0, F.lit(0.0)).otherwise(other / F.length(dense))


def exceeds_non_alpha(c: Column, threshold: float = MAX_NON_ALPHA) -> Column:
    return non_alpha_ratio(c) > threshold


def is_good_chunk(c: Column) -> Column:
    """Long enough, and letters for the most part. Null is no good chunk."""
    return F.coalesce((F.length(c) >= MIN_CHARS) & (non_alpha_ratio(c) <= MAX_NON_ALPHA), F.lit(False))


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that works, each sharing up to `overlap` with the one before.

    A separator stays at the front of the piece after it; pieces are stripped, and empty ones left out.
    """
    if overlap > size:
        raise ValueError("the overlap is larger than the chunk")
    which = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[which], separators[which + 1 :]
    if sep:
        head, *tail = text.split(sep)
        parts = ([head] if head else []) + [sep + t for t in tail]
    else:
        parts = list(text)
    out: list[str] = []
    small: list[str] = []
    for part in parts:
        if len(part) < size:
            small.append(part)
            continue
        out += _joined(small, size, overlap)
        small = []
        out += split_text(part, size, overlap, finer) if finer else [part]
    return out + _joined(small, size, overlap)


def _joined(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: list[str] = []
    total = 0
    for part in parts:
        if total + len(part) > size and window:
            if piece := "".join(window).strip():
                out.append(piece)
            while window and (total > overlap or total + len(part) > size):
                total -= len(window.pop(0))
        window.append(part)
        total += len(part)
    if piece := "".join(window).strip():
        out.append(piece)
    return out


def split_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """doc_id, chunk_id (numbered before any filter), text, page_num (null). Null texts have no chunk."""

    # a row at a time: a batch of an Arrow function has 10,000 texts, however long, and all of their pieces at once
    pieces = F.udf(lambda t: [] if t is None else split_text(t, size, overlap), "array<string>", useArrow=False)
    own = docs.select(F.col(id_col).cast("string").alias("doc_id"), pieces(F.col(text_col)).alias("_pieces"))
    return own.select("doc_id", F.posexplode("_pieces").alias("chunk_id", "text")).withColumn("page_num", F.lit(None).cast("int"))


def keep_good_chunks(chunks: DataFrame) -> DataFrame:
    """Good chunks with their ids as they were: ids have gaps."""
    return chunks.where(is_good_chunk(F.col("text"))).withColumn("text", stripped(F.col("text")))


#: A match is one token: letters four at a time, digits three, other marks, line breaks, and runs of blanks.
_BLANK = r"\t-\r\x20\x1C-\x1F\x85\p{Z}"
TOKEN = rf"\p{{L}}{{1,4}}|\p{{Nd}}{{1,3}}|[^\p{{L}}\p{{Nd}}{_BLANK}]|\n|[\t\x0B-\r\x20\x1C-\x1F\x85\p{{Z}}]{{2,}}"


class TokenCounter:
    """Counts tokens as a byte-level BPE would, roughly and without a vocabulary: runs of letters cost one token for every four
    characters begun, runs of digits one for every three, other marks one each; a single space before a run is free.
    token_count() does the same in the JVM."""

    def __call__(self, text: str | None) -> int:
        import regex

        return len(regex.findall(TOKEN, text or ""))


class VocabularyCounter:
    """Exact counts with a rank file of a byte-level BPE (lines of base64 token and rank)."""

    def __init__(self, rank_file: str, pattern: str):
        self.rank_file, self.pattern, self._encoding = rank_file, pattern, None

    def __call__(self, text: str | None) -> int:
        if self._encoding is None:
            import base64

            import tiktoken

            with open(self.rank_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._encoding.encode_ordinary(text or ""))

    def __getstate__(self):
        return self.__dict__ | {"_encoding": None}


def token_count(c: Column, counter: Callable[[str | None], int] | None = None) -> Column:
    if counter is None or type(counter) is TokenCounter:
        return F.coalesce(F.regexp_count(c, F.lit(TOKEN)).cast("long"), F.lit(0).cast("long"))

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(counter).astype("int64")

    return run(c)


def pack_paragraphs(paragraphs: list[tuple[str | None, str, int | None]], count: Callable[[str], int], optimal: int = OPTIMAL_TOKENS) -> list[tuple[int, str, int | None]]:
    """(chunk_id, raw text, page) from paragraphs (role, content, page) in order; paragraphs of role "null" are left out.

    A chunk is closed by the paragraph that would overfill it, and carries that paragraph's page. A section
    heading closes a chunk that is more than 70 % full and opens the next. Every closing takes a number, that of nothing too.
    """
    out: list[tuple[int, str, int | None]] = []
    held: list[str] = []
    number, filled, page = 0, 0, None
    for role, content, page in (p for p in paragraphs if p[0] != "null"):
        text = content + "\n"
        n = count(text)
        if filled + n > optimal:
            out.append((number, " ".join(held), page))
            number, held, filled = number + 1, [text], n
        else:
            held.append(text)
            filled += n
        if role == "sectionHeading" and filled > 0.7 * optimal:
            heading = held.pop()
            out.append((number, " ".join(held), page))
            number, held, filled = number + 1, [heading], count(heading)
    if held:  # the last chunk carries the page of the last paragraph of all, one that is left out too
        out.append((number, " ".join(held), paragraphs[-1][2]))
    return [x for x in out if x[1]]


def _chunk_bounds(items: list, optimal: int) -> list[tuple[int, int, int, int]]:
    """(chunk_id, first, paragraphs, place of the page) of chunks with text, as pack_paragraphs() makes them. items: role and n, the tokens, of paragraphs in order."""
    out: list[tuple[int, int, int, int]] = []
    own = [i for i, p in enumerate(items) if p["role"] != "null"]
    number = first = filled = 0  # the open chunk's paragraphs are those from `first` on
    for at, i in enumerate(own):
        role, n = items[i]["role"], items[i]["n"]
        if filled + n > optimal:
            out.append((number, first, at - first, i))
            number, first, filled = number + 1, at, n
        else:
            filled += n
        if role == "sectionHeading" and filled > 0.7 * optimal:
            out.append((number, first, at - first, i))
            number, first, filled = number + 1, at, n
    if first < len(own):
        out.append((number, first, len(own) - first, len(items) - 1))
    return [x for x in out if x[2]]


def chunk_paragraphs(paragraphs: DataFrame, counter: Callable[[str], int] | None = None, optimal: int = OPTIMAL_TOKENS, keep_all: bool = False) -> DataFrame:
    """doc_id, chunk_id, text, page_num of good chunks (all of them with keep_all), paragraphs packed in order of id within a document.

    Tokens are counted and texts put together in the JVM; only roles and counts go to Python, as the bounds of a chunk depend on the one before.
    """
    bounds = F.udf(lambda items: _chunk_bounds(items, optimal), "array<struct<chunk_id: int, first: int, n: int, page: int>>", useArrow=False)
    content = F.concat(F.coalesce("content", F.lit("")), F.lit("\n"))
    own = paragraphs.select("doc_id", F.struct("id", "role", content.alias("content"), F.col("page_num").cast("int").alias("page_num"), token_count(content, counter).alias("n")).alias("p"))
    docs = own.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("all"))
    cut = docs.select("doc_id", "all", F.transform(F.filter("all", lambda p: F.coalesce(p["role"], F.lit("")) != "null"), lambda p: p["content"]).alias("texts"), F.inline(bounds(F.transform("all", lambda p: F.struct(p["role"].alias("role"), p["n"].alias("n"))))))
    out = cut.select("doc_id", "chunk_id", F.array_join(F.slice("texts", F.col("first") + 1, F.col("n")), " ").alias("text"), F.get("all", F.col("page"))["page_num"].alias("page_num"))
    return out if keep_all else keep_good_chunks(out)


def full_texts(paragraphs: DataFrame) -> DataFrame:
    """doc_id, full_text: contents in order of id, each ended by a line break; role "null" left out."""
    kept = paragraphs.where(F.coalesce(F.col("role"), F.lit("")) != "null")
    parts = F.array_sort(F.collect_list(F.struct("id", "content")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["content"], F.lit("\n"))), "").alias("full_text"))
