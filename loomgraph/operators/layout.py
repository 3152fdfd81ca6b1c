"""Page-layout operators: geometry, token features, and grouping of tokens into segments."""

from __future__ import annotations

import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN_TYPES = ["FORMULA", "FOOTNOTE", "LIST_ITEM", "TABLE", "PICTURE", "TITLE", "TEXT", "PAGE_HEADER", "SECTION_HEADER", "CAPTION", "PAGE_FOOTER"]
DEFAULT_TYPE = TOKEN_TYPES.index("TEXT")
CATEGORIES = ["Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Cs", "Co", "Cn"]

TOKENS = "doc_id string, page int, idx int, id string, content string, font_id string, font_size double, bold boolean, italic boolean, color string, `left` double, top double, `right` double, bottom double, page_width int, page_height int, reading_order int, type string"


def parse_layout_xml(files: DataFrame) -> DataFrame:
    """Tokens of Poppler layout XML (path or doc_id, content): one row per text element with visible content."""

    def run(frames):
        for frame in frames:
            rows = []
            for doc, raw in zip(frame["doc_id"], frame["content"]):
                root = ET.fromstring(raw)
                fonts = {f.get("id"): f for f in root.iter("fontspec")}
                for page in root.iter("page"):
                    idx = 0
                    for el in page.iter("text"):
                        content = "".join(el.itertext()).strip()
                        if not content:
                            continue
                        font = fonts.get(el.get("font"))
                        family = "" if font is None else font.get("family", "")
                        x, y = float(el.get("left")), float(el.get("top"))
                        box = normal_box(x, y, x + float(el.get("width")), y + float(el.get("height")))
                        rows.append((doc, int(page.get("number")), idx, el.get("id", "tag"), content, el.get("font"), float(font.get("size", 0)) if font is not None else 0.0, "Bold" in family, "Italic" in family, "#000000" if font is None else font.get("color", "#000000"), *box, int(page.get("width")), int(page.get("height")), int(el.get("reading_order_no", -1)), "TEXT"))
                        idx += 1
            yield pd.DataFrame(rows, columns=[c.split()[0].strip("`") for c in TOKENS.split(", ")])

    return files.select(F.col("doc_id").cast("string"), "content").mapInPandas(run, TOKENS)


def has_text(tokens: DataFrame) -> DataFrame:
    """doc_id of documents with any token."""
    return tokens.select("doc_id").distinct()


def normal_box(x0: float, y0: float, x1: float, y1: float) -> tuple[float, float, float, float]:
    """Corners in order; a box without width or height is made one wide or high."""
    x0, x1 = min(x0, x1), max(x0, x1)
    y0, y1 = min(y0, y1), max(y0, y1)
    return x0, y0, x1 + (x0 == x1), y1 + (y0 == y1)


def area(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return (c("right") - c("left")) * (c("bottom") - c("top"))


def overlap_percent(a: str, b: str) -> Column:
    """100 times the common area as a share of box a's own; boxes are columns <prefix>left, top, right, bottom."""
    width = F.least(F.col(a + "right"), F.col(b + "right")) - F.greatest(F.col(a + "left"), F.col(b + "left"))
    height = F.least(F.col(a + "bottom"), F.col(b + "bottom")) - F.greatest(F.col(a + "top"), F.col(b + "top"))
    return F.when((width <= 0) | (height <= 0) | (area(a) <= 0), F.lit(0.0)).otherwise(100.0 * width * height / area(a))


def merged_box() -> list[Column]:
    """Aggregates for the box around a group's boxes."""
    return [F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom")]


def same_line(tokens: DataFrame) -> DataFrame:
    """Pairs idx, other of tokens of a page whose vertical extents meet, each with every other (a range join on the page)."""
    b = tokens.select("doc_id", "page", F.col("idx").alias("other"), F.col("top").alias("t2"), F.col("bottom").alias("b2"), F.col("left").alias("l2"), F.col("right").alias("r2"))
    return tokens.join(b, ["doc_id", "page"]).where("idx <> other and bottom >= t2 and b2 >= top")


def line_context(tokens: DataFrame) -> DataFrame:
    """For each token, edges of neighbours that begin or end within its line (0 where there is none): of those that end before it the
    greatest right (left_of_token) and the least left (left_most), of those that begin after it the least left (right_of_token) and the greatest right (right_most)."""
    pairs = same_line(tokens).where("(top <= t2 and t2 < bottom) or (top < b2 and b2 <= bottom)")
    before, after = F.col("r2") < F.col("right"), F.col("l2") > F.col("left")
    edge = lambda f, where, c, name: F.coalesce(f(F.when(where, F.col(c))), F.lit(0.0)).alias(name)
    return pairs.groupBy("doc_id", "page", "idx").agg(
        edge(F.max, before, "r2", "left_of_token"), edge(F.min, before, "l2", "left_most"), edge(F.min, after, "l2", "right_of_token"), edge(F.max, after, "r2", "right_most"),
    )


def label_types(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Each token with the type of the label that covers it: labels by ascending area, the first that covers over 95 %, else the best; TEXT without any overlap.

    labels: doc_id, page, left, top, right, bottom, label (a place in TOKEN_TYPES).
    """
    t = tokens.select("doc_id", "page", "idx", *(F.col(c).alias(f"t_{c}") for c in ("left", "top", "right", "bottom")))
    l = labels.select("doc_id", "page", "label", *(F.col(c).alias(f"l_{c}") for c in ("left", "top", "right", "bottom")))  # noqa: E741
    both = t.join(l, ["doc_id", "page"]).withColumn("covered", overlap_percent("t_", "l_")).withColumn("size", area("l_")).where("covered > 0")
    whole = F.col("covered") > 95
    order = Window.partitionBy("doc_id", "page", "idx").orderBy(F.desc(whole), F.when(whole, F.col("size")), F.desc("covered"), "size", "label")
    best = both.withColumn("n", F.row_number().over(order)).where("n = 1").select("doc_id", "page", "idx", "label")
    return tokens.drop("type").join(best, ["doc_id", "page", "idx"], "left").withColumn("label", F.coalesce("label", F.lit(DEFAULT_TYPE))).withColumn("type", F.element_at(F.array(*map(F.lit, TOKEN_TYPES)), F.col("label") + 1))


def pair_features(tokens: DataFrame) -> DataFrame:
    """A row for each token and the next of its page: fonts, lengths, gaps and punctuation (nulls at a page's last token)."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    nxt = lambda c: F.lead(c).over(w)
    starts_upper = lambda c: F.col(c).rlike(r"^\p{Lu}").cast("int")
    out = tokens.withColumn("next_content", nxt("content"))
    for c in ("left", "top", "right", "bottom", "font_id", "font_size", "bold", "italic", "color"):
        out = out.withColumn(f"next_{c}", nxt(c))
    return out.select(
        "doc_id", "page", "idx", "content", "next_content",
        (F.col("font_id") == F.col("next_font_id")).cast("int").alias("same_font"),
        (F.col("color") == F.col("next_color")).cast("int").alias("same_color"),
        F.abs(F.col("font_size") - F.col("next_font_size")).alias("size_change"),
        F.length("content").alias("length"), F.length("next_content").alias("next_length"),
        (F.length("content") - F.length(F.replace("content", F.lit(" "), F.lit("")))).alias("spaces"), punctuation_count(F.col("content")).alias("marks"), punctuation_count(F.col("next_content")).alias("next_marks"),
        F.col("content").rlike(r"[.!?;:]$").cast("int").alias("ends_mark"), F.col("content").rlike(r",$").cast("int").alias("ends_comma"),
        F.col("content").endswith("-").cast("int").alias("ends_hyphen"), starts_upper("content").alias("upper"), starts_upper("next_content").alias("next_upper"),
        (F.col("next_left") - F.col("right")).alias("gap_right"), (F.col("next_top") - F.col("bottom")).alias("gap_down"),
        (F.col("left") - F.col("next_left")).alias("indent"), (F.col("top") - F.col("next_top")).alias("rise"),
        (F.col("right") - F.col("left")).alias("width"), (F.col("next_right") - F.col("next_left")).alias("next_width"),
        (F.col("bottom") - F.col("top")).alias("height"), (F.col("next_bottom") - F.col("next_top")).alias("next_height"),
        (F.col("left") / F.col("page_width")).alias("left_share"), (F.col("top") / F.col("page_height")).alias("top_share"),
        (F.col("right") / F.col("page_width")).alias("right_share"), (F.col("bottom") / F.col("page_height")).alias("bottom_share"),
        (F.col("bold") & F.col("next_bold")).cast("int").alias("both_bold"), (F.col("italic") & F.col("next_italic")).cast("int").alias("both_italic"),
    )


def gap_without_between(tokens: DataFrame) -> DataFrame:
    """For each token and the next of its page: the vertical gap between them; where tokens begin in it, the gap above those and what they fill of it, less the gap below."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    own = tokens.select("doc_id", "page", "idx", F.col("bottom").alias("from"), F.lead("top").over(w).alias("to")).where("to is not null")
    between = tokens.select("doc_id", "page", "top", "bottom")
    filled = own.join(between, ["doc_id", "page"]).where("top >= from and top < to").groupBy("doc_id", "page", "idx").agg((F.max("bottom") + F.min("top")).alias("ends"))
    gap = F.coalesce(F.col("ends") - 2 * F.col("from"), F.col("to") - F.col("from"))
    return own.join(filled, ["doc_id", "page", "idx"], "left").select("doc_id", "page", "idx", gap.alias("gap"))


@dataclass(frozen=True)
class Modes:
    """Usual measures of a document's tokens; 0 where they aren't known."""

    line_space: float = 0.0
    right: float = 0.0
    font_size: float = 0.0


def document_modes(tokens: DataFrame) -> DataFrame:
    """doc_id and the most frequent space below a token, right edge and font size of each document (the least of equals)."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    spaced = tokens.select("doc_id", "right", "font_size", (F.lead("top").over(w) - F.col("bottom")).alias("line_space"))
    own = spaced.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("what"), F.round(n, 2).alias("value")) for n in ("line_space", "right", "font_size")))).alias("m"))
    counts = own.where("m.value is not null").groupBy("doc_id", "m.what", "m.value").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").pivot("what", ["line_space", "right", "font_size"]).agg(F.max_by("value", F.struct("n", -F.col("value"))))


#: Columns of position_features() after doc_id, page, idx.
POSITIONS = ["line_right", "top", "right", "width", "height", "next_top", "next_right", "next_width", "next_height", "right_distance", "left_distance", "right_gap", "next_left_gap", "height_change", "top_distance", "top_distance_to_mode", "gap", "top_distance_less_height", "line_end_change", "line_start_change", "gap_to_mode", "right_to_mode"]


def position_features(tokens: DataFrame, modes: Modes = Modes()) -> DataFrame:
    """The POSITIONS of each token and the next of its page: where they and their lines begin and end, and how far they are apart."""
    by = ["doc_id", "page", "idx"]
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    edges = ("left_of_token", "left_most", "right_of_token", "right_most")
    own = tokens.select(*by, "left", "top", "right", "bottom").join(line_context(tokens), by, "left").fillna(0.0, edges)
    own = own.withColumns({"line_right": F.greatest("right", "right_most"), "line_left": F.least("left", "left_most"), "width": F.col("right") - F.col("left"), "height": F.col("bottom") - F.col("top")})
    own = own.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("left", "top", "right", "width", "height", "left_of_token", "line_right", "line_left")}).where("next_top is not null")
    c = F.col
    distance = c("next_top") - c("bottom")
    out = own.join(gap_without_between(tokens), by).withColumns({
        "right_distance": c("next_left") - c("right"), "left_distance": c("left") - c("next_left"), "right_gap": c("right_of_token") - c("right"), "next_left_gap": c("next_left") - c("next_left_of_token"),
        "height_change": c("height") - c("next_height"), "top_distance": distance, "top_distance_to_mode": distance - modes.line_space, "top_distance_less_height": distance - c("height"),
        "line_end_change": F.abs(c("line_right") - c("next_line_right")), "line_start_change": c("line_left") - c("next_line_left"), "gap_to_mode": modes.line_space - c("gap"), "right_to_mode": modes.right - c("line_right"),
    })
    return out.select(*by, *POSITIONS)


def punctuation_count(c: Column) -> Column:
    """How many ASCII punctuation marks a text has."""
    return F.regexp_count(c, F.lit(r"[!-/:-@\[-`{-~]"))


def paragraph_features(tokens: DataFrame, modes: Modes = Modes()) -> DataFrame:
    """position_features() of typed tokens with one-hot types of both: type_<name>, next_type_<name>."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    kinds = tokens.select("doc_id", "page", "idx", "type", F.lead("type").over(w).alias("next_type"))
    hot = {f"{p}_{t}": (F.col(p) == t).cast("int") for p in ("type", "next_type") for t in TOKEN_TYPES}
    return position_features(tokens, modes).join(kinds, ["doc_id", "page", "idx"]).withColumns(hot).drop("type", "next_type")


def unicode_categories(c: Column) -> Column:
    """One-hot categories of the first two and last two characters; -1 throughout where a character is missing."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        def hot(t: str | None) -> list[int]:
            t = t or ""
            out: list[int] = []
            for ch in (t[:1], t[1:2], t[-2:-1], t[-1:]):
                out += [int(unicodedata.category(ch) == k) for k in CATEGORIES] if ch else [-1] * len(CATEGORIES)
            return out

        return texts.map(hot)

    return run(c)


def with_context(features: DataFrame, columns: list[str], size: int = 4, pad: float = -1.0) -> DataFrame:
    """The feature columns of the `size` rows before and after in the document, padded at its ends: <column>_m1, <column>_p1 and so on."""
    w = Window.partitionBy("doc_id").orderBy("page", "idx")
    more = {}
    for k in range(1, size + 1):
        for c in columns:
            more[f"{c}_m{k}"] = F.coalesce(F.lag(c, k).over(w).cast("double"), F.lit(pad))
            more[f"{c}_p{k}"] = F.coalesce(F.lead(c, k).over(w).cast("double"), F.lit(pad))
    return features.withColumns(more)


def predict(features: DataFrame, columns: list[str], model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`scores` array<double> and `predicted` (place of the greatest, the first of equals) of a model from matrix to matrix."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(model(np.stack(x.to_list())).astype(float))) if len(x) else pd.Series([], dtype=object)

    row = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return features.withColumn("scores", run(row)).withColumn("predicted", F.array_position("scores", F.array_max("scores")).cast("int") - 1)


def rule_types(x: np.ndarray) -> np.ndarray:
    """A stand-in for a trained type model. Columns: font size, page mean of it, top share, ends with a mark."""
    out = np.zeros((len(x), len(TOKEN_TYPES)))
    out[:, DEFAULT_TYPE] = 0.5
    big = x[:, 0] > 1.2 * x[:, 1]
    out[big & (x[:, 3] == 0), TOKEN_TYPES.index("SECTION_HEADER")] = 0.9
    out[x[:, 2] > 0.94, TOKEN_TYPES.index("PAGE_FOOTER")] = 0.95
    out[x[:, 2] < 0.04, TOKEN_TYPES.index("PAGE_HEADER")] = 0.95
    return out


def rule_joined(x: np.ndarray) -> np.ndarray:
    """A stand-in for a trained paragraph model. Columns: gap below, height, gap to the right, then the one-hot types of both tokens."""
    types = x[:, 3:].reshape(len(x), 2, len(TOKEN_TYPES))
    same = (types[:, 0] == types[:, 1]).all(axis=1)
    near = x[:, 0] <= 0.8 * np.maximum(x[:, 1], 1.0)
    on = (same & near).astype(float)
    return np.column_stack([0.5 - on, on])


def typed(tokens: DataFrame, model: Callable[[np.ndarray], np.ndarray] = rule_types) -> DataFrame:
    """The tokens with the type that a model (of the columns that rule_types names) gives them."""
    page = Window.partitionBy("doc_id", "page")
    named = {"_mean": F.avg("font_size").over(page), "_share": F.col("top") / F.col("page_height"), "_mark": F.col("content").rlike(r"[.!?;:]$").cast("int")}
    got = predict(tokens.withColumns(named), ["font_size", "_mean", "_share", "_mark"], model)
    return got.withColumn("type", F.element_at(F.array(*map(F.lit, TOKEN_TYPES)), F.col("predicted") + 1)).select(*tokens.columns)


def joined(tokens: DataFrame, model: Callable[[np.ndarray], np.ndarray] = rule_joined) -> DataFrame:
    """Typed tokens with joined: 1 where a model of paragraph_features (as rule_joined names them) has a token go on into the next of its page."""
    hot = [f"{p}_{t}" for p in ("type", "next_type") for t in TOKEN_TYPES]
    got = predict(paragraph_features(tokens), ["top_distance", "height", "right_distance", *hot], model)
    return tokens.join(got.select("doc_id", "page", "idx", F.col("predicted").alias("joined")), ["doc_id", "page", "idx"], "left").fillna(0, ["joined"])


def islands(tokens: DataFrame, joined: str = "joined") -> DataFrame:
    """Tokens with their paragraph number within the page: a token with joined <> 0 goes on into the next one of its page."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    return tokens.withColumn("paragraph", F.sum((F.coalesce(F.lag(joined).over(w), F.lit(0)) == 0).cast("int")).over(w))


def segments(tokens: DataFrame) -> DataFrame:
    """One row per paragraph: space-joined text, merged box, the most frequent type (the first seen of equals), page geometry."""
    by = ["doc_id", "page", "paragraph"]
    kinds = tokens.groupBy(*by, "type").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    kind = kinds.groupBy(*by).agg(F.max_by("type", F.struct("n", -F.col("first"))).alias("type"))
    text = tokens.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda t: t["content"]), " ").alias("text"), *merged_box(), F.first("page_width").alias("page_width"), F.first("page_height").alias("page_height"))
    return text.join(kind, by).select("doc_id", "left", "top", (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"), F.col("page").alias("page_number"), "page_width", "page_height", "text", "type", "paragraph")


def to_paragraphs(segs: DataFrame) -> DataFrame:
    """doc_id, id, role, content, page_num of segments, numbered in reading order; plain kinds have no role, others but headings "null"."""
    w = Window.partitionBy("doc_id").orderBy("page_number", "paragraph")
    role = F.when(F.col("type").isin("TEXT", "LIST_ITEM", "FORMULA"), F.lit(None).cast("string")).when(F.col("type") == "SECTION_HEADER", F.lit("sectionHeading")).otherwise(F.lit("null"))
    return segs.select("doc_id", (F.row_number().over(w) - 1).alias("id"), role.alias("role"), F.col("text").alias("content"), F.col("page_number").alias("page_num"))
