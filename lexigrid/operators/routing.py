"""Admission, page types and routes, and the tests that candidates of a page pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions import geometry as g
from lexigrid.functions.text import CONSONANT, THAI, has_thai, squeeze, strip, suffix

# The routes with what each translates, and the limits of documents.
ROUTES = (
    ("native_text", True, None),
    ("native_table", True, None),
    ("scanned_image", False, "scan"),
    ("dense_vector", True, "cad"),
    ("preserve", False, None),
)
PLAIN_CHARACTERS, MAX_CHARACTERS, OCR_PAGES, DENSE_DRAWINGS = 50_000, 1_000_000, 50, 20_000
MARK = r"ะ-ฺเ-๎"


def page_type(drawings: str, images: str, units: str) -> Column:
    """A page by its counts; many drawings come first, then images without text, then text."""
    d, i, u = F.col(drawings), F.col(images), F.col(units)
    return F.when(d >= DENSE_DRAWINGS, "vector").when((i > 0) & (u == 0), "image").when(u > 0, "native_text").otherwise("no_native_text")


def route() -> Column:
    """The route of a page (page_type, table_like, processing_route): a stored one stays, and must be known."""
    kind = F.coalesce("page_type", F.lit(""))
    picked = (
        F.when(kind.isin("vector", "vector_mixed"), "dense_vector")
        .when(kind.isin("image", "mixed"), "scanned_image")
        .when(kind.isin("native_text", "text"), F.when(F.coalesce("table_like", F.lit(False)), "native_table").otherwise("native_text"))
        .otherwise("preserve")
    )
    stored = F.nullif("processing_route", F.lit(""))
    wrong = F.raise_error(F.concat(F.lit("unknown page route: "), stored)).cast("string")
    return F.when(stored.isNull(), picked).when(stored.isin(*(r[0] for r in ROUTES)), stored).otherwise(wrong)


def plan_pages(pages: DataFrame) -> DataFrame:
    """Pages with route, translate_native and visual_strategy; a complete text layer needs no visual pass."""
    spark: SparkSession = pages.sparkSession
    plans = spark.createDataFrame(ROUTES, "route string, translate_native boolean, visual_strategy string")
    out = pages.withColumn("route", route()).join(F.broadcast(plans), "route")  # five rows
    complete = (F.col("route") == "dense_vector") & F.coalesce("native_text_complete", F.lit(False))
    return out.withColumn("visual_strategy", F.when(~complete, F.col("visual_strategy")))


def rejection(name: str, text: str, ocr_pages: str, has_visual: str, limit: int = MAX_CHARACTERS) -> Column:
    """Why a document is not admitted: ``no_text``, ``too_long``, ``too_many_ocr_pages``; null if it is."""
    empty = (strip(F.coalesce(text, F.lit(""))) == "") & (F.col(ocr_pages) == 0) & ~F.col(has_visual)
    most = F.when(suffix(name).isin(".txt", ".md"), PLAIN_CHARACTERS).otherwise(limit)
    return F.when(empty, "no_text").when(F.char_length(text) > most, "too_long").when(F.col(ocr_pages) > OCR_PAGES, "too_many_ocr_pages")


def _letters(x: Column, cls: str) -> Column:
    return F.regexp_extract_all(x, F.lit(f"([{cls}])"), 1)


def hint_is_reliable(hint="source_hint", confidence="source_confidence") -> Column:
    """Whether local OCR read enough of a Thai line to be believed."""
    v = strip(F.coalesce(hint, F.lit("")))
    own = _letters(v, CONSONANT)
    n, kinds = F.size(own), F.size(F.array_distinct(own))
    share = F.size(_letters(v, THAI)) / F.greatest(F.lit(1), F.char_length(squeeze(v)))
    varied = v.rlike(f"[{MARK}]") | (kinds / F.greatest(F.lit(1), n) >= 0.60)
    return (F.coalesce(confidence, F.lit(0.0)) >= 60) & (n >= 2) & (kinds >= 2) & (share >= 0.30) & varied


def read_needs_review(read: str, hint="source_hint", confidence="source_confidence") -> Column:
    """A reading without Thai that local OCR contradicts."""
    said = strip(F.coalesce(read, F.lit("")))
    none = (F.upper(said) == "[NO_TEXT]") & (F.coalesce(confidence, F.lit(0.0)) >= 80) & (F.size(_letters(F.coalesce(hint, F.lit("")), THAI)) >= 2)
    return ~has_thai(said) & (hint_is_reliable(hint, confidence) | none)


def is_tiny_label(box: Column, hint="source_hint") -> Column:
    """A small code that may stay unread: compact, short, little Thai, with a digit."""
    v = squeeze(F.coalesce(hint, F.lit("")))
    small = (F.greatest(g.width(box), g.height(box)) <= 36) | ((g.width(box) <= 28) & (g.height(box) <= 80))
    return ~g.is_empty(box) & small & F.char_length(v).between(1, 8) & (F.size(_letters(v, THAI)) <= 3) & v.rlike("[0-9๐-๙]")


def direction_matches(box: Column, rotation: Column) -> Column:
    level = F.pmod(rotation, F.lit(180)) == 0
    return F.when(level, g.height(box) <= g.width(box) * 1.5).otherwise(g.width(box) <= g.height(box) * 1.5)


def is_acceptable(text: str, score: str, box: Column, rotation: Column) -> Column:
    """An OCR line that can be accepted."""
    own, s = _letters(F.col(text), CONSONANT), F.col(score)
    thai = F.size(_letters(F.col(text), THAI))
    sure = (s >= 0.78) | ((thai >= 2) & (F.size(F.array_distinct(own)) >= 2))
    return (s >= 0.65) & (thai > 0) & direction_matches(box, rotation) & sure


def covers_seed(text: str, score: str, box: Column, rotation: Column) -> Column:
    thai = F.size(_letters(F.col(text), THAI))
    return direction_matches(box, rotation) & (F.col(score) >= 0.40) & (thai > 0) & ((F.col(score) >= 0.78) | (thai >= 2))


def looks_like_table(strokes: DataFrame, page: str, page_width: float, page_height: float) -> DataFrame:
    """(page, table_like) from strokes (page, kind 're' or 'l', x0, y0, x1, y1)."""
    wide, tall = max(20.0, page_width * 0.025), max(8.0, page_height * 0.015)
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    rect, line = F.col("kind") == "re", F.col("kind") == "l"
    flat = (rect & (w >= wide) & (h <= 2)) | (line & (h <= 0.8) & (w >= wide))
    up = (rect & (h >= tall) & (w <= 2)) | (line & ~((h <= 0.8) & (w >= wide)) & (w <= 0.8) & (h >= tall))
    counts = strokes.groupBy(page).agg(
        F.count_if(flat).alias("f"), F.count_if(up).alias("u"), F.count_if(rect & (w >= wide) & (h >= 4)).alias("c")
    )
    return counts.selectExpr(page, "c >= 6 or (f >= 4 and u >= 3) as table_like")


def profile_warnings(pages: DataFrame) -> DataFrame:
    """(document, kind, pages): pages by what must be said of them, in page order."""
    kept = "greatest(0, coalesce(preserved_source_chars, 0) - coalesce(protected_logo_source_chars, 0))"
    cases = {
        "visual": ("visual_required and not native_text_complete", "cast(page_number as string)"),
        "no_text_layer": ("coalesce(text_blocks, 0) = 0 and not visual_required", "cast(page_number as string)"),
        "preserved": (f"{kept} > 0", f"concat(page_number, ':', {kept})"),
        "logo": ("coalesce(protected_logo_source_chars, 0) > 0", "concat(page_number, ':', protected_logo_source_chars)"),
    }
    parts = [f"if({cond}, named_struct('kind', '{k}', 'said', {said}), null)" for k, (cond, said) in cases.items()]
    rows = pages.select("document", "page_number", F.explode(F.array_compact(F.expr(f"array({', '.join(parts)})"))).alias("w"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "w.said"))), lambda x: x["said"]), ", ")
    return rows.groupBy("document", F.col("w.kind").alias("kind")).agg(said.alias("pages"))


def segment_route() -> Column:
    """Which writer a segment goes to, from its flags: every segment has exactly one."""
    visual = F.coalesce("visual", F.lit(False)) | F.col("source_kind").isin("ocr", "visual")
    outline = visual & (F.coalesce("engine", F.lit("")) == "outline")
    return F.when(outline, "outline").when(visual, "layout").when(F.coalesce("engine", F.lit("")) == "text-layer", "text_layer").otherwise("native")


def pages_with_text(pages: DataFrame, route_: str, text: str) -> DataFrame:
    """Pages of a document in parts that are not scanned and have text."""
    return pages.where((F.col(route_) != "scanned_image") & (strip(F.coalesce(text, F.lit(""))) != ""))
