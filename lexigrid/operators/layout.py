"""Layout rules over boxes, lines and spans, and the remaining page-level filters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions import geometry as g
from lexigrid.functions.text import CONSONANT, THAI, bilingual_key, squeeze, strip

CONTEXT_LINES, CONTEXT_LENGTH = 80, 120


def alignment(n_lines: Column, box: Column, content: Column) -> Column:
    """Left, center or right by where a single line stands in the content box."""
    w = F.greatest(F.lit(1.0), g.width(content))
    off = F.abs((box["x0"] + box["x1"] - content["x0"] - content["x1"]) / 2)
    return (
        F.when((n_lines > 1) | (g.width(box) >= w * 0.8), "left")
        .when(off <= w * 0.06, "center")
        .when(F.abs(box["x1"] - content["x1"]) <= w * 0.025, "right")
        .otherwise("left")
    )


def leading(lines: DataFrame, group: str, order: str) -> DataFrame:
    """(group, leading): the median positive distance of following baselines, never below the font size."""
    step = F.abs(F.col("baseline") - F.lag("baseline").over(Window.partitionBy(group).orderBy(order)))
    rows = lines.withColumn("_d", F.when(step > 0, step))
    size = F.max("font_size")
    alone = F.greatest(size, F.max("height"))
    return rows.groupBy(group).agg(
        F.when(F.count("*") < 2, alone).otherwise(F.greatest(size, F.coalesce(F.median("_d"), size * 1.15))).alias("leading")
    )


def majority(flag: Column, weight: Column) -> Column:
    """Aggregate: whether the flagged weight is half of all or more."""
    w = F.greatest(F.lit(1), weight)
    return F.sum(F.when(flag, w).otherwise(0)) * 2 >= F.sum(w)


def clip_line(box: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a line inside a box as struct<x0, y0, x1, y1>; null if it misses it or is shorter than half a unit."""
    dx, dy = x1 - x0, y1 - y0
    sides = ((-dx, x0 - box["x0"]), (dx, box["x1"] - x0), (-dy, y0 - box["y0"]), (dy, box["y1"] - y0))
    flat = lambda p: F.abs(p) < 1e-9
    low = F.greatest(F.lit(0.0), *(F.when(~flat(p) & (p < 0), q / p) for p, q in sides))
    high = F.least(F.lit(1.0), *(F.when(~flat(p) & (p > 0), q / p) for p, q in sides))
    outside = F.lit(False)
    for p, q in sides:
        outside |= flat(p) & (q < 0)
    part = g.box(x0 + low * dx, y0 + low * dy, x0 + high * dx, y0 + high * dy)
    length = F.sqrt(F.pow(dx * (high - low), F.lit(2)) + F.pow(dy * (high - low), F.lit(2)))
    return F.when(~outside & (low <= high) & (length >= 0.5), part)


def distinct_lines(lines: DataFrame, part: list[str], order: str) -> DataFrame:
    """The first of the lines whose ends and width agree to two places."""
    key = [F.round(c, 2).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1", "width")]
    w = Window.partitionBy(*part, *(f"_{c}" for c in ("x0", "y0", "x1", "y1", "width"))).orderBy(order)
    return lines.select("*", *key).withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*lines.columns)


def context_lines(lines: DataFrame, page: str, order: str, text: str, score: str) -> DataFrame:
    """(page, text, place): sure, short lines without Thai but with a letter or digit, each once, the first eighty."""
    ok = (F.col(score) >= 0.80) & ~F.col(text).rlike(f"[{THAI}]") & F.col(text).rlike(r"(?U)[\p{L}\p{N}]")
    own = lines.where(ok & (F.char_length(text) <= CONTEXT_LENGTH)).groupBy(page, text).agg(F.min(order).alias("_o"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("_o"))).where(F.col("place") <= CONTEXT_LINES).drop("_o")


def gap_is_credible(text: str, confidence: str, matched: Column) -> Column:
    """Whether a line found in a gap is kept: matched to a known text, or sure, varied, mostly Thai and not too long."""
    t = F.col(text)
    own = F.regexp_extract_all(t, F.lit(f"([{CONSONANT}])"), 1)
    n, kinds = F.size(own), F.size(F.array_distinct(own))
    share = F.regexp_count(t, F.lit(f"[{THAI}]")) / F.greatest(F.lit(1), F.char_length(squeeze(t)))
    sure = (F.col(confidence) >= 72) & (n >= 3) & (kinds >= 2) & (kinds / F.greatest(F.lit(1), n) >= 0.30) & (share >= 0.35)
    return matched | (sure & (F.char_length(t) <= 250))


def reading_is_confirmed(text: str, score: str) -> Column:
    own = F.regexp_extract_all(F.col(text), F.lit(f"([{CONSONANT}])"), 1)
    return (F.col(score) >= 0.55) & (F.size(own) >= 3) & (F.size(F.array_distinct(own)) >= 2)


def recall_shape(box: Column, page_height: float, band: float = 0.24) -> Column:
    """Long boxes, or less long ones in the top band of the page."""
    long_, short = F.greatest(g.width(box), g.height(box)), F.greatest(F.lit(1.0), F.least(g.width(box), g.height(box)))
    aspect = long_ / short
    return (aspect >= 3.0) | ((aspect >= 1.5) & (box["y1"] <= page_height * band))


def clip_at_barriers(boxes: DataFrame, barriers: DataFrame, page: str, ident: str, margin: float = 5, slack: float = 1) -> DataFrame:
    """(ident, bbox): boxes (rotation, bbox) kept to their widest stretch between barriers (page, axis, pos, lo, hi).

    Level boxes are cut by vertical barriers ('v'), others by horizontal ones ('h'), where one crosses their middle line
    and stands off both ends by the margin.  Of equal stretches the first stays.
    """
    a, b = boxes.alias("a"), barriers.withColumnRenamed(page, "_p").alias("b")
    box, level = F.col("a.bbox"), F.pmod(F.col("a.rotation"), F.lit(180)) == 0
    low, high = F.when(level, box["x0"]).otherwise(box["y0"]), F.when(level, box["x1"]).otherwise(box["y1"])
    middle = F.when(level, g.center_y(box)).otherwise(g.center_x(box))
    cuts = (F.col("axis") == F.when(level, "v").otherwise("h")) & (F.col("pos") > low + margin) & (F.col("pos") < high - margin)
    cuts &= middle.between(F.col("lo") - slack, F.col("hi") + slack)
    met = a.join(b, (F.col(f"a.{page}") == F.col("b._p")) & cuts, "left")
    own = met.groupBy(F.col(f"a.{ident}").alias(ident)).agg(
        F.first("a.bbox").alias("o"), F.first(level).alias("level"), F.first(low).alias("low"), F.first(high).alias("high"),
        F.sort_array(F.collect_list("pos")).alias("cuts"),
    )
    own = own.withColumn("s", F.concat(F.array("low"), "cuts")).withColumn("e", F.concat("cuts", F.array("high")))
    spans = F.transform(F.arrays_zip("s", "e"), lambda z: F.struct((z["s"] - z["e"]).alias("n"), z["s"].alias("s"), z["e"].alias("e")))
    best = F.element_at(F.array_sort(spans), 1)
    o = F.col("o")
    flat, up = g.box(best["s"], o["y0"], best["e"], o["y1"]), g.box(o["x0"], best["s"], o["x1"], best["e"])
    return own.select(ident, F.when(F.col("level"), flat).otherwise(up).alias("bbox"))


def _line_share(a, b, rotation) -> bool:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return False
    aw, ah, bw, bh = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    if w * h / max(1.0, min(aw * ah, bw * bh)) >= 0.45:
        return True
    across, along = h / max(1.0, min(ah, bh)), w / max(1.0, min(aw, bw))
    return (across >= 0.72 and along >= 0.12) if rotation in (0, 180) else (along >= 0.72 and across >= 0.12)


def recall_additions(candidates: DataFrame, covered: DataFrame, page: str) -> DataFrame:
    """Candidates (page, pos, rotation, exact, x0, y0, x1, y1) that no covered box of their rotation has, in order.

    Each kept candidate covers for the next ones; exact short labels only collide by overlap, not by sharing a line.
    """

    def fold(key, own: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        taken = [(r.rotation % 360, (r.x0, r.y0, r.x1, r.y1)) for r in old.itertuples()]
        keep = []
        for r in own.sort_values("pos").itertuples():
            box, rot = (r.x0, r.y0, r.x1, r.y1), r.rotation % 360

            def hit(b, box=box, rot=rot, exact=r.exact):
                w, h = min(box[2], b[2]) - max(box[0], b[0]), min(box[3], b[3]) - max(box[1], b[1])
                share = w * h / max(1.0, min((box[2] - box[0]) * (box[3] - box[1]), (b[2] - b[0]) * (b[3] - b[1]))) if w > 0 and h > 0 else 0
                return share >= 0.50 or (not exact and _line_share(box, b, rot))

            if not any(k == rot and hit(b) for k, b in taken):
                keep.append(r.Index)
                taken.append((rot, box))
        return own.loc[keep]

    return candidates.groupBy(page).cogroup(covered.groupBy(page)).applyInPandas(fold, candidates.schema)


def merge_bilingual(labels: DataFrame, page: str, order: str) -> DataFrame:
    """Labels (page, pos, text, translated_text, x0..y1) of one translation that stand above each other joined into one.

    In order, each label takes up the later ones of its translation key that share 0.35 of the narrower width with what
    it has grown to and stand no further off than 18 units or half again the lower height.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        todo, out = rows.sort_values(order).to_dict("records"), []
        while todo:
            own, rest = todo[0], []
            for r in todo[1:]:
                shared = min(own["x1"], r["x1"]) - max(own["x0"], r["x0"])
                gap = max(0.0, r["y0"] - own["y1"], own["y0"] - r["y1"])
                narrow = min(own["x1"] - own["x0"], r["x1"] - r["x0"])
                low = min(own["y1"] - own["y0"], r["y1"] - r["y0"])
                if own["_key"] and r["_key"] == own["_key"] and max(0.0, shared) >= narrow * 0.35 and gap <= max(18.0, low * 1.5):
                    own["text"] += "\n" + r["text"]
                    own |= {c: f(own[c], r[c]) for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}
                else:
                    rest.append(r)
            out.append(own)
            todo = rest
        return pd.DataFrame(out, columns=rows.columns)

    keyed = labels.withColumn("text", strip("text")).withColumn("_key", bilingual_key("translated_text"))
    return keyed.groupBy(page).applyInPandas(fold, keyed.schema).drop("_key")


def wrap_tokens(x: Column) -> Column:
    """The pieces at which a text may break: runs of Latin letters and digits, single other characters, spaces."""
    return F.regexp_extract_all(x, F.lit(r"([A-Za-z0-9]+|\s+|[^A-Za-z0-9\s])"), 1)


def wrap_lines(x: Column, width: int) -> Column:
    """A text as lines of at most ``width`` characters, broken between pieces; a longer piece has a line of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(s: Column, t: Column) -> Column:
        fits = (F.char_length(s["line"]) + F.char_length(t) <= width) | (s["line"] == "")
        on = F.struct(s["done"].alias("done"), F.when(s["line"] == "", F.ltrim(t)).otherwise(F.concat(s["line"], t)).alias("line"))
        cut = F.struct(F.array_append(s["done"], F.rtrim(s["line"])).alias("done"), F.ltrim(t).alias("line"))
        return F.when(fits, on).otherwise(cut)

    return F.aggregate(
        wrap_tokens(x), start, step, lambda s: F.when(F.trim(s["line"]) == "", s["done"]).otherwise(F.array_append(s["done"], F.rtrim(s["line"])))
    )


def positioned_parts(rows: DataFrame, ident: str) -> DataFrame:
    """(ident, part, source, translated): the cells of rows whose texts split alike at wide gaps; others stay whole."""
    cells = lambda c: F.split(strip(c), r"(?U)\s{2,}")
    both = rows.select(ident, cells("text").alias("a"), cells("translated_text").alias("b"), strip("text").alias("t"), strip("translated_text").alias("u"))
    fits = (F.size("a") == F.size("b")) & (F.size("b") >= 2)
    pairs = F.when(fits, F.arrays_zip("a", "b")).otherwise(F.array(F.struct(F.col("t").alias("a"), F.col("u").alias("b"))))
    return both.select(ident, F.posexplode(pairs).alias("part", "z")).select(ident, (F.col("part") + 1).alias("part"), F.col("z.a").alias("source"), F.col("z.b").alias("translated"))


def repack_rows(rows: DataFrame, signature: list[str], order: list[str]) -> DataFrame:
    """Rows of compatible sheets packed densely: sheet and row within it, by the largest capacity of the signature."""
    own = Window.partitionBy(*signature)
    out = rows.withColumn("_c", F.greatest(F.lit(1), F.max("capacity").over(own))).withColumn("_n", F.row_number().over(own.orderBy(*order)) - 1)
    return out.withColumn("sheet", F.floor(F.col("_n") / F.col("_c")).cast("int")).withColumn("sheet_row", (F.col("_n") % F.col("_c")).cast("int")).drop("_c", "_n")


def request_payload(segments: DataFrame, part: list[str], order: str) -> DataFrame:
    """(part, payload): the segments of a batch as one JSON object, in order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, "id", "text"))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))
    return segments.groupBy(*part).agg(F.to_json(F.struct(items.alias("segments"))).alias("payload"))


def initial_completed(pages: DataFrame, document: str) -> DataFrame:
    """(document, completed): pages that need neither visual nor text work."""
    work = F.coalesce("visual", F.lit(False)) | (strip(F.coalesce("text", F.lit(""))) != "")
    return pages.groupBy(document).agg(F.greatest(F.lit(0), F.count("*") - F.count_if(work)).alias("completed"))


def label_font_size(cross: Column, lines: Column, n_consonants: Column) -> Column:
    """A font size from the size across the reading direction: 2 to 14 units, 7 for labels of at most two consonants."""
    most = F.when(n_consonants <= 2, 7.0).otherwise(14.0)
    return F.greatest(F.lit(2.0), F.least(most, cross / F.greatest(F.lit(1), lines) * 0.72))
