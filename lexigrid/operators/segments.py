"""Segments in order: islands, batches, pages, reuse of work."""

from __future__ import annotations

from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.functions.text import collapse, separate_list_items, strip

BATCH_ITEMS, BATCH_CHARACTERS, BATCH_PAGES = 180, 6000, 5


def islands(rows: DataFrame, part: list[str], order: list[str | Column], joined: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a new run starts where ``joined``, over the row and the columns _prev, is not true."""
    w = Window.partitionBy(*part).orderBy(*order)
    whole = F.struct(*rows.columns)
    out = rows.withColumn("_prev", F.lag(whole).over(w))
    out = out.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    return out.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_prev", "_new")


def same_paragraph() -> Column:
    """Whether a unit (text, color, font_size, bbox) goes on the paragraph of the one before it."""
    p, s, t = F.col("_prev"), F.col("_prev.font_size"), F.col("font_size")
    a, b = F.col("_prev.bbox"), F.col("bbox")
    big, small = F.greatest(s, t), F.least(s, t)
    gap = b["y0"] - a["y1"]
    return (
        p.isNotNull()
        & (F.col("color") == p["color"])
        & ~separate_list_items(p["text"], F.col("text"))
        & (F.abs(s - t) <= F.greatest(F.lit(0.75), small * 0.12))
        & (b["y0"] >= a["y0"])
        & (b["y1"] - a["y1"] <= big * 1.70)
        & (gap >= -F.greatest(F.lit(1.0), small * 0.55))
        & (gap <= F.greatest(F.lit(4.0), big * 0.8))
        & (F.abs(b["x0"] - a["x0"]) <= F.greatest(F.lit(8.0), big * 2.0))
    )


def same_list() -> Column:
    """Whether a unit is the next row of a widely spaced list."""
    p, s, t = F.col("_prev"), F.col("_prev.font_size"), F.col("font_size")
    a, b = F.col("_prev.bbox"), F.col("bbox")
    big = F.greatest(s, t)
    gap = b["y1"] - a["y1"]
    return (
        p.isNotNull()
        & (F.col("color") == p["color"])
        & (F.abs(s - t) <= F.greatest(F.lit(0.75), F.least(s, t) * 0.12))
        & (F.abs(b["x0"] - a["x0"]) <= big * 0.5)
        & (gap > big * 1.70)
        & (gap <= big * 3.50)
    )


def vertical_lists(units: DataFrame, page: str = "page_number", order: str = "pos") -> DataFrame:
    """Units with list_width: the width shared by three or more rows of a list; null outside one."""
    out = islands(units, [page], [order], same_list(), "_list")
    w = Window.partitionBy(page, "_list")
    wide = F.max(F.expr("bbox.x1 - bbox.x0")).over(w)
    return out.withColumn("list_width", F.when(F.count("*").over(w) >= 3, wide)).drop("_list")


def merge_paragraphs(units: DataFrame, page: str = "page_number", order: str = "pos") -> DataFrame:
    """A row a paragraph: text joined by spaces, or with none after a hyphen; its box, median font size and leading."""
    parts = islands(units, [page], [order], same_paragraph(), "paragraph")
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: strip(x["text"]))
    glue = lambda acc, t: strip(F.concat(acc, F.when(acc.endswith("-"), "").otherwise(" "), t))
    down = F.col("bbox.y1") - F.lag("bbox.y1").over(Window.partitionBy(page, "paragraph").orderBy(order))
    parts = parts.withColumn("_down", F.when(down > 0, down))
    return parts.groupBy(page, "paragraph").agg(
        F.aggregate(texts, F.lit(""), glue).alias("text"),
        F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"),
        F.median("font_size").alias("font_size"), F.count("*").alias("n_units"),
        F.coalesce(F.median("_down"), F.median("font_size") * 1.2).alias("leading"),
    )


def pack_batches(
    segments: DataFrame, key: str, order: str, page: str, text: str,
    items: int = BATCH_ITEMS, characters: int = BATCH_CHARACTERS, pages: int = BATCH_PAGES,
) -> DataFrame:
    """(key, order, batch): a batch closes before a segment that would pass the items, characters or pages it may hold.

    A fold over each document's ordered segments, in the JVM.  The state is five numbers, whatever the length.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(page).alias("p"), F.char_length(text).alias("n"))))
    start = "named_struct('b', 0, 'items', 0, 'chars', 0, 'pages', cast(array() as array<bigint>), 'out', cast(array() as array<int>))"
    full = f"""(s.items > 0 and (s.items >= {items} or s.chars + x.n > {characters}
               or (not array_contains(s.pages, cast(x.p as bigint)) and size(s.pages) >= {pages})))"""
    step = f"""(s, x) -> if({full},
        named_struct('b', s.b + 1, 'items', 1, 'chars', x.n, 'pages', array(cast(x.p as bigint)), 'out', array_append(s.out, s.b + 1)),
        named_struct('b', s.b, 'items', s.items + 1, 'chars', s.chars + x.n,
                     'pages', array_union(s.pages, array(cast(x.p as bigint))), 'out', array_append(s.out, s.b)))"""
    folded = segments.groupBy(key).agg(rows.alias("r")).withColumn("b", F.expr(f"aggregate(r, {start}, {step}, s -> s.out)"))
    return folded.select(key, F.explode(F.arrays_zip("r", "b")).alias("z")).select(key, F.col("z.r.o").alias(order), F.col("z.b").alias("batch"))


def fixed_chunks(rows: DataFrame, part: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / n).cast("int"))


def join_pages(lines: DataFrame, key: str, page: str, order: str, text: str) -> DataFrame:
    """(key, text): pages in order under their headings, or the bare text of a single page; blank pages left out."""
    by_page = lines.groupBy(key, page).agg(
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")).alias("t")
    )
    all_ = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), "t")))
    headed = F.array_join(F.transform(all_, lambda x: F.concat(F.lit("【第 "), x["p"].cast("string"), F.lit(" 页】\n"), x["t"])), "\n\n")
    out = by_page.groupBy(key).agg(F.max(page).alias("n"), headed.alias("headed"), F.first("t").alias("only"))
    return out.select(key, F.when(F.col("n") > 1, F.col("headed")).otherwise(F.col("only")).alias("text"))


def split_pages(texts: DataFrame, key: str, text: str, default_page: int | None = None) -> DataFrame:
    """(key, page_number, text): what follows each page heading; of a repeated page the last; without one the default."""
    mark = r"(?U)【第\s*(\d+)\s*页】"
    parts = texts.select(key, F.col(text).alias("t"), F.expr(f"transform(regexp_extract_all({text}, '{mark.replace(chr(92), chr(92) * 2)}', 1), x -> cast(x as int))").alias("p"))
    cut = parts.where("size(p) > 0").select(
        key, F.posexplode(F.arrays_zip(F.col("p"), F.slice(F.split("t", mark), 2, 2_000_000).alias("t")).alias("z")).alias("pos", "z")
    )
    found = cut.groupBy(key, F.col("z.p").alias("page_number")).agg(strip(F.max_by("z.t", "pos")).alias("text"))
    if default_page is None:
        return found
    rest = parts.where("size(p) = 0").select(key, F.lit(default_page).alias("page_number"), strip("t").alias("text"))
    return found.unionByName(rest)


def reuse_first(rows: DataFrame, key: Column, order: list[str], value: str) -> DataFrame:
    """Rows with the value that the first row of the same key gives, where there is one."""
    w = Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_k", key)
    return out.withColumn(value, F.coalesce(F.first(F.nullif(strip(value), F.lit("")), ignorenulls=True).over(w), value)).drop("_k")


def distinct_work(rows: DataFrame, text: str) -> DataFrame:
    """The different keys of a text column, each once, with how many rows it stands for."""
    return rows.groupBy(strip(collapse(text)).alias("key")).agg(F.count("*").alias("n_rows"))


def fan_out(rows: DataFrame, done: DataFrame, text: str) -> DataFrame:
    """Rows with the results of their keys."""
    return rows.withColumn("key", strip(collapse(text))).join(done, "key", "left")


def replace_rows(rows: DataFrame, replacements: DataFrame, key: str) -> DataFrame:
    """Rows without those that are replaced, and the replacements."""
    return rows.join(replacements.select(key).distinct(), key, "left_anti").unionByName(replacements)


def ordinals(rows: DataFrame, part: list[str], order: list[str], prefix: str, width: int = 3) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return rows.withColumn("ordinal", F.concat(F.lit(prefix), F.lpad(F.row_number().over(w).cast("string"), width, "0")))


def first_seen(rows: DataFrame, part: list[str], value: str, order: list[str]) -> DataFrame:
    """Each value of a group once, with its place by first sight."""
    at = rows.groupBy(*part, value).agg(F.min(F.struct(*order)).alias("_at"))
    return at.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy("_at"))).drop("_at")


def positions_agree(a: Column, b: Column) -> Column:
    """Whether two character sequences are the same but for white space."""
    drop = lambda x: F.filter(x, lambda c: ~c.rlike(r"(?U)^\s*$"))
    return drop(a) == drop(b)


def same_group() -> Column:
    """Whether a line of a second extractor (rotation, bold, italic, font_size, bbox) goes on the group before it."""
    p, s, t = F.col("_prev"), F.col("_prev.font_size"), F.col("font_size")
    a, b = F.col("_prev.bbox"), F.col("bbox")
    style = (p["rotation"] == F.col("rotation")) & (p["bold"] == F.col("bold")) & (p["italic"] == F.col("italic"))
    style &= F.abs(s - t) <= F.greatest(F.lit(0.35), F.least(s, t) * 0.08)
    level = F.col("rotation").isin(0, 180)
    pick = lambda h, v: F.when(level, h).otherwise(v)
    near = lambda lo, hi: (F.abs((a[lo] + a[hi] - b[lo] - b[hi]) / 2), F.least(a[hi] - a[lo], b[hi] - b[lo]))
    (dy, h), (dx, w) = near("y0", "y1"), near("x0", "x1")
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.greatest(a[lo], b[lo]) - F.least(a[hi], b[hi]))
    both = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    apart = pick(dy, dx) >= pick(h, w) * 0.55
    aligned = pick(both("x0", "x1"), both("y0", "y1")) >= pick(w, h) * 0.15
    return p.isNotNull() & style & apart & aligned & (pick(gap("y0", "y1"), gap("x0", "x1")) <= F.greatest(s, t) * 1.25)


def merge_fragments(lines: DataFrame) -> DataFrame:
    """Fragments (page, pos, text, x0, y0, x1, y1, baseline, size, color) of one baseline joined by a space.

    A fragment is compared with the line as it has grown, medians over characters included, so this is an ordered fold
    over the rows of one page.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in rows.sort_values("pos").to_dict("records"):
            r["text"] = r["text"].strip()
            n = max(1, len(r["text"]))
            r["_sizes"], r["_bases"] = [r["size"]] * n, [r["baseline"]] * n
            last = out[-1] if out and out[-1]["text"] and r["text"] else None
            if last:
                s, t = median(last["_sizes"]), median(r["_sizes"])
                limit = max(0.75, min(s, t) * 0.12)
                level = abs(median(last["_bases"]) - median(r["_bases"])) <= limit
                alike = abs(s - t) <= limit and last["color"] == r["color"]
                if level and alike and -0.5 <= r["x0"] - last["x1"] <= max(8.0, max(s, t) * 2.25):
                    last["text"] += " " + r["text"]
                    last["_sizes"] += [last["size"], *r["_sizes"]]
                    last["_bases"] += [last["_bases"][-1], *r["_bases"]]
                    last |= {k: f(last[k], r[k]) for k, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}
                    continue
            out.append(r)
        done = pd.DataFrame([r | {"size": float(median(r["_sizes"]))} for r in out], columns=[*rows.columns])
        return done[list(rows.columns)]

    return lines.groupBy("page").applyInPandas(one, lines.schema)


def translated(rows: DataFrame, done: DataFrame, part: list[str], order: list[str], value: str) -> DataFrame:
    """Rows that have a translation, which is stripped and not blank, with their place in order; the others go."""
    own = done.select(*part, *order, strip(value).alias(value)).where(F.col(value) != "")
    return rows.join(own, [*part, *order]).withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def last_by_part(rows: DataFrame, prefix: str, ident: str, value: str, seq: str) -> DataFrame:
    """(part, paragraph, value): of ids ``prefix`` part ``:`` paragraph the value that comes last; other ids go."""
    own = rows.where(F.col(ident).startswith(prefix)).withColumn("_r", F.substring(ident, len(prefix) + 1, 1 << 30))
    own = own.where(F.col("_r").rlike(r"^.+:\d{1,18}$"))
    part, paragraph = F.regexp_extract("_r", r"^(.+):\d+$", 1), F.regexp_extract("_r", r":(\d+)$", 1).cast("bigint")
    return own.groupBy(part.alias("part"), paragraph.alias("paragraph")).agg(F.max_by(value, seq).alias(value))


def side_by_side(rows: DataFrame, keys: list[str], expected: str, baseline: str) -> DataFrame:
    """(keys, place from 1, expected, baseline): what stands at the same place of two arrays, null beyond the second."""
    out = rows.select(*keys, baseline, F.posexplode(expected).alias("_i", "_e"))
    return out.select(*keys, (F.col("_i") + 1).alias("place"), F.col("_e").alias(expected), F.get(baseline, F.col("_i")).alias(baseline))


def pages_apart(rows: DataFrame, others: DataFrame, page: str) -> DataFrame:
    """The pages of ``rows`` that ``others`` lacks, each once."""
    return rows.select(page).distinct().join(others.select(page), page, "left_anti")
