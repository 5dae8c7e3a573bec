"""Model responses: lenient parsing, strict checks, and comparisons of asked and returned ids."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import _c, strip
from lexigrid.functions.unicode_udf import _udf

ITEMS = "struct<items: array<struct<id: string, source_text: string, translated_text: string>>>"
IMAGE = "struct<source_language: string, source_text: string, translated_text: string>"
LAYOUT = "struct<source_language: string, blocks: array<struct<source_text: string, translated_text: string, bbox: array<string>>>>"
SPLITTABLE = "timed out|timeout|context length|too large|maximum"


def json_body(x) -> Column:
    """The object in a response: without a code fence, from the first brace to the last."""
    bare = F.regexp_replace(F.regexp_replace(strip(x), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found).otherwise(bare)


def _strict(text: str | None) -> str | None:
    """The body as JSON again, or null if it isn't an object or repeats a key at any depth."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(keys) != len(set(keys)):
            raise ValueError("repeated key")
        return dict(pairs)

    body = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", (text or "").strip()))
    a, z = body.find("{"), body.rfind("}")
    try:
        value = json.loads(body[a : z + 1] if 0 <= a < z else body, object_pairs_hook=once)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None


def strict_object(x) -> Column:
    """The object of a response; null if it is not one, or repeats a key.  Spark's reader keeps the last of two keys."""
    return _udf(_strict, "string")(x)


def items(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, id, source_text, translated_text) of the items array; missing fields are empty."""
    got = rows.select(key, F.inline(F.from_json(json_body(body), ITEMS)["items"]))
    return got.select(key, *(F.coalesce(c, F.lit("")).alias(c) for c in ("id", "source_text", "translated_text")))


def translations(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, id, translated_text) of the translations map, scalars only, as text."""
    inner = F.get_json_object(json_body(body), "$.translations")
    got = rows.select(key, F.explode(F.from_json(inner, "map<string,string>")).alias("id", "translated_text"))
    return got.where(F.col("translated_text").isNotNull() & ~F.col("translated_text").rlike(r"^\s*[\[{]"))


def image_result(body) -> Column:
    return F.from_json(json_body(body), IMAGE)


def layout_blocks(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, source_text, translated_text, x0, y0, x1, y1): blocks with both texts and a box of four numbers, clamped."""
    got = rows.select(key, F.inline(F.from_json(json_body(body), LAYOUT)["blocks"])).where("size(bbox) = 4")
    got = got.select(
        key, strip("source_text").alias("source_text"), strip("translated_text").alias("translated_text"),
        *(F.expr(f"greatest(0D, least(1000D, try_cast(bbox[{i}] as double)))").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))),
    )
    return got.where("source_text <> '' and translated_text <> '' and x1 > x0 and y1 > y0")


def responses_text(body) -> Column:
    """The text of a response: output_text, else the output texts of the nested contents, a line each."""
    kind = "struct<output_text: string, output: array<struct<content: array<struct<type: string, text: string>>>>>"
    x = F.from_json(_c(body), kind)
    parts = F.flatten(F.transform(x["output"], lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    own = F.filter(parts, lambda c: (c["type"] == "output_text") & (c["text"] != ""))
    joined = F.when(F.size(own) > 0, F.array_join(F.transform(own, lambda c: c["text"]), "\n"))
    return F.coalesce(x["output_text"], joined)


def chat_text(body) -> Column:
    """The text of a chat response: a string, or the texts of its parts, a line each."""
    content = F.get_json_object(_c(body), "$.choices[0].message.content")
    parts = F.filter(F.from_json(content, "array<struct<text: string>>"), lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return F.when(F.ltrim(content).startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).otherwise(content)


def compare_ids(asked: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem) for ids that are ``missing``, ``unknown``, ``repeated`` or ``blank``."""
    missing = asked.select(*keys).distinct().join(returned.select(*keys), keys, "left_anti").withColumn("problem", F.lit("missing"))
    unknown = returned.select(*keys).distinct().join(asked.select(*keys), keys, "left_anti")
    blank = F.coalesce(strip(keys[-1]), F.lit("")) == ""
    unknown = unknown.withColumn("problem", F.when(blank, "blank").otherwise("unknown"))
    again = returned.groupBy(*keys).count().where("count > 1").select(*keys).withColumn("problem", F.lit("repeated"))
    return missing.unionByName(unknown).unionByName(again)


def is_complete(asked: Column, returned: Column) -> Column:
    return F.size(F.array_except(asked, returned)) == 0


def retry_action(status, message) -> Column:
    """What a failed request calls for: ``retry``, ``fallback``, ``split`` or ``fail``."""
    return (
        F.when(_c(status).isin(401, 403, 429), "retry")
        .when(_c(status).isin(404, 405, 501), "fallback")
        .when(F.lower(_c(message)).rlike(SPLITTABLE), "split")
        .otherwise("fail")
    )


def longest_partial(results: DataFrame, key: str, items_: str, seq: str) -> DataFrame:
    """Of each key the result with the most items, the earliest of equals."""
    return results.groupBy(key).agg(F.max_by(F.col(items_), F.struct(F.size(items_), -F.col(seq))).alias(items_))


def reading_votes(readings: DataFrame, key: str, attempt: str, text: str, needed: int = 2) -> DataFrame:
    """(key, text): of readings without Thai the first that is given ``needed`` times, by its latest needed attempt."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, text).orderBy(attempt).rowsBetween(Window.unboundedPreceding, 0)
    seen = readings.where(~F.col(text).rlike("[฀-๿]")).withColumn("n", F.count("*").over(w)).where(F.col("n") == needed)
    return seen.groupBy(key).agg(F.min_by(text, F.struct(attempt, text)).alias(text))
