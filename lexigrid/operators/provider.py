"""Translators behind one interface, and the contract around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.functions.text import quality_warnings, strip, translation_text

# The phrases of the built-in translator and the label of what it doesn't know.
PHRASES = [
    ("zh", "th", "你好", "สวัสดี"), ("zh", "th", "谢谢", "ขอบคุณ"), ("zh", "th", "欢迎来到泰国", "ยินดีต้อนรับสู่ประเทศไทย"),
    ("zh", "en", "你好", "Hello"), ("zh", "en", "谢谢", "Thank you"),
    ("th", "zh", "สวัสดี", "你好"), ("th", "zh", "ขอบคุณ", "谢谢"), ("th", "en", "สวัสดี", "Hello"), ("th", "en", "ขอบคุณ", "Thank you"),
    ("en", "zh", "hello", "你好"), ("en", "zh", "thank you", "谢谢"), ("en", "th", "hello", "สวัสดี"), ("en", "th", "thank you", "ขอบคุณ"),
]
LABELS = {"zh": "演示译文", "th": "คำแปลตัวอย่าง", "en": "Demo translation"}
_providers: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, translate: Callable[[DataFrame], DataFrame]) -> None:
    """A provider takes (source_language, target_language, text, ...) rows and adds translated_text."""
    _providers[name] = translate


def demo(rows: DataFrame) -> DataFrame:
    """The built-in translator: a phrase as it stands, else in lower case, else the text under a label."""
    own = F.inline(F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, ("s", "t", "k", "v"), strict=True))) for p in PHRASES)))
    phrases = rows.sparkSession.range(1).select(own)
    out = rows.withColumn("_k", strip("text"))
    for name, key in (("_exact", F.col("_k")), ("_lower", F.lower("_k"))):
        side = phrases.select(F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("k").alias("_p"), F.col("v").alias(name))
        on = (F.col("source_language") == F.col("_s")) & (F.col("target_language") == F.col("_t")) & (key == F.col("_p"))
        out = out.join(F.broadcast(side), on, "left").drop("_s", "_t", "_p")  # thirteen rows
    label = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))[F.col("target_language")]
    return out.withColumn("translated_text", F.coalesce("_exact", "_lower", F.concat_ws(": ", label, "_k"))).drop("_k", "_exact", "_lower")


register("demo", demo)


def translate(rows: DataFrame, provider: str = "demo") -> DataFrame:
    """Rows with translated_text and warnings; each different text of a direction is translated once."""
    key = ["source_language", "target_language", "text"]
    done = _providers[provider](rows.select(*key).distinct())
    done = done.withColumn("translated_text", translation_text("translated_text"))
    out = rows.join(done, key)
    return out.withColumn("warnings", quality_warnings("text", "translated_text"))
