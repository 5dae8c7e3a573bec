"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations alone.

1. Phrases.  Benchmark texts become phrases (windows of ``PHRASE`` words, or the whole of a shorter item) and owners
   (phrase, item).  Their terms are the vocabulary.
2. Index.  One pass over the corpus stores a posting (term, document, position) for each word of the vocabulary, and
   one that holds the length of the document.  Nothing else of a text is stored or moved.  Term counts, over all
   documents, are those of the postings.
3. Search.  Each phrase starts from its ``RAREST`` rarest terms.  Their lists, each less the term's offset in the
   phrase, are intersected on (document, start): an anchor is a start to which two of them lead within ``SLOP`` words
   (or the only one, where a phrase has one).  The lists of all other terms are then intersected with the anchors'.
   All terms in their places are an exact match; all but ``MISSES``, each within ``SLOP`` words of its place, a near one.

Words are joined with the vocabulary while they lie, so a term that a third of the corpus holds makes no hot partition.
Vocabulary, starting terms and anchors are broadcast only below ``BROADCAST_BYTES`` as counted, and are joined by a
shuffle that adaptive execution can split beyond it.  Postings of lengths have ``LENGTHS`` keys, dealt by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrid.llm.common import free_prefix, stage, table, without

PHRASE, RAREST, SLOP, MISSES = 13, 3, 3, 3
BROADCAST_BYTES = 32 << 20
#: Terms that no text can hold; their postings, of number -1, hold the lengths of documents.
LENGTH_TERM, LENGTHS = "\x00", 256
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _tokens(text: str) -> str:
    """SQL for the words of a text; the first and the last may be empty."""
    lowered = (
        f"if(octet_length({text}) = char_length({text}), lower({text}), "
        f"translate({text}, '{_UPPER}', '{_UPPER.lower()}'))"
    )
    pattern = _BETWEEN.replace("\\", "\\\\")
    return f"split({lowered}, '{pattern}')"


def phrases_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """(pid, phrase, len): the different phrases of all items, and (pid, item): whose they are.  Both staged.

    Items without a word have none.
    """
    words = items.where(f"{id_col} is not null").select(
        F.col(id_col).cast("string").alias("item"), F.array_remove(F.expr(_tokens(text_col)), "").alias("w")
    )
    starts = words.where("size(w) > 0").withColumn("at", F.explode(F.expr(f"sequence(1, greatest(1, size(w) - {width - 1}))")))
    cut = stage(starts.select("item", F.expr(f"slice(w, at, {width})").alias("phrase")).distinct(), "windows")
    phrases = cut.select("phrase").distinct().withColumn("pid", F.monotonically_increasing_id())
    phrases = stage(phrases.withColumn("len", F.size("phrase")), "phrases")
    return phrases, stage(cut.join(phrases, "phrase").select("pid", "item"), "owners")


def vocabulary_of(phrases: DataFrame) -> DataFrame:
    """(term, t): the different terms with a number each."""
    terms = phrases.select(F.explode("phrase").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id())
    return stage(terms, "vocabulary")


def _sized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Broadcast if all rows together are small by their own count."""
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(64))
    n = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def _document_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, w): doc is the id, which may be null, with a number that tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    doc = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tid"))
    return docs.select(doc.alias("doc"), F.coalesce(text, F.lit("")).alias("x")).select("doc", F.expr(_tokens("x")).alias("w"))


def build_index(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (doc, t, pos) of the terms of the vocabulary, and for t = -1 the number of words of each document."""
    lengths = words.sparkSession.range(LENGTHS).selectExpr(f"concat('{LENGTH_TERM}', id) as term", "-1L as t")
    count = "greatest(0, size(w) - if(w[0] = '', 1, 0) - if(w[size(w) - 1] = '', 1, 0))"
    own = f"array(concat('{LENGTH_TERM}', pmod(xxhash64(doc), {LENGTHS})))"
    every = words.select("doc", F.expr(count).alias("n"), F.posexplode(F.expr(f"concat(w, {own})")).alias("pos", "term"))
    terms = stage(vocabulary.select("term", "t").unionByName(lengths), "terms")
    return every.join(_sized(terms, ["term"]), "term").select("doc", "t", F.expr("if(t < 0, n, pos)").alias("pos"))


def lookups(phrases: DataFrame, vocabulary: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(pid, len, terms): every place of the phrase as struct(rank, t, off); ranks by rarity, -1 for places not started from."""
    places = phrases.select("pid", "len", F.posexplode("phrase").alias("off", "term")).join(vocabulary, "term")
    places = places.join(counts, "t", "left").fillna(0, "n")
    ordered = places.groupBy("pid", "len").agg(F.array_sort(F.collect_list(F.struct("n", "term", "t", "off"))).alias("all"))  # a phrase's words
    different = "filter(all, (x, i) -> i = 0 or all[i - 1].t <> x.t)"
    ranked = f"transform(slice({different}, 1, {rarest}), (x, i) -> struct(i as rank, x.t as t, x.off as off))"
    rest = "transform(all, x -> struct(-1 as rank, x.t as t, x.off as off))"
    return ordered.selectExpr("pid", "len", f"concat({ranked}, {rest}) as terms", f"size({ranked}) as need")


def anchors(index: DataFrame, found: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc, pid, start): where two of a phrase's rarest terms, or its only one, lead to within ``slop`` words."""
    keys = found.select("pid", "need", F.explode("terms").alias("x")).selectExpr("pid", "need", "x.*").where("rank >= 0")
    keys = stage(keys, "keys")
    hits = index.join(_sized(keys, ["pid", "t", "off"]), "t").select("doc", "pid", "need", "rank", F.expr("pos - off as start"))
    near = Window.partitionBy("doc", "pid").orderBy("start").rangeBetween(-slop, slop)  # within one document and phrase
    seen = hits.withColumn("seen", F.expr("bit_or(shiftleft(1, rank))").over(near))
    return seen.where("bit_count(seen) >= least(2, need)").select("doc", "pid", "start").distinct()


def matches(index: DataFrame, found: DataFrame, at: DataFrame, slop: int = SLOP, misses: int = MISSES) -> DataFrame:
    """(doc, pid, start, len, exact) for the anchors from which all of the phrase, or nearly all of it, is met.

    exact: word for word.  Else at most ``misses`` of its words are not within ``slop`` words of their places, and never
    more than half.
    """
    wide = 2 * slop + 1  # places within slop of one lie in two parts of this width at most
    places = found.select("pid", "len", F.explode("terms").alias("x")).selectExpr("pid", "len", "x.*").where("rank < 0")
    needs = at.join(_sized(places, ["pid", "t", "off"]), "pid").withColumn("place", F.expr("start + off"))
    parts = f"array_distinct(array(floor((place - {slop}) / {wide}), floor((place + {slop}) / {wide})))"
    needs = needs.select("doc", "pid", "start", "len", "t", "off", "place", F.explode(F.expr(parts)).alias("part"))
    needs = _sized(stage(needs, "needs"), ["doc"])
    there = index.where("t >= 0").withColumn("part", F.expr(f"floor(pos / {wide})"))
    met = there.join(needs, ["doc", "t", "part"]).where(f"abs(pos - place) <= {slop}")
    met = met.groupBy("doc", "pid", "start", "len", "off").agg(F.max(F.expr("pos = place")).alias("same"))
    sums = met.groupBy("doc", "pid", "start", "len").agg(F.count("*").alias("n"), F.count_if("same").alias("exact"))
    sums = sums.where(f"exact = len or (n >= len - {misses} and 2 * n > len)")
    return sums.select("doc", "pid", "start", "len", F.expr("exact = len").alias("exact"))


def _items(found: DataFrame, owners: DataFrame, name: str) -> DataFrame:
    """The items, sorted, that a document meets: as many as the result has to name."""
    named = found.select("doc", "pid").distinct().join(_sized(owners, ["item"]), "pid").select("doc", "item").distinct()
    return named.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias(name))


def contamination(docs: DataFrame, items: DataFrame, width: int = PHRASE, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, tid, n_words, n_hit, items, near_items, contaminated) for each row of ``docs``.

    items: the ids, as sorted strings, of the benchmark items of which a phrase occurs; near_items: of which a phrase
    occurs exactly or nearly.  contaminated: at least one word in twenty is inside an exact occurrence.  Null and empty
    texts have no words; texts of any length are read whole; rows of one id are told apart by their text, rows alike in
    both give one row each; items of null id or without words match nothing; an empty table on either side gives no hits.
    """
    words = _document_words(docs, id_col, text_col)
    phrases, owners = phrases_of(items, width=width)
    vocabulary = vocabulary_of(phrases)
    index = stage(build_index(words, vocabulary), "index")
    counts = index.where("t >= 0").groupBy("t").agg(F.count("*").alias("n"))
    found = stage(lookups(phrases, vocabulary, counts), "lookups")
    every = stage(matches(index, found, stage(anchors(index, found), "anchors")), "matches")
    hits = every.where("exact")
    cover = hits.select("doc", F.explode(F.expr("sequence(start, start + len - 1)")).alias("at")).distinct()
    marks = cover.groupBy("doc").agg(F.count("*").alias("n_hit"))
    marks = marks.join(_items(hits, owners, "items"), "doc").join(_items(every, owners, "near_items"), "doc", "full")
    lengths = index.where("t < 0").select("doc", F.col("pos").alias("n_words"))
    none = "cast(array() as array<string>)"
    return lengths.join(_sized(stage(marks, "marks"), ["doc", "items", "near_items"]), "doc", "left").selectExpr(
        "doc.doc_id as doc_id",
        "doc.tid as tid",
        "cast(n_words as bigint) as n_words",
        "cast(coalesce(n_hit, 0) as bigint) as n_hit",
        f"coalesce(items, {none}) as items",
        f"coalesce(near_items, {none}) as near_items",
        "coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= n_words as contaminated",
    )


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every row of documents against all of benchmark.  Odd rows as in contamination."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.selectExpr(
        "doc_id",
        "n_words",
        "n_hit",
        "cast(size(items) as bigint) as n_items",
        "sha2(array_join(items, ','), 256) as items_sha256",
        "contaminated",
        "cast(size(near_items) as bigint) as n_near_items",
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.  Odd rows as in contamination: null and
    empty texts and rows of a null id are judged like any other, rows alike stay or go together."""
    tid = free_prefix(docs) + "tid"
    bad = contamination(docs, items).where("contaminated").select("doc_id", F.col("tid").alias(tid)).distinct()
    marked = docs.withColumn(tid, F.xxhash64(F.col("text").cast("string")))
    return without(marked, stage(bad, "contaminated"), ["doc_id", tid]).select(*docs.columns)


#: The same rows by plain search: for each window of an item, where it stands in a document's word sequence; near
#: matches from pairs of starting terms.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
p AS (
  SELECT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
g AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, i, g.n, item FROM g JOIN p ON g.g = p.g AND g.n = p.n),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY doc_id),
s AS (SELECT DISTINCT n, g, string_split(g, ' ') AS ws FROM p),
o AS (SELECT g, n, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS off FROM s),
t AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
k AS (SELECT term, count(*) AS n FROM t GROUP BY term),
f AS (SELECT g, term, off, r FROM (SELECT g, term, off, row_number() OVER (PARTITION BY g ORDER BY coalesce(k.n, 0), term) AS r
      FROM (SELECT g, term, min(off) AS off FROM o GROUP BY ALL) LEFT JOIN k USING (term)) WHERE r <= 3),
e AS (SELECT g, count(*) AS need FROM f GROUP BY g),
v AS (SELECT doc_id, g, r, pos - off AS start FROM t JOIN f USING (term)),
y AS (SELECT v.doc_id, v.g, v.start FROM v JOIN v AS x ON v.doc_id = x.doc_id AND v.g = x.g AND abs(v.start - x.start) <= 3 JOIN e ON v.g = e.g
      GROUP BY v.doc_id, v.g, v.start, need HAVING count(DISTINCT x.r) >= least(2, need)),
z AS (SELECT y.doc_id, y.g, y.start, o.n, count(DISTINCT o.off) AS found FROM y JOIN o ON y.g = o.g
      JOIN t ON t.doc_id = y.doc_id AND t.term = o.term AND abs(t.pos - o.off - y.start) <= 3 GROUP BY ALL),
q AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM z JOIN p ON z.g = p.g AND z.n = p.n WHERE found >= z.n - 3 AND 2 * found > z.n GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN q USING (doc_id)
"""
