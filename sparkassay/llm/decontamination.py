"""Benchmark decontamination by a distributed positional inverted index, in SQL functions only.

The corpus frequency of every benchmark term is counted first. Of each window of WINDOW consecutive
item words, the RAREST terms are looked up: their postings (term, document, position) are stored in
the shared folder, and lists are intersected after their offsets in the window are taken off. What is
left over is compared word by word with the text (exact phrases). The same postings give proximity
matches: items of which the NEAR_TERMS rarest terms stand close together. Postings of terms that no
window needs are never stored.

Defined results: NULL texts have no words and hit nothing; items without words or id are left out;
an item of fewer words than a window is one window; rows that repeat id and text are one document
for the index, and each gets its result; other columns are not read; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.common import BETWEEN_ASCII_WORDS, ascii_lower, keyed, settled

WINDOW, RAREST = 13, 2
#: Proximity: so many of an item's rarest terms within so many words.
NEAR_TERMS, SPAN = 3, 26
#: The benchmark's side is broadcast up to so many rows of at most WINDOW words each.
BROADCAST_ROWS = 200_000


def words_of(text: str):
    """Words of a text. Splitting between them takes a seventh of the time of extracting every match."""
    return F.array_remove(F.split(ascii_lower(F.col(text)), BETWEEN_ASCII_WORDS), "")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where the row count proves it small; else the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, _phrase, _words): the windows of every item."""
    items = benchmark.select(F.col("item_id"), words_of("text").alias("_all")).where(
        "item_id IS NOT NULL AND size(_all) > 0"
    )
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_all") - (window - 1)))
    cut = items.select("item_id", "_all", F.explode(starts).alias("_at"))
    cut = cut.select("item_id", F.slice("_all", F.col("_at"), window).alias("_words"))
    return cut.withColumn("_phrase", F.xxhash64(F.array_join("_words", " "))).distinct()


def rarest_terms(windows: DataFrame, counts: DataFrame, key: str, keep: int) -> DataFrame:
    """(key, term, offset, rank, wanted): of each group of terms the rarest `keep`; groups with a term that the
    corpus lacks are left out."""
    terms = windows.select(key, F.posexplode("_words").alias("_offset", "_term")).groupBy(key, "_term").agg(
        F.min("_offset").alias("_offset")
    )
    known = terms.join(counts, "_term", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    order = Window.partitionBy(key).orderBy("_n", "_term")
    ranked = known.withColumn("_rank", F.row_number().over(order)).withColumn(
        "_least", F.min("_n").over(Window.partitionBy(key))
    )
    ranked = ranked.where((F.col("_rank") <= keep) & (F.col("_least") > 0)).drop("_n", "_least")
    return ranked.withColumn("_wanted", F.max("_rank").over(Window.partitionBy(key)))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST, carry: Sequence[str] = ()
) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, hits
    (start, end, item_id of every occurrence). With `carry`, those columns of docs come with it, in
    place of doc_id, and may not bear a result's name."""
    documents = keyed(docs)
    windows = settled(item_windows(benchmark, window), "item-windows")
    vocabulary = windows.select(F.explode("_words").alias("_term")).distinct()
    tokens = documents.select(F.explode(words_of("_text")).alias("_term"))
    counts = tokens.join(_small(vocabulary), "_term").groupBy("_term").agg(F.count("*").alias("_n"))
    counts = settled(counts, "term-counts")
    phrases = windows.select("_phrase", "_words").dropDuplicates(["_phrase"])
    anchors = settled(rarest_terms(phrases, counts, "_phrase", rarest), "anchors")
    whole = windows.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("_words"))).alias("_words"))
    near_terms = settled(rarest_terms(whole, counts, "item_id", NEAR_TERMS), "near-terms")
    indexed = anchors.select("_term").union(near_terms.select("_term")).distinct()
    postings = documents.select("doc_id", "_hash", F.posexplode(words_of("_text")).alias("_pos", "_term"))
    index = settled(postings.join(_small(indexed), "_term"), "postings")
    found = candidates(index, anchors)
    near = proximity(index, near_terms)
    occurrence = F.struct("_start", "item_id", "_words")
    exact = found.join(_small(windows), "_phrase").select("doc_id", "_hash", occurrence.alias("_found"), F.lit(0).alias("_near"))
    close = near.select("doc_id", "_hash", F.lit(None).cast(exact.schema["_found"].dataType).alias("_found"), F.lit(1).alias("_near"))
    # both lists of a document are bounded by its own length
    marks = (
        exact.union(close)
        .groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_mark"))
        .agg(F.collect_set("_found").alias("_found"), F.sum("_near").alias("_near"))
    )
    names = list(carry) or ["doc_id"]
    source = docs.select(
        *(F.col(c).alias(c) for c in names),
        F.col("doc_id").alias("_key"),
        F.coalesce("text", F.lit("")).alias("_text"),
        F.xxhash64("text").alias("_hash"),
    )
    joined = source.join(marks, F.expr("_key <=> _id AND _hash = _mark"), "left").select(
        *names, words_of("_text").alias("_words"), "_found", "_near"
    )
    hits = F.expr(
        "array_sort(transform(filter(coalesce(_found, array()), c -> slice(_words, c._start + 1, size(c._words)) = c._words), "
        "c -> named_struct('start', c._start, 'end', c._start + size(c._words), 'item_id', c.item_id)))"
    )
    counted = joined.select(*names, F.size("_words").cast("long").alias("n_words"), hits.alias("hits"), "_near")
    # hits are in order of their starts: each adds the words past what is covered so far
    cover = F.expr(
        "aggregate(hits, named_struct('n', 0L, 'to', 0), (s, h) -> named_struct("
        "'n', s.n + greatest(0, h.end - greatest(h.start, s.to)), 'to', greatest(s.to, h.end)), s -> s.n)"
    )
    ids = F.expr("array_sort(array_distinct(transform(hits, h -> CAST(h.item_id AS STRING))))")
    out = counted.select(*names, "n_words", cover.alias("n_hit"), ids.alias("_ids"), "hits", "_near")
    return out.select(
        *names,
        "n_words",
        "n_hit",
        F.size("_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"),
        "hits",
    )


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, _hash, _phrase, _start) where all anchors of a phrase stand at their offsets."""
    shifted = index.join(_small(anchors), "_term").withColumn("_start", F.col("_pos") - F.col("_offset"))
    met = (
        shifted.where("_start >= 0")
        .groupBy("doc_id", "_hash", "_phrase", "_start")
        .agg(F.bit_or(F.expr("shiftleft(1, _rank)")).alias("_met"), F.max("_wanted").alias("_wanted"))
    )
    return met.where("_met = shiftleft(1, _wanted + 1) - 2").select("doc_id", "_hash", "_phrase", "_start")


def proximity(index: DataFrame, near_terms: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, _hash, item_id, _span): the least number of words that holds an item's rarest terms, where
    at most `span`. One sweep along the positions keeps the last place of each term."""
    placed = index.join(_small(near_terms), "_term").where("_wanted > 1")
    sweep = Window.partitionBy("doc_id", "_hash", "item_id").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("_rank") == k, F.col("_pos"))).over(sweep) for k in range(1, NEAR_TERMS + 1)]
    placed = placed.select("doc_id", "_hash", "item_id", "_pos", "_wanted", *(x.alias(f"_l{k}") for k, x in enumerate(last, 1)))
    seen = sum((F.col(f"_l{k}").isNotNull().cast("int") for k in range(1, NEAR_TERMS + 1)), F.lit(0))
    oldest = F.least(*(F.col(f"_l{k}") for k in range(1, NEAR_TERMS + 1)))
    spans = placed.where(seen == F.col("_wanted")).withColumn("_span", F.col("_pos") - oldest + 1)
    return spans.where(F.col("_span") <= span).groupBy("doc_id", "_hash", "item_id").agg(F.min("_span").alias("_span"))
