"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Each benchmark window (ten consecutive words; all words of a shorter item) is a set of tokens ordered by rarity in the
documents. Full containment allows no missing token, so the necessary prefix is the rarest token alone: only windows
whose rarest token occurs in a document are looked at. The token's place in the window fixes where the window would
start (positional bound), the document must be long enough for it (length bound), and the words there must be equal
(exact verification).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchweave.llm.common import pick, stage, wrapped

WINDOW = 10
#: Windows of one block: what is broadcast at a time. About 150 bytes each, so under 8 MB whatever the benchmark's size.
BLOCK_WINDOWS = 50_000

DELIMITERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z only; null has none.

    ``lower`` is taken where it can't touch more than A-Z (no capitals beyond ASCII), as it is the faster of the two.
    """
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, DELIMITERS), "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id string, words, n) for every distinct window of every item."""
    w = pick(items, item_id="string", text="string").where("item_id is not null").select("item_id", words_of(F.col("text")).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    return (
        w.where(F.size("all") > 0)
        .select("item_id", "all", F.explode(starts).alias("s"))
        .select("item_id", F.slice("all", F.col("s"), F.lit(window)).alias("words"))
        .distinct()
        .withColumn("n", F.size("words"))
    )


def _document_words(docs: DataFrame, keep: list[Column | str]) -> DataFrame:
    """One row for each word, and one with pos 0 and word '' for each document, so that no document is lost."""
    return docs.select(*keep, F.posexplode(F.concat(F.array(F.lit("")), F.col("words"))).alias("pos", "word"))


def rarity(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in the documents of each word of the benchmark (word, n_occ)."""
    words = pick(docs, text="string").select(F.explode(words_of(F.col("text"))).alias("word"))
    return words.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n_occ"))


def indexed_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows with their prefix token: (token, at, words, n, items). ``at`` is the token's place, from 0."""
    per_item = windows_of(items, window)
    distinct = stage(per_item.groupBy("words", "n").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "windows")
    vocabulary = stage(distinct.select(F.explode("words").alias("word")).distinct(), "bench-words")
    n_blocks = max(1, -(-vocabulary.count() // BLOCK_WINDOWS))
    counts = None
    for k in range(n_blocks):
        part = vocabulary if n_blocks == 1 else vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(n_blocks)) == k)
        found = rarity(docs, part)
        counts = found if counts is None else counts.unionByName(found)
    rare = vocabulary.join(counts, "word", "left").select("word", F.coalesce("n_occ", F.lit(0)).alias("n_occ"))
    tokens = distinct.select("words", "n", "items", F.posexplode("words").alias("at", "word")).join(rare, "word")
    return tokens.groupBy("words", "n", "items").agg(F.min(F.struct("n_occ", "word", "at")).alias("first")).where("first.n_occ > 0").select(
        F.col("first.word").alias("token"), F.col("first.at").alias("at"), "words", "n", "items"
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_words, n_hit, hit_items (sorted strings).

    A word inside any occurrence of a benchmark window is hit. Null and empty texts have no words; items without words
    or id are no items; repeated items count once by id; repeated documents are judged alike; a very long text is
    searched whole; empty tables give no rows, or no hits. Extra columns are ignored.
    """
    index = stage(indexed_windows(docs, items, window), "window-index")
    n_blocks = max(1, -(-index.count() // BLOCK_WINDOWS))
    base = pick(docs, doc_id="long", text="string").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")
    )
    parts = None
    for k in range(n_blocks):
        block = index if n_blocks == 1 else index.where(F.pmod(F.xxhash64("token"), F.lit(n_blocks)) == k)
        d = _document_words(base, ["row", "doc_id", "text_hash", "words"]).alias("d")
        w = F.broadcast(block.select("token", F.col("at"), F.col("words").alias("window"), "n", "items")).alias("w")
        start = F.col("pos") - F.col("at")  # from 1, as pos 0 is the document itself
        fits = (start >= 1) & (start + F.col("n") - 1 <= F.size("d.words"))
        found = (
            d.join(w, F.col("d.word") == F.col("w.token"), "left")
            .where((F.col("pos") == 0) | (fits & (F.slice("d.words", F.greatest(start, F.lit(1)), F.coalesce("n", F.lit(0))) == F.col("window"))))
            .select("row", "doc_id", "text_hash", F.size("d.words").alias("n_words"), F.when(F.col("pos") > 0, F.struct(start.alias("s"), F.col("n").alias("n"))).alias("hit"), F.when(F.col("pos") > 0, F.col("items")).alias("items"))
        )
        parts = found if parts is None else parts.unionByName(found)
    hit_words = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["s"], h["s"] + h["n"] - 1))))
    return (
        parts.groupBy("row", "doc_id", "text_hash")
        .agg(F.max("n_words").alias("n_words"), F.collect_set("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("hit_items"))
        .select("doc_id", "text_hash", F.col("n_words").cast("long"), F.size(hit_words).cast("long").alias("n_hit"), "hit_items")
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark."""
    bad = contamination(docs, items, window).where("n_hit > 0").select("doc_id", "text_hash").distinct()
    mine = wrapped(docs).withColumn("hash", F.xxhash64("text")).alias("m")
    return mine.join(bad.alias("b"), F.col("m.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("m.hash") == F.col("b.text_hash")), "left_anti").select("row.*")


ORACLE = r"""
with w as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
b as (
  select item_id::varchar as item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
win as (
  select distinct item_id, list_slice(words, s, s + 9) as window, least(len(words), 10) as n
  from (select item_id, words, unnest(generate_series(1, greatest(len(words) - 9, 1))) as s from b where len(words) > 0)),
sizes as (select distinct n from win),
cand as (
  select r, s, n, list_slice(words, s, s + n - 1) as window
  from (select r, words, n, unnest(generate_series(1, len(words) - n + 1)) as s from w, sizes where len(words) >= n)),
hits as (select r, s, win.n, item_id from cand join win on cand.window = win.window and cand.n = win.n),
hit_words as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(s, s + n - 1)) as p from hits) group by r),
hit_items as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit_words using (r) left join hit_items using (r)
"""
