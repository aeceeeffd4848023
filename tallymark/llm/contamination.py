"""Benchmark decontamination by a prefix-filtered join, in DataFrame operations only.

Every benchmark item is cut into windows of ``window`` consecutive words (an item of
fewer words is one window).  A window occurs in a document only if all its words do, in
place, so one word of each window is a necessary prefix: the one that is rarest over
all documents.  Document positions join those prefix words, the position bounds the
start, the length bounds the end, and what is left is compared word by word.

The prefix table holds one row a distinct window, and which items hold it is joined only
to the distinct windows that a document has.  The table is broadcast while its words take
at most ``broadcast_bytes``; beyond that the join shuffles the positions of prefix words
only, with the words around them, and those of a frequent word by salts.

Defined cases: a null or wordless text has no words and is never contaminated; an item
without words has no windows; windows of items with a null id count as hits, but such
items are not listed; rows with equal or null doc ids stay separate rows; other columns
are ignored; a very long text is searched whole; an empty benchmark leaves every document
clean, and an empty table of documents gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, settled

#: ASCII characters outside 0-9, A-Z and a-z separate words; all others belong to them.
SEPARATORS = "".join(chr(c) for c in range(1, 0x80) if not chr(c).isalnum())
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
END = "\x01"
#: Size up to which the windows are broadcast, and rows of a prefix word that one task joins.
BROADCAST_BYTES, SALT_ROWS = 64 << 20, 1_000_000


def words(text: Column) -> Column:
    """The words of a text, in order."""
    # translate() would drop NUL, which ends its replacement table, so it goes first.
    text = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\0"), F.lit(" "))
    spaced = F.trim(F.translate(text, UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def windows(benchmark: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid long, win array<string>), and the items that hold them (wid, item)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    runs = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), window).alias("win"))
    runs = materialise(runs.distinct(), "item-windows")
    # Numbered once and written: the numbers hold from here on.
    own = materialise(runs.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), "win"), "windows")
    return own, runs.join(own, "win").select("wid", "item")


def occurrences(docs: DataFrame, wins: DataFrame, window: int, id_col: str, text_col: str, broadcast_bytes: int) -> DataFrame:
    """Rows (_row, id, n_words, start, size, wid); one with null ``start`` for each document."""
    bound = wins.agg(F.sum(F.length(F.array_join("win", " ")) + 64 + 24 * F.size("win"))).first()[0] or 0
    # The row number needs a projection of its own, below the explode.
    tokens = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    small = bound <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    counts = tokens.select(F.explode("w").alias("word")).join(hint(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = wins.select("wid", "win", F.posexplode("win").alias("offset", "word")).join(hint(counts), "word", "left")
    key = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word").alias("word"), F.col("offset").alias("offset"))
    first = ranked.groupBy("wid").agg(F.min(key).alias("k"), F.first("win").alias("win"))
    # A window whose rarest word is in no document can't occur.
    prefix = first.where(F.col("k.n") > 0).select(F.col("k.word").alias("word"), F.col("k.offset").alias("offset"), "win", F.size("win").alias("size"), "wid", F.col("k.n").alias("n"))
    # One more word a document, no window of its own: it keeps documents without hits.
    mark = prefix.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(0).alias("offset"), F.lit(None).cast("array<string>").alias("win"), F.lit(0).alias("size"), F.lit(None).cast("long").alias("wid"))
    spots = tokens.select("_row", "id", F.size("w").alias("n_words"), "w", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word"))
    start = F.col("pos") - F.col("offset")
    if small:
        found = spots.join(F.broadcast(prefix.drop("n").unionByName(mark)), "word")
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.greatest("size", F.lit(1))) == F.col("win")
    else:
        # Positions of prefix words only are sent on; a frequent word's are dealt over salts.
        prefix = materialise(prefix.withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int")).drop("n"), "window-prefixes")
        heads = prefix.select("word", "salts").distinct()
        reach = F.greatest(F.col("pos") - window + 1, F.lit(0))
        near = spots.where(F.col("word") != END).join(heads, "word").select("_row", "id", "n_words", "pos", "word", reach.alias("reach"), F.slice("w", reach + 1, 2 * window - 1).alias("near"), F.pmod(F.xxhash64("_row", "pos"), F.col("salts")).cast("int").alias("salt"))
        dealt = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        ends = spots.where(F.col("word") == END).select("_row", "id", "n_words", "pos", "word", F.lit(0).alias("reach"), F.array().cast("array<string>").alias("near"))
        found = near.join(dealt, ["word", "salt"]).drop("salt").unionByName(ends.join(F.broadcast(mark), "word"))
        same = F.slice("near", F.greatest(start - F.col("reach"), F.lit(0)) + 1, F.greatest("size", F.lit(1))) == F.col("win")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    kept = found.where(F.col("win").isNull() | (fits & same))
    return kept.select("_row", "id", "n_words", F.when(F.col("win").isNotNull(), start).alias("start"), "size", "wid")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Return id_col, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated when some word is hit and hits are at least one in
    ``share`` of its words.
    """
    docs = settled(docs.select(F.col(id_col), F.col(text_col)), "contamination-texts")
    wins, holders = windows(benchmark, window)
    rows = materialise(occurrences(docs, wins, window, id_col, text_col, broadcast_bytes), "window-hits")
    hit = F.when(F.col("start").isNotNull(), F.struct("start", "size"))
    whole = rows.groupBy("_row").agg(F.first("id").alias("id"), F.max("n_words").cast("long").alias("n_words"), F.collect_set(hit).alias("spans"))
    # Items are joined to the distinct windows of a document, not to its hits.
    held = rows.where("wid is not null").select("_row", "wid").distinct().join(holders.where("item is not null"), "wid").groupBy("_row").agg(F.array_sort(F.collect_set("item")).alias("i"))
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))
    items = F.coalesce("i", F.array().cast("array<string>"))
    out = whole.join(held, "_row", "left").select(F.col("id").alias(id_col), "n_words", F.when(F.size("spans") == 0, 0).otherwise(F.size(places)).cast("long").alias("n_hit"), items.alias("i"))
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return out.select(id_col, "n_words", "n_hit", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"), dirty.alias("contaminated"))


#: DuckDB SQL of :func:`report` with the defaults.
SQL = r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT item, unnest(CASE WHEN len(w) < 13 THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda k: w[k:k + 12]) END) AS win FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS size FROM iw),
starts AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT r, s, size, item FROM (SELECT r, s, size, w[s:s + size - 1] AS win FROM starts) x JOIN iw USING (win)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT r, s, size FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""
