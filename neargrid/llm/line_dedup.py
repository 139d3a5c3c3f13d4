"""Line dedup: a line that an earlier document holds too is dropped, by DataFrame functions alone.

Texts are cut at line feeds. A line's key is the line without white space (tab to carriage return, and blank) at its ends
and with A-Z in lower case; it is compared by two 64-bit hashes of different seeds. Keys of fewer than `min_chars` code points
never count. Of each other key all lines are dropped but those of the document with the smallest id.

Hashes are partitioned by ranges and sorted by document and position behind them, so that the first occurrence of a key
streams by before all others. What comes out is no text but bitmaps: for each document that loses lines, words of 64
lines in which a set bit says that the line stays; words whose lines all stay are left out. The texts meet their
bitmaps once, in `apply_bitmaps`.

A frequent key would be one long run in one task. Keys with more rows than a fraction of a task's share are named by a
sketch of frequent items, and the first documents of these (a bounded number) are aggregated exactly before anything
is shuffled. The sketch only chooses the way: whichever way a key goes, its result is the same.

Null and empty texts hold one empty line, which stays. Rows that share an id are one document: all of them keep what
the id holds first, and each row gets the bitmap of its own text. Null ids are one document, behind all others. Other columns
stay as they are; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, task_count

#: fixed values: blank, tab, line feed, vertical tab, form feed, carriage return
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 10
#: Lines of a bitmap's word.
BITS = 64
#: A key is hot if it has more than 1 / HOT of a task's rows. Bytes of a shuffled line.
HOT, LINE_BYTES = 4, 64
#: Counters of the sketch for each key that can be hot, and the most that Spark allows.
COUNTERS, MOST_COUNTERS = 8, 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def text_id(text: Column) -> Column:
    """Tells the texts of rows that share an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_id, pos, h1, h2 of all lines that are long enough to count."""
    each = docs.select("doc_id", text_id(F.col("text")).alias("text_id"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = each.select("doc_id", "text_id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_firsts(lines: DataFrame, parts: int) -> DataFrame:
    """h1, h2, first: the smallest id that holds each hot key. A key is hot from 1 / (parts x HOT) of all lines on, so there are
    at most parts x HOT of them."""
    most = min(parts * HOT, MOST_COUNTERS // COUNTERS)
    top = lines.agg(F.expr(f"approx_top_k(h1, {most}, {most * COUNTERS})").alias("top"), F.count("*").alias("n"))
    often = top.select(F.explode("top").alias("x"), "n").where(F.col("x.count") * most >= F.col("n")).select(F.col("x.item").alias("h1"))
    # at most `most` rows
    return lines.join(F.broadcast(often), "h1").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))


def _later(first: str) -> Column:
    """Whether a row's document comes after the first one; null ids are behind all others."""
    return F.col(first).isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col(first)))


def dropped_lines(lines: DataFrame) -> DataFrame:
    """doc_id, text_id, pos of the lines that an earlier document holds. `lines` is read several times: a written table."""
    parts = task_count(lines.sparkSession, lines.count() * LINE_BYTES)
    hot = stage(hot_firsts(lines, parts)).withColumn("hot", F.lit(True))
    told = lines.join(F.broadcast(hot), ["h1", "h2"], "left")  # parts x HOT rows at most, but for equal 64-bit hashes
    of_hot = told.where(F.col("hot") & _later("first"))
    ranged = told.where(F.col("hot").isNull()).drop("first", "hot").repartitionByRange(parts, "h1")
    w = Window.partitionBy("h1", "h2").orderBy(F.asc_nulls_last("doc_id"), "pos")
    of_rest = ranged.withColumn("first", F.first("doc_id").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(_later("first"))
    return of_hot.select("doc_id", "text_id", "pos").unionByName(of_rest.select("doc_id", "text_id", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_id, words array<struct<word, bits>>, for the documents that lose lines."""
    gone = dropped_lines(stage(line_table(docs, min_chars)))
    bit = F.expr(f"shiftleft(1L, pos % {BITS})")
    words = gone.groupBy("doc_id", "text_id", F.expr(f"pos div {BITS}").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("words"))


def unpacked(words: Column) -> Column:
    """All words up to the last one that is given, those left out filled in."""
    before = F.concat(F.array(F.struct(F.lit(-1).alias("word"), F.lit(0).cast("bigint").alias("bits"))), F.slice(words, F.lit(1), F.size(words) - 1))
    all_stay = F.lit(-1).cast("bigint")
    return F.flatten(F.zip_with(words, before, lambda own, last: F.concat(F.array_repeat(all_stay, own["word"] - last["word"] - 1), F.array(own["bits"]))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with their texts as they stay, and the columns __lines and __left: lines before and after."""
    # a join does not let the unpacked words be made anew for each line
    keep = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text_id"), unpacked(F.col("words")).alias("__keep"))
    # hashed by partitions at every size: bitmaps are small beside their texts, which need no sort
    met = docs.join(keep.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(keep["__id"]) & (text_id(docs["text"]) == keep["__text_id"]), "left")
    word = lambda i: F.coalesce(F.get("__keep", F.shiftright(i, 6)), F.lit(-1))
    stays = lambda line, i: F.call_function("shiftright", word(i), i % BITS).bitwiseAND(F.lit(1)) == 1
    left = met.withColumn("__kept", F.filter(lines_of(F.col("text")), stays))
    changed = F.when(F.col("__keep").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    left = left.withColumn("__lines", F.size(lines_of(F.col("text")))).withColumn("__left", F.size("__kept")).withColumn("text", changed)
    return left.drop("__id", "__text_id", "__keep", "__kept")


def deduplicate(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs without the lines that an earlier document holds."""
    return apply_bitmaps(docs, stage(keep_bitmaps(docs, min_chars))).drop("__lines", "__left")


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what stays of each document's text."""
    docs = docs.select("doc_id", "text")
    left = apply_bitmaps(docs, stage(keep_bitmaps(docs, min_chars)))
    return left.select(
        "doc_id", F.col("__lines").cast("bigint").alias("n_lines"), (F.col("__lines") - F.col("__left")).cast("bigint").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
