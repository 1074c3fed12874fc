"""Line dedup by winnowing over line hashes (DataFrame functions only).

A line is a maximal text without line feeds; lines are compared after trimming blanks and lines without words are
neither compared nor removed. A window is a shortest run of lines with `min_words` words, from a line on (forward) or up
to a line (backward). Of each window the place of the smallest line hash is selected (winnowing): the fingerprints are
these places, fewer than the windows, each with the windows that selected it. Two equal runs of at least `min_words`
words contain an equal window and so have a fingerprint at the same place of both. Places of fingerprints met more than
once are joined; of these the windows are compared, and a match extends both ways through the windows around it:
together the forward and the backward windows cover every line of every maximal repeated run of at least `min_words`
words. Every occurrence but the first, by (doc_id, text hash, line), is removed.

Windows are equal if their fingerprints, the hashes of their lines' hashes and lengths, and their numbers of words are:
more than 128 bits. Fingerprints and windows that many places share are joined by broadcast, at most `FREQUENT` of them.

Nulls and edges: a null text stays null, an empty text empty; documents with a null doc_id come first in the order;
rows equal in doc_id and text count as one document and keep the same lines. Other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talweg.llm.common import cut, spread_join

MIN_WORDS = 50


def _key(text: str) -> Column:
    return F.xxhash64(F.col(text))


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, k, pos, h, words, s, c): one row a line with words; s and c are the words before and through it."""
    parts = docs.where(F.length(text) > 0).select(F.col(doc_id).alias("id"), _key(text).alias("k"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    # Rare characters and runs of blanks are looked for before the dearer functions that deal with them are called.
    raw = F.col("line")
    blank = F.contains(raw, F.lit("\t")) | F.contains(raw, F.lit("\r")) | F.contains(raw, F.lit("\x0b")) | F.contains(raw, F.lit("\x0c"))
    line = F.trim(F.when(blank, F.translate("line", "\t\r\x0b\x0c", "    ")).otherwise(raw))
    # Every word begins at the line's start or after a blank: blanks less those before another blank.
    doubled = F.when(F.contains(raw, F.lit("  ")), F.regexp_count(raw, F.lit(" (?= )"))).otherwise(0)
    words = F.length(raw) - F.length(F.replace(raw, F.lit(" "), F.lit(""))) - doubled + 1
    parts = parts.withColumn("line", line).where(F.length("line") > 0).select("id", "k", "pos", F.xxhash64("line").alias("h"), words.cast("long").alias("words"))
    # Dealt by document and sorted by line once, for repeated rows to meet and for the words before a line.
    once = F.row_number().over(W.partitionBy("id", "k", "pos").orderBy("h"))
    parts = parts.repartition("id", "k").withColumn("once", once).where("once = 1").drop("once")
    doc = W.partitionBy("id", "k").orderBy("pos")
    return parts.withColumn("c", F.sum("words").over(doc.rowsBetween(W.unboundedPreceding, 0))).withColumn("s", F.col("c") - F.col("words"))


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, k, way, run, lo, hi, at, mark): the forward (0) and backward (1) window of each line, where the document has
    the words, with their hash, their first and last line, and the place and hash of their fingerprint."""
    ahead = W.partitionBy("id", "k").orderBy("s").rangeBetween(0, min_words - 1)
    behind = W.partitionBy("id", "k").orderBy("c").rangeBetween(-(min_words - 1), 0)

    def window(way: int, w, lo: Column, hi: Column) -> Column:
        words, least = F.sum("words").over(w), F.min(F.struct("h", "pos")).over(w)
        found = F.struct(F.lit(way).alias("way"), F.xxhash64(F.collect_list("h").over(w), words).alias("run"), lo.alias("lo"), hi.alias("hi"), least["pos"].alias("at"), least["h"].alias("mark"))
        return F.when(words >= min_words, found)

    two = lines.select("id", "k", window(0, ahead, F.col("pos"), F.max("pos").over(ahead)).alias("f"), window(1, behind, F.min("pos").over(behind), F.col("pos")).alias("b"))
    return two.select("id", "k", F.explode(F.array_compact(F.array("f", "b"))).alias("x")).select("id", "k", "x.*")


def fingerprints(found: DataFrame) -> DataFrame:
    """(id, k, at, mark, found): the selected places, each once, with the windows that selected it."""
    return found.groupBy("id", "k", "at", "mark").agg(F.collect_list(F.struct("way", "run", "lo", "hi")).alias("found"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, k, gone array<int>): the positions of the lines that a repeated run takes from each document."""
    selected = cut(fingerprints(windows(line_table(docs, doc_id, text), min_words)))
    places, total = selected.agg(F.count("*"), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
    place = F.struct("id", "k", "at")
    marks = selected.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("z"), F.count("*").alias("n")).where("a != z").select("mark", "n")
    met = cut(spread_join(selected, marks, "mark", places).select("id", "k", "mark", F.inline("found")), selected)
    key, spot = ["way", "mark", "run"], F.struct("id", "k", "lo")
    first = met.groupBy(*key).agg(F.min(spot).alias("first"), F.max(spot).alias("last"), F.count("*").alias("n")).where("first != last").drop("last")
    later = spread_join(met, first, key, total).where(spot != F.col("first"))
    return later.select("id", "k", F.explode(F.sequence("lo", "hi")).alias("pos")).groupBy("id", "k").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated runs of lines removed from `text`; all other columns and rows as they were."""
    gone = repeated_lines(docs, min_words, doc_id, text).select(F.col("id").alias("__id"), F.col("k").alias("__k"), F.col("gone").alias("__gone"))
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("__id")) & (_key(text) == F.col("__k")), "left")
    whole = F.col("__gone").isNull()

    def taken(lines: Column) -> Column:
        # Runs reach over lines without words, which stay.
        worded = F.filter("__gone", lambda i: F.length(F.trim(F.translate(F.get(lines, i), "\t\r\x0b\x0c", "    "))) > 0)
        kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), worded), lambda i: F.get(lines, i))
        return F.struct(F.array_join(kept, "\n").alias("text"), F.size(worded).cast("long").alias("n"))

    # The text is split once and bound to a variable: an expression inside a lambda is worked out anew for every element.
    joined = joined.withColumn("__taken", F.when(~whole, F.get(F.transform(F.array(F.split(F.col(text), "\n", -1)), taken), F.lit(0))))
    cleaned = F.when(whole, F.col(text)).otherwise(F.col("__taken.text"))
    return joined.select(*[cleaned.alias(c) if c == text else docs[c] for c in docs.columns if c != "n_removed"], F.coalesce("__taken.n", F.lit(0).cast("long")).alias("n_removed"))
