"""Threshold-scaled document fingerprints, in DataFrame functions only.

A document's set is its distinct runs of five words (the whole sequence if it has fewer).
Each run is hashed; the sketch retains every hash below a fixed fraction of the hash space,
so two sketches can be merged by union and compared whatever the sizes of their documents.
A document of which no hash is below the fraction retains its smallest one, which makes the
comparison of two such documents a one-sample estimate instead of undefined.

The fraction is 1/8: MD5 in hexadecimal below "2". A sketch keeps the first 12 digits of each
hash in ascending order; as text they are written one after the other.

Defined cases: NULL is the empty text; a text without words has the empty sketch; two empty
sketches are alike (1.0), an empty and another one are not (0.0). A very long text is a row like any
other: its words and the hash of each of its runs are in its task's memory at once, some 100 bytes a
word. Equal texts have equal sketches, whatever their ids.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import let, words_of

SHINGLE_WORDS = 5
BELOW = "2"
DIGITS = 12
#: Documents of neighbouring ids that one task orders at a time, about.
BLOCK_ROWS = 4096
#: Ranges of ids that a table is cut into first, at most; the first ids of ranges are broadcast.
MAX_BLOCKS = 65536
#: A range with over twice its rows is cut again, into so many times the ranges that its rows need.
FINER = 4
_WIDE = "decimal(20,0)"


def sketch(text: Column) -> Column:
    """The ascending array of retained hashes."""
    empty = F.array().cast("array<string>")

    def hashed(words: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE_WORDS - 1), F.lit(1))),
            lambda i: F.md5(F.array_join(F.slice(words, i, SHINGLE_WORDS), " ").cast("binary")),
        )

    def retained(hashes: Column) -> Column:
        below = F.filter(hashes, lambda h: h < BELOW)
        return let(below, lambda b: F.when(F.size(b) > 0, b).otherwise(F.array(F.array_min(hashes))))

    def cut(hashes: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(hashes, lambda h: F.substring(h, 1, DIGITS))))

    return let(
        words_of(text),
        lambda words: F.when(F.size(words) == 0, empty).otherwise(cut(let(hashed(words), retained))),
    )


def as_text(hashes: Column) -> Column:
    """The fingerprint of a sketch."""
    return F.array_join(hashes, "")


def merged(left: Column, right: Column) -> Column:
    """The sketch of two documents' sets together; a smallest hash above the fraction gives way."""
    both = F.array_sort(F.array_union(left, right))
    return let(both, lambda b: F.when(b[0] < BELOW, F.filter(b, lambda h: h < BELOW)).otherwise(F.slice(b, 1, 1)))


def likeness(left: Column, right: Column) -> Column:
    """Estimated intersection over union, 0 to 1."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the first set that the second holds, 0 to 1; 1 for the empty set."""
    return F.when(F.size(part) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sketch (array) and fingerprint (text); columns of those names are replaced."""
    return docs.withColumn("sketch", sketch(F.col(text))).withColumn("fingerprint", as_text(F.col("sketch")))


def _top(ids: Column, top: Column, width: Column) -> Column:
    """The greatest id that the range of ids can hold, of ranges of that width below top."""
    return (top - F.floor((top - ids) / width).cast(_WIDE) * width).cast(_WIDE)


def with_blocks(docs: DataFrame) -> DataFrame:
    """docs with block, a range of doc_id that holds about BLOCK_ROWS rows; greater ids have greater blocks.

    Ranges are of equal width first. Ranges with over twice their rows are cut again between their own
    least and greatest id until none is left, or one id alone has that many rows. Each round reads
    doc_id alone and broadcasts the ranges to be cut, of which there are at most MAX_BLOCKS / 2; a far id
    costs a round or two. NULL ids have a block of their own below all others.
    """
    low, high, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    low, high = (low or 0), (high or 0)
    pieces = min(MAX_BLOCKS, max(1, math.ceil(n / BLOCK_ROWS)))
    held = max(BLOCK_ROWS, math.ceil(n / MAX_BLOCKS))
    ids = F.col("doc_id").cast(_WIDE)
    width = max(1, math.ceil((high - low + 1) / pieces))
    block = _top(ids, F.lit(high).cast(_WIDE), F.lit(str(width)).cast(_WIDE))
    cuts: list[DataFrame] = []

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("block", block)
        for cut in cuts:
            finer = F.when(F.col("cut_top").isNotNull(), _top(ids, F.col("cut_top"), F.col("cut_width")))
            rows = rows.join(F.broadcast(cut), rows["block"] == cut["cut_block"], "left").withColumn("block", F.coalesce(finer, "block"))
            rows = rows.drop("cut_block", "cut_top", "cut_width")
        return rows.withColumn("block", F.coalesce("block", F.lit(str(low - 1)).cast(_WIDE)))

    while n > 2 * held:
        sizes = placed(docs.select("doc_id").where("doc_id IS NOT NULL")).groupBy("block").agg(
            F.count(F.lit(1)).alias("n"), F.min(ids).alias("least"), F.max(ids).alias("cut_top")
        )
        span = (F.col("cut_top") - F.col("least") + 1).cast(_WIDE)
        parts = F.ceil(F.col("n") * FINER / held).cast(_WIDE)
        cut = sizes.where((F.col("n") > 2 * held) & (F.col("cut_top") > F.col("least"))).select(
            F.col("block").alias("cut_block"), "cut_top", F.ceil(span / parts).cast(_WIDE).alias("cut_width")
        )
        if cut.isEmpty():
            break
        cuts.append(cut)
    return placed(docs)


def with_next(docs: DataFrame) -> DataFrame:
    """Each row (doc_id, text, ...) with next_text: that of the next row, descending doc_id.

    After the last row comes the first. Rows of equal id are ordered by text; NULL ids come last.
    Rows are dealt by ranges of ids (with_blocks), and the first rows of a range are also sent, marked,
    to the range before, so the texts are shuffled once and no task orders the whole table. Only the
    first ids of the ranges are broadcast, a few per BLOCK_ROWS rows or MAX_BLOCKS in all.
    """
    rows = with_blocks(docs)
    firsts = rows.groupBy("block").agg(F.max("doc_id").alias("doc_id"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("block"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sent = firsts.select(
        F.col("doc_id").alias("first_id"),
        F.coalesce(F.lag("block").over(order), F.min("block").over(everything)).alias("before"),
        F.lit(True).alias("is_first"),
    )
    dealt = rows.join(F.broadcast(sent), rows["doc_id"].eqNullSafe(sent["first_id"]), "left")
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("before").alias("block"), F.lit(True).alias("copy"))
    targets = F.when(F.col("is_first"), F.array(own, copy)).otherwise(F.array(own))
    dealt = dealt.withColumn("target", F.explode(targets)).drop("block", "first_id", "before", "is_first")
    dealt = dealt.select("*", F.col("target.block").alias("at_block"), F.col("target.copy").alias("is_copy")).drop("target")
    inside = Window.partitionBy("at_block").orderBy("is_copy", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(inside)).where(~F.col("is_copy")).select(*docs.columns, "next_text")


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by the first as many of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): both fingerprints and how alike they are.

    Returns doc_id, text, edited_text, sketch, edited_sketch, next_sketch and the likenesses.
    Other columns of docs are not read.
    """
    # Texts alone travel: a sketch is computed where it is used, the next document's once more.
    rows = with_next(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    rows = rows.withColumn("edited_text", edited_text(F.col("text"), F.col("next_text")))
    for name, text in (("sketch", "text"), ("edited_sketch", "edited_text"), ("next_sketch", "next_text")):
        rows = rows.withColumn(name, sketch(F.col(text)))
    rows = rows.drop("next_text")
    return rows.withColumn("near_edited", likeness(F.col("sketch"), F.col("edited_sketch"))).withColumn(
        "near_next", likeness(F.col("sketch"), F.col("next_sketch"))
    )
