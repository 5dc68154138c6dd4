"""Temperature mixing of sources, in DataFrame functions only.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources
alike) and 1 (as they are), divided by the sum of such powers. The exponent is the smallest
millionth that meets the target, found by sectioning: a target entropy of the weights, or a limit
on how often any source is repeated. Both only fall as the exponent grows.

The weights are then realised against a token budget. A source's quota is its weight's part of the
budget. Its documents form a stream of passes, each a permutation of all of them by hash; the
stream ends with the first document at or after the quota, so every source gets its quota to
within one document. The streams are cut into blocks of equal budget, each holding every source by
weight, and inside a block rows are permuted by hash. Without a budget, the least one is taken at
which every document occurs: nothing is left out, and small sources repeat.

Running token counts over a pass are taken in two steps (inside ranges of hashes, then over the
ranges), so that no task orders a whole source.

Defined cases: NULL is a source of its own; documents without tokens cost nothing, so they are kept
once, in block 0, and play no part in the weights; repeated rows are documents of their own. A
column of docs that has an output's name is replaced. An empty table gives an empty result. A text only
counts by its number of tokens, so a very long one is a row like any other; it may overrun its source's
quota by its own length. Rows of equal hash are ordered by id, then by tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import words_of
from scorelake.sources.workspace import new_folder

#: The exponent is a whole number of these parts.
PARTS = 1_000_000
_SECTIONS = 128
#: Documents of one source that one task orders at a time, about.
RANGE_ROWS = 1024
OUTPUTS = ("n_tokens", "pass", "block", "slot")


def token_count(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.size(words_of(text)).cast("long")


def source_key(source: Column) -> Column:
    """A key that keeps NULL apart from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def source_totals(rows: DataFrame) -> DataFrame:
    """Per key of rows(key, n_tokens): tokens, n_docs and share; only documents with tokens count."""
    totals = rows.where(F.col("n_tokens") > 0).groupBy("key").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")
    )
    folder = new_folder(rows.sparkSession, "mixing-totals")
    totals.write.parquet(folder)
    totals = rows.sparkSession.read.parquet(folder)
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    return totals.withColumn("share", F.col("tokens") / F.lit(float(everything) or 1.0))


def _measure(totals: DataFrame, target: str, parts: list[int], budget: int | None) -> DataFrame:
    """Per part: the entropy of the weights, or the largest number of passes over a source."""
    grown = totals.withColumn("part", F.explode(F.array(*(F.lit(p) for p in parts))))
    powered = grown.withColumn("w", F.exp(F.ln("share") * (F.col("part") / PARTS)))
    if target == "entropy":
        value = F.ln(F.sum("w")) - F.sum(F.col("w") * F.ln("w")) / F.sum("w")
    elif budget is None:
        value = F.max(F.col("w") / F.col("tokens")) / F.min(F.col("w") / F.col("tokens"))
    else:
        value = F.max(F.col("w") / F.col("tokens")) * float(budget) / F.sum("w")
    return powered.groupBy("part").agg(value.alias("value"))


def exponent(totals: DataFrame, target: str, limit: float, budget: int | None) -> int:
    """The smallest exponent, in millionths, whose entropy or repetition is at most the limit; PARTS if none is.

    totals has one row per source and is read once per round; a round narrows the interval 128 times.
    """
    if target not in ("entropy", "repetition"):
        raise ValueError(f"no such target: {target}")
    low, high = -1, PARTS  # the smallest one that holds lies in (low, high]
    while high - low > 1:
        parts = sorted({low + (high - low) * i // _SECTIONS for i in range(1, _SECTIONS)} - {low, high})
        holds = {r.part for r in _measure(totals, target, parts, budget).collect() if r.value is None or r.value <= limit}
        first = min(holds, default=high)
        low, high = max([p for p in parts if p < first], default=low), first
    return high


def _running(rows: DataFrame) -> DataFrame:
    """Adds before: the tokens of earlier rows of the same key and pass, in order of their hash."""
    ranges = ["key", "pass", "range"]
    sums = rows.groupBy(*ranges).agg(F.sum("n_tokens").alias("tokens_of_range"))
    earlier = Window.partitionBy("key", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("tokens_of_range").over(earlier), F.lit(0))).drop("tokens_of_range")
    inside = Window.partitionBy(*ranges).orderBy("hash", "id_text", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(sums, ranges).withColumn("before", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))


def mix(
    docs: DataFrame,
    target: str = "repetition",
    limit: float = 4.0,
    budget: int | float | None = None,
    blocks: int = 64,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Rows of docs as often as the mixture takes them, with n_tokens, pass (from 0), block and slot.

    Read by block and then slot, every stretch has about the target weights. budget is a number of
    tokens, or as a float a multiple of the table's tokens; None takes the least at which all
    documents occur. docs should be a table that reads the same every time.
    """
    names = {n.lower() for n in OUTPUTS}
    kept = [c for c in docs.columns if c.lower() not in names]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        source_key(F.col(source).cast("string")).alias("key"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id_text"),
        token_count(F.col(text)).alias("n_tokens"),
    )
    totals = source_totals(docs.select(source_key(F.col(source).cast("string")).alias("key"), token_count(F.col(text)).alias("n_tokens")))
    tokens, n_sources = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if isinstance(budget, float):
        budget = int(budget * (tokens or 0))
    part = exponent(totals, target, limit, budget) if n_sources else PARTS
    powered = totals.withColumn("w", F.exp(F.ln("share") * (part / PARTS)))
    mass, needed = powered.agg(F.sum("w"), F.max(F.col("tokens") / F.col("w"))).first()
    if budget is None:
        quota = F.ceil(F.round(F.col("w") * float(needed or 0), 6)).cast("long")
    else:
        quota = F.floor(F.round(F.col("w") / float(mass or 1), 12) * float(budget)).cast("long")
    plan = powered.select(
        "key", "tokens", quota.alias("quota"), F.ceil(F.col("n_docs") / RANGE_ROWS).cast("long").alias("n_ranges")
    )
    # A row per pass that the quota reaches; the last is cut below. Sources are few beside documents, but
    # their number isn't bounded, so how to join is left to the sizes found.
    taken = rows.join(plan, "key", "left").withColumn("free", F.col("n_tokens") == 0)
    passes = F.when(F.col("free"), F.lit(1)).otherwise(F.ceil(F.col("quota") / F.col("tokens")))
    taken = taken.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), passes.cast("int") - 1)))
    digest = F.md5(F.concat_ws("|", "id_text", F.col("pass").cast("string")).cast("binary"))
    taken = taken.withColumn("hash", digest)
    share = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    counted = _running(
        taken.where(~F.col("free")).withColumn("range", F.shiftright(share * F.col("n_ranges"), 32))
    )
    at = F.col("pass") * F.col("tokens") + F.col("before")
    counted = counted.where(at < F.col("quota")).withColumn("block", F.floor(at * F.lit(blocks) / F.col("quota")).cast("int"))
    free = taken.where(F.col("free")).withColumn("block", F.lit(0))
    slot = F.md5(F.concat_ws("|", "key", "hash").cast("binary"))
    shape = ["row.*", "n_tokens", "pass", "block", slot.alias("slot")]
    return counted.select(*shape).unionByName(free.select(*shape))
