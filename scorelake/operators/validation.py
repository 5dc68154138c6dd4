"""Checks of detectors and judges against human labels, prompts and earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake.sources.workspace import new_folder

# The three-level scale of the labels.
LEVELS = (("yes", 1.0), ("partial", 0.5), ("no", 0.0))


def level(word: Column) -> Column:
    """A label word as a grade; other words are NULL."""
    grade = F.lit(None).cast("double")
    for name, value in LEVELS:
        grade = F.when(word == name, value).otherwise(grade)
    return grade


def labelled_verdicts(labels: DataFrame, key: DataFrame) -> DataFrame:
    """Human labels beside the automatic verdict of the same item."""
    return labels.join(key, "item")


def agreement(pairs: DataFrame, human: str, auto: str) -> DataFrame:
    """Share of items on which both agree exactly, among those both judged."""
    both = F.col(human).isNotNull() & F.col(auto).isNotNull()
    same = (F.col(human) == F.col(auto)).cast("int")
    return pairs.filter(both).agg(
        F.count(F.lit(1)).alias("n_items"), F.avg(same).alias("agreement")
    )


def confusion(pairs: DataFrame, human: str, auto: str) -> DataFrame:
    """Counts per human label with one column per automatic grade."""
    return pairs.groupBy(human).agg(
        *(
            F.sum((F.col(auto) == value).cast("int")).alias(f"auto_{name}")
            for name, value in LEVELS
        )
    )


def average_ranks(counts: DataFrame, value: str, weight: str) -> DataFrame:
    """Average-tie rank of every distinct value, from (value, weight) counts.

    A global rank would sort everything in one task. Values are dealt to range partitions, whose numbers are
    written with them, so that they stay the same when tasks are repeated: ranks run inside a partition, and
    a partition starts where the sizes of those before it end. The plan is the same for any number of values.
    """
    totals = counts.groupBy(value).agg(F.sum(weight).alias("_ties"))
    dealt = totals.repartitionByRange(value).withColumn("_bucket", F.spark_partition_id())
    bucketed = _written(dealt, "rank-ranges")
    sizes = bucketed.groupBy("_bucket").agg(F.sum("_ties").alias("_size"))
    # One row per partition, so this window is bounded.
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    inside = W.partitionBy("_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    smaller = F.col("_start") + F.coalesce(F.sum("_ties").over(inside), F.lit(0))
    rank = smaller + (F.col("_ties") + 1) / 2
    return bucketed.join(starts, "_bucket").select(value, rank.alias(f"{value}_rank"))


def rank_correlation(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation with average ranks, over pairs that have both values.

    Works on the counts of distinct (x, y) pairs: they are built before the first
    shuffle, so a value that a third of all rows share is one row per task.
    """
    table = (
        pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(x, y)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = table.join(average_ranks(table, x, "_n"), x).join(average_ranks(table, y, "_n"), y)
    rx, ry, n = F.col(f"{x}_rank"), F.col(f"{y}_rank"), F.col("_n")
    sums = ranked.agg(
        F.sum("_n").alias("n_items"),
        F.sum(n * rx * ry).alias("xy"),
        F.sum(n * rx * rx).alias("xx"),
        F.sum(n * ry * ry).alias("yy"),
    )
    # The mean of average ranks is (n + 1) / 2 on both sides.
    return sums.selectExpr(
        "n_items",
        "try_divide(xy - n_items * pow((n_items + 1) / 2D, 2), "
        "sqrt(xx - n_items * pow((n_items + 1) / 2D, 2)) * "
        "sqrt(yy - n_items * pow((n_items + 1) / 2D, 2))) AS rank_correlation",
    )


def error_audit(rows: DataFrame) -> DataFrame:
    """Number of errors of each kind per (model, track); every ``*error`` column counts."""
    kinds = [c for c in rows.columns if c == "error" or c.endswith("_error")]
    return rows.groupBy("model_slug", "track").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.count(F.nullif(F.col(c), F.lit(""))).alias(f"n_{c}") for c in kinds),
    )


def prompt_usage(rows: DataFrame) -> DataFrame:
    """Rows per (run, track, prompt)."""
    return rows.groupBy("run_id", "track", "prompt_hash").agg(F.count(F.lit(1)).alias("n_rows"))


def prompt_drift(rows: DataFrame) -> DataFrame:
    """Distinct prompts per (run, track); more than one means the prompt changed mid-run."""
    return (
        prompt_usage(rows)
        .groupBy("run_id", "track")
        .agg(F.count("prompt_hash").alias("n_prompts"), F.sum("n_rows").alias("n_rows"))
        .withColumn("drifted", F.col("n_prompts") > 1)
    )


def leaks_any(text: Column, terms) -> Column:
    """Whether a text holds any of a short fixed list of terms, case-folded."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(lowered, F.lit(term.lower()))
    return hit


_WORDS = "regexp_extract_all({}, '(?U)\\\\w+', 0)"
#: Characters of a neighbouring word that an anchor holds, at most.
EDGE = 3
#: Inner words of a term that serve as anchors.
RARE = 2
#: Rows of one anchor that are joined in one task, about.
ANCHOR_ROWS = 1 << 20
#: Rows that are sent to all tasks at most, so that the words of prompts are not shuffled; more are joined by a shuffle.
SENT = 1 << 17
#: Different terms of one word with which each word of the vocabulary is compared at most.
FEW = 256


def _edges(before: Column, after: Column, left: Column, right: Column) -> list[Column]:
    """The ends of two words that an anchor holds: the last ``left`` and the first ``right`` characters."""
    return [F.right(before, left).alias("_before"), F.left(after, right).alias("_after")]


def _anchored(places: DataFrame, anchors: DataFrame, key: list[str]) -> DataFrame:
    """Candidates (prompt_id, _no): prompts that hold the rarest anchor of a term.

    ``places`` has the anchors of each prompt, ``anchors`` those of each term. An anchor that very many
    prompts hold is dealt over tasks by its count; one row in ANCHOR_ROWS at most is sent to all tasks for that.
    """
    counts = places.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rarest = anchors.join(counts, key).groupBy("_no").agg(F.min(F.struct("_n", *key)).alias("_least")).select("_no", "_least.*")
    salts = F.ceil(F.col("_n") / ANCHOR_ROWS).cast("int")
    hot = counts.where(F.col("_n") > ANCHOR_ROWS).select(*key, salts.alias("_salts"))
    seat = F.pmod(F.xxhash64("prompt_id"), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = places.join(F.broadcast(hot), key, "left").withColumn("_seat", seat)
    asked = rarest.withColumn("_seat", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(asked, [*key, "_seat"]).select("prompt_id", "_no")


def _places(prompts: DataFrame) -> DataFrame:
    """A row per word of each prompt, with the EDGE last and first characters of its neighbours, NULL where there is none.

    Words and neighbours are zipped before they become rows: none of them carries the list.
    """
    words = prompts.select("prompt_id", F.expr(_WORDS.format("lower(text)")).alias("_words"))
    most = F.size("_words") - 1
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("_words", F.lit(1), most))
    zipped = F.arrays_zip(before.alias("_b"), F.col("_words").alias("_word"), F.slice("_words", F.lit(2), most).alias("_a"))
    rows = words.where(most >= 0).select("prompt_id", F.inline(zipped).alias("_b", "_word", "_a"))
    return rows.select("prompt_id", "_word", *_edges(F.col("_b"), F.col("_a"), F.lit(EDGE), F.lit(EDGE)))


def _by_inner_word(places: DataFrame, vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates of terms of three words or more, by an inner word with the ends of its neighbours.

    An inner word of a term is a whole word of any prompt that holds the term, the word before it ends like
    the term's, and the word after it begins like the term's. Only the RARE rarest inner words of a term are
    looked for: the frequent ones would give many places, and seldom the rarest.
    """
    inner = terms.select("_no", "_words", F.explode(F.sequence(F.lit(1), F.size("_words") - 2)).alias("_at"))
    word = lambda at: F.get("_words", at)
    at = F.col("_at")
    asked = _written(inner.select("_no", "_at", word(at).alias("_word")), "leak-terms")
    counts = vocabulary.join(_sent(asked.select("_word").distinct()), "_word")
    ranked = asked.join(counts, "_word").withColumn("_rank", F.row_number().over(W.partitionBy("_no").orderBy("_n", "_at")))
    inner = inner.join(ranked.where(F.col("_rank") <= RARE).select("_no", "_at"), ["_no", "_at"])
    sizes = (F.least(F.length(word(at - 1)), F.lit(EDGE)).alias("_left"), F.least(F.length(word(at + 1)), F.lit(EDGE)).alias("_right"))
    sized = inner.select("_no", word(at).alias("_word"), word(at - 1).alias("_b"), word(at + 1).alias("_a"), *sizes)
    key = ["_word", "_left", "_right", "_before", "_after"]
    anchors = sized.select("_no", "_word", "_left", "_right", *_edges(F.col("_b"), F.col("_a"), F.col("_left"), F.col("_right"))).distinct()
    anchors = _written(anchors, "leak-terms")
    shapes = _sent(anchors.select("_word", "_left", "_right").distinct())
    held = places.where("_before IS NOT NULL AND _after IS NOT NULL").join(shapes, "_word").select(
        "prompt_id", "_word", "_left", "_right", *_edges(F.col("_before"), F.col("_after"), F.col("_left"), F.col("_right"))
    )
    held = held.join(_sent(anchors.select(*key).distinct()), key, "left_semi").distinct()
    return _anchored(_written(held, "leak-anchors"), anchors, key)


def _by_pair(places: DataFrame, terms: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """Candidates of terms of two words: the end of one word and the beginning of the next.

    ``shapes`` are the lengths of both that occur, EDGE * EDGE at most. Each different border of the prompts,
    the ends of EDGE characters, is compared with the anchors once; the prompts' borders only meet those that hold one.
    """
    first, second = F.get("_words", F.lit(0)), F.get("_words", F.lit(1))
    sizes = (F.least(F.length(first), F.lit(EDGE)).alias("_left"), F.least(F.length(second), F.lit(EDGE)).alias("_right"))
    sized = terms.select("_no", first.alias("_b"), second.alias("_a"), *sizes)
    key = ["_left", "_right", "_before", "_after"]
    anchors = sized.select("_no", "_left", "_right", *_edges(F.col("_b"), F.col("_a"), F.col("_left"), F.col("_right")))
    anchors = _written(anchors, "leak-terms")
    borders = places.where("_after IS NOT NULL").select("prompt_id", F.right("_word", F.lit(EDGE)).alias("_b"), F.col("_after").alias("_a"))
    every = F.array(*(F.struct(F.lit(a).alias("_left"), F.lit(b).alias("_right")) for a, b in shapes))
    shaped = borders.select("_b", "_a").distinct().withColumn("_s", F.explode(every))
    shaped = shaped.select("_b", "_a", "_s._left", "_s._right", *_edges(F.col("_b"), F.col("_a"), F.col("_s._left"), F.col("_s._right")))
    holding = _sent(shaped.join(_sent(anchors.select(*key).distinct()), key, "left_semi"))
    held = borders.join(holding, ["_b", "_a"]).select("prompt_id", *key).distinct()
    return _anchored(_written(held, "leak-anchors"), anchors, key)


def _by_vocabulary(places: DataFrame, vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates of terms of one word: prompts with a word that holds the term's.

    Each different word of the prompts is compared once: with the words of all terms if they are FEW, else with
    those whose rarest run of EDGE characters (or of all, if shorter) it holds.
    """
    own = _written(terms.select("_no", F.get("_words", F.lit(0)).alias("_own")), "leak-terms")
    looked = own.select("_own").distinct()
    if looked.count() <= FEW:
        pairs = vocabulary.join(F.broadcast(looked), F.contains("_word", "_own"))
    else:
        pairs = _by_run(vocabulary, looked)
    holding = _sent(pairs.join(own, "_own").groupBy("_word").agg(F.collect_set("_no").alias("_nos")))
    return places.select("prompt_id", "_word").join(holding, "_word").select("prompt_id", F.explode("_nos").alias("_no")).distinct()


def _by_run(vocabulary: DataFrame, looked: DataFrame) -> DataFrame:
    """Pairs (_word, _own) where a word holds another, which meet in its rarest run of EDGE characters."""
    at, key = F.col("_at"), ["_width", "_run"]
    starts = lambda text: F.explode(F.sequence(F.lit(1), F.length(text) - F.col("_width") + 1)).alias("_at")
    run = lambda text: F.substr(text, at, F.col("_width")).alias("_run")
    asked = looked.withColumn("_width", F.least(F.length("_own"), F.lit(EDGE))).select("*", starts("_own"))
    asked = _written(asked.select("_own", "_width", run("_own")).distinct(), "leak-terms")
    widths = F.explode(F.array(*(F.lit(r._width) for r in asked.select("_width").distinct().collect())))
    runs = vocabulary.withColumn("_width", widths).where(F.length("_word") >= F.col("_width"))
    runs = runs.select("*", starts("_word")).select("_word", "_width", run("_word"))
    runs = _written(runs.join(_sent(asked.select(*key).distinct()), key, "left_semi").distinct(), "leak-runs")
    counts = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(counts, key).groupBy("_own").agg(F.min(F.struct("_n", *key)).alias("_least"))
    return runs.join(rarest.select("_own", "_least._width", "_least._run"), key).where(F.contains("_word", "_own")).select("_word", "_own")


def _by_opening(lowered: DataFrame, terms: DataFrame, widths: list[int]) -> DataFrame:
    """Candidates of terms without words, by opening characters, as many as the greatest width that fits."""
    width = F.lit(0)
    for w in widths:
        width = F.when(F.length("_term") >= w, w).otherwise(width)
    anchored = terms.select("_no", F.left("_term", width).alias("_piece"))
    # Overlapping character windows in one pass per width.
    windows = ", ".join(f"regexp_extract_all(_text, '(?s)(?=(.{{{w}}}))', 1)" for w in widths)
    pieces = F.expr(f"array_distinct(flatten(array({windows})))")
    return lowered.select("prompt_id", F.explode(pieces).alias("_piece")).join(anchored, "_piece").select("prompt_id", "_no")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Rows that two branches read, made once."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _sent(df: DataFrame) -> DataFrame:
    """Rows made once and, if they are SENT at most, sent to all tasks that join them."""
    rows = _written(df, "leak-sent")
    return F.broadcast(rows) if rows.count() <= SENT else rows


def leak_candidates(prompts: DataFrame, terms: DataFrame) -> DataFrame:
    """Distinct pairs (prompt_id, term_id) that may hold, few more than do.

    A term of three words or more is looked for at the rarest of its inner words in their surroundings, one of
    two words at their common border, and one of a single word in the vocabulary of the prompts.
    """
    split = _split(terms)
    return _candidates(prompts, split).join(_sent(_named(terms, split)), "_no").select("prompt_id", "term_id").distinct()


def _candidates(prompts: DataFrame, split: DataFrame) -> DataFrame:
    """Pairs (prompt_id, _no) that may hold, by numbers of different terms."""
    n = F.size("_words")
    # Kinds of terms and, for those without words, powers of two up to the longest: a handful.
    power = F.expr("cast(shiftleft(1, cast(floor(log2(length(_term))) AS int)) AS int)")
    edge = lambda at: F.when(n == 2, F.least(F.length(F.get("_words", F.lit(at))), F.lit(EDGE)))
    kinds = split.select(
        F.least(n, F.lit(3)).alias("n"), F.when(n == 0, power).alias("w"), edge(0).alias("left"), edge(1).alias("right")
    ).distinct().collect()
    found = []
    if any(k.n > 0 for k in kinds):
        places = _written(_places(prompts), "leak-places")
        vocabulary = _written(places.groupBy("_word").agg(F.count(F.lit(1)).alias("_n")), "leak-vocabulary")
    if any(k.n == 3 for k in kinds):
        found.append(_by_inner_word(places, vocabulary, split.where(n > 2)))
    if any(k.n == 2 for k in kinds):
        found.append(_by_pair(places, split.where(n == 2), sorted({(k.left, k.right) for k in kinds if k.n == 2})))
    if any(k.n == 1 for k in kinds):
        found.append(_by_vocabulary(places, vocabulary, split.where(n == 1)))
    widths = sorted(k.w for k in kinds if k.n == 0)
    if widths:
        lowered = prompts.select("prompt_id", F.lower("text").alias("_text"))
        found.append(_by_opening(lowered, split.where(n == 0), widths))
    if not found:
        return prompts.where(F.lit(False)).select("prompt_id", F.lit(None).cast("long").alias("_no"))
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every


def _folded(terms: DataFrame) -> DataFrame:
    return terms.select("term_id", F.lower("term").alias("_term")).filter("_term <> ''")


def _split(terms: DataFrame) -> DataFrame:
    """Different terms, numbered: _no, _term and _words."""
    rows = _folded(terms).select("_term").distinct().withColumn("_no", F.monotonically_increasing_id())
    return _written(rows.withColumn("_words", F.expr(_WORDS.format("_term"))), "leak-terms")


def _named(terms: DataFrame, split: DataFrame) -> DataFrame:
    """The ids of each numbered term."""
    return _folded(terms).where("term_id IS NOT NULL").join(split, "_term").select("_no", "term_id")


def leak_scan(prompts: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs (prompt_id, term_id) where the prompt contains the term, case-folded.

    ``prompts`` is (prompt_id, text), ``terms`` (term_id, term). Texts stay behind while anchors are matched
    and come back for the candidates, which are compared in full, each different term once.
    """
    split = _split(terms)
    lowered = prompts.select("prompt_id", F.lower("text").alias("_text"))
    candidates = _candidates(prompts, split).join(_sent(split.select("_no", "_term")), "_no")
    found = candidates.join(lowered, "prompt_id").filter(F.contains("_text", "_term")).select("prompt_id", "_no")
    return found.join(_sent(_named(terms, split)), "_no").select("prompt_id", "term_id")
