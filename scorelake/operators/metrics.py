"""Metric registry over mergeable statistics.

A metric is a function from :class:`Stats` to a Column. ``Stats`` hands out sums and
counts by name and remembers which ones were asked for, so a query reads and
aggregates only the columns its metrics need, and every statistic can be merged by
adding: per-trial rows roll up to tracks, to models and across micro-batches.

A metric may build on others through ``Stats.metric``. Those become columns of
their own, layer by layer: nested in one projection, the shared sub-expressions
would multiply in Catalyst's constraint propagation.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.functions.values import first_present, number_sql, truth, truth_sql


class Stats:
    """Statistics of a group of scored rows, by name.

    ``columns`` are those of the scored table; a statistic of a column the table
    lacks is NULL.
    """

    def __init__(self, columns: Collection[str], metrics: dict[str, Metric] | None = None):
        self.columns = set(columns)
        self.metrics = METRICS if metrics is None else {**METRICS, **metrics}
        # The row count is always there, so that a group without metrics is still a group.
        self.sums: dict[str, Callable[[DataFrame], str]] = {"n_rows": lambda df: "count(1)"}
        self._values: dict[str, Column] = {}
        self._layer: dict[str, int] = {}
        self._depth: list[int] = []

    def has(self, *names: str) -> bool:
        return all(n in self.columns for n in names)

    @staticmethod
    def missing() -> Column:
        return F.expr("CAST(NULL AS DOUBLE)")

    def _need(self, stat: str, build: Callable[[DataFrame], str]) -> str:
        self.sums[stat] = build
        return stat

    def total_sql(self, name: str) -> str:
        """Sum of the present numbers, 0 when there are none."""
        stat = self._need(f"sum__{name}", lambda df: f"sum({number_sql(df, name)})")
        return f"coalesce({stat}, 0)"

    def mean_sql(self, name: str) -> str:
        """Mean of the present numbers, NULL when there are none."""
        if not self.has(name):
            return "CAST(NULL AS DOUBLE)"
        total = self._need(f"sum__{name}", lambda df: f"sum({number_sql(df, name)})")
        count = self._need(f"n__{name}", lambda df: f"count({number_sql(df, name)})")
        return f"try_divide({total}, {count})"

    def share_sql(self, name: str) -> str:
        """Share of true rows among the present ones."""
        if not self.has(name):
            return "CAST(NULL AS DOUBLE)"
        true = self._need(f"true__{name}", lambda df: f"sum({truth_sql(df, name)})")
        known = self._need(f"known__{name}", lambda df: f"count({truth_sql(df, name)})")
        return f"try_divide({true}, {known})"

    def true_total_sql(self, name: str) -> str:
        """Number of true rows."""
        stat = self._need(f"true__{name}", lambda df: f"sum({truth_sql(df, name)})")
        return f"coalesce({stat}, 0)"

    def total(self, name: str) -> Column:
        return F.expr(self.total_sql(name))

    def mean(self, name: str) -> Column:
        return F.expr(self.mean_sql(name))

    def share(self, name: str) -> Column:
        return F.expr(self.share_sql(name))

    def true_total(self, name: str) -> Column:
        return F.expr(self.true_total_sql(name))

    def rate(self, numerator: str, denominator: str) -> Column:
        """Ratio of two sums; missing values count as 0, a zero denominator is NULL."""
        if not self.has(numerator, denominator):
            return self.missing()
        return F.expr(f"try_divide({self.total_sql(numerator)}, {self.total_sql(denominator)})")

    def first_try_share(self) -> Column:
        """Share of rows with a verdict that passed on attempt 1."""

        def build(df: DataFrame) -> str:
            first = f"coalesce(CAST({number_sql(df, 'attempts')} = 1 AS INT), 0)"
            return f"sum({truth_sql(df, 'passed')} * {first})"

        self.share_sql("passed")
        return F.expr(f"try_divide({self._need('first__passed', build)}, known__passed)")

    def n_samples(self) -> Column:
        """Distinct samples of the group; joined in, as distinct counts do not add up."""
        return F.col("n_samples")

    def metric_sql(self, name: str) -> str:
        """Another metric's column, computed in an earlier layer."""
        layer = self.use(name)
        if self._depth:
            self._depth[-1] = max(self._depth[-1], layer + 1)
        return f"`{name}`"

    def metric(self, name: str) -> Column:
        return F.expr(self.metric_sql(name))

    def mean_of(self, parts: Iterable[tuple[str, float]]) -> Column:
        """Weighted mean of the non-NULL parts, added in the given order."""
        terms = ", ".join(f"named_struct('v', ({v}) * {w}D, 'w', {w}D)" for v, w in parts)
        return F.expr(
            f"aggregate(array({terms}), named_struct('v', 0D, 'w', 0D), "
            "(t, p) -> if(p.v IS NULL, t, named_struct('v', t.v + p.v, 'w', t.w + p.w)), "
            "t -> try_divide(t.v, t.w))"
        )

    def use(self, name: str) -> int:
        """Plan a metric and everything it builds on; returns its layer."""
        if name not in self._layer:
            self._depth.append(0)
            self._values[name] = self.metrics[name](self)
            self._layer[name] = self._depth.pop()
        return self._layer[name]

    def use_all(self, names: Iterable[str]) -> Stats:
        for name in names:
            self.use(name)
        return self

    def aggregates(self, df: DataFrame) -> list[Column]:
        """The aggregate expressions over the scored table."""
        return [F.expr(build(df)).alias(stat) for stat, build in self.sums.items()]

    def merges(self) -> list[Column]:
        """The aggregate expressions that add partial statistics up."""
        return [F.expr(f"sum({stat})").alias(stat) for stat in self.sums]

    def layers(self) -> Iterator[dict[str, Column]]:
        for layer in range(max(self._layer.values(), default=-1) + 1):
            yield {n: self._values[n] for n, at in self._layer.items() if at == layer}

    def with_metrics(self, df: DataFrame) -> DataFrame:
        """The statistics table with a column for every planned metric."""
        for layer in self.layers():
            df = df.withColumns(layer)
        return df


Metric = Callable[[Stats], Column]


def cost_per_run(s: Stats) -> Column:
    """Dollars per distinct sample."""
    if not s.has("cost"):
        return s.missing()
    return F.expr(f"try_divide({s.total_sql('cost')}, n_samples)")


def tok_per_s(s: Stats) -> Column:
    return s.rate("tokens_out", "latency_s")


def mean_latency_s(s: Stats) -> Column:
    return s.mean("latency_s")


def output_tokens(s: Stats) -> Column:
    return s.mean("tokens_out")


def cost_per_correct(s: Stats) -> Column:
    """Dollars per passing row, NULL when nothing passed."""
    if not s.has("cost", "passed"):
        return s.missing()
    return F.expr(f"try_divide({s.total_sql('cost')}, {s.true_total_sql('passed')})")


def false_positive_rate(s: Stats) -> Column:
    return s.rate("tests_failing_on_correct", "tests_total")


def false_negative_rate(s: Stats) -> Column:
    return s.rate("mutants_surviving", "mutants_total")


def recall(s: Stats) -> Column:
    return F.expr(f"1D - {s.metric_sql('false_negative_rate')}")


def precision(s: Stats) -> Column:
    """Killed mutants among killed mutants and false alarms."""
    if not s.has("mutants_killed", "tests_failing_on_correct"):
        return s.missing()
    killed, alarms = s.total_sql("mutants_killed"), s.total_sql("tests_failing_on_correct")
    return F.expr(f"try_divide({killed}, {killed} + {alarms})")


def f1(s: Stats) -> Column:
    p, r = s.metric_sql("precision"), s.metric_sql("recall")
    return F.expr(f"try_divide(2D * {p} * {r}, {p} + {r})")


def code_correctness(s: Stats) -> Column:
    """Share of valid outputs, by the first correctness column the table has."""
    name = next((c for c in fixed.CORRECTNESS_COLUMNS if s.has(c)), None)
    return s.share(name) if name else s.missing()


def coverage(s: Stats) -> Column:
    return s.mean("coverage_pct")


def design_score(s: Stats) -> Column:
    return s.mean("design_judge")


def hallucination_rate(s: Stats) -> Column:
    return s.share("hallucinated")


def localization_accuracy(s: Stats) -> Column:
    return s.share("localized")


def pattern_adoption(s: Stats) -> Column:
    return s.mean("pattern_used")


def locator_quality(s: Stats) -> Column:
    return s.mean("locator_quality")


def assertion_quality(s: Stats) -> Column:
    return s.mean("assertion_quality")


def waiting_quality(s: Stats) -> Column:
    return s.mean("waiting_quality")


def craft_score(s: Stats) -> Column:
    """Mean of the available craft facets; smell rates count inverted."""
    qualities = [(s.mean_sql(c), 1.0) for c in fixed.CRAFT_QUALITIES]
    smells = [(f"1D - {s.share_sql(c)}", 1.0) for c in fixed.CRAFT_SMELLS]
    return s.mean_of(qualities + smells)


def dry_score(s: Stats) -> Column:
    return s.mean("dry_score")


def review_score(s: Stats) -> Column:
    return s.mean("review_score")


def one_shot_pass_rate(s: Stats) -> Column:
    """Share of rows that passed on the first attempt, among those with a verdict."""
    return s.first_try_share() if s.has("passed", "attempts") else s.missing()


def multi_shot_pass_rate(s: Stats) -> Column:
    return s.share("passed")


def composite(s: Stats) -> Column:
    """Weighted mean of the available quality terms, in 0..1."""
    forms = {"coverage": "{} / 100D", "hallucination_rate": "1D - {}"}
    return s.mean_of(
        (forms.get(name, "{}").format(s.metric_sql(name)), weight)
        for name, weight in fixed.COMPOSITE_WEIGHTS
    )


METRICS: dict[str, Metric] = {
    "composite": composite,
    "multi_shot_pass_rate": multi_shot_pass_rate,
    "one_shot_pass_rate": one_shot_pass_rate,
    "code_correctness": code_correctness,
    "recall": recall,
    "precision": precision,
    "f1": f1,
    "false_positive_rate": false_positive_rate,
    "false_negative_rate": false_negative_rate,
    "coverage": coverage,
    "design_score": design_score,
    "localization_accuracy": localization_accuracy,
    "pattern_adoption": pattern_adoption,
    "craft_score": craft_score,
    "locator_quality": locator_quality,
    "assertion_quality": assertion_quality,
    "waiting_quality": waiting_quality,
    "dry_score": dry_score,
    "review_score": review_score,
    "hallucination_rate": hallucination_rate,
    "cost_per_run": cost_per_run,
    "cost_per_correct": cost_per_correct,
    "tok_per_s": tok_per_s,
    "mean_latency_s": mean_latency_s,
    "output_tokens": output_tokens,
}


def tier(score: Column) -> Column:
    """A, B or C by the cut-offs; ``n/a`` without a score."""
    return (
        F.when(score.isNull(), "n/a")
        .when(score >= fixed.TIER_A, "A")
        .when(score >= fixed.TIER_B, "B")
        .otherwise("C")
    )


def with_levels(df: DataFrame) -> DataFrame:
    """Each row once under its own track and once under the overall level."""
    return df.withColumn(
        "track", F.explode(F.array(F.col("track"), F.lit(fixed.OVERALL)))
    ).filter(F.col("track").isNotNull())


def sample_counts(scored: DataFrame) -> DataFrame:
    """Distinct samples per (model, track) and per model.

    Overall sample ids are not qualified by track. Duplicates fall away before the
    shuffle, so a hot (model, track) costs one row per sample and task.
    """
    keys = scored.select("model_slug", "track", "sample_id").filter(
        F.col("model_slug").isNotNull() & F.col("sample_id").isNotNull()
    )
    return (
        with_levels(keys)
        .distinct()
        .groupBy("model_slug", "track")
        .agg(F.count(F.lit(1)).alias("n_samples"))
    )


def metric_table(
    scored: DataFrame, names: Iterable[str], metrics: dict[str, Metric] | None = None
) -> DataFrame:
    """Chosen metrics per (model, track) and pooled per model.

    An entry of ``metrics`` is a function of the statistics, or an ``opaque.Opaque`` metric over rows.
    """
    from scorelake.operators.opaque import Opaque, opaque_table

    names = list(names)
    opaque = {n: m for n, m in (metrics or {}).items() if isinstance(m, Opaque)}
    if opaque.keys() & set(names):
        plain = metric_table(scored, [n for n in names if n not in opaque], {n: m for n, m in metrics.items() if n not in opaque})
        own = opaque_table(scored, {n: opaque[n] for n in names if n in opaque})
        return plain.join(own, ["model_slug", "track"], "left").select("model_slug", "track", *names)
    stats = Stats(scored.columns, metrics).use_all(names)
    keyed = scored.filter(F.col("model_slug").isNotNull())
    grouped = keyed.groupBy("model_slug", "track").agg(*stats.aggregates(scored))
    merged = with_levels(grouped).groupBy("model_slug", "track").agg(*stats.merges())
    if "cost_per_run" in names:
        merged = merged.join(sample_counts(scored), ["model_slug", "track"], "left")
    return stats.with_metrics(merged).select("model_slug", "track", *names)


def correctness_column(scored: DataFrame) -> str | None:
    """The column that feeds ``code_correctness`` for this table."""
    return first_present(scored, fixed.CORRECTNESS_COLUMNS)


def correctness_by_track(scored: DataFrame) -> DataFrame:
    """Share of valid outputs by each track's own correctness column.

    ``code_correctness`` looks at one column for the whole table; this one does not.
    """
    own = F.coalesce(
        *(truth(scored, c) for c in fixed.CORRECTNESS_COLUMNS if c in scored.columns)
    )
    return (
        scored.filter(F.col("model_slug").isNotNull() & F.col("track").isNotNull())
        .groupBy("model_slug", "track")
        .agg(F.avg(own).alias("correctness"))
    )
