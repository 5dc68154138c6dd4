"""The metric definitions once more, as plain SQL over scored rows.

Written from the definitions, with AVG and COUNT DISTINCT per group instead of
mergeable statistics, so the two sides share no formula.
"""

from __future__ import annotations

from scorelake import fixed_values as fixed

BASE = {
    "multi_shot_pass_rate": "avg(CAST(passed AS INTEGER))",
    "one_shot_pass_rate": "avg(CASE WHEN passed IS NULL THEN NULL WHEN passed AND attempts = 1 THEN 1 ELSE 0 END)",
    "code_correctness": "avg(CAST(runs_and_valid AS INTEGER))",
    "recall": "1.0 - sum(mutants_surviving) / nullif(sum(mutants_total), 0)",
    "precision": "coalesce(sum(mutants_killed), 0) / nullif(coalesce(sum(mutants_killed), 0) + coalesce(sum(tests_failing_on_correct), 0), 0)",
    "false_positive_rate": "sum(tests_failing_on_correct) / nullif(sum(tests_total), 0)",
    "false_negative_rate": "sum(mutants_surviving) / nullif(sum(mutants_total), 0)",
    "coverage": "avg(coverage_pct)",
    "design_score": "avg(design_judge)",
    "localization_accuracy": "avg(CAST(localized AS INTEGER))",
    "pattern_adoption": "avg(pattern_used)",
    "locator_quality": "avg(locator_quality)",
    "assertion_quality": "avg(assertion_quality)",
    "waiting_quality": "avg(waiting_quality)",
    "dry_score": "avg(dry_score)",
    "review_score": "avg(review_score)",
    "hallucination_rate": "avg(CAST(hallucinated AS INTEGER))",
    "cost_per_run": "coalesce(sum(cost), 0) / nullif(count(DISTINCT sample_id), 0)",
    "cost_per_correct": "coalesce(sum(cost), 0) / nullif(sum(CAST(passed AS INTEGER)), 0)",
    "tok_per_s": "sum(tokens_out) / nullif(sum(latency_s), 0)",
    "mean_latency_s": "avg(latency_s)",
    "output_tokens": "avg(tokens_out)",
}

_FACETS = {
    "facet_teardown": "avg(teardown_hygiene)",
    "facet_url": "1.0 - avg(CAST(uses_hardcoded_url AS INTEGER))",
    "facet_smell": "1.0 - avg(CAST(has_code_smell AS INTEGER))",
}
_CRAFT = (
    "locator_quality",
    "assertion_quality",
    "waiting_quality",
    "facet_teardown",
    "facet_url",
    "facet_smell",
)


def _available_mean(parts) -> str:
    total = " + ".join(f"coalesce(({e}) * {w}::DOUBLE, 0)" for e, w in parts)
    weight = " + ".join(f"CASE WHEN ({e}) IS NULL THEN 0 ELSE {w}::DOUBLE END" for e, w in parts)
    return f"({total}) / nullif({weight}, 0)"


CRAFT_SCORE = _available_mean([(c, "1.0") for c in _CRAFT])
F1 = "2.0 * precision * recall / nullif(precision + recall, 0)"
_TERMS = {"coverage": "coverage / 100.0::DOUBLE", "hallucination_rate": "1.0 - hallucination_rate"}
COMPOSITE = _available_mean(
    [(_TERMS.get(name, name), str(weight)) for name, weight in fixed.COMPOSITE_WEIGHTS]
)


def grouped(relation: str, keys: str) -> str:
    """Every metric of a relation of scored rows, by the given keys."""
    base = ", ".join(f"{e} AS {n}" for n, e in {**BASE, **_FACETS}.items())
    facets = ", ".join(_FACETS)
    return (
        f"SELECT *, {COMPOSITE} AS composite FROM ("
        f"SELECT * EXCLUDE ({facets}), {CRAFT_SCORE} AS craft_score, {F1} AS f1 FROM ("
        f"SELECT {keys}, count(DISTINCT sample_id) AS n_samples, {base} "
        f"FROM {relation} GROUP BY {keys}))"
    )


def tier(score: str) -> str:
    return (
        f"CASE WHEN {score} IS NULL THEN 'n/a' WHEN {score} >= 0.8 THEN 'A' "
        f"WHEN {score} >= 0.6 THEN 'B' ELSE 'C' END"
    )


def python_round(expr: str) -> str:
    """Correct rounding to four places through the C formatter."""
    return f"CAST(printf('%.4f', {expr}) AS DOUBLE)"


_HEADLINE = ", ".join(f"'{t}'" for t in fixed.HEADLINE_TRACKS)


def summary_ctes(relation: str = "v_scored", suffix: str = "") -> str:
    """CTEs that end in ``summary<suffix>``: the whole table, unrounded."""
    x = suffix
    return f"""
per_track{x} AS ({grouped(relation, 'model_slug, track')}),
per_model{x} AS ({grouped(relation, 'model_slug')}),
per_trial{x} AS ({grouped(relation, 'model_slug, track, trial')}),
track_spread{x} AS (SELECT model_slug, track, greatest(count(composite), 1) AS n_trials,
  stddev_samp(composite) AS composite_std FROM per_trial{x} GROUP BY 1, 2),
trial_headline{x} AS (SELECT model_slug, trial, avg(composite) AS composite FROM per_trial{x}
  WHERE track IN ({_HEADLINE}) GROUP BY 1, 2),
model_spread{x} AS (SELECT model_slug, greatest(count(composite), 1) AS n_trials,
  stddev_samp(composite) AS composite_std FROM trial_headline{x} GROUP BY 1),
headline{x} AS (SELECT model_slug, avg(composite) AS composite FROM per_track{x}
  WHERE track IN ({_HEADLINE}) GROUP BY 1),
summary{x} AS (
  SELECT p.*, n_trials, composite_std, {tier(python_round('p.composite'))} AS tier
  FROM per_track{x} p JOIN track_spread{x} USING (model_slug, track)
  UNION ALL BY NAME
  SELECT p.* EXCLUDE (composite), 'ALL' AS track, h.composite, n_trials, composite_std,
    {tier('h.composite')} AS tier
  FROM per_model{x} p LEFT JOIN headline{x} h USING (model_slug) JOIN model_spread{x} USING (model_slug)
)"""


SUMMARY = summary_ctes()
