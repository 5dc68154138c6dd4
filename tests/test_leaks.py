"""The leak scan: equal to brute force, and few candidates beside the hits."""

from __future__ import annotations

import random

import pytest

from scorelake.operators import validation


def _tables(spark, prompts, terms):
    return (
        spark.createDataFrame(list(enumerate(prompts)), "prompt_id int, text string").repartition(4),
        spark.createDataFrame(list(enumerate(terms)), "term_id int, term string"),
    )


def _brute(prompts, terms):
    return sorted((i, j) for i, p in enumerate(prompts) for j, t in enumerate(terms) if p is not None and t and t.lower() in p.lower())


@pytest.mark.parametrize("seed", range(3))
def test_scan_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = ["a", "the", "cat", "Sat", "on", "été", "x1", "cats", "th", "mat", "über"]
    joins = [" ", " ", ", ", "-", "\n", "  "]
    text = lambda n: "".join(rng.choice(words) + rng.choice(joins) for _ in range(n))
    prompts = [text(rng.choice((1, 3, 30))) for _ in range(60)] + ["", None, "...", "the " * 400]
    whole = [p for p in prompts if p]
    terms = [text(n).strip() for n in (1, 2, 3, 3, 4, 5) for _ in range(4)]
    for _ in range(30):  # pieces of prompts, cut anywhere
        p = rng.choice(whole)
        at = rng.randrange(len(p))
        terms.append(p[at : at + rng.choice((1, 2, 4, 9, 20))])
    terms += ["", "..", "-", "é", "THE CAT SAT", "e c", "no such words here"]
    monkeypatch.setattr(validation, "ANCHOR_ROWS", 3)  # so that common anchors are dealt out
    frames = _tables(spark, prompts, terms)
    assert sorted(map(tuple, validation.leak_scan(*frames).collect())) == _brute(prompts, terms)


def test_candidates_are_near_the_hits(spark):
    rng = random.Random(9)
    names = [f"{a}{b}{c}" for a in "bdkl" for b in "aeiou" for c in "mnrst"]
    prompts = [" ".join(f"{rng.choice(names)} the {rng.choice(names)}" for _ in range(20)) for _ in range(400)]
    three = [f"{rng.choice(names)} the {rng.choice(names)}" for _ in range(40)]  # a middle word that all prompts have
    one = [n[rng.randrange(2) :] for n in rng.sample(names, 20)]
    for terms in (three, one):
        frames = _tables(spark, prompts, terms)
        hits, candidates = len(_brute(prompts, terms)), validation.leak_candidates(*frames).count()
        assert hits <= candidates <= 1.2 * hits


@pytest.mark.parametrize("bound", ["SENT", "FEW"])
def test_terms_too_many_to_send_or_compare(spark, monkeypatch, bound):
    rng = random.Random(4)
    words = ["alpha", "beta", "bet", "a", "gamma", "mma-x", "été"]
    prompts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(50)] + [None, "", "a"]
    terms = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 1, 2, 2, 3, 4, 5) for _ in range(4)] + ["lph", "et", "mm"]
    monkeypatch.setattr(validation, bound, 0)
    assert sorted(map(tuple, validation.leak_scan(*_tables(spark, prompts, terms)).collect())) == _brute(prompts, terms)


def test_words_do_not_carry_their_text(spark, monkeypatch):
    plans, written = [], validation._written

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(validation, "_written", kept)
    terms = ["one two three four", "two three", "four"]
    prompts, rows = _tables(spark, ["one two three four five"], terms)
    found = validation.leak_scan(prompts, rows)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 3
    rows = [line for plan in plans for line in plan.splitlines() if "Generate" in line and "prompt_id" in line]
    assert rows and not any("_words#" in line.split("), [")[1].split("]")[0] for line in rows if "), [" in line)


def test_one_id_of_two_terms(spark):
    prompts, _ = _tables(spark, ["see the red cat here", "see the big dog here", "none"], [])
    terms = spark.createDataFrame([(7, "the red cat"), (7, "the big dog"), (8, "THE RED CAT"), (None, "none")], "term_id int, term string")
    assert sorted(map(tuple, validation.leak_scan(prompts, terms).collect())) == [(0, 7), (0, 8), (1, 7)]
