"""Judge prompts, request keys and reply reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.functions import json_values as json


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def rubric_messages(rubric: str, artifact: Column) -> Column:
    """Messages that ask for one score against a rubric."""
    prompt = F.concat(F.lit(rubric + fixed.RUBRIC_FORMAT), artifact)
    return F.array(message("system", F.lit(fixed.EVALUATOR_SYSTEM)), message("user", prompt))


def review_messages(artifact: Column, criteria: dict[str, str] | None = None) -> Column:
    """Messages that ask for a score on each criterion."""
    criteria = criteria or fixed.REVIEW_CRITERIA
    listed = "\n".join(f"- {name}: {text}" for name, text in criteria.items())
    shape = ", ".join(f'"{name}": {{"score": <0..1>, "note": "<short>"}}' for name in criteria)
    opening = f"{fixed.REVIEW_HEAD}{listed}{fixed.REVIEW_SHAPE_HEAD}{{{shape}}}{fixed.REVIEW_TAIL}"
    prompt = F.concat(F.lit(opening), artifact)
    return F.array(message("system", F.lit(fixed.EVALUATOR_SYSTEM)), message("user", prompt))


def hallucination_messages(source: Column, tests: Column) -> Column:
    """Messages that ask whether tests call symbols the source does not have."""
    return _checked_messages(F.concat(source, F.lit(fixed.HALLUCINATION_MIDDLE), tests))


def _artifacts(payload: Column, parsed: Column) -> dict[str, Column]:
    """What each judge is shown of one parsed output: the end of its prompt, after the fixed part."""
    source = F.coalesce(payload["source"], F.lit(""))
    cause = F.coalesce(F.get_json_object(parsed, "$.root_cause"), F.lit(""))
    suite = F.concat(
        F.lit("REQUIREMENT:\n"),
        F.coalesce(payload["requirement"], F.lit("")),
        F.lit("\n\nSUITE:\n"),
        parsed,
    )
    return {
        "hallucination": F.concat(source, F.lit(fixed.HALLUCINATION_MIDDLE), parsed),
        "design": parsed,
        "test_case_design": suite,
        "explanation": F.concat(F.lit("BUGGY CODE:\n"), source, F.lit("\n\nEXPLANATION:\n"), cause),
        "review": parsed,
    }


def _checked_messages(artifact: Column) -> Column:
    prompt = F.concat(F.lit(fixed.HALLUCINATION_HEAD), artifact)
    return F.array(message("system", F.lit(fixed.ANALYST_SYSTEM)), message("user", prompt))


_MESSAGES = {
    "hallucination": _checked_messages,
    "design": lambda artifact: rubric_messages(fixed.DESIGN_RUBRIC, artifact),
    "test_case_design": lambda artifact: rubric_messages(fixed.TEST_DESIGN_RUBRIC, artifact),
    "explanation": lambda artifact: rubric_messages(fixed.EXPLANATION_RUBRIC, artifact),
    "review": lambda artifact: review_messages(artifact),
}


def _by_judge(judge: Column, values: dict[str, Column]) -> Column:
    first, *others = values.items()
    chosen = F.when(judge == first[0], first[1])
    for name, value in others:
        chosen = chosen.when(judge == name, value)
    return chosen


def judged_artifact(judge: Column, payload: Column, parsed: Column) -> Column:
    """What the named judge is shown of one parsed output."""
    return _by_judge(judge, _artifacts(payload, parsed))


def artifact_messages(judge: Column, artifact: Column) -> Column:
    """The prompt of the named judge around an artifact."""
    return _by_judge(judge, {name: around(artifact) for name, around in _MESSAGES.items()})


def judge_messages(judge: Column, payload: Column, parsed: Column) -> Column:
    """The prompt of the named judge for one parsed output."""
    shown = _artifacts(payload, parsed)
    return _by_judge(judge, {name: around(shown[name]) for name, around in _MESSAGES.items()})


def judge_request_key(model_id: Column, judge: Column, payload: Column, parsed: Column) -> Column:
    """``request_key`` of ``judge_messages``: a judge's fixed part is a constant, and only the artifact is put into JSON.

    The artifact ends the last message, so the JSON of it alone ends like the JSON of the whole.
    """

    def text(around: Callable[[Column], Column], artifact: Column) -> Column:
        fixed_part = _request_json(model_id, around(F.lit("")))
        opening = F.substr(fixed_part, F.lit(1), F.length(fixed_part) - F.lit(len('"}]}')))
        shown = F.to_json(F.struct(artifact.alias("a")))
        whole = F.concat(opening, F.substr(shown, F.lit(len('{"a":"') + 1)), F.lit("]}"))
        missing = _request_json(model_id, around(F.lit(None).cast("string")))
        return F.when(artifact.isNull(), missing).otherwise(whole)

    shown = _artifacts(payload, parsed)
    return F.sha2(_by_judge(judge, {name: text(around, shown[name]) for name, around in _MESSAGES.items()}), 256)


def _request_json(model_id: Column, messages: Column) -> Column:
    return F.to_json(F.struct(model_id.alias("id"), messages.alias("messages")))


def request_key(model_id: Column, messages: Column) -> Column:
    """SHA-256 of the judge model and its ordered messages."""
    return F.sha2(_request_json(model_id, messages), 256)


def _with_fields(df: DataFrame, document: str, paths) -> DataFrame:
    """Adds ``_doc`` and a type-name column per path."""
    df = df.withColumn("_doc", F.expr(f"try_parse_json({document})"))
    return df.withColumns({kind: F.expr(json.kind_sql("_doc", path)) for kind, path in paths.items()})


def _note(path: str, kind: str, chars: int) -> str:
    return f"left({json.text_sql('_doc', path, kind)}, {chars})"


def with_rubric_reply(df: DataFrame, document: str) -> DataFrame:
    """Adds ``score`` and ``note`` of a reply to a rubric."""
    paths = {"_score_kind": "$.score", "_note_kind": "$.rationale"}
    return (
        _with_fields(df, document, paths)
        .withColumns(
            {
                "score": F.expr(json.score_sql("_doc", "$.score", "_score_kind")),
                "note": F.expr(_note("$.rationale", "_note_kind", fixed.JUDGE_NOTE_CHARS)),
            }
        )
        .drop("_doc", *paths)
    )


def with_hallucination_reply(df: DataFrame, document: str) -> DataFrame:
    """Adds ``flag``: whether the reply reports invented symbols."""
    paths = {"_flag_kind": "$.hallucinated"}
    flag = F.expr(json.truthy_sql("_doc", "$.hallucinated", "_flag_kind"))
    return _with_fields(df, document, paths).withColumn("flag", flag).drop("_doc", *paths)


def with_review_reply(df: DataFrame, document: str) -> DataFrame:
    """Adds per-criterion scores and notes and their mean; a missing criterion scores 0."""
    names = list(fixed.REVIEW_CRITERIA)
    paths = {}
    for name in names:
        paths[f"_{name}"] = f"$.{name}"
        paths[f"_{name}_score"] = f"$.{name}.score"
        paths[f"_{name}_note"] = f"$.{name}.note"
    columns = {}
    for name in names:
        is_entry = f"startswith(_{name}, 'OBJECT')"
        score = json.score_sql("_doc", f"$.{name}.score", f"_{name}_score")
        note = _note(f"$.{name}.note", f"_{name}_note", fixed.REVIEW_NOTE_CHARS)
        columns[f"review_{name}"] = F.expr(f"if({is_entry}, {score}, 0D)")
        columns[f"review_{name}_note"] = F.expr(f"if({is_entry}, {note}, '')")
    mean = " + ".join(f"review_{name}" for name in names)
    return (
        _with_fields(df, document, paths)
        .withColumns(columns)
        .withColumn("review_score", F.expr(f"({mean}) / {len(names)}"))
        .drop("_doc", *paths)
    )
