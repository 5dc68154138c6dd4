"""Prompts as arrays of (role, content) messages, their hashes and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake import schemas
from scorelake.functions.judging import message
from scorelake.functions.localization import numbered_listing


def prompt_hash(text: Column) -> Column:
    """First twelve hex characters of the prompt's SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(fixed.PROMPT_HASH_CHARS))


def user_content(track: Column, payload: Column) -> Column:
    """The user message of a sample, by track."""

    def text(name: str) -> Column:
        return F.coalesce(payload[name], F.lit(""))

    # The wording of each track's user message.
    unit = F.concat(
        F.lit("Module name: `"),
        text("module_name"),
        F.lit("` — import it as `from "),
        text("module_name"),
        F.lit(" import ...`.\n\n```python\n"),
        text("source"),
        F.lit("\n```"),
    )
    bug = F.concat(
        F.lit("Symptom: "),
        text("symptom"),
        F.lit("\n\nCode under test (line numbers shown):\n```\n"),
        numbered_listing(text("source")),
        F.lit("\n```"),
    )

    def scenario(label: str) -> Column:
        return F.concat(
            F.lit("Base URL: "),
            text("base_url"),
            F.lit(f"\n\n{label}:\n"),
            text("flow"),
            F.lit("\n\nSuccess condition: "),
            text("success"),
        )

    repair = F.concat(
        F.lit("Base URL: "),
        text("base_url"),
        F.lit("\n\nFailing test:\n```ts\n"),
        text("broken_test"),
        F.lit("\n```\n\nPlaywright runner output:\n```\n"),
        text("error"),
        F.lit("\n```\n\nSuccess condition: "),
        text("success"),
    )
    return (
        F.when(track == "unit_test_gen", unit)
        .when(track == "bug_localization", bug)
        .when(track == "test_case_design", text("requirement"))
        .when(track == "e2e_ui", scenario("User flow"))
        .when(track == "e2e_advanced", scenario("Scenario"))
        .when(track == "e2e_repair", repair)
    )


def build_messages(system_prompt: Column, track: Column, payload: Column) -> Column:
    """System and user message of a sample."""
    system = F.struct(F.lit("system").alias("role"), system_prompt.alias("content"))
    return F.array(system, message("user", user_content(track, payload)))


def retry_messages(messages: Column, raw_output: Column, feedback: Column) -> Column:
    """The next round's request: the failed output and what was wrong with it."""
    ask = F.concat(F.lit(fixed.RETRY_HEAD), feedback, F.lit(fixed.RETRY_TAIL))
    return F.concat(messages, F.array(message("assistant", raw_output), message("user", ask)))


def system_text(messages: Column) -> Column:
    """System contents joined by newlines, for APIs that take them apart."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    return F.array_join(F.transform(system, lambda m: m["content"]), "\n")


def chat_turns(messages: Column) -> Column:
    """The messages without the system ones."""
    return F.filter(messages, lambda m: m["role"] != "system")


def word_count(text: Column) -> Column:
    """Token estimate: whitespace-separated words."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollar cost of a call from its tokens and the per-million-token prices."""
    million = F.lit(1_000_000.0)
    return tokens_in / million * price_in + tokens_out / million * price_out


def chat_reply(reply: Column) -> dict[str, Column]:
    """Text and token counts of a stored chat reply (JSON); absent counts are 0."""
    read = F.from_json(reply, schemas.CHAT_REPLY)
    return {
        "text": F.get(read["choices"], F.lit(0))["message"]["content"],
        "tokens_in": F.coalesce(read["usage"]["prompt_tokens"], F.lit(0)),
        "tokens_out": F.coalesce(read["usage"]["completion_tokens"], F.lit(0)),
    }
