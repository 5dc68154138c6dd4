"""License detection by ordered signature rules, in DataFrame functions only and without a shuffle.

Every document's words (ASCII letters and digits, lower-cased, and everything outside ASCII) are
written with one space between them. Each rule has a keyword, a pattern, a label, a priority and a
confidence, and its kind has a text that all of its patterns hold; a pattern is tried only where
both occur in the written words. Every match is an interval of the written words. An
interval is suppressed when one of a better or equal priority contains it; between equal intervals
the better priority, then the earlier rule, wins. What is left gives the document's detections.

Beside these, the base phrases are counted in every document whatever the rules suppress.

A row is worked on in memory as one text with its matches; the work grows with the text, and with the matches
times their root.

Defined cases: NULL and empty texts have no words, no labels and score 0; repeated rows get equal
results, as each row is treated alone; columns of docs that have an output's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import let

# Separators and words as they are before lower-casing.
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_PART = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Phrase of words and the label it stands for.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, keyword, the license's name as it is written, and its version numbers if it has any.
# Written with one space between lower-case words, as the texts are.
_FAMILIES = (
    ("mit", "mit", "mit", ""),
    ("mit", "expat", "expat", ""),
    ("mit", "x11", "x11", ""),
    ("mit-0", "mit", "mit (?:no attribution|0)", ""),
    ("apache", "apache", "apache(?: software)?", "[12](?: [01])?"),
    ("gpl", "general public", "(?:gnu )?general public", "[123](?: 0)?"),
    ("gpl", "gpl", "(?:gnu )?gpl", "(?:v )?[123](?: 0)?|v[123]"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public", "[23](?: [01])?"),
    ("lgpl", "library general", "(?:gnu )?library general public", "2(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "(?:v )?[23](?: [01])?|v[23](?: 1)?"),
    ("agpl", "affero", "(?:gnu )?affero general public", "[13](?: 0)?"),
    ("agpl", "agpl", "(?:gnu )?agpl", "(?:v )?[13](?: 0)?|v[13]"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation", "1 [123]"),
    ("bsd-0", "bsd", "(?:bsd 0 clause|zero clause bsd|0bsd)", ""),
    ("bsd-2", "bsd", "(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)", ""),
    ("bsd-3", "bsd", "(?:bsd 3 clause|(?:3|three) clause bsd|modified bsd|new bsd|revised bsd)", ""),
    ("bsd-4", "bsd", "(?:bsd 4 clause|(?:4|four) clause bsd|original bsd)", ""),
    ("bsd", "bsd", "bsd(?: style)?", ""),
    ("isc", "isc", "isc", ""),
    ("mpl", "mozilla", "mozilla public", "[12] [01]"),
    ("mpl", "mpl", "mpl", "[12] [01]"),
    ("epl", "eclipse", "eclipse public", "[12] 0"),
    ("edl", "eclipse", "eclipse distribution", "1 0"),
    ("cddl", "common development", "common development and distribution", "1 [01]"),
    ("cpl", "common public", "common public", "1 0"),
    ("eupl", "european union", "european union public", "1 [012]"),
    ("artistic", "artistic", "artistic", "[12] 0"),
    ("zlib", "zlib", "zlib(?: libpng)?", ""),
    ("libpng", "libpng", "libpng", "2"),
    ("boost", "boost", "boost software", "1 0"),
    ("psf", "python software", "python software foundation", "2"),
    ("ruby", "ruby", "ruby", ""),
    ("php", "php", "php", "3 0(?: 1)?"),
    ("postgresql", "postgresql", "postgresql", ""),
    ("ofl", "open font", "(?:sil )?open font", "1 [01]"),
    ("wtfpl", "wtfpl", "wtfpl", "2"),
    ("unlicense", "unlicense", "unlicense", ""),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", ""),
    ("w3c", "w3c", "w3c(?: software)?", ""),
    ("ms-pl", "microsoft public", "microsoft public", ""),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal", ""),
    ("afl", "academic free", "academic free", "[123] [01]"),
    ("osl", "open software", "open software", "[123] [01]"),
    ("upl", "universal permissive", "universal permissive", "1 0"),
    ("blueoak", "blue oak", "blue oak model", "1 0 0"),
    ("mulan", "mulan", "mulan (?:psl|permissive software)", "[12]"),
    ("cecill", "cecill", "cecill", "[12](?: [01])?"),
    ("odbl", "open database", "open database", "1 0"),
    ("odc-by", "open data commons", "open data commons attribution", "1 0"),
    ("pddl", "public domain dedication", "(?:odc |open data commons )?public domain dedication(?: and)?", "1 0"),
    ("cc0", "cc0", "cc0", "1 0"),
    ("cc0", "zero", "creative commons zero", "1 0"),
    ("cc-by-nc-nd", "by nc nd", "(?:cc|creative commons) by nc nd", "[1234] [05]"),
    ("cc-by-nc-sa", "by nc sa", "(?:cc|creative commons) by nc sa", "[1234] [05]"),
    ("cc-by-nc", "by nc", "(?:cc|creative commons) by nc", "[1234] [05]"),
    ("cc-by-nd", "by nd", "(?:cc|creative commons) by nd", "[1234] [05]"),
    ("cc-by-sa", "by sa", "(?:cc|creative commons) by sa", "[1234] [05]"),
    ("cc-by", "cc by", "cc by", "[1234] [05]"),
    ("cc-by", "creative commons by", "creative commons by", "[1234] [05]"),
    ("cc-by-nc-nd", "creative commons attribution", "creative commons attribution non ?commercial no ?derivatives?", "[1234] [05]"),
    ("cc-by-nc-sa", "creative commons attribution", "creative commons attribution non ?commercial share ?alike", "[1234] [05]"),
    ("cc-by-nc", "creative commons attribution", "creative commons attribution non ?commercial", "[1234] [05]"),
    ("cc-by-nd", "creative commons attribution", "creative commons attribution no ?derivatives?", "[1234] [05]"),
    ("cc-by-sa", "creative commons attribution", "creative commons attribution share ?alike", "[1234] [05]"),
    ("cc-by", "creative commons", "creative commons attribution", "[1234] [05]"),
    ("elastic", "elastic", "elastic", "2(?: 0)?"),
    ("sspl", "server side", "server side public", "1"),
    ("busl", "business source", "business source", "1 1"),
    ("openrail", "rail", "(?:big ?science |creative ml )?open ?rail(?: m)?", ""),
    ("llama", "llama", "llama [234](?: [123])? community", ""),
)

# Passages that stand for a license or a claim without its name.
_PASSAGES = (
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache", "compliance with", "you may not use this file except in compliance with the license"),
    ("gpl", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "free software foundation", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "free software foundation", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl", "source code form", "this source code form is subject to the terms of the mozilla public license"),
    ("boost", "obtaining a copy", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "as is", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "public domain", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the", "do what the fuck you want to public license"),
    ("public-domain", "public domain", "(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "(?:is|are) in the public domain"),
    ("cc0", "waived all", "waived all copyright and related or neighboring rights"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|reproduction|distribution|use) (?:of this \\w+ )?(?:is|are)? ?(?:strictly )?prohibited"),
    ("all-rights-reserved", "rights reserved", "all rights reserved"),
    ("permission-required", "prior written", "without (?:the )?(?:express )?prior written (?:permission|consent)"),
)


@dataclass(frozen=True)
class Rule:
    """priority: 0 is best. Patterns match whole words only.

    Everything that a pattern matches holds the keyword and, if it is given, what also names.
    """

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    also: str = ""


def rules() -> list[Rule]:
    """All rules in their order: identifiers, passages and grants, names with version, names alone."""
    whole = r"(?<![^ ]){}(?![^ ])"
    made: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, priority: int, confidence: float, also: str = "") -> None:
        made.append(Rule(label, keyword, whole.format(f"(?:{pattern})"), priority, confidence, also))

    granted = (
        "(?:re)?(?:licensed|released|distributed|available|provided|published|covered|shared) under "
        "(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
    )
    version = "(?: (?:version |v )?(?:{}))"
    for label, keyword, name, numbers in _FAMILIES:
        tail = version.format(numbers) + "?" if numbers else ""
        add(label, keyword, f"spdx licen[sc]e identifier {name}{tail}(?: only| or later)?", 0, 1.0, "spdx licen")
    for label, keyword, passage in _PASSAGES:
        add(label, keyword, passage, 1, 0.9)
    for label, keyword, name, numbers in _FAMILIES:
        tail = version.format(numbers) + "?" if numbers else ""
        add(label, keyword, f"{granted}{name}(?: public)?(?: licen[sc]e)?{tail}(?: only| or (?:any )?later(?: version)?)?", 1, 0.95, " under ")
    for label, keyword, name, numbers in _FAMILIES:
        if numbers:
            add(label, keyword, f"{name}(?: licen[sc]e)?{version.format(numbers)}", 2, 0.8)
    for label, keyword, name, _ in _FAMILIES:
        add(label, keyword, f"{name} (?:international )?licen[sc]es?", 3, 0.7, "licen")
    return made


def _phrase(words: str) -> str:
    return rf"(?<!{_PART})" + f"{_APART}+".join(words.split()) + rf"(?!{_PART})"


def n_words(text: Column) -> Column:
    """Number of words of a text."""
    return F.regexp_count(text, F.lit(f"{_PART}++")).cast("long")


def written(text: Column) -> Column:
    """The lower-case words of a text with one space between them."""
    return F.trim(F.regexp_replace(F.lower(text), f"{_APART}++", " "))


def _running(items: Column, zero: Column, advance, emit, out_type: str) -> Column:
    """emit(state, item) of every item, where advance(state, item) carries a state of fixed size from item to item.

    Items go in blocks of about the root of their number, so an array that grows is never longer than that:
    the work is the number of items times its root, in one row without a shuffle.
    """

    def blocked(blocks: Column) -> Column:
        empty = F.array().cast(f"array<{out_type}>")
        whole = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("starts"))
        starts = F.aggregate(
            blocks, whole,
            lambda s, block: F.struct(
                F.aggregate(block, s["at"], advance).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")
            ),
            lambda s: s["starts"],
        )

        def inside(block: Column, start: Column) -> Column:
            return F.aggregate(
                block, F.struct(start.alias("at"), empty.alias("out")),
                lambda s, x: F.struct(
                    advance(s["at"], x).alias("at"), F.concat(s["out"], F.array(emit(s["at"], x)).cast(f"array<{out_type}>")).alias("out")
                ),
                lambda s: s["out"],
            )

        return F.flatten(F.zip_with(blocks, starts, inside))

    def cut(values: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(values))).cast("int")
        numbers = F.sequence(F.lit(0), F.ceil(F.size(values) / side).cast("int") - 1)
        return F.when(
            F.size(values) > 0, let(F.transform(numbers, lambda k: F.slice(values, k * side + 1, side)), blocked)
        ).otherwise(F.array().cast(f"array<{out_type}>"))

    return let(items, cut)


_PLACE = "struct<start:int,end:int,start_word:bigint,end_word:bigint>"


def _matches(words: Column, rule: Column) -> Column:
    """A rule's matches as (start, end) in characters of the written words, and (start_word, end_word) in words."""

    def sized(piece: Column, name: str) -> list[Column]:
        spaces = F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))
        return [F.length(piece).alias(f"{name}_chars"), spaces.cast("long").alias(f"{name}_words")]

    def located(hits: Column) -> Column:
        gaps = F.slice(F.split(words, rule["pattern"], -1), 1, F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda gap, hit: F.struct(*sized(gap, "gap"), *sized(hit, "hit")))
        return _running(
            pairs, F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("word")),
            lambda s, p: F.struct((s["at"] + p["gap_chars"] + p["hit_chars"]).alias("at"), (s["word"] + p["gap_words"] + p["hit_words"]).alias("word")),
            lambda s, p: F.struct(
                (s["at"] + p["gap_chars"]).alias("start"), (s["at"] + p["gap_chars"] + p["hit_chars"]).alias("end"),
                (s["word"] + p["gap_words"]).alias("start_word"), (s["word"] + p["gap_words"] + p["hit_words"] + 1).alias("end_word"),
            ),
            _PLACE,
        )

    return let(F.regexp_extract_all(words, rule["pattern"], F.lit(0)), located)


def detections(words: Column) -> Column:
    """What is left of all rules' matches in written words: array of (label, start_word, end_word, priority, confidence).

    start_word and end_word (exclusive) count words from 0.
    """
    kinds: dict[str, list[Column]] = {}
    for i, r in enumerate(rules()):
        one = F.struct(
            F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.label).alias("label"),
            F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(i).alias("rule"),
        )
        kinds.setdefault(r.also, []).append(one)
    none = F.array().cast("array<struct<keyword:string,pattern:string,label:string,priority:int,confidence:double,rule:int>>")
    table = F.concat(*(F.when(F.contains(words, F.lit(also)), F.array(*some)).otherwise(none) for also, some in kinds.items()))
    found = F.flatten(
        F.transform(
            F.filter(table, lambda r: F.contains(words, r["keyword"])),
            lambda r: F.transform(
                _matches(words, r),
                lambda m: F.struct(
                    m["start"].alias("start"), (-m["end"]).alias("minus_end"), r["priority"].alias("priority"),
                    r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence"),
                    m["start_word"].alias("start_word"), m["end_word"].alias("end_word"),
                ),
            ),
        )
    )
    # In order of start, longest first, every interval that contains another comes before it: one pass is enough.
    # ends[p] is the furthest end so far among intervals of priority p or better.
    levels = max(r.priority for r in rules()) + 1

    def advance(ends: Column, x: Column) -> Column:
        return F.transform(ends, lambda e, level: F.when(level >= x["priority"], F.greatest(e, -x["minus_end"])).otherwise(e))

    def emit(ends: Column, x: Column) -> Column:
        return F.struct(
            x["label"].alias("label"), x["start_word"].alias("start_word"), x["end_word"].alias("end_word"),
            x["priority"].alias("priority"), x["confidence"].alias("confidence"), (F.get(ends, x["priority"]) >= -x["minus_end"]).alias("inside"),
        )

    kept_type = "struct<label:string,start_word:bigint,end_word:bigint,priority:int,confidence:double,inside:boolean>"
    judged = _running(F.array_sort(found), F.array_repeat(F.lit(-1), levels), advance, emit, kept_type)
    return F.transform(
        F.filter(judged, lambda d: ~d["inside"]),
        lambda d: F.struct(*(d[n].alias(n) for n in ("label", "start_word", "end_word", "priority", "confidence"))),
    )


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, detections, labels and score.

    labels are arrays in ascending order. detections count start_word and end_word (exclusive) in
    words from 0. score is the best confidence left; a base phrase alone gives 0.6.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lower = F.lower(body)
    patterns = [_phrase(words) for words, _ in BASE_PHRASES]
    anyone = "|".join(patterns)
    count = sum((F.regexp_count(body, F.lit(f"(?i){p}")).cast("long") for p in patterns), F.lit(0).cast("long"))
    labels = F.array_compact(
        F.array(*(F.when(body.rlike(f"(?i){p}"), F.lit(label)) for p, (_, label) in zip(patterns, BASE_PHRASES, strict=True)))
    )
    before_first = F.substring(body, F.lit(1), F.regexp_instr(body, F.lit(f"(?i){anyone}")) - 1)
    before_last = F.regexp_extract(body, f"(?is)^(.*)(?:{anyone})", 1)
    base = F.when(
        F.contains(lower, F.lit("license")),
        F.struct(
            count.alias("n"), F.array_sort(labels).alias("labels"),
            F.when(count > 0, n_words(before_first)).alias("first"), F.when(count > 0, n_words(before_last)).alias("last"),
        ),
    )

    spans = let(written(body), detections)
    no_labels = F.array().cast("array<string>")
    mark = "__licenses"
    out = docs.withColumn(mark, F.struct(base.alias("base"), spans.alias("found"), n_words(body).alias("n")))
    found, base_labels = F.col(mark)["found"], F.coalesce(F.col(mark)["base"]["labels"], no_labels)
    n_base = F.coalesce(F.col(mark)["base"]["n"], F.lit(0).cast("long"))
    best = F.coalesce(F.array_max(F.transform(found, lambda d: d["confidence"])), F.lit(0.0))
    return out.withColumns(
        {
            "n_words": F.col(mark)["n"],
            "n_base": n_base,
            "first_word": F.col(mark)["base"]["first"],
            "last_word": F.col(mark)["base"]["last"],
            "base_labels": base_labels,
            "detections": found,
            "labels": F.array_sort(F.array_union(base_labels, F.transform(found, lambda d: d["label"]))),
            "score": F.greatest(best, F.when(n_base > 0, F.lit(0.6)).otherwise(F.lit(0.0))),
        }
    ).drop(mark)
