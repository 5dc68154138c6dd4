"""Fingerprints, license rules, mixing, packing, archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from scorelake.llm import licenses, mixing, packing, sketch, warc

ROWS = [
    (5, "a b c d e f g h i j", "s"), (4, None, None), (3, "", "s"), (3, "two\twords", "t"), (9, "a b c d e f g h i j", "s"),
    (None, "no id at all", "t"), (-7, "é😀 öß x y z w v", "s"), (5, "same id, other text", "s"), (5, "same id, other text", "s"),
    (1 << 60, "x " * 5000, "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)


def _sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return []
    n = min(5, len(words))
    hashes = [hashlib.md5(" ".join(words[i : i + n]).encode()).hexdigest() for i in range(len(words) - n + 1)]
    below = [h for h in hashes if h < "2"]
    return sorted({h[:12] for h in below or [min(hashes)]})


def _like(a, b):
    return 1.0 if not a and not b else len({*a} & {*b}) / len({*a} | {*b})


@pytest.mark.parametrize("block_rows", [4096, 1])
def test_fingerprints_equal_brute_force(spark, docs, monkeypatch, block_rows):
    monkeypatch.setattr(sketch, "BLOCK_ROWS", block_rows)
    got = sketch.compare_with_edit(docs.withColumn("sketch", F.lit(1)))
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for at, (doc_id, text, _) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = _sketch(text)
        want.append((doc_id, edited, "".join(own), _like(own, _sketch(edited)), _like(own, _sketch(following))))
    rows = [(r.doc_id, r.edited_text, "".join(r.sketch), r.near_edited, r.near_next) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert sketch.compare_with_edit(docs.where("false")).collect() == []


def test_blocks_of_ids_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BLOCK_ROWS", 50)
    far = [-(1 << 63), -(1 << 61), 1 << 45, (1 << 45) + 1, 1 << 60, (1 << 63) - 1, None]
    ids = [*range(3000), *(10**12 + 7 * i for i in range(1500)), *far, *[77] * 400]
    rows = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(5)
    blocks = {}
    for row in sketch.with_blocks(rows).collect():
        blocks.setdefault(row.block, []).append(row.doc_id)
    assert max(len(held) for held in blocks.values() if 77 not in held) <= 100 and len(blocks) < 700
    ranges = [blocks[b] for b in sorted(blocks)]
    assert ranges[0] == [None]
    assert all(max(one) < min(other) for one, other in zip(ranges[1:], ranges[2:], strict=False))
    order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
    want = sorted(((i, str(order[(at + 1) % len(order)])) for at, i in enumerate(order)), key=str)
    assert sorted(((r.doc_id, r.next_text) for r in sketch.with_next(rows).collect()), key=str) == want


def test_a_very_long_text_has_a_fingerprint(spark):
    text = " ".join(map(str, range(300_000)))
    row = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.sketch for r in sketch.fingerprints(row).collect()}
    assert got[1] == _sketch(text) and got[2] == []


def test_licenses_of_an_empty_table_and_a_long_text(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    text = "plain words " * 100_000 + "mit license"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_words == 200_002 and row.first_word == row.last_word == 200_000 and row.base_labels == ["mit"]


def test_sketches_merge(spark):
    long, short = " ".join(map(str, range(4000))), " ".join(map(str, range(1000, 1100)))
    row = spark.createDataFrame([(long, short)], "a string, b string").select(
        sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b")
    )
    got = row.select(sketch.containment(F.col("b"), F.col("a")), sketch.likeness(F.col("a"), F.col("b")), sketch.merged(F.col("a"), F.col("b")) == F.col("a")).first()
    assert got[0] == 1.0 and got[1] < 0.1 and got[2]
    assert sketch.fingerprints(spark.createDataFrame([("x", 1)], "text string, sketch int")).columns == ["text", "sketch", "fingerprint"]


def _base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        part = phrase.split()
        for i in range(len(words) - len(part) + 1):
            if words[i : i + len(part)] == part:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_license_base_equals_brute_force(spark):
    rng = random.Random(7)
    pieces = ["mit", "MIT", "License", "license", "licenses", "apache", "general", "public", "GNU", "é", "x1", "smit", "Łlicense", "K"]
    gaps = [" ", "\n", ", ", "-", "", "  ", "'", "/"]
    texts = ["".join(rng.choice(pieces) + rng.choice(gaps) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "MIT LICENSE mit license", "general public license " * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, N_BASE string").repartition(3)
    for r in licenses.scan(df).collect():
        n, n_base, first, last, labels = _base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, labels), texts[r.doc_id]
        assert set(labels) <= set(r.labels) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", ["mit"]),
        ("Licensed under the Apache License, Version 2.0.", ["apache"]),
        ("licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
        ("Licensed under the GNU Lesser General Public License v2.1", ["gpl", "lgpl"]),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 license", ["cc-by-nc-sa"]),
        ("SPDX-License-Identifier: GPL-3.0-or-later", ["gpl"]),
        ("the BSD 3-Clause license and the ISC license", ["bsd-3", "isc"]),
        ("All rights reserved.", ["all-rights-reserved"]),
        ("a license to submit", []),
        ("summit licenses", []),
    ],
)
def test_license_labels(spark, text, labels):
    assert licenses.scan(spark.createDataFrame([(text,)], "text string")).first().labels == labels


def test_license_labels_without_the_word(spark):
    """Notices without the word license, and line-wrapped ones."""
    want = {
        "Released under the GNU GPL v3.": ["gpl"],
        "available under CC BY-SA 4.0": ["cc-by-sa"],
        "available under Creative Commons BY 4.0": ["cc-by"],
        "Distributed under Apache 2.0": ["apache"],
        "Released under the Expat License.": ["mit"],
        "the X11 license": ["mit"],
        "Proprietary and confidential.": ["proprietary"],
        "Unauthorized copying of this file is strictly prohibited.": ["proprietary"],
        "without prior written permission": ["permission-required"],
        "released into the public\ndomain": ["public-domain"],
        "All rights\n * reserved": ["all-rights-reserved"],
    }
    rows = licenses.scan(spark.createDataFrame([(t,) for t in want], "text string")).collect()
    assert {r.text: r.labels for r in rows} == want and all(r.score >= 0.7 for r in rows)


def test_license_suppression(spark):
    """What is left equals a comparison of every two matches."""
    texts = [
        "licensed under the gnu general public license version 3 or later and the mit license",
        "under the terms of the gnu general public license as published by the free software foundation",
        "released under the mit license the mit license",
    ]
    rows = licenses.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        found = []
        for i, rule in enumerate(licenses.rules()):
            if rule.keyword in r.text:
                found += [(m.start(), m.end(), rule.priority, i, rule.label) for m in re.finditer(rule.pattern, r.text)]
        left = []
        for a in found:
            better = [
                b for b in found if b is not a and b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2] and (b[:2] != a[:2] or b[2:4] < a[2:4])
            ]
            if not better:
                left.append((a[4], len(r.text[: a[0]].split()), len(r.text[: a[1]].split())))
        assert sorted((d.label, d.start_word, d.end_word) for d in r.detections) == sorted(left)
        assert len(left) <= len(found)


def test_rules_are_many_and_distinct():
    made = licenses.rules()
    assert len({r.pattern for r in made}) == len(made) > 200 and all(0 < r.confidence <= 1 for r in made)


def _example(parsed, rng):
    """A text that a parsed pattern matches, with each choice at random."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "IN":
            kind, of = rng.choice(value)
            out += "w" if str(kind) == "CATEGORY" else chr(of if isinstance(of, int) else rng.randint(*of))
        elif name == "BRANCH":
            out += _example(rng.choice(value[1]), rng)
        elif name == "SUBPATTERN":
            out += _example(value[3], rng)
        elif name == "MAX_REPEAT":
            out += "".join(_example(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 1))))
        else:
            assert name == "ASSERT_NOT", name
    return out


def test_keywords_occur_in_all_that_patterns_match():
    rng = random.Random(3)
    for rule in licenses.rules():
        parsed = re._parser.parse(rule.pattern)
        for _ in range(300):
            text = _example(parsed, rng)
            assert re.fullmatch(rule.pattern, text) and rule.keyword in text and rule.also in text, (rule, text)


def _mixable(spark, n=400):
    rows = [(i, "w " * (1 + i % 9), "big" if i % 10 < 7 else ["s1", "s2", None][i % 3], "x") for i in range(n)]
    return spark.createDataFrame([*rows, (900, None, "big", "x"), (901, " ", "s9", "x"), (7, "w w", "big", "x"), (7, "w w", "big", "x")], "doc_id long, text string, source string, block string").repartition(3)


def test_mixture_keeps_everything_without_a_budget(spark):
    docs = _mixable(spark)
    rows = mixing.mix(docs, target="repetition", limit=2.0).collect()
    ids = Counter(r.doc_id for r in rows)
    assert set(ids) == {*range(400), 900, 901} and ids[900] == ids[901] == 1 and ids[7] == 4
    passes = {s: max(r["pass"] for r in rows if r.source == s) for s in ("big", "s1", "s2", None)}
    assert passes["big"] == 0 and max(passes.values()) == 1
    assert {r["pass"] for r in rows} == {0, 1}


def test_mixture_meets_its_budget_and_entropy(spark):
    docs = _mixable(spark, 3000)
    tokens = sum(1 + i % 9 for i in range(3000)) + 4
    out = mixing.mix(docs, target="entropy", limit=1.1, budget=1.5, blocks=8)
    assert [c.lower() for c in out.columns].count("block") == 1
    rows = out.where("n_tokens > 0").collect()
    by_source = Counter()
    for r in rows:
        by_source[r.source] += r.n_tokens
    total = sum(by_source.values())
    assert abs(total - 1.5 * tokens) <= 9 * len(by_source)
    entropy = -sum(c / total * math.log(c / total) for c in by_source.values())
    assert abs(entropy - 1.1) < 0.01
    for block in range(8):
        part = Counter()
        for r in rows:
            if r.block == block:
                part[r.source] += r.n_tokens
        assert all(abs(part[s] / sum(part.values()) - by_source[s] / total) < 0.03 for s in by_source)
    assert len({(r.slot, r.doc_id, r["pass"]) for r in rows}) >= len(rows) - 8


def test_mixture_of_nothing(spark):
    assert mixing.mix(_mixable(spark).where("false")).collect() == []
    assert mixing.mix(_mixable(spark).where("doc_id >= 900")).count() == 2


def _naive_pack(pieces, lengths):
    bins, where = [], []
    left = sum(pieces)
    for n in pieces:
        fits = [(room, order, b) for b, (room, order) in enumerate(bins) if room >= n]
        if fits:
            _, _, b = min(fits)
        else:
            bins.append((packing.opened(n, left, lengths, packing.OVERHEAD, packing.ATTENTION), 0))
            b = len(bins) - 1
        bins[b] = (bins[b][0] - n, len(where) + 1)
        where.append(b)
        left -= n
    return where


def test_packing_is_best_fit():
    rng = random.Random(3)
    for lengths in ((8, 16, 64), (512, 1024, 2048, 4096, 8192)):
        pieces = sorted((rng.randint(1, lengths[-1] // 2) for _ in range(400)), reverse=True)
        where, offsets, sizes = packing.pack_pieces(pieces, lengths)
        assert where == _naive_pack(pieces, lengths)
        used = Counter()
        for n, b, at in zip(pieces, where, offsets, strict=True):
            assert at == used[b]
            used[b] += n
        assert all(sizes[b] == min(c for c in lengths if c >= u) for b, u in used.items())


def test_packing_keeps_every_token(spark):
    rows = [(i, "w " * (i * 7 % 50)) for i in range(200)] + [(900, None), (901, "w " * 1000), (None, "w w"), (5, "w " * 35), (5, "w " * 35)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bin_id string").repartition(4)
    out = packing.pack(docs, lengths=(16, 64), shard_rows=50).collect()
    spans = {}
    for r in out:
        spans.setdefault((r.doc_id, r.copy), []).append(r)
    assert sum(sum(r.n_tokens for r in s) for s in spans.values()) == sum(len((t or "").split()) for _, t in rows)
    for pieces in spans.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
    assert len({c for d, c in spans if d == 5}) == 3
    bins = {}
    for r in out:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= parts[0].bin_length and len({r.bin_length for r in parts}) == 1
    assert packing.pack(docs.where("false")).collect() == []


def test_archives_round_trip(spark, tmp_path):
    pages = [(4, "http://a/\nb", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "u", None), (9, "u", ""), (None, "u", "<p>é</p>"), (11, "u", "x" * 300000), (2, "again", "<p>é</p>"), (12, "u", "short")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    folder = warc.qualified(spark, str(tmp_path / "archive"))
    index = warc.normalise(warc.write_archives(warc.with_revisits(df), folder), folder)
    rows = warc.read_records(index, folder).collect()
    assert len(rows) == len(pages) == index.count()
    firsts = {"<p>é</p>": 2, "": 7, "x" * 300000: 11, "short": 12}
    want = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        again = page_id != firsts[html or ""]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((page_id, len(payload), digest, "revisit" if again else "response", firsts[html or ""] if again else None, None if again else payload))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) or (b"" if r.record_type == "response" else None)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    system, base = pafs.FileSystem.from_uri("file://" + str(tmp_path / "archive"))
    for r in index.collect():  # every record is a member of its own
        with open(f"{base}/members/{r.file}", "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
    kept = {(r.page_id, r.refers_to) for r in warc.with_revisits(df, min_bytes=10**6).collect()}
    assert all(refers is None for _, refers in kept)


def test_normaliser_reads_any_members():
    records = [warc.record(i, "u", bytes([i]) * 2000, None, "2000-01-01T00:00:00Z") for i in range(1, 6)]
    for packed in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), gzip.compress(b"\r\n\r\n" + b"".join(records))):
        out = io.BytesIO()
        entries = list(warc.normalise_file(io.BytesIO(packed), out))
        assert len(entries) == 5
        for e, r in zip(entries, records, strict=True):
            assert gzip.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]]) == r
    with pytest.raises(ValueError):
        list(warc.normalise_file(io.BytesIO(gzip.compress(records[0][:-50])), io.BytesIO()))


def test_no_pages(spark, tmp_path):
    folder = warc.qualified(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([], "page_id long, url string, html string")
    index = warc.normalise(warc.write_archives(warc.with_revisits(df), folder), folder)
    assert warc.read_records(index, folder).collect() == []


def test_license_scan_of_many_matches_takes_little_time(spark):
    import time

    phrase = "This file is under the MIT License. Apache License 2.0 elsewhere; "
    texts = [(0, phrase * 10), (1, phrase * 4000), (2, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    licenses.scan(docs.where("doc_id = 0")).collect()
    start = time.perf_counter()
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert time.perf_counter() - start < 20
    few, many = got[0].detections, got[1].detections
    step = got[0].n_words // 10
    assert len(many) == 400 * len(few) and got[1].n_base == 8000 and got[2].detections == []
    for k in (0, 9, 1234, 3999):
        for i in range(len(few) // 10):
            a, b = few[i], many[k * (len(few) // 10) + i]
            assert (b.label, b.start_word - k * step, b.end_word - k * step) == (a.label, a.start_word, a.end_word)
    assert licenses.scan(docs.limit(0)).collect() == []
