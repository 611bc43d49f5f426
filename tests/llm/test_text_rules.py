import random
import textwrap
import time

from siteweave.llm import decontam, licenses, quality
from tests.llm import plain

SCHEMA = "doc_id long, text string, n_words long, fail_bits string"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of the hunters in this very long sentence today", 0, ""),
    (2, "one two three four five six seven eight " * 6, 0, ""), (3, None, 0, ""), (4, "", 0, ""), (5, " \t\r\n\x0b\x0c", 0, ""),
    (6, "a line\nsame\n\nsame\n \nsame \n#*$ %&|<>", 0, ""), (7, "é" * 400 + " über", 0, ""), (7, "é" * 400 + " über", 0, ""), (None, "x", 0, ""),
    (8, "w " * 30_000, 0, ""), (9, " ".join(f"v{i}" for i in range(5000)), 0, ""), (10, "## " * 40, 0, ""),
]


def test_measures(spark):
    df = quality.report(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df)
    assert got == sorted((str(r[0]), *plain.quality(r[1])) for r in ROWS)
    for r in df:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert {r.doc_id for r in df if r.kept} == {1, 9}
    assert quality.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_regular_lines(spark):
    """Thue-Morse words, whose polynomial hashes modulo 2**64 are equal, are different lines."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    text = "\n".join((word, word.translate(str.maketrans("ab", "ba")), word[:1024], word[1024:], word))
    row = quality.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_dup_lines == 1


def test_policies_and_ablation(spark):
    entries = quality.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).cache()
    rows = quality.judged(entries).collect()
    for policy in quality.POLICIES:
        mask = quality.mask_of(policy.name)
        kept = [r for r in rows if not r.fail_bits & mask]
        assert len(kept) == sum(r["kept_" + policy.name.replace("-", "_")] for r in rows)
        table = {r.rule: r for r in quality.ablation(entries, policy.name).collect()}
        for rule in quality.RULES:
            if mask >> rule.bit & 1:
                without = mask & ~(1 << rule.bit)
                failed = [r for r in rows if r.fail_bits >> rule.bit & 1]
                r = table.get(rule.name)
                assert (r.failed, r.only_this, r.kept_without) == (len(failed), sum(not x.fail_bits & without for x in failed), sum(not x.fail_bits & without for x in rows))
    entries.unpersist()


def test_licences(spark):
    apache = ("Copyright 2020 Someone. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
              "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 \nUnless required by applicable law or agreed to in writing, software distributed under "
              "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES. See the License for the specific language governing permissions and limitations under the License.")
    rows = [
        (1, apache, 0, ""), (2, "Some words. Released under the MIT License.", 0, ""), (3, "Licensed under CC BY-NC 4.0.\nThen more.", 0, ""),
        (4, "This work is licensed under the GNU General Public License, version 3.", 0, ""), (5, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License. All rights reserved.", 0, ""),
        (6, "You need a driving licence; a fishing license too.", 0, ""), (7, None, 0, ""), (8, "", 0, ""), (9, "no cue here", 0, ""), (None, "x\n" * 2000 + "All rights reserved.", 0, ""),
    ]
    got = {r.doc_id: (r.licences, r.n_unmatched) for r in licenses.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("Apache-2.0", 1), 2: ("MIT", 0), 3: ("CC-BY-NC-4.0", 0), 4: ("GPL-3.0", 0), 5: ("Apache-2.0, MIT, All-Rights-Reserved", 0), 6: ("", 2), 7: ("", 0), 8: ("", 0), 9: ("", 0), None: ("All-Rights-Reserved", 0)}
    assert licenses.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_decontamination(spark):
    item = " ".join(f"q{i}" for i in range(40))
    words = item.split()
    near = " ".join([*words[:38], "changed", "end"])
    far = " ".join(w if i % 5 else "x" for i, w in enumerate(words))
    items = [(0, item, "b"), (1, "a b a b a b a b a b a b", "b"), (2, "tiny item", "b"), (3, "", "b"), (4, None, "b"), (5, item, "b")]
    docs = [
        (1, "before it " + item + " behind it", 0, ""), (2, "so " * 50 + near, 0, ""), (3, far, 0, ""), (4, " ".join(words[:20]), 0, ""), (5, None, 0, ""), (6, "", 0, ""),
        (7, "a b " * 30, 0, ""), (8, "one TINY\tItem here", 0, ""), (9, item.upper(), 0, ""), (10, "word " * 20_000 + near, 0, ""), (11, "clean text with nothing in it at all", 0, ""),
    ]
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontam.report(
        spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string, extra string")).collect()}
    want = {k: (round(s, 9), at) for k, (s, at) in plain.benchmark_hits([d[:2] for d in docs], [i[:2] for i in items]).items()}
    assert got == want and {d for d, _ in want} == {1, 2, 7, 8, 9, 10}
    kept = decontam.documents_kept(spark.createDataFrame([*docs, docs[0], (None, item, 0, "")], SCHEMA), spark.createDataFrame(items, "item_id long, text string, extra string"))
    assert kept.columns == ["doc_id", "text", "n_words", "fail_bits"] and {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {d for d, _ in want}
    nothing = spark.createDataFrame([], "item_id long, text string, extra string")
    assert decontam.report(spark.createDataFrame(docs, SCHEMA), nothing).collect() == []


def test_decontamination_of_repetitive_texts(spark):
    """A long text of two words takes time in proportion to its length; of windows with repeated shingles at least 0.9 are found, and nothing else."""
    rng = random.Random(5)
    phrases = [" ".join(f"p{i}x{j}" for j in range(6)) for i in range(30)]
    items = [(i, " ".join(rng.choice(phrases[i % 10 * 3:i % 10 * 3 + 3]) for _ in range(rng.randrange(4, 14))), "b") for i in range(16)]
    docs = []
    for n, (i, text, _) in enumerate(items * 3):
        words = text.split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = "z"
        filler = " ".join(rng.choice("abcdefgh") for _ in range(1_020 if n == 20 else rng.choice([0, 3, 30])))
        docs.append((n, f"{filler} {' '.join(words)} tail", 0, ""))
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in decontam.report(
        spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(items, "item_id long, text string, extra string")).collect()}
    want = {k: (round(s, 9), at) for k, (s, at) in plain.benchmark_hits([d[:2] for d in docs], [i[:2] for i in items]).items()}
    assert set(got) <= set(want) and len(want) > 20
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want)

    long = spark.createDataFrame([(1, "a b " * 100_000, 0, "")], SCHEMA)
    began = time.monotonic()
    found = decontam.report(long, spark.createDataFrame([(0, "a b " * 50, "b")], "item_id long, text string, extra string")).collect()
    assert [(r.doc_id, r.start_word, r.n_words, r.similarity) for r in found] == [(1, 0, 100, 1.0)]
    assert time.monotonic() - began < 120


def test_documents_shorter_than_the_item(spark):
    items = [(n, " ".join(f"{n}w{i}" for i in range(n)), "b") for n in (9, 16, 30, 50)]
    items += [(100 + n, text + " tail", "b") for n, text, _ in items] + [(200, "a b c d " * 10 + "e", "b")]
    docs = [(1000 * n + m, " ".join(text.split()[at:at + m]), 0, "") for n, text, _ in items for m in range(3, len(text.split())) for at in (0, 1)]
    docs += [(-1, "clean", 0, ""), (-2, "a b c d e", 0, ""), (-3, None, 0, "")]
    docs = list({d[0]: d for d in docs}.values())
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.n_words) for r in decontam.report(
        spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string, extra string")).collect()}
    sizes = {d[0]: len((d[1] or "").split()) for d in docs}, {i[0]: len(i[1].split()) for i in items}
    want = {k: (round(s, 9), at, m) for k, (s, at, m) in plain.short_document_hits([d[:2] for d in docs], [i[:2] for i in items]).items()}
    assert {k: v for k, v in got.items() if sizes[0][k[0]] < sizes[1][k[1]]} == want
    assert {d for d, i in want if i == 50} >= {50_000 + m for m in range(41, 50)} and (30_025, 30) in want and (16_014, 16) in want and (9_008, 9) in want


BSD = """Copyright 2008, Google Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

    * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
    * Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES."""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def test_wrapped_licences(spark):
    texts = [(BSD, "BSD-3-Clause, All-Rights-Reserved"), (GPL.format(":", ",", 3), "GPL-3.0"), (GPL.format(";", ";", 2), "GPL-2.0"), (MIT, "MIT"), (APACHE, "Apache-2.0")]
    rows, want = [], {}
    for n, (text, licence) in enumerate(texts):
        for width in (20, 33, 50, 66, 72, 79, 100, 10_000):
            for m, mark in enumerate(("", "# ", "// ")):
                lines = [line for part in text.split("\n") for line in (textwrap.wrap(part, width, break_on_hyphens=False) or [""])]
                key = n * 1_000_000 + width * 10 + m
                rows.append((key, "\n".join((mark + line).rstrip() for line in lines), 0, ""))
                want[key] = (licence, 0)
        rows.append((-n - 1, " ".join(text.split()), 0, ""))
        want[-n - 1] = (licence, 0)
    got = {r.doc_id: (r.licences, r.n_unmatched) for r in licenses.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v for k, v in got.items() if v[0] != want[k][0]} == {}
    rows = [(1, "Title\nReleased under the MIT License\nmore", 0, ""), (2, "put in the public\ndomain. Dedicated to the public\ndomain", 0, "")]
    got = {r.doc_id: r.licences for r in licenses.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "MIT", 2: "CC0-1.0"}


def test_more_licences_and_junk(spark):
    texts = {
        1: ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the FSF.", "LGPL"),
        2: ("Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published.", "AGPL-3.0"),
        3: ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        4: ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "ISC"),
        5: ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        6: ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    }
    rows = [(i, t, 0, "") for i, (t, _) in texts.items()] + [(1, texts[1][0], 0, "")]
    junk = ["\n" * 1_000_000, "." * 1_000_000, ". " * 300_000, " " * 1_000_000, "\n * " * 200_000, "# \n" * 200_000, "all rights\n" * 50_000, "/" * 1_000_000, "the " * 200_000, ";\t" * 200_000]
    rows += [(100 + i, "Copyright 2020 me. " + j + "\nAll rights reserved.", 0, "") for i, j in enumerate(junk)]
    found = licenses.report(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()
    assert len(found) == 7 + len(junk)
    got = {r.doc_id: r.licences for r in found}
    assert {i: got[i] for i in texts} == {i: name for i, (_, name) in texts.items()}
    assert {got[100 + i] for i in range(len(junk))} == {"All-Rights-Reserved"}
