"""Licence scan by sentences: known sentences get identifiers, and identifier sequences are matched with ordered rules.

1. Wrapped lines are joined.  Texts are cut into sentences at blank lines, list marks, around lines that begin or are a known
   sentence, and behind ``.``, ``!``, ``?`` and ``;`` before a blank or line break, but not before the clauses in ``GOES_ON``.
2. Sentences that hold one of the licence cues (every known sentence has one) are normalised: lower case, one blank for each run of characters other than
   letters, digits, ``.``, ``+`` and ``-``, no stop at the end.
3. A normalised sentence gets the identifier of the first sentence pattern that it matches as a whole, else ``unknown``.
4. The identifiers of a document, in order, form a sequence.  The rules are tried in their order; a rule that finds its
   identifiers one behind another reports its licence and takes them out, so later and more general rules do not see
   them.  What is left counts as unmatched.

All steps are column functions over single documents: no shuffle, no Python.  Sentence and rule tables are parameters.

No expression repeats a group, and none begins anew inside a run that it has read, so texts of a million line breaks or
stops neither exhaust the stack nor take quadratic time.

Defined cases: null, empty and blank texts have no sentences; a repeated licence is reported once, in order of the rules;
repeated rows and null ids are scanned like any other row; an empty table gives an empty result; other columns are
not looked at.

``sql()`` cuts at every line break and knows ``CUES`` and ``SENTENCES`` only, so it differs on wrapped notices.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sentence:
    """A known licence sentence: its identifier and a regular expression for its whole normalised form."""

    name: str
    pattern: str


@dataclass(frozen=True)
class Rule:
    """Identifiers that stand one behind another (a name ending with ``?`` may be missing), and what they mean."""

    licence: str
    sequence: tuple[str, ...]


CUES = ("licen", "copyright", "permission", "warrant", "redistribut", "rights reserved", "public domain", "spdx", "liab", "software is provided", "creative commons")

SENTENCES = (
    Sentence("spdx-apache-2.0", r"spdx-license-identifier apache-2.0"),
    Sentence("spdx-mit", r"spdx-license-identifier mit"),
    Sentence("spdx-gpl-3.0", r"spdx-license-identifier gpl-3.0(-only|-or-later|\+)?"),
    Sentence("spdx-gpl-2.0", r"spdx-license-identifier gpl-2.0(-only|-or-later|\+)?"),
    Sentence("spdx-bsd-3", r"spdx-license-identifier bsd-3-clause"),
    Sentence("copyright", r"(c |\(c\) )?copyright .*"),
    Sentence("rights-reserved", r"all rights reserved"),
    Sentence("spdx-lgpl", r"spdx-license-identifier lgpl-[0-9.]+(-only|-or-later|\+)?"),
    Sentence("spdx-agpl-3.0", r"spdx-license-identifier agpl-3.0(-only|-or-later|\+)?"),
    Sentence("spdx-mpl-2.0", r"spdx-license-identifier mpl-2.0"),
    Sentence("spdx-isc", r"spdx-license-identifier isc"),
    Sentence("spdx-epl-2.0", r"spdx-license-identifier epl-2.0"),
    Sentence("spdx-unlicense", r"spdx-license-identifier unlicense"),
    Sentence("lgpl-grant", r"this (work|program|software|file|document|library) is (licensed|distributed|released) under the (terms of the )?gnu (lesser|library) general public license.*"),
    Sentence("agpl-3-grant", r"this (work|program|software|file|document) is (licensed|distributed|released) under the (terms of the )?gnu affero general public license.*"),
    Sentence("lgpl-redistribute", r"you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license.*"),
    Sentence("agpl-redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license.*"),
    Sentence("mpl-2.0-grant", r"this source code form is subject to the terms of the mozilla public license (v. )?2.0.*"),
    Sentence("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    Sentence("epl-2.0-grant", r"this program and the accompanying materials are made available under the terms of the eclipse public license (v. )?2.0.*"),
    Sentence("unlicense", r"this is free and unencumbered software released into the public domain.*"),
    Sentence("apache-2.0-grant", r"(this (file|work|software|document) is )?licensed under the apache license version 2.0( the license )?.*"),
    Sentence("apache-2.0-compliance", r"you may not use this file except in compliance with the license"),
    Sentence("apache-2.0-obtain", r"you may obtain a copy of the license at.*"),
    Sentence("apache-2.0-as-is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    Sentence("apache-2.0-see", r"see the license for the specific language governing permissions and limitations under the license"),
    Sentence("gpl-3-grant", r"this (work|program|software|file|document) is (licensed|distributed|released) under the (terms of the )?gnu general public license (as published by the free software foundation )?(either )?version 3.*"),
    Sentence("gpl-2-grant", r"this (work|program|software|file|document) is (licensed|distributed|released) under the (terms of the )?gnu general public license (as published by the free software foundation )?(either )?version 2.*"),
    Sentence("gpl-redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    Sentence("gpl-no-warranty", r"this program is distributed in the hope that it will be useful but without any warranty.*"),
    Sentence("gpl-see", r"see the gnu general public license for more details"),
    Sentence("mit-reference", r"(this (work|software|file|document) is )?(released|licensed|distributed) under the (terms of the )?mit license"),
    Sentence("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy.*"),
    Sentence("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies.*"),
    Sentence("as-is", r"(the|this) software is provided as is.*"),
    Sentence("no-liability", r"in no event shall .* be liable.*"),
    Sentence("bsd-grant", r"redistribution and use in source and binary forms.*"),
    Sentence("bsd-source", r"(1. )?redistributions of source code must retain.*"),
    Sentence("bsd-binary", r"(2. )?redistributions in binary form must reproduce.*"),
    Sentence("bsd-endorse", r"(3. )?neither the name of .*"),
    Sentence("cc-by-nc-4.0", r"(this work is )?licensed under (a |the )?(cc|creative commons) (by-nc|attribution-noncommercial) 4.0.*"),
    Sentence("cc-by-sa-4.0", r"(this work is )?licensed under (a |the )?(cc|creative commons) (by-sa|attribution-sharealike) 4.0.*"),
    Sentence("cc-by-4.0", r"(this work is )?licensed under (a |the )?(cc|creative commons) (by|attribution) 4.0.*"),
    Sentence("cc0", r"(this work is )?(dedicated to|released into|in) the public domain.*"),
)

RULES = (
    Rule("Apache-2.0", ("apache-2.0-grant", "apache-2.0-compliance", "apache-2.0-obtain", "apache-2.0-as-is", "apache-2.0-see")),
    Rule("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability?")),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is?", "no-liability?")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "as-is?", "no-liability?")),
    Rule("GPL-3.0", ("gpl-3-grant", "gpl-no-warranty?", "gpl-see?")),
    Rule("GPL-2.0", ("gpl-2-grant", "gpl-no-warranty?", "gpl-see?")),
    Rule("GPL", ("gpl-redistribute", "gpl-no-warranty?", "gpl-see?")),
    Rule("LGPL", ("lgpl-grant",)),
    Rule("LGPL", ("lgpl-redistribute",)),
    Rule("AGPL-3.0", ("agpl-3-grant",)),
    Rule("AGPL-3.0", ("agpl-redistribute",)),
    Rule("MPL-2.0", ("mpl-2.0-grant",)),
    Rule("ISC", ("isc-grant", "as-is?", "no-liability?")),
    Rule("EPL-2.0", ("epl-2.0-grant",)),
    Rule("Unlicense", ("unlicense", "as-is?", "no-liability?")),
    Rule("LGPL", ("spdx-lgpl",)),
    Rule("AGPL-3.0", ("spdx-agpl-3.0",)),
    Rule("MPL-2.0", ("spdx-mpl-2.0",)),
    Rule("ISC", ("spdx-isc",)),
    Rule("EPL-2.0", ("spdx-epl-2.0",)),
    Rule("Unlicense", ("spdx-unlicense",)),
    Rule("Apache-2.0", ("apache-2.0-grant",)),
    Rule("Apache-2.0", ("spdx-apache-2.0",)),
    Rule("MIT", ("mit-reference",)),
    Rule("MIT", ("mit-grant", "mit-notice?")),
    Rule("MIT", ("spdx-mit",)),
    Rule("GPL-3.0", ("spdx-gpl-3.0",)),
    Rule("GPL-2.0", ("spdx-gpl-2.0",)),
    Rule("BSD-3-Clause", ("spdx-bsd-3",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-4.0",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-4.0",)),
    Rule("CC-BY-4.0", ("cc-by-4.0",)),
    Rule("CC0-1.0", ("cc0",)),
    Rule("All-Rights-Reserved", ("copyright?", "rights-reserved")),
)

BREAK = r"\n|[.!?;]+[ \t\r]+"
STRANGE = r"[^a-z0-9.+-]+"


WRAPPED_CUES = (*CUES, "neither the name of")
WRAPPED_SENTENCES = (
    Sentence("gpl-3-grant", r"([^.]{0,80} is free software )?you can redistribute it and or modify it under the terms of the gnu general public license (as published by the free software foundation )?(either )?version 3.*"),
    Sentence("gpl-2-grant", r"([^.]{0,80} is free software )?you can redistribute it and or modify it under the terms of the gnu general public license (as published by the free software foundation )?(either )?version 2.*"),
    Sentence("gpl-redistribute", r"[^.]{0,80} is free software you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    Sentence("lgpl-redistribute", r"[^.]{0,80} is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license.*"),
    Sentence("agpl-redistribute", r"[^.]{0,80} is free software you can redistribute it and or modify it under the terms of the gnu affero general public license.*"),
    Sentence("as-is", r"(the|this) software is provided by .* as is.*"),
    *SENTENCES,
)
GOES_ON = (r"2\.0", "nor the names", "either version", "without even the implied", "loss of use", "or business interruption", "you can redistribute it")
MARK = "\u0001"
RUN = r"[\n \t*#/]"


def _raw(pattern: str) -> str:
    """The fixed beginning of a sentence pattern, for lower-case text before it is normalised."""
    if "copyright .*" in pattern:
        return rf"(?:\(?c\)?{STRANGE})?copyright{STRANGE}(?!notice|holder|owner|law|licen|statement|and |or )"
    return pattern.split(".*")[0].replace(" ", STRANGE)


def _joined(text: Column) -> Column:
    """Text with ``MARK`` at the line breaks that end a sentence and a blank at all others."""
    known = "|".join(f"(?:{_raw(k.pattern)})" for k in WRAPPED_SENTENCES)
    closed = "|".join(f"(?:{_raw(k.pattern)})" for k in WRAPPED_SENTENCES if ".*" not in k.pattern)
    lead = r"[ \t]*(?:(?:\*|#+|//+)[ \t]*)?"
    t = F.regexp_replace(text, r"\r\n?", "\n")
    # a run of breaks, blanks and comment marks is read once, from its start, so long runs cost no more than their length
    t = F.regexp_replace(t, rf"(?<!{RUN})[ \t*#/]*+\n{RUN}*+(?=https?://)", "\n")
    t = F.regexp_replace(t, rf"(?m)(^{lead}|[.!?;][ \t]+)({closed})([^a-z0-9\n]*)$", f"$1$2$3{MARK}")
    t = F.regexp_replace(t, rf"\n(?={lead}(?:\n|$|(?:[0-9]+|\(?[a-z])[.)][ \t]|[-\u2022][ \t]|{known}))", MARK)
    return F.regexp_replace(t, rf"\n{lead}", " ")


def rule_pattern(rule: Rule) -> str:
    """A rule as a regular expression over a sequence written as ``<a><b><c>``."""
    parts = []
    for name in rule.sequence:
        plain = name.rstrip("?").replace(".", r"\.").replace("+", r"\+")
        parts.append(f"(<{plain}>)?" if name.endswith("?") else f"<{plain}>")
    return "".join(parts)


def _sentences(text: Column) -> Column:
    """Normalised sentences that hold a cue, in order."""
    def cued(s: Column) -> Column:
        found = F.lit(False)
        for cue in WRAPPED_CUES:
            found = found | s.contains(cue)
        return found

    ends = rf"{MARK}|:[ \t]+[*-][ \t]+|(?<=[.!?;])[ \t]++(?!(?:{'|'.join(GOES_ON)}))"
    plain = F.transform(F.split(_joined(text), ends), lambda s: F.rtrim(F.trim(F.regexp_replace(s, STRANGE, " ")), F.lit(". ")))
    return F.filter(plain, lambda s: (s != "") & cued(s))


def _identifier(s: Column) -> Column:
    found = None
    for known in WRAPPED_SENTENCES:
        matches = s.rlike(f"^(?:{known.pattern})$")
        found = F.when(matches, known.name) if found is None else found.when(matches, known.name)
    return found.otherwise("unknown")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_sentences, sequence, licences, n_unmatched) of every document."""
    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    # most texts have no cue at all; looking for one first saves cutting them up
    some = F.col("t").rlike("|".join(cue.replace(" ", STRANGE) for cue in WRAPPED_CUES))
    cut = lowered.select("doc_id", F.when(some, _sentences(F.col("t"))).otherwise(F.array().cast("array<string>")).alias("s"))
    named = cut.select("doc_id", F.transform("s", lambda s: F.concat(F.lit("<"), _identifier(s), F.lit(">"))).alias("ids"))
    state = named.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", "").alias("sequence"), F.array_join("ids", "").alias("r0"))
    found = []
    for i, rule in enumerate(rules):  # a rule looks at what the rules before it have left
        pattern = rule_pattern(rule)
        found.append(F.when(F.col(f"r{i}").rlike(pattern), rule.licence))
        state = state.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", pattern, "|"))
    licences = F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ", ")
    left = F.regexp_count(F.col(f"r{len(rules)}"), F.lit("<")).cast("long")
    return state.select("doc_id", "n_sentences", "sequence", licences.alias("licences"), left.alias("n_unmatched"))


def sql() -> str:
    """The same scan for DuckDB."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    cues = " OR ".join(f"contains(s, {quoted(c)})" for c in CUES)
    cases = " ".join(f"WHEN regexp_full_match(s, {quoted(k.pattern)}) THEN {quoted(k.name)}" for k in SENTENCES)
    steps, previous = [], "ids"
    for i, rule in enumerate(RULES):
        pattern = quoted(rule_pattern(rule))
        steps.append(
            f"x{i} AS (SELECT doc_id, n_sentences, sequence, regexp_replace(r, {pattern}, '|', 'g') AS r, "
            f"CASE WHEN regexp_matches(r, {pattern}) AND NOT list_contains(l, {quoted(rule.licence)}) THEN list_append(l, {quoted(rule.licence)}) ELSE l END AS l FROM {previous})"
        )
        previous = f"x{i}"
    return f"""
    WITH parts AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), {quoted(BREAK)}) AS p FROM documents),
    named AS (
      SELECT doc_id, list_transform(list_filter(list_transform(list_filter(p, lambda s: {cues}), lambda s: rtrim(trim(regexp_replace(s, {quoted(STRANGE)}, ' ', 'g')), '. ')), lambda s: s <> ''),
        lambda s: '<' || CASE {cases} ELSE 'unknown' END || '>') AS n FROM parts
    ),
    ids AS (SELECT doc_id, len(n)::BIGINT AS n_sentences, coalesce(array_to_string(n, ''), '') AS sequence, coalesce(array_to_string(n, ''), '') AS r, CAST([] AS VARCHAR[]) AS l FROM named),
    {", ".join(steps)}
    SELECT doc_id, n_sentences, sequence, coalesce(array_to_string(l, ', '), '') AS licences, (length(r) - length(replace(r, '<', '')))::BIGINT AS n_unmatched FROM {previous}
    """
