"""Licence recognition by sentences and ordered rules.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences: identifier and pattern of the whole normalised sentence (fixed
#: values, public licence wordings).  A version is part of the sentence.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("ApacheGrant", r"(this (work|file|software|project) is )?licensed under the apache license,? version 2 0( the license)?"),
    ("ApacheComply", r"you may not use this file except in compliance with the license"),
    ("ApacheUrl", r"you may obtain a copy of the license at .*apache org licenses license-2 0"),
    ("MitGrant", r"(this (work|file|software|project) is )?(released|licensed|distributed|available) under the (terms of the )?mit license"),
    ("MitPermission", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software.*"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies.*"),
    ("BsdGrant", r"(this (work|file|software|project) is )?(released|licensed|distributed) under the ([23]-clause )?bsd license"),
    ("BsdRedistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted.*"),
    ("BsdEndorse", r"neither the name of .* may be used to endorse or promote products.*"),
    ("GplGrant3", r"(this (work|program|file|software|project) is )?(released|licensed|distributed) under (the terms of )?the gnu general public license,? version 3"),
    ("GplGrant2", r"(this (work|program|file|software|project) is )?(released|licensed|distributed) under (the terms of )?the gnu general public license,? version 2"),
    ("GplFree", r"this program is free software.*redistribute it and/or modify it under the terms of the gnu general public license.*"),
    ("LgplGrant", r"(this (work|library|software) is )?(released|licensed|distributed) under (the terms of )?the gnu lesser general public license.*"),
    ("LaterVersion", r"either version [23] of the license, or (\(at your option\) )?any later version"),
    ("MplGrant", r"this source code form is subject to the terms of the mozilla public license, v 2 0"),
    ("CcByNcSa", r"(this (work|text) is )?licensed under (a )?cc[ -]by-nc-sa( [1-4] 0)?"),
    ("CcByNc", r"(this (work|text) is )?licensed under (a )?cc[ -]by-nc( [1-4] 0)?"),
    ("CcBySa", r"(this (work|text) is )?licensed under (a )?cc[ -]by-sa( [1-4] 0)?"),
    ("CcBy", r"(this (work|text) is )?licensed under (a )?cc[ -]by( [1-4] 0)?"),
    ("Cc0", r"(this (work|text) is )?(released|licensed) under (the )?cc0( 1 0)?"),
    ("PublicDomain", r"(this (work|text|file) is )?(released|placed) (in|into) the public domain"),
    ("AllRights", r"(copyright .* )?all rights reserved"),
    ("NoWarranty", r"(the software|this software|this program) is (provided|distributed) .*without (any )?warranty.*"),
)

#: Ordered licence rules: name and the identifiers that have to follow each other.  An earlier
#: rule takes its sentences away from the later ones (fixed values).
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("GPL-3.0-or-later", ("GplGrant3", "LaterVersion")),
    ("GPL-2.0-or-later", ("GplGrant2", "LaterVersion")),
    ("GPL-or-later", ("GplFree", "LaterVersion")),
    ("GPL-3.0-only", ("GplGrant3",)),
    ("GPL-2.0-only", ("GplGrant2",)),
    ("GPL", ("GplFree",)),
    ("LGPL", ("LgplGrant",)),
    ("Apache-2.0", ("ApacheGrant", "ApacheComply", "ApacheUrl")),
    ("Apache-2.0", ("ApacheGrant",)),
    ("Apache-2.0", ("ApacheUrl",)),
    ("MIT", ("MitPermission", "MitNotice")),
    ("MIT", ("MitGrant",)),
    ("MIT", ("MitPermission",)),
    ("BSD-3-Clause", ("BsdRedistribution", "BsdEndorse")),
    ("BSD", ("BsdGrant",)),
    ("BSD", ("BsdRedistribution",)),
    ("MPL-2.0", ("MplGrant",)),
    ("CC-BY-NC-SA", ("CcByNcSa",)),
    ("CC-BY-NC", ("CcByNc",)),
    ("CC-BY-SA", ("CcBySa",)),
    ("CC-BY", ("CcBy",)),
    ("CC0", ("Cc0",)),
    ("PublicDomain", ("PublicDomain",)),
    ("Proprietary", ("AllRights",)),
)

#: A sentence without one of these words is none of a licence; it is looked at no further.
CRITICAL = "licens|copyright|permission|redistribut|warrant|public domain|any later version|endorse|under cc|under the cc|under a cc|all rights|apache"
#: What follows a version's "v." is no end of a sentence; nor is a ';' inside the GNU grants.
#: A line that opens a grant of its own starts a sentence, so the one before it takes no more.
GRANT_LINE = (
    r"\n(?=[ \t]*(?i:this (?:work|text|file|software|project|program|library) is (?:released|licensed|placed) "
    r"|licensed under (?:an? |the )?(?:terms of the )?(?:cc|creative commons|mit|bsd|apache|gnu|mozilla)\b"
    r"|permission is hereby granted|redistribution and use in source))"
)
SENTENCE_END = GRANT_LINE + r"|\n\s*\n|(?<!\b[vV])[.!?]+(?=\s|$)|(?<!(?i:free software));+(?=\s|$)(?!\s+(?i:(?:either )?version \d))"
#: Comment marks before and after the words of a line.
LINE_START = r"(?m)^[ \t]*(?:(?://+!?|/?\*+/?|#+|;+|--+|%+|>+|<!--|\|+|(?i:dnl|rem)(?=[ \t]))[ \t]*)+"
LINE_END = r"(?m)[ \t]*(?:\*+/|-->|[*#|]+)[ \t]*$"
#: Marks that count as a space.
MARKS = r"[#*<>\"'`=_|/(){}\[\];,“”‘’\u0001\u0002]+"

_FREE = (
    r"(\S+ ){1,8}is free software you (can|may) redistribute it and or modify it under the terms of "
    r"(version \d of )?the gnu KIND( version \d( \d)?)?( only)?( as published by the free software foundation)?"
)
_LATER = r" (either )?version NUMBER of the license or( at your option)? any later version"


def _free(kind: str, end: str = "", number: str = "") -> str:
    return (_FREE + end).replace("KIND", kind).replace("NUMBER", number)


_CC = r"(this (work|text|file) is )?licensed under (a|the) creative commons KIND( [1-4] 0)?( international| unported| generic)?( public)? license.*"

#: Sentences of whole public notices that the table above has not, in the same form but
#: without brackets, commas and slashes.  They go before those above.
NOTICES: tuple[tuple[str, str], ...] = (
    ("LgplLater3", _free("(lesser|library) general public license", _LATER, "3")),
    ("LgplLater2", _free("(lesser|library) general public license", _LATER, "2( 1)?")),
    ("LgplFree", _free("(lesser|library) general public license") + ".*"),
    ("AgplLater3", _free("affero general public license", _LATER, "3")),
    ("AgplFree", _free("affero general public license") + ".*"),
    ("GplLater3", _free("general public license", _LATER, "3")),
    ("GplLater2", _free("general public license", _LATER, "2")),
    ("GplOnly3", _FREE.replace("KIND( version \\d( \\d)?)?", "general public license( version 3| v3)") + "|" + _free("general public license", " version 3 of the license")),
    ("GplOnly2", _FREE.replace("KIND( version \\d( \\d)?)?", "general public license( version 2| v2)") + "|" + _free("general public license", " version 2 of the license")),
    ("GplFree", _free("general public license") + ".*"),
    ("GplDetails", r"see the gnu (\w+ )?general public license for more details"),
    ("GplCopy", r"you should have received a copy of the gnu (\w+ )?general public license.*|if not see .*gnu org licenses.*"),
    ("ApacheGrant", r"(the )?(\S+ ){1,6}licenses this file to you under the apache license version 2 0( the license)?"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice.*"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdEndorse", r"(neither )?the names? of .* may (not )?be used to endorse or promote products.*"),
    ("NoWarranty", r"this software is provided by .*as is and any express or implied warranties.*|without even the implied warranty of .*"),
    ("NoLiability", r"in no event shall the .*liable.*"),
    ("CcByNcSa", _CC.replace("KIND", "attribution-noncommercial-sharealike")),
    ("CcByNc", _CC.replace("KIND", "attribution-noncommercial")),
    ("CcBySa", _CC.replace("KIND", "attribution-sharealike")),
    ("CcBy", _CC.replace("KIND", "attribution")),
    ("Cc0", r"to the extent possible under law .*waived all copyright and related or neighboring rights.*"),
    ("PublicDomain", r"this is free and unencumbered software released into the public domain"),
)

#: SPDX short identifiers (lower case, dots as spaces) and licence names.
SPDX: tuple[tuple[str, str], ...] = (
    ("apache-2 0", "Apache-2.0"),
    ("mit", "MIT"),
    ("bsd-2-clause", "BSD-2-Clause"),
    ("bsd-3-clause", "BSD-3-Clause"),
    ("gpl-2 0(-only)?", "GPL-2.0-only"),
    (r"gpl-2 0(-or-later|\+)", "GPL-2.0-or-later"),
    ("gpl-3 0(-only)?", "GPL-3.0-only"),
    (r"gpl-3 0(-or-later|\+)", "GPL-3.0-or-later"),
    (r"lgpl-[23] [01](-only)?", "LGPL"),
    (r"lgpl-2 [01](-or-later|\+)", "LGPL-2.1-or-later"),
    (r"lgpl-3 0(-or-later|\+)", "LGPL-3.0-or-later"),
    ("agpl-3 0(-only)?", "AGPL"),
    (r"agpl-3 0(-or-later|\+)", "AGPL-3.0-or-later"),
    ("mpl-2 0", "MPL-2.0"),
    ("cc-by-nc-sa-[1-4] [05]", "CC-BY-NC-SA"),
    ("cc-by-nc-[1-4] [05]", "CC-BY-NC"),
    ("cc-by-sa-[1-4] [05]", "CC-BY-SA"),
    ("cc-by-[1-4] [05]", "CC-BY"),
    ("cc0-1 0", "CC0"),
    ("unlicense", "PublicDomain"),
)

#: Rules of the sentences that only whole notices have; they go before those above.
NOTICE_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("LGPL-3.0-or-later", ("LgplLater3",)),
    ("LGPL-2.1-or-later", ("LgplLater2",)),
    ("LGPL", ("LgplFree",)),
    ("AGPL-3.0-or-later", ("AgplLater3",)),
    ("AGPL", ("AgplFree",)),
    ("GPL-3.0-or-later", ("GplLater3",)),
    ("GPL-2.0-or-later", ("GplLater2",)),
    ("GPL-3.0-only", ("GplOnly3",)),
    ("GPL-2.0-only", ("GplOnly2",)),
    ("Apache-2.0", ("ApacheGrant", "ApacheComply", "ApacheUrl", "ApacheAsIs", "ApacheSee")),
    ("BSD-3-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary")),
    *((name, (f"Spdx{i}",)) for i, (_, name) in enumerate(SPDX)),
)


def _plain(pattern: str) -> str:
    """A pattern of ``SENTENCES`` for text whose brackets, commas and slashes are spaces."""
    for old, new in ((r"\(", ""), (r"\)", ""), (",?", ""), (",", ""), ("/", " "), ("[ -]", "(?: |-)")):
        pattern = pattern.replace(old, new)
    return pattern


def known_sentences() -> list[tuple[str, str]]:
    """Identifier and pattern of every known sentence, in the order they are tried."""
    short = [(f"Spdx{i}", f"spdx-license-identifier {p}") for i, (p, _) in enumerate(SPDX)]
    return [*short, *NOTICES, *((name, _plain(p)) for name, p in SENTENCES)]


def unwrapped(text: Column) -> Column:
    """Lines without comment marks; a URL set off by a blank line belongs to what comes before;
    an SPDX line stands alone."""
    for pattern, new in (
        (r"\r\n?", "\n"),
        (LINE_END, ""),
        (LINE_START, ""),
        (r"(?<![.!?;\s])[ \t]*\n\s*\n[ \t]*(?=https?://)", "\n"),
        (r"-\n[ \t]*(?=\p{L})", "-"),
        (r"(?im)^.*(SPDX-License-Identifier:.*)$", "\n\n$1\n\n"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return text


def normalise(sentence: Column) -> Column:
    """Lower case, marks and single stops as spaces, white space as one space; line breaks stay."""
    plain = F.regexp_replace(F.lower(sentence), MARKS, " ")
    plain = F.regexp_replace(plain, r"(?:[.:]|[^\S\n])+", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def critical(text: Column) -> Column:
    return F.lower(text).rlike(CRITICAL.replace(" ", r"\s+"))


def sentences(text: Column) -> Column:
    """Normalised sentences of a text that hold a critical word, in order; an SPDX expression
    is one for each identifier in it."""
    parts = F.transform(F.filter(F.split(unwrapped(text), SENTENCE_END), critical), normalise)
    spdx = "spdx-license-identifier "
    return F.flatten(
        F.transform(
            parts,
            lambda s: F.when(
                s.startswith(spdx),
                F.transform(
                    F.split(F.regexp_replace(F.substr(s, F.lit(len(spdx) + 1)), r" with \S+", ""), " (?:or|and) "),
                    lambda x: F.concat(F.lit(spdx), F.trim(x)),
                ),
            ).otherwise(F.array(s)),
        )
    )


def identifiers(sentence: Column) -> Column:
    """Identifiers of the known sentences in a normalised one, in order; '' for critical words
    that belong to none.

    A known sentence starts and ends with a line (of any number), so a heading or a name without
    a stop before it does not hide it.
    """
    for name, pattern in known_sentences():
        wrapped = pattern.replace(" ", r"[ \n]")
        sentence = F.regexp_replace(sentence, rf"(?s)(?<![^\n])(?:{wrapped})(?![^\n])", f"\x01\x02{name}\x01")
    parts = F.filter(F.split(sentence, "\x01"), lambda p: p.startswith("\x02") | critical(p))
    return F.transform(parts, lambda p: F.when(p.startswith("\x02"), F.substr(p, F.lit(2))).otherwise(F.lit("")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_sentences`` (those with a critical word),
    ``identifiers`` (known ones in order, each in commas), ``n_unknown`` (critical sentences
    that are not known), ``licenses`` (names in rule order, joined by ``+``) and ``n_unmatched``
    (identifiers that no rule took).

    Wrapped lines are joined: a sentence ends at a stop or a blank line, and comment marks go.
    A known sentence keeps its place among unknown ones: rules need neighbours in the sequence
    of known identifiers.  A null text has no sentences.  A projection: no shuffle, no row count
    to bound, and texts without a critical word are passed over by one search.
    """
    text = F.col(text_col)
    # line breaks and comment marks may lie between the words
    worth = F.coalesce(F.lower(text).rlike(CRITICAL.replace(" ", r"\W+")), F.lit(False))
    none = F.expr("cast(array() as array<string>)")
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(worth, F.flatten(F.transform(sentences(text), identifiers))).otherwise(none).alias("all"),
    )
    known = found.select(
        "doc_id",
        F.size("all").cast("long").alias("n_sentences"),
        F.filter("all", lambda i: i != "").alias("known"),
    ).select(
        "doc_id",
        "n_sentences",
        (F.col("n_sentences") - F.size("known")).alias("n_unknown"),
        F.concat(F.array_join(F.transform("known", lambda i: F.concat(F.lit(","), i, F.lit(","))), "")).alias(
            "identifiers"
        ),
    )
    return known.select("doc_id", "n_sentences", "n_unknown", "identifiers", *_apply_rules("identifiers"))


def _apply_rules(column: str) -> list[Column]:
    """Licence names, and the number of identifiers left, of a sequence such as ``,A,,B,``."""
    start = F.struct(F.col(column).alias("left"), F.lit("").alias("names"))
    rules = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in ids)).alias("ids"))
            for name, ids in NOTICE_RULES + RULES
        ]
    )
    done = F.aggregate(
        rules,
        start,
        lambda acc, rule: F.when(
            F.contains(acc["left"], rule["ids"]),
            F.struct(
                F.replace(acc["left"], rule["ids"], F.lit("")).alias("left"),
                F.when(F.contains(F.concat(F.lit("+"), acc["names"], F.lit("+")), F.concat(F.lit("+"), rule["name"], F.lit("+"))), acc["names"])
                .when(acc["names"] == "", rule["name"])
                .otherwise(F.concat(acc["names"], F.lit("+"), rule["name"]))
                .alias("names"),
            ),
        ).otherwise(acc),
    )
    out = F.when(F.col(column) == "", start).otherwise(done)
    left = F.length(out["left"]) - F.length(F.replace(out["left"], F.lit(","), F.lit("")))
    return [out["names"].alias("licenses"), (left / 2).cast("long").alias("n_unmatched")]


def oracle() -> str:
    """The scan of notices that lie on one line each as DuckDB SQL, from ``SENTENCES`` and ``RULES``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(
        f"WHEN regexp_full_match(s, {quoted(p)}) THEN {quoted(n)}" for n, p in SENTENCES
    )
    steps = []
    for i, (name, ids) in enumerate(RULES):
        key = "".join(f",{x}," for x in ids)
        steps.append(
            f"r{i + 1} AS (SELECT doc_id, n_sentences, n_unknown, identifiers, "
            f"replace(rest, {quoted(key)}, '') AS rest, CASE WHEN contains(rest, {quoted(key)}) "
            f"AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) "
            f"ELSE names END AS names FROM r{i})"
        )
    return f"""
WITH parts AS (
  SELECT doc_id, text, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''),
    '[.;!?]+(\\s|$)', chr(10) || '\\1', 'g'), '[\\n\\r]+')) AS raw,
    generate_subscripts(regexp_split_to_array(regexp_replace(coalesce(text, ''),
    '[.;!?]+(\\s|$)', chr(10) || '\\1', 'g'), '[\\n\\r]+'), 1) AS pos FROM documents
), critical AS (
  SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(raw), '[#*<>"''`=_|]+|//+', ' ', 'g'),
    '[.:\\s]+', ' ', 'g')) AS s FROM parts WHERE regexp_matches(lower(raw), {quoted(CRITICAL)})
), named AS (SELECT doc_id, pos, CASE {cases} ELSE '' END AS i FROM critical),
grouped AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (i = '') AS unknown,
    coalesce(string_agg(',' || i || ',', '' ORDER BY pos) FILTER (i <> ''), '') AS ids
  FROM named GROUP BY doc_id
), r0 AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(unknown, 0) AS n_unknown,
    coalesce(ids, '') AS identifiers, coalesce(ids, '') AS rest, CAST([] AS VARCHAR[]) AS names
  FROM documents d LEFT JOIN grouped USING (doc_id)
), {", ".join(steps)}
SELECT doc_id, n_sentences, n_unknown, identifiers, coalesce(array_to_string(names, '+'), '') AS licenses,
  CAST((length(rest) - length(replace(rest, ',', ''))) / 2 AS BIGINT) AS n_unmatched FROM r{len(RULES)}
"""
