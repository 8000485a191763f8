"""License recognition by sentences and ordered rules, in built-in functions only.

A text is cut into sentences; each sentence is normalised (letters, digits, ``.`` and ``+``
in single spaces, A-Z lowered, comment marks removed) and looked up among known licence
sentences. The identifiers found, in order, are then matched against ordered rules: the first
rule whose identifiers stand in a row names a licence and uses them up.

Everything is a row-local expression (higher-order functions over one row's sentences): no
shuffle, no Python, and texts without a licence word skip all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: licence names as they are written, by SPDX identifier ----------------
NAMES = {
    "MIT": ["the mit license", "mit license", "the mit licence"],
    "Apache-2.0": ["the apache license version 2.0", "the apache license 2.0", "apache license 2.0", "apache 2.0"],
    "GPL-2.0-only": ["the gnu general public license version 2", "the gnu gpl version 2", "gplv2"],
    "GPL-3.0-only": ["the gnu general public license version 3", "the gnu gpl version 3", "gplv3"],
    "LGPL-2.1-only": ["the gnu lesser general public license version 2.1", "the gnu lgpl version 2.1"],
    "LGPL-3.0-only": ["the gnu lesser general public license version 3", "the gnu lgpl version 3"],
    "AGPL-3.0-only": ["the gnu affero general public license version 3", "the gnu agpl version 3"],
    "BSD-2-Clause": ["the bsd 2 clause license", "the 2 clause bsd license"],
    "BSD-3-Clause": ["the bsd 3 clause license", "the 3 clause bsd license"],
    "MPL-2.0": ["the mozilla public license version 2.0", "the mozilla public license 2.0"],
    "ISC": ["the isc license"],
    "Unlicense": ["the unlicense"],
    "CC0-1.0": ["cc0 1.0", "cc0"],
    "CC-BY-4.0": ["cc by 4.0", "a creative commons attribution 4.0 international license"],
    "CC-BY-SA-4.0": ["cc by sa 4.0", "a creative commons attribution sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4.0", "a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4.0"],
    "CC-BY-ND-4.0": ["cc by nd 4.0"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4.0"],
}
#: fixed values: how a sentence names one of them
PHRASES = [
    "licensed under {}",
    "released under {}",
    "distributed under {}",
    "this work is licensed under {}",
    "this software is licensed under {}",
    "this project is licensed under {}",
    "this file is licensed under {}",
    "this software is released under {}",
]
#: fixed values: sentences of licence texts and file headers, normalised, by identifier
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-conditions": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "apache-may-not": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at http www.apache.org licenses license 2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-at": "you may obtain a copy of the license at",
    "apache-url": "http www.apache.org licenses license 2.0",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "mpl-terms": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
}
#: fixed values: rules in order; the first that fits names the licence
RULES = [
    (["mit-grant", "mit-as-is", "mit-liability"], "MIT"),
    (["mit-grant"], "MIT"),
    (["mit-permission", "mit-conditions", "mit-as-is", "mit-liability"], "MIT"),
    (["mit-permission", "mit-conditions"], "MIT"),
    (["isc-grant", "isc-as-is"], "ISC"),
    (["isc-grant"], "ISC"),
    (["apache-may-not", "apache-at", "apache-url", "apache-unless", "apache-see"], "Apache-2.0"),
    (["apache-may-not", "apache-at", "apache-url", "apache-unless"], "Apache-2.0"),
    (["apache-may-not", "apache-obtain", "apache-see"], "Apache-2.0"),
    (["apache-may-not", "apache-obtain"], "Apache-2.0"),
    (["apache-may-not"], "Apache-2.0"),
    (["gpl-free", "gpl-hope", "gpl-details", "gpl-copy"], "GPL-3.0-or-later"),
    (["gpl-free", "gpl-hope", "gpl-details"], "GPL-3.0-or-later"),
    (["gpl-free"], "GPL-3.0-or-later"),
    (["gpl2-free", "gpl-hope", "gpl-details", "gpl-copy"], "GPL-2.0-or-later"),
    (["gpl2-free", "gpl-hope", "gpl-details"], "GPL-2.0-or-later"),
    (["gpl2-free"], "GPL-2.0-or-later"),
    (["mpl-subject", "mpl-obtain"], "MPL-2.0"),
    (["mpl-subject"], "MPL-2.0"),
    (["mpl-terms", "mpl-obtain"], "MPL-2.0"),
    (["mpl-terms"], "MPL-2.0"),
    (["bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"], "BSD-3-Clause"),
    (["bsd-conditions", "bsd-source", "bsd-binary"], "BSD-2-Clause"),
    (["unlicense-free"], "Unlicense"),
    (["all-rights"], "LicenseRef-All-Rights-Reserved"),
]
# ------------------------------------------------------------------------------------------

#: every known sentence holds one of these; texts without any are not looked at further
WORDS = "licen|mozilla|copyright|permission|warrant|redistribut|public domain|all rights reserved|gplv|liab|(released|distributed) under"
MARKS = r"^[ \t]*(//+|/[*]+|[*]+/?|#+|;+|--+|<!--)[ \t]*"
ENDS = r"([.!?])[ \t\r\n\f]+"
GAPS = r"\n[ \t\r]*\n[ \t\r\n]*"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def known_sentences() -> dict[str, str]:
    """Identifier of every known normalised sentence: texts of licences and the naming phrases."""
    named = {p.format(name): f"names:{spdx}" for spdx, names in NAMES.items() for name in names for p in PHRASES}
    tags = {f"spdx license identifier {spdx.lower().replace('-', ' ')}": f"names:{spdx}" for spdx in NAMES}
    return {**{s: i for i, s in SENTENCES.items()}, **named, **tags}


WRAP = max(len(s.split()) for s in known_sentences())  # lines over which one sentence may be broken: a word on each


def rules() -> list[tuple[list[str], str]]:
    """The ordered rules: licence texts first, then sentences that name a licence."""
    return [*RULES, *[([f"names:{spdx}"], spdx) for spdx in NAMES]]


def normalised(sentence: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(sentence, r"[^a-z0-9.+]+", " "), r"[.]+( |$)", " ")
    return F.trim(F.regexp_replace(words, " +", " "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(segment: Column, known: Column) -> Column:
    """Identifiers of the known sentences in one segment: runs of lines, none inside another."""
    # a run of lines can be a known sentence only if it begins and ends with words of one
    begins, ends = (sorted({"", *(s.split()[k] for s in known_sentences())}) for k in (0, -1))

    def hits(lines: Column) -> Column:
        first = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.substring_index(F.element_at(lines, i), " ", 1).isin(begins))
        last = lambda i: F.filter(F.sequence(i, F.least(i + WRAP - 1, F.size(lines))), lambda j: F.substring_index(F.element_at(lines, j), " ", -1).isin(ends))
        run = lambda i, j: F.array_join(F.filter(F.slice(lines, i, j - i + 1), lambda line: line != ""), " ")
        named = F.flatten(F.transform(first, lambda i: F.transform(last(i), lambda j: F.struct(i.alias("i"), j.alias("j"), F.element_at(known, run(i, j)).alias("id")))))
        return F.filter(named, lambda m: m["id"].isNotNull())

    def whole(found: Column) -> Column:
        outer = F.filter(found, lambda m: ~F.exists(found, lambda o: (o["i"] <= m["i"]) & (o["j"] >= m["j"]) & ((o["j"] - o["i"]) > (m["j"] - m["i"]))))
        return F.transform(outer, lambda m: m["id"])

    lines = F.transform(F.filter(F.split(segment, "\n"), lambda line: F.trim(line) != ""), normalised)
    return _let(lines, lambda n: F.when(F.size(n) > 0, _let(hits(n), whole)).otherwise(F.array().cast("array<string>")))


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences named in every text.

    Returns (doc_id, sentence_ids, licenses, n_unmatched), one row per input row:
    ``sentence_ids`` are the known sentences in order and ``licenses`` the SPDX identifiers in
    the order of the rules, both joined by commas and empty if there are none; ``n_unmatched``
    counts segments that speak of a licence or copyright without a known sentence. ``docs``
    needs doc_id and text; other columns are ignored. Null and empty texts name nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.translate(F.coalesce("text", F.lit("")), CAPITALS + "\x01", CAPITALS.lower() + " ")
    rows = rows.select("doc_id", text.alias("text"))
    clean = F.regexp_replace("text", "(?dm)" + MARKS, "")
    cut = F.regexp_replace(F.regexp_replace(clean, ENDS, "$1\x01"), GAPS, "\x01")
    segments = F.filter(F.split(cut, "\x01"), lambda s: s.rlike(WORDS))
    empty = F.array().cast("array<string>")
    rows = rows.select("doc_id", F.when(F.col("text").rlike(WORDS), segments).otherwise(empty).alias("segments"))
    known = F.create_map(*[F.lit(x) for pair in known_sentences().items() for x in pair])
    found = F.transform("segments", lambda s: F.struct(s.alias("s"), _matches(s, known).alias("ids")))
    rows = rows.select("doc_id", F.when(F.size("segments") > 0, found).otherwise(F.array().cast("array<struct<s:string,ids:array<string>>>")).alias("found"))
    ids = F.flatten(F.transform("found", lambda f: f["ids"]))
    unmatched = F.filter("found", lambda f: (F.size(f["ids"]) == 0) & f["s"].rlike("licen|copyright"))
    rows = rows.select("doc_id", ids.alias("ids"), F.size(unmatched).cast("long").alias("n_unmatched"))
    ordered = F.array(*[F.struct(F.lit(f" {'  '.join(seq)} ").alias("seq"), F.lit(name).alias("name")) for seq, name in rules()])
    start = F.struct(F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("rest"), empty.alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.instr(state["rest"], rule["seq"]) > 0
        return F.struct(
            F.when(hit, F.replace(state["rest"], rule["seq"], F.lit(" | "))).otherwise(state["rest"]).alias("rest"),
            F.when(hit & ~F.array_contains(state["names"], rule["name"]), F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"),
        )

    licenses = F.when(F.size("ids") > 0, F.array_join(F.aggregate(ordered, start, apply, lambda s: s["names"]), ",")).otherwise(F.lit(""))
    return rows.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), licenses.alias("licenses"), "n_unmatched")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql(table: str = "documents") -> str:
    """The same result in DuckDB SQL: segments, line runs and rules as relations."""
    known = ", ".join(f"({_quoted(s)}, {_quoted(i)})" for s, i in known_sentences().items())
    norm = "trim(regexp_replace(regexp_replace(regexp_replace({}, '[^a-z0-9.+]+', ' ', 'g'), '[.]+( |$)', ' ', 'g'), ' +', ' ', 'g'))"
    sql = f"""
    WITH known(sentence, id) AS (VALUES {known}),
    rows AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{CAPITALS}' || chr(1), '{CAPITALS.lower()} ') AS text FROM {table}),
    cut AS (SELECT r, string_split(regexp_replace(regexp_replace(regexp_replace(text, '(?m){MARKS}', '', 'g'), '{ENDS}', '\\1' || chr(1), 'g'), '{GAPS}', chr(1), 'g'), chr(1)) AS parts
            FROM rows WHERE regexp_matches(text, '{WORDS}')),
    segments AS (SELECT r, unnest(parts) AS s, generate_subscripts(parts, 1) AS k FROM cut),
    lines AS (SELECT r, k, s, list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '') AS parts FROM segments WHERE regexp_matches(s, '{WORDS}')),
    starts AS (SELECT r, k, parts, unnest(range(1, len(parts) + 1)) AS i FROM lines),
    spans AS (SELECT r, k, parts, i, unnest(range(i, least(i + {WRAP - 1}, len(parts)) + 1)) AS j FROM starts),
    hits AS (SELECT r, k, i, j, id FROM (SELECT r, k, i, j, {norm.format("array_to_string(parts[i:j], ' ')")} AS sentence FROM spans) JOIN known USING (sentence)),
    whole AS (SELECT * FROM hits m WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.r = m.r AND o.k = m.k AND o.i <= m.i AND o.j >= m.j AND o.j - o.i > m.j - m.i)),
    named AS (SELECT r, string_agg(id, ',' ORDER BY k, i, j) AS sentence_ids, ' ' || string_agg(id, '  ' ORDER BY k, i, j) || ' ' AS rest FROM whole GROUP BY r),
    missed AS (SELECT r, count(*) AS n FROM lines l WHERE regexp_matches(s, 'licen|copyright') AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.r = l.r AND h.k = l.k) GROUP BY r),
    step0 AS (SELECT r, sentence_ids, rest, []::varchar[] AS names FROM named)"""
    ordered = rules()
    for n, (seq, name) in enumerate(ordered):
        pattern = _quoted(f" {'  '.join(seq)} ")
        sql += f""",
    step{n + 1} AS (SELECT r, sentence_ids, replace(rest, {pattern}, ' | ') AS rest,
        CASE WHEN contains(rest, {pattern}) AND NOT list_contains(names, {_quoted(name)}) THEN list_append(names, {_quoted(name)}) ELSE names END AS names FROM step{n})"""
    return sql + f"""
    SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(names, ','), '') AS licenses, cast(coalesce(n, 0) AS bigint) AS n_unmatched
    FROM rows LEFT JOIN step{len(ordered)} USING (r) LEFT JOIN missed USING (r)"""
