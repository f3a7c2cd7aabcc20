"""Licence recognition by sentence rules.

A text is cut into sentences at .!? before white space and at blank lines, and normalised (lower case, letters and
digits only, so that line breaks, comment marks and commas are spaces). Known licence sentences are looked for where a
sentence or a line begins, also over several lines; they need not be the whole sentence, and one may follow another
within it. Their identifiers, in order, form the document's sequence, and a licence is found where one of its ordered
rules matches a run of that sequence. Both tables are fixed and small; everything stays in the JVM.

Edge cases: null or empty text has no sentences and no licences; sentences may be of any length; repeated rows are
reported each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Known licence sentences, normalised, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0-grant",
    "licensed under the apache license version 2 0 the license": "apache-2.0-grant",
    "you may not use this file except in compliance with the license": "apache-2.0-comply",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-grant",
    "this program is free software": "gnu-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "either version 3 of the license or at your option any later version": "gpl-3.0-later",
    "either version 2 of the license or at your option any later version": "gpl-2.0-later",
    "released under the mit license": "mit-grant",
    "licensed under the mit license": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-permission",
    "the above copyright notice and this permission notice shall be included in all copies": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse products": "bsd-endorse",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-grant",
    "licensed under cc by 4 0": "cc-by-4.0-grant",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-grant",
    "all rights reserved": "rights-reserved",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "either version 2 1 of the license or at your option any later version": "lgpl-2.1-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-terms",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-2.0-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-permission",
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
}
# Ordered rules, a run of sentence identifiers each.
RULES = {
    "Apache-2.0": [["apache-2.0-grant"], ["apache-2.0-comply", "apache-2.0-copy"]],
    "GPL-3.0": [["gpl-3.0-grant"], ["gpl-terms", "gpl-3.0-later"]],
    "GPL-2.0": [["gpl-terms", "gpl-2.0-later"]],
    "MIT": [["mit-grant"], ["mit-permission", "mit-notice"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "CC-BY-NC-4.0": [["cc-by-nc-4.0-grant"]],
    "CC-BY-4.0": [["cc-by-4.0-grant"]],
    "CC-BY-SA-4.0": [["cc-by-sa-4.0-grant"]],
    "Proprietary": [["rights-reserved"]],
    "LGPL-2.1": [["lgpl-terms", "lgpl-2.1-later"]],
    "LGPL-3.0": [["lgpl-terms", "gpl-3.0-later"]],
    "AGPL-3.0": [["agpl-terms", "gpl-3.0-later"]],
    "MPL-2.0": [["mpl-2.0-grant"]],
    "ISC": [["isc-permission", "isc-notice"]],
    "Unlicense": [["unlicense-grant"]],
}
# Wordings of the licences' own texts beside SENTENCES.
WORDINGS = {
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-endorse",
}
CUT = r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n\s*"
#: Marks in the normalised text: a sentence begins, a line begins.
SENTENCE, LINE = "\x01", "\x02"


def recognise(docs: DataFrame, sentences: dict[str, str] = SENTENCES | WORDINGS, rules: dict[str, list[list[str]]] = RULES) -> DataFrame:
    """doc_id, n_sentences, sequence (identifiers, by comma), licenses (names, by comma)."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    gap = f"[ {LINE}]+"
    longest = "|".join(s.replace(" ", gap) for s in sorted(sentences, key=len, reverse=True))
    # \G: right after the known sentence before. A number may stand before the items of a list.
    begins = rf"(?:\G|[{SENTENCE}{LINE}])[ {LINE}]*(?:[0-9]+ )?({longest})(?![a-z0-9])"
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.regexp_replace(F.translate(F.lower(text), SENTENCE + LINE, "  "), CUT, SENTENCE)
    plain = F.regexp_replace(F.translate(marked, "\n", LINE), f"[^a-z0-9{SENTENCE}{LINE}]+", " ")
    ids = F.transform(F.regexp_extract_all(plain, F.lit(begins), F.lit(1)), lambda s: F.element_at(known, F.regexp_replace(s, gap, " ")))
    count = F.size(F.filter(F.split(text, CUT), lambda s: F.trim(s) != "")).cast("long")
    held = docs.select("doc_id", count.alias("n_sentences"), F.array_join(ids, ",").alias("sequence"))
    padded = F.concat(F.lit(","), "sequence", F.lit(","))
    names = []
    for name in sorted(rules):
        found = F.lit(False)
        for run in rules[name]:
            found = found | F.contains(padded, F.lit("," + ",".join(run) + ","))
        names.append(F.when(found, F.lit(name)))
    return held.withColumn("licenses", F.concat_ws(",", *names))


def query(spark, sf_dir: str) -> DataFrame:
    return recognise(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Runs of known sentences that follow one another from the beginning of a sentence or line, then the sentences in each."""
    every = SENTENCES | WORDINGS
    known = "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in every.items()) + " END"
    names = ", ".join("CASE WHEN " + " OR ".join(f"contains(p, ',{','.join(run)},')" for run in RULES[name]) + f" THEN '{name}' END" for name in sorted(RULES))
    cut = r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n[ \t\n\x0B\f\r]*"
    either = "|".join(s.replace(" ", r"[ \x02]+") for s in sorted(every, key=len, reverse=True))
    piece = rf"[ \x02]*(?:[0-9]+ )?({either})\b"
    return rf"""
WITH c AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, doc_id, len(list_filter(regexp_split_to_array(t, '{cut}'), lambda x: trim(x, ' ') <> '')) AS n,
  regexp_replace(translate(regexp_replace(translate(lower(t), chr(1) || chr(2), '  '), '{cut}', chr(1), 'g'), chr(10), chr(2)), '[^a-z0-9\x01\x02]+', ' ', 'g') AS q FROM c),
u AS (SELECT r, unnest(a) AS run, generate_subscripts(a, 1) AS i FROM (SELECT r, regexp_extract_all(q, '(?:^|[\x01\x02])(?:{piece.replace("(" + either, "(?:" + either)})+') AS a FROM m)),
v AS (SELECT r, i, unnest(a) AS f, generate_subscripts(a, 1) AS j FROM (SELECT r, i, regexp_extract_all(run, '{piece}', 1) AS a FROM u)),
k AS (SELECT r, i, j, regexp_replace(f, '[ \x02]+', ' ', 'g') AS s FROM v),
g AS (SELECT r, string_agg({known}, ',' ORDER BY i, j) AS q FROM k GROUP BY r),
j AS (SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, coalesce(g.q, '') AS sequence, ',' || coalesce(g.q, '') || ',' AS p FROM m LEFT JOIN g USING (r))
SELECT doc_id, n_sentences, sequence, concat_ws(',', {names}) AS licenses FROM j
"""


SQL = _sql()
