"""Licence recognition by sentences and rules (operator 8), in DataFrame functions only.

A text is cut into sentences twice: at every line end, and with line ends inside a paragraph read as spaces (licence texts are often
wrapped). Some licence texts have an end inside a sentence of the table or none where one stops ("free software: you can", "License,
v. 2.0", "(the "License"); you may"); INNER sets those right before the cut. A sentence is lower-cased and every run of other characters than a-z and 0-9 becomes one space. Known sentences become
their identifiers, others vanish, and the identifiers' sequence is matched against the ordered rules: a rule that matches names its
licence and takes its sentences away from the rules after it. The sentences and rules are a fixed table, so lookups need no join. Known
are notices, tags, and the beginnings of whole texts of some thirty common licences; texts changed in their wording are not.

Null and empty texts have no sentences and no licences. Very long texts are cut like any other; a sentence of any length is compared whole. Rows are independent: repeated rows give repeated results, an empty table
none. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, unique_columns

#: Licence sentences by identifier, as they are after normalisation.
SENTENCES = {
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "apache-2.0-notice-the": "licensed under the apache license version 2 0 the license",
    "apache-2.0-compliance": "you may not use this file except in compliance with the license",
    "apache-2.0-copy": "you may obtain a copy of the license at",
    "apache-2.0-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-2.0-see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-4.0-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-4.0-short": "licensed under cc by 4 0",
    "cc-by-nc-4.0-notice": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-4.0-short": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0-notice": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-sa-4.0-short": "licensed under cc by sa 4 0",
    "cc0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0-work": "this work is licensed under the gnu general public license version 3",
    "gpl-3.0-notice": "licensed under the gnu general public license version 3",
    "gpl-2.0-notice": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    # whole texts: their titles and first sentences
    "apache-2.0-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-2.0-terms": "terms and conditions for use reproduction and distribution",
    "gpl-3.0-title": "gnu general public license version 3 29 june 2007",
    "gpl-3.0-preamble": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl-2.0-title": "gnu general public license version 2 june 1991",
    "gpl-2.0-preamble": "the licenses for most software are designed to take away your freedom to share and change it",
    "lgpl-2.1-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl-3.0-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl-3.0-terms": "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    "agpl-3.0-title": "gnu affero general public license version 3 19 november 2007",
    "agpl-3.0-preamble": "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    # warranties
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-warranty": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-warranty": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    # notices of further licences
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "epl-2.0-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "epl-1.0-notice": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "epl-1.0-made": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html",
    "eupl-1.2-notice": "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the licence you may not use this work except in compliance with the licence",
    "eupl-1.2-short": "licensed under the eupl version 1 2",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "artistic-2.0-title": "the artistic license 2 0",
    "artistic-2.0-use": "1 you are permitted to use the standard version and create and use modified versions for any purpose without restriction provided that you do not distribute the modified version",
    "artistic-2.0-short": "licensed under the artistic license 2 0",
    "bsl-1.0-notice": "distributed under the boost software license version 1 0",
    "bsl-1.0-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cddl-notice": "the contents of this file are subject to the terms of the common development and distribution license the license",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "postgresql-grant": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "wtfpl-copies": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
}
#: Identifiers that a tag names on a line of its own, and the longer names of further Creative Commons licences.
TAGS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib",
]
COMMONS = {"CC-BY-ND-4.0": "attribution noderivatives", "CC-BY-NC-SA-4.0": "attribution noncommercial sharealike", "CC-BY-NC-ND-4.0": "attribution noncommercial noderivatives"}
_plain = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
SENTENCES |= {f"spdx-{tag.lower()}": f"spdx license identifier {_plain(tag)}" for tag in TAGS}
SENTENCES |= {f"{name.lower()}-notice": f"this work is licensed under a creative commons {said} 4 0 international license" for name, said in COMMONS.items()}
SENTENCES |= {f"{name.lower()}-short": f"licensed under {_plain(name)}" for name in COMMONS}
#: Licence and the identifiers that must follow one another, in order of precedence.
RULES = [
    ("Apache-2.0", "apache-2.0-notice-the apache-2.0-compliance apache-2.0-copy apache-2.0-basis apache-2.0-see"),
    ("Apache-2.0", "apache-2.0-notice-the apache-2.0-compliance apache-2.0-copy"),
    ("Apache-2.0", "apache-2.0-title apache-2.0-terms"),
    ("GPL-3.0-only", "gpl-3.0-title gpl-3.0-preamble"),
    ("GPL-2.0-only", "gpl-2.0-title gpl-2.0-preamble"),
    ("LGPL-2.1-only", "lgpl-2.1-title gpl-2.0-preamble"),
    ("LGPL-3.0-only", "lgpl-3.0-title lgpl-3.0-terms"),
    ("AGPL-3.0-only", "agpl-3.0-title agpl-3.0-preamble"),
    ("BSD-3-Clause", "bsd-conditions bsd-source bsd-binary bsd-endorse bsd-warranty"),
    ("BSD-2-Clause", "bsd-conditions bsd-source bsd-binary bsd-warranty"),
    ("BSD-3-Clause", "bsd-conditions bsd-source bsd-binary bsd-endorse"),
    ("BSD-2-Clause", "bsd-conditions bsd-source bsd-binary"),
    ("GPL-3.0-or-later", "gpl-free gpl-hope gpl-details"),
    ("GPL-2.0-or-later", "gpl-2-free gpl-hope gpl-details"),
    ("LGPL-2.1-or-later", "lgpl-free lgpl-hope lgpl-details"),
    ("LGPL-3.0-or-later", "lgpl-3-free gpl-hope lgpl-details"),
    ("AGPL-3.0-or-later", "agpl-free gpl-hope agpl-details"),
    ("Zlib", "zlib-as-is zlib-liable zlib-grant zlib-origin"),
    ("ISC", "isc-grant isc-warranty"),
    ("0BSD", "0bsd-grant isc-warranty"),
    ("MIT-0", "mit-0-grant mit-warranty mit-liability"),
    ("MIT", "mit-title mit-grant mit-notice mit-warranty mit-liability"),
    ("MIT", "mit-grant mit-notice mit-warranty mit-liability"),
    ("MIT", "mit-title mit-grant mit-notice"),
    ("MIT", "mit-grant mit-notice"),
    ("GPL-3.0-or-later", "gpl-free"),
    ("GPL-2.0-or-later", "gpl-2-free"),
    ("Apache-2.0", "apache-2.0-notice"),
    ("Apache-2.0", "apache-2.0-notice-the"),
    ("CC-BY-4.0", "cc-by-4.0-notice"),
    ("CC-BY-4.0", "cc-by-4.0-short"),
    ("CC-BY-NC-4.0", "cc-by-nc-4.0-notice"),
    ("CC-BY-NC-4.0", "cc-by-nc-4.0-short"),
    ("CC-BY-SA-4.0", "cc-by-sa-4.0-notice"),
    ("CC-BY-SA-4.0", "cc-by-sa-4.0-short"),
    ("CC0-1.0", "cc0-notice"),
    ("GPL-2.0-only", "gpl-2.0-notice"),
    ("GPL-3.0-only", "gpl-3.0-work"),
    ("GPL-3.0-only", "gpl-3.0-notice"),
    ("ISC", "isc-grant"),
    ("MIT", "mit-short"),
    ("MIT", "mit-licensed"),
    ("MIT", "mit-grant"),
    ("MPL-2.0", "mpl-2.0-notice"),
    ("Unlicense", "unlicense-domain"),
    ("LGPL-2.1-or-later", "lgpl-free"),
    ("LGPL-3.0-or-later", "lgpl-3-free"),
    ("AGPL-3.0-or-later", "agpl-free"),
    ("EPL-2.0", "epl-2.0-notice"),
    ("EPL-1.0", "epl-1.0-notice"),
    ("EPL-1.0", "epl-1.0-made"),
    ("EUPL-1.2", "eupl-1.2-notice"),
    ("EUPL-1.2", "eupl-1.2-short"),
    ("Zlib", "zlib-grant"),
    ("Artistic-2.0", "artistic-2.0-title"),
    ("Artistic-2.0", "artistic-2.0-use"),
    ("Artistic-2.0", "artistic-2.0-short"),
    ("BSL-1.0", "bsl-1.0-notice"),
    ("BSL-1.0", "bsl-1.0-grant"),
    ("CDDL-1.0", "cddl-notice"),
    ("0BSD", "0bsd-grant"),
    ("MIT-0", "mit-0-grant"),
    ("PostgreSQL", "postgresql-grant"),
    ("WTFPL", "wtfpl-copies"),
]
RULES += [(tag, f"spdx-{tag.lower()}") for tag in TAGS]
RULES += [(name, f"{name.lower()}-{form}") for name in COMMONS for form in ("notice", "short")]
SPACE = "[ \\t\\r]*"
#: A sentence ends at these and white space; a paragraph at an empty line.
SENTENCE_END, PARAGRAPH_END = "[.!?:]+[ \\t\\r\\n]+", f"\\n{SPACE}\\n"
GAP = "[^a-zA-Z0-9]+"
SPDX = "(?:" + "|".join(re.escape(t) for t in sorted(TAGS, key=len, reverse=True)) + ")"
words = lambda s: s.replace(" ", GAP)
#: Patterns and what takes their place before the cut: ends that are none, ends that lack a mark, and openings after a line of copyright.
INNER = [
    (f"(?i)(free{GAP}software):[ \\t\\r\\n]+(?=[^a-zA-Z0-9]*{words('you can redistribute it')})", "$1 "),
    (f"(?i)(SPDX-License-Identifier):[ \\t]+(?={SPDX}(?:[.!?:]+[ \\t\\r\\n]|[^a-zA-Z0-9\\n]*(?:\\n|\\z)))", "$1 "),
    (f"(?i)({words('Mozilla Public License v')})\\.[ \\t\\r\\n]+(?=[^a-zA-Z0-9]*2\\.0)", "$1 "),
    (f"(?i);(?={GAP}{words('you may not use this file except')})", "\n"),
    (f"(?i)({words('obtain a copy of the License at')}){GAP}(https?://www\\.apache\\.org/licenses/LICENSE-2\\.0(?:\\.txt|\\.html)?)(?![a-zA-Z0-9])", "$1\n$2\n"),
    (f"(?i:copyright|\\(c\\)|(?:MIT|ISC) License)[^\\n]{{0,200}}?[^a-zA-Z0-9\\n](?={words('(?:Licensed under the (?:Apache|Artistic) License|Permission is hereby granted free of charge|Permission to use copy modify|This (?:program|library) is free software|Redistribution and use in source and binary forms)')})", "$0\n"),
]


def sentence_ids(text: Column, paragraphs: bool) -> Column:
    """The identifiers of known sentences of ``text`` in order; array<string>."""
    t = F.coalesce(text, F.lit(""))
    if paragraphs:
        t = F.regexp_replace(F.regexp_replace(t, PARAGRAPH_END, ". "), "\\n", " ")
    for pattern, instead in INNER:
        t = F.regexp_replace(t, pattern, instead)
    t = F.regexp_replace(t, SENTENCE_END, "\n")
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    plain = F.transform(F.split(t, "\n", -1), lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    likely = F.filter(plain, lambda s: s.isin(*SENTENCES.values()))  # one hash look-up; the map is searched for known sentences only
    return F.transform(likely, lambda s: F.element_at(known, s))


def licences(ids: Column) -> Column:
    """The licences whose rules match the sequence of identifiers, by precedence, each once; array<string>."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f" {seq.replace(' ', '  ')} ").alias("seq")) for name, seq in RULES])
    start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, rule: F.when(
        F.contains(acc["left"], rule["seq"]),
        F.struct(F.replace(acc["left"], rule["seq"], F.lit("|")).alias("left"), F.array_append(acc["found"], rule["name"]).alias("found")),
    ).otherwise(acc)
    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.aggregate(rules, start, step)["found"]))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with line_ids, paragraph_ids and licences (those of either way of cutting)."""
    ids = docs.withColumns({"line_ids": sentence_ids(F.col("text"), False), "paragraph_ids": sentence_ids(F.col("text"), True)})
    return ids.withColumn("licences", F.sort_array(F.array_union(licences(F.col("line_ids")), licences(F.col("paragraph_ids")))))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(unique_columns(read_table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    join = lambda c: F.array_join(c, ",")
    return found.select("doc_id", join("line_ids").alias("line_ids"), join("paragraph_ids").alias("paragraph_ids"), join("licences").alias("licences"), F.size("line_ids").cast("long").alias("n_sentences"))


def _oracle() -> str:
    known = "MAP {" + ", ".join(f"'{sentence}': '{name}'" for name, sentence in SENTENCES.items()) + "}"
    plain = lambda t: f"list_filter(list_transform(string_split({t}, chr(10)), lambda s: ({known})[trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))]), lambda x: x IS NOT NULL)"
    text, end = "coalesce(text, '')", "'[.!?:]+[ \\t\\r\\n]+'"
    lines = f"regexp_replace({text}, {end}, chr(10), 'g')"
    flat = f"regexp_replace(regexp_replace(regexp_replace({text}, '\\n[ \\t\\r]*\\n', '. ', 'g'), '\\n', ' ', 'g'), {end}, chr(10), 'g')"
    ctes = [f"s AS (SELECT doc_id, {plain(lines)} AS a, {plain(flat)} AS b FROM documents)", "r0 AS (SELECT *, ' ' || array_to_string(a, '  ') || ' ' AS l, ' ' || array_to_string(b, '  ') || ' ' AS p, []::VARCHAR[] AS f FROM s)"]
    for k, (name, seq) in enumerate(RULES):
        q = f"' {seq.replace(' ', '  ')} '"
        ctes.append(f"r{k + 1} AS (SELECT doc_id, a, b, replace(l, {q}, '|') AS l, replace(p, {q}, '|') AS p, CASE WHEN contains(l, {q}) OR contains(p, {q}) THEN list_append(f, '{name}') ELSE f END AS f FROM r{k})")
    ctes[1] = ctes[1][:-1] + " WHERE len(a) + len(b) > 0)"
    rest = "SELECT doc_id, '' AS line_ids, '' AS paragraph_ids, '' AS licences, 0::BIGINT AS n_sentences FROM s WHERE len(a) + len(b) = 0"
    return f"WITH {', '.join(ctes)} SELECT doc_id, array_to_string(a, ',') AS line_ids, array_to_string(b, ',') AS paragraph_ids, array_to_string(list_sort(list_distinct(f)), ',') AS licences, CAST(len(a) AS BIGINT) AS n_sentences FROM r{len(RULES)} UNION ALL {rest}"


ORACLE = _oracle()
