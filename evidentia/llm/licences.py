"""Licence scan by sentence rules, natively.

A text is cut into sentences (at closing marks, semicolons and colons, at empty
lines, and around a line that is a known sentence by itself). A whole sentence,
normalised (ASCII letters lowered, all but letters, digits, dots and pluses to
one blank) and brought to its template, is looked up in one map of known licence
sentences; a phrase inside another sentence is not one, so a denial ("is not
licensed under ..") is unknown, not a licence. Templates stand for what varies:
who is licensed and by which verb, names and years in notices.

The sequence of a document's identifiers is matched against ordered rules. A
rule is a sequence of identifiers that may stand apart by up to ``GAP`` others;
what it takes leaves the sequence, so that a later, more general rule sees only
what is left. One expression per row: no shuffle, no join, no Python.

Defined cases: null and empty texts have no sentences; a sentence that sounds
like a licence but is not known counts in ``n_unknown``; identifiers that no
rule takes count in ``n_unruled``; repeated rows give repeated results; an empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sentences of public licences, normalised, and their identifiers. Fixed values.
SENTENCES = {
    "copyright @": "Copyright",
    "all rights reserved": "AllRights",
    # MIT
    "mit license": "MITTitle",
    "the mit license": "MITTitle",
    "the mit license mit": "MITTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "MITGrant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided as is without warranty of any kind": "MITAsIs",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITLiable",
    # BSD
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice": "BSDSource",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice": "BSDBinary",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "neither the name of @ nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this software is provided by the copyright holders and contributors as is": "BSDAsIs",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDAsIs",
    # Apache
    "apache license": "ApacheTitle",
    "apache license version 2.0": "ApacheTitle2",
    "apache license version 2.0 january 2004": "ApacheTitle2",
    "version 2.0 january 2004": "ApacheVersion2",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www.apache.org licenses license 2.0": "ApacheURL",
    "https www.apache.org licenses license 2.0": "ApacheURL",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "ApacheAsIs",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    # GNU
    "this program is free software": "GPLFree",
    "this library is free software": "LGPLFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPLTerms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AGPLTerms",
    "either version 2 of the license or at your option any later version": "Later2",
    "either version 2.1 of the license or at your option any later version": "Later21",
    "either version 3 of the license or at your option any later version": "Later3",
    "version 2 of the license": "Only2",
    "version 3 of the license": "Only3",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPLTerms2",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPLTerms3",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "LGPLTerms21",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LGPLTerms3",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPLTerms3",
    "gnu general public license": "GPLTitle",
    "gnu lesser general public license": "LGPLTitle",
    "gnu affero general public license": "AGPLTitle",
    "version 2 june 1991": "GPLVersion2",
    "version 3 29 june 2007": "GPLVersion3",
    "version 3 19 november 2007": "AGPLVersion3",
    # others
    "mozilla public license version 2.0": "MPLTitle2",
    "this source code form is subject to the terms of the mozilla public license version 2.0": "MPLTerms2",
    "this source code form is subject to the terms of the mozilla public license v": "MPLTerms2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "isc license": "ISCTitle",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "boost software license version 1.0": "BoostTitle1",
    "distributed under the boost software license version 1.0": "BoostTitle1",
    "eclipse public license version 2.0": "EPLTitle2",
    "eclipse public license v 2.0": "EPLTitle2",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
}
#: Licences by the names that "licensed under .." gives them, normalised. Fixed values.
NAMES = {
    "mit license": "MIT", "mit": "MIT", "mit licence": "MIT", "expat license": "MIT", "isc license": "ISC", "unlicense": "Unlicense", "zlib license": "Zlib",
    "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache 2.0 license": "Apache-2.0", "apache 2.0": "Apache-2.0",
    "bsd 2 clause license": "BSD-2-Clause", "2 clause bsd license": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause", "3 clause bsd license": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause",
    "mozilla public license version 2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0", "mpl 2.0": "MPL-2.0",
    "eclipse public license version 2.0": "EPL-2.0", "eclipse public license 2.0": "EPL-2.0", "boost software license version 1.0": "BSL-1.0",
    "cc0 1.0": "CC0-1.0", "cc0": "CC0-1.0", "cc0 1.0 universal": "CC0-1.0",
}
for _full, _short, _spdx, _versions in (("gnu general public license", "gpl", "GPL", ("2.0", "3.0")), ("gnu lesser general public license", "lgpl", "LGPL", ("2.1", "3.0")), ("gnu affero general public license", "agpl", "AGPL", ("3.0",))):
    for _v in _versions:
        for _name in (_full, _short, f"gnu {_short}"):
            for _shown in {_v, _v.removesuffix(".0")}:
                for _link in (" version ", " "):
                    NAMES[_name + _link + _shown] = f"{_spdx}-{_v}"
                    NAMES[f"{_name}{_link}{_shown} or later"] = NAMES[f"{_name}{_link}{_shown} or any later version"] = f"{_spdx}-{_v}-or-later"
for _kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
    for _v in ("3.0", "4.0"):
        _spdx = f"CC-{_kind.upper().replace(' ', '-')}-{_v}"
        for _tail in ("", " license", " international license"):
            NAMES[f"cc {_kind} {_v}{_tail}"] = NAMES[f"creative commons {_kind} {_v}{_tail}"] = _spdx
#: Identifiers recognised in a line "SPDX-License-Identifier: ...". Fixed values.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "BSL-1.0", "EPL-2.0")
#: Every known sentence after its template.
KNOWN = SENTENCES | {f"under {name}": f"Ref:{spdx}" for name, spdx in NAMES.items()} | {f"spdx {s.lower().replace('-', ' ')}": f"Ref:{s}" for s in SPDX}

#: Ordered rules: a licence and the identifiers, in order, that establish it.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("Ref:Apache-2.0", "ApacheUse", "ApacheCopy", "ApacheURL", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("Ref:Apache-2.0", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("Ref:Apache-2.0", "ApacheUse", "ApacheCopy", "ApacheAsIs")),
    ("Apache-2.0", ("Ref:Apache-2.0", "ApacheUse", "ApacheCopy", "ApacheURL")),
    ("Apache-2.0", ("Ref:Apache-2.0", "ApacheUse", "ApacheCopy")),
    ("Apache-2.0", ("Ref:Apache-2.0", "ApacheUse")),
    ("Apache-2.0", ("ApacheTitle", "ApacheVersion2")),
    ("Apache-2.0", ("ApacheTitle2",)),
    ("MIT", ("MITTitle", "MITGrant", "MITNotice", "MITAsIs", "MITLiable")),
    ("MIT", ("MITTitle", "MITGrant", "MITNotice", "MITAsIs")),
    ("MIT", ("MITTitle", "MITGrant", "MITNotice")),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs", "MITLiable")),
    ("MIT", ("MITGrant", "MITNotice", "MITAsIs")),
    ("MIT", ("MITGrant", "MITNotice")),
    ("MIT", ("MITTitle",)),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("LGPL-2.1-or-later", ("LGPLFree", "LGPLTerms", "Later21")),
    ("LGPL-3.0-or-later", ("LGPLFree", "LGPLTerms", "Later3")),
    ("AGPL-3.0-or-later", ("GPLFree", "AGPLTerms", "Later3")),
    ("GPL-2.0-or-later", ("GPLFree", "GPLTerms", "Later2")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLTerms", "Later3")),
    ("GPL-2.0", ("GPLFree", "GPLTerms", "Only2")),
    ("GPL-3.0", ("GPLFree", "GPLTerms", "Only3")),
    ("GPL-2.0-or-later", ("GPLFree", "GPLTerms2")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLTerms3")),
    ("LGPL-2.1-or-later", ("LGPLFree", "LGPLTerms21")),
    ("LGPL-3.0-or-later", ("LGPLFree", "LGPLTerms3")),
    ("AGPL-3.0-or-later", ("GPLFree", "AGPLTerms3")),
    ("GPL", ("GPLFree", "GPLTerms")),
    ("AGPL-3.0", ("AGPLTitle", "AGPLVersion3")),
    ("LGPL-3.0", ("LGPLTitle", "GPLVersion3")),
    ("GPL-2.0", ("GPLTitle", "GPLVersion2")),
    ("GPL-3.0", ("GPLTitle", "GPLVersion3")),
    ("MPL-2.0", ("MPLTerms2",)),
    ("MPL-2.0", ("MPLTitle2",)),
    ("ISC", ("ISCTitle", "ISCGrant")),
    ("ISC", ("ISCGrant",)),
    ("Unlicense", ("UnlicenseGrant",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("Zlib", ("ZlibGrant",)),
    ("BSL-1.0", ("BoostTitle1",)),
    ("EPL-2.0", ("EPLTitle2",)),
    *[(spdx, (f"Ref:{spdx}",)) for spdx in sorted({*NAMES.values(), *SPDX})],
    ("all-rights-reserved", ("AllRights",)),
]
#: Other identifiers that may stand between two of a rule.
GAP = 8

#: A colon that is no end of a sentence, and its text without it.
LABEL = (r"(?i)(spdx-license-identifier) *:", r"\1 ")
#: What a sentence must hold to count as licence-like.
CUE = "license|licence|copyright|permission|redistribut|warrant|public domain|rights reserved|free software|licensed|spdx|neither the name|gpl"
#: The same on raw text, so that most documents are passed over in one scan.
RAW_CUE = r"[lL][iI][cC][eE][nN][sScC]|[cC][oO][pP][yY][rR]|[pP][eE][rR][mM][iI][sS]|[rR][eE][dD][iI][sS]|[wW][aA][rR][rR]|[pP][uU][bB][lL][iI][cC]|[rR][iI][gG][hH][tT]|[fF][rR][eE][eE]|[sS][pP][dD][xX]|[nN][eE][iI][tT]|[gG][pP][lL]"
_THING = "work|project|software|program|library|package|file|code|source code|repository|document|material|content|text|dataset|data|module|tool"
#: Templates, applied in order to a normalised sentence: pattern and what stands for it.
TEMPLATES = (
    (r"^[.]+|[.]+$", ""),
    (rf"^(?:this|the|our) (?:{_THING}) (?:is|are) (?:also |dual )?(licensed|licenced|released|distributed|published|available|made available|provided|offered) under ", "licensed under "),
    (r"^(?:licensed|licenced|released|distributed|published|available|made available|provided|offered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", "under "),
    (r"^(under .*) the license$", r"\1"),
    (r"^(under .* )v([0-9])", r"\1version \2"),
    (r"^spdx license identifier ", "spdx "),
    (r"^copyright .*$", "copyright @"),
    (r"^c [0-9][0-9][0-9][0-9] .*$", "copyright @"),
    (r"^neither the name of .* nor the names of its", "neither the name of @ nor the names of its"),
)


def _normal(sentence: Column) -> Column:
    """A sentence's template: letters lowered, other characters blanks, what varies replaced."""
    s = F.btrim(F.regexp_replace(F.lower(F.regexp_replace(sentence, "[^A-Za-z0-9.+]+", " ")), " +", " "))
    for pattern, stands in TEMPLATES:
        s = F.regexp_replace(s, pattern, stands.replace("\\", "$"))
    return F.btrim(s)


def _known(template: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair]), template)


def licence_sentences(text: Column) -> Column:
    """array of (template, id) of the licence-like sentences of a text; id is null for unknown ones."""
    let: Callable = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    plain = F.regexp_replace(text, LABEL[0], LABEL[1].replace("\\", "$"))
    lines = F.transform(F.split(plain, "\n", -1), lambda x: F.when(F.lower(x).rlike(CUE) & _known(_normal(F.regexp_replace(x, r"[.!?;:]+[ \t]*\z", ""))).isNotNull(), F.concat(F.lit("\n\n"), x, F.lit("\n\n"))).otherwise(x))
    cut = F.split(F.regexp_replace(F.array_join(lines, "\n"), r"[.!?;:]+([ \t\r\n]|\z)", "\n\n"), r"\n[ \t\r]*\n", -1)
    licence_like = F.filter(cut, lambda s: F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ").rlike(CUE) | _known(_normal(s)).isNotNull())
    found = F.transform(licence_like, lambda s: let(_normal(s), lambda t: F.struct(t.alias("template"), _known(t).alias("id"))))
    return F.when(text.rlike(RAW_CUE), found).otherwise(F.array().cast("array<struct<template:string,id:string>>"))


def _pattern(ids: tuple[str, ...], escape: str = r"\\") -> tuple[str, int]:
    """Expression for a rule's identifiers, <a>..<b>, with up to ``GAP`` others between, and the number of gaps."""
    quoted = ["<" + i.replace(".", r"\.").replace("+", r"\+") + ">" for i in ids]
    gap = rf"((?:<[^<>]*>|\[[^\[\]]*\]){{0,{GAP}}}?)"
    return gap.join(quoted), len(ids) - 1


def scan_licences(documents: DataFrame) -> DataFrame:
    """A row per document: sentence_ids (in order), licenses (sorted), n_unknown, n_unruled."""
    found = documents.select("doc_id", licence_sentences(F.coalesce(F.col("text"), F.lit(""))).alias("sentences"))
    ids = F.filter(F.transform("sentences", lambda s: s["id"]), lambda i: i.isNotNull())
    known = found.select("doc_id", (F.size("sentences") - F.size(ids)).cast("long").alias("n_unknown"), ids.alias("ids"))
    ruled = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    for name, rule in RULES:
        pattern, gaps = _pattern(rule)
        ruled = F.regexp_replace(ruled, pattern, f"[{name}]" + "".join(f"${g}" for g in range(1, gaps + 1)))
    out = known.withColumn("ruled", F.when(F.size("ids") > 0, ruled).otherwise(""))
    return out.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("ruled", F.lit(r"\[([^\]]+)\]"), F.lit(1)))), ",").alias("licenses"),
        "n_unknown",
        F.regexp_count("ruled", F.lit("<")).cast("long").alias("n_unruled"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql() -> str:
    """The same by joins: sentences are rows, met with a table of the known ones."""

    def normal(x: str) -> str:
        x = f"trim(regexp_replace(lower(regexp_replace({x}, '[^A-Za-z0-9.+]+', ' ', 'g')), ' +', ' ', 'g'))"
        for pattern, stands in TEMPLATES:
            x = f"regexp_replace({x}, '{pattern}', '{stands}', 'g')"
        return f"trim({x})"

    ruled = "ids"
    for name, rule in RULES:
        pattern, gaps = _pattern(rule)
        ruled = f"regexp_replace({ruled}, '{pattern}', '[{name}]{''.join(chr(92) + str(g) for g in range(1, gaps + 1))}', 'g')"
    return f"""
WITH known AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in KNOWN.items())}) k(template, id)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '{LABEL[0]}', '{LABEL[1]}', 'g') AS text FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d WHERE regexp_matches(text, '{RAW_CUE}')),
n AS (SELECT r, k, line, {normal("regexp_replace(line, '[.!?;:]+[ \\t]*\\z', '')")} AS template FROM l),
m AS (SELECT r, string_agg(CASE WHEN id IS NOT NULL AND regexp_matches(lower(line), '{CUE}') THEN chr(10) || chr(10) || line || chr(10) || chr(10) ELSE line END, chr(10) ORDER BY k) AS text FROM n LEFT JOIN known USING (template) GROUP BY r),
c AS (SELECT r, regexp_split_to_array(regexp_replace(text, '[.!?;:]+([ \\t\\r\\n]|\\z)', chr(10) || chr(10), 'g'), '\\n[ \\t\\r]*\\n') AS cut FROM m),
s AS (SELECT r, unnest(cut) AS s, generate_subscripts(cut, 1) AS k FROM c),
t AS (SELECT r, k, s, {normal("s")} AS template FROM s),
i AS (SELECT r, string_agg(id, ',' ORDER BY k) AS sentence_ids, string_agg('<' || id || '>', '' ORDER BY k) AS ids, count(*) FILTER (id IS NULL) AS n_unknown FROM t LEFT JOIN known USING (template)
  WHERE id IS NOT NULL OR regexp_matches(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'), '{CUE}') GROUP BY r),
f AS (SELECT d.doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(n_unknown, 0) AS n_unknown, coalesce({ruled}, '') AS ruled FROM d LEFT JOIN i USING (r))
SELECT doc_id, sentence_ids, array_to_string(list_sort(list_distinct(regexp_extract_all(ruled, '\\[([^\\]]+)\\]', 1))), ',') AS licenses, n_unknown, CAST(length(ruled) - length(replace(ruled, '<', '')) AS BIGINT) AS n_unruled FROM f
"""


SQL_LICENCES = _sql()
