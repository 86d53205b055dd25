"""Canonical digest lookup: whole texts, normalised, hashed and joined with the digests of known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import common

# Equivalent spellings of words and phrases (without punctuation), each read as the second.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("licencor", "licensor"), ("licencee", "licensee"),
    ("sublicence", "sublicense"), ("sub licence", "sublicense"), ("sub license", "sublicense"), ("sub licensed", "sublicensed"), ("sub licensable", "sublicensable"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("organisation", "organization"), ("organisations", "organizations"),
    ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"), ("favour", "favor"),
    ("behaviour", "behavior"), ("honour", "honor"), ("labour", "labor"), ("wilful", "willful"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("judgement", "judgment"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("authorise", "authorize"), ("recognise", "recognize"), ("recognised", "recognized"), ("utilise", "utilize"),
    ("utilisation", "utilization"), ("analyse", "analyze"), ("artefact", "artifact"), ("artefacts", "artifacts"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("modelling", "modeling"), ("labelled", "labeled"), ("offence", "offense"), ("defence", "defense"),
    ("per cent", "percent"), ("programme", "program"), ("realise", "realize"), ("whilst", "while"), ("https", "http"),
]

# Whole texts of short public licences.
KNOWN = [
    (
        "MIT",
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nCopyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Copyright (c) <year> <owner>\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "WTFPL",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nCopyright (C) 2004 Sam Hocevar <sam@hocevar.net>\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>",
    ),
    (
        "Zlib",
        "zlib License\n\nCopyright (c) <year> <copyright holders>\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MIT-0",
        "MIT No Attribution\n\nCopyright <year> <copyright holder>\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

# Marks that open a line of a comment in source code, and words that do.
_COMMENT = r"\n[ \t]*([/*#;%>|!-]+|(rem|dnl)[ \t])*[ \t]*"
_YEAR = r"(19|20)[0-9][0-9]"
#: A line that is a copyright notice: the word or sign, followed by a sign, a year or a place to fill in.
NOTICE = (
    r"\n(portions[ \t]+)?(copyright[ \t]*[:,]?[ \t]*(by[ \t]+)?(\(c\)|©|[\[<{(]?[ \t]*" + _YEAR + r"|[\[<{])"
    r"|\(c\)[ \t]*(copyright|[\[<{]?[ \t]*" + _YEAR + r"|<)|©|all rights reserved)[^\n]*\n"
)
#: A line that is one by a holder's name: it ends in a word that holders' names end in.
NAMED = r"\n(portions[ \t]+)?copyright[ \t]+([^\n]*[ \t])?(authors|contributors to the [^\n]+|inc|ltd|llc|gmbh|foundation|corporation|corp|project)[., \t]*\n"
MARKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case; without comment marks, then without copyright notices; words apart by single spaces; one spelling of
    equivalent words.

    The rest of the text doesn't depend on where its lines break: a line that merely begins with "copyright" ("copyright
    holders be liable") is no notice and stays. A notice that is itself broken over lines loses its first line only.
    """
    out = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    out = F.concat(F.lit("\n"), F.replace(out, F.lit("\n"), F.lit("\n\n")), F.lit("\n"))  # each line between breaks of its own
    for pattern in (_COMMENT, NOTICE, NAMED):
        out = F.regexp_replace(out, pattern, "\n")
    out = F.concat(F.lit(" "), F.regexp_replace(out, MARKS, "  "), F.lit(" "))  # each word between spaces of its own
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(out, " +", " "))


#: Title lines under which these licences stand; their texts below stand without a title too.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
}


def all_known() -> list[tuple[str, str]]:
    """KNOWN and the files of licence_texts, each with its title variants."""
    rows = KNOWN + [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    found = list(rows)
    for name, text in rows:
        if name in TITLES:
            first, _, rest = text.partition("\n\n")
            bare = rest if first in TITLES[name] else text
            found += [(name, bare), *((name, f"{title}\n\n{bare}") for title in TITLES[name])]
    return found


def known_licences(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or all_known(), "licence string, text string")


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, n_canonical (code points), licence: that whose canonical text equals the document's, else null.

    Whole texts are compared, by SHA-256, however long they are. Null, empty and wordless texts match nothing. Of licences
    with equal canonical texts the least name stands. Every row of documents is returned, repeated ones and null doc_ids
    too; an empty table gives no rows, an empty list of licences no matches; extra columns are ignored.
    """
    clean = canonical(F.col("text"))
    digests = (
        common.only(known, "licence", "text")
        .select("licence", clean.alias("clean"))
        .where("clean <> ''")
        .groupBy(F.sha2("clean", 256).alias("known_digest"))
        .agg(F.min("licence").alias("licence"))
    )
    docs = common.only(documents, "doc_id", "text").select("doc_id", clean.alias("clean"))
    docs = docs.select("doc_id", F.sha2("clean", 256).alias("digest"), F.length("clean").cast("long").alias("n_canonical"))
    return docs.join(digests, docs["digest"] == digests["known_digest"], "left").drop("known_digest")


def variants(documents: DataFrame) -> DataFrame:
    """doc_id, text: the documents, and for each a whole known licence as it stands in the wild, dealt by doc_id: its letters as they
    are, all upper or all lower, its lines behind a comment's marks or not, under a copyright line of some year. Such a
    row's doc_id is the document's, less 1, negated; that of a null one is null.
    """
    rows = all_known()
    known = documents.sparkSession.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k long, known string")
    n = F.coalesce("doc_id", F.lit(0))
    dealt = common.only(documents, "doc_id").withColumn("k", F.pmod(n, F.lit(len(rows)))).join(F.broadcast(known), "k")  # the licences above
    cased = F.when(n % 3 == 0, F.upper("known")).when(n % 3 == 1, F.lower("known")).otherwise(F.col("known"))
    mark = F.when(n % 5 == 0, "# ").when(n % 5 == 1, " * ").otherwise("")
    noted = F.concat(mark, F.lit("Copyright (c) "), (n % 40 + 1985).cast("string"), F.lit(" Someone\n"), mark, F.replace(cased, F.lit("\n"), F.concat(F.lit("\n"), mark)))
    return common.only(documents, "doc_id", "text").unionByName(dealt.select((-F.col("doc_id") - 1).alias("doc_id"), noted.alias("text")))


#: The rows of variants from documents and the numbered licences.
VARIANTS_SQL = """SELECT doc_id, text FROM documents UNION ALL
    SELECT -doc_id - 1, mark || 'Copyright (c) ' || (n % 40 + 1985) || ' Someone' || chr(10) || mark || replace(cased, chr(10), chr(10) || mark) FROM
    (SELECT doc_id, n, CASE n % 3 WHEN 0 THEN upper(l.text) WHEN 1 THEN lower(l.text) ELSE l.text END AS cased, CASE n % 5 WHEN 0 THEN '# ' WHEN 1 THEN ' * ' ELSE '' END AS mark
    FROM (SELECT doc_id, coalesce(doc_id, 0) AS n FROM documents) JOIN listed l ON k = n % (SELECT count(*) FROM listed))"""


def oracle_sql(rows: str = "SELECT doc_id, text FROM documents") -> str:
    quote = lambda x: "'" + x.replace("'", "''").replace("\n", "\xb6") + "'"

    def clean(column: str) -> str:
        out = f"replace(replace(lower(coalesce({column}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
        out = f"chr(10) || replace({out}, chr(10), chr(10) || chr(10)) || chr(10)"
        for pattern in (_COMMENT, NOTICE, NAMED):
            out = f"regexp_replace({out}, '{pattern}', chr(10), 'g')"
        out = f"' ' || regexp_replace({out}, '{MARKS}', '  ', 'g') || ' '"
        for old, new in SPELLINGS:
            out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    values = ", ".join(f"({k}, {quote(n)}, {quote(t)})" for k, (n, t) in enumerate(all_known()))
    return f"""
    WITH listed AS (SELECT k, licence, replace(joined, '\xb6', chr(10)) AS text FROM (VALUES {values}) AS v(k, licence, joined)),
    known AS (SELECT sha256(c) AS d, min(licence) AS licence FROM (SELECT licence, {clean('text')} AS c FROM listed) WHERE c <> '' GROUP BY 1),
    docs AS (SELECT doc_id, {clean('text')} AS c FROM ({rows}))
    SELECT doc_id, sha256(c) AS digest, CAST(length(c) AS BIGINT) AS n_canonical, licence
    FROM docs LEFT JOIN known ON sha256(c) = d
    """
