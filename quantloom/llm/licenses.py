"""Licence texts and notices by canonical digest.

A text's canonical form has no case, punctuation, title lines or copyright
statements and one spelling of each variant word; equal forms have equal digests,
so that finding known licences is a hash join.  Whole texts are looked up, and so
are lines and paragraphs of several lines, for notices inside other texts.  Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER

#: Spellings that count as equal, as (one, the other) on lower-cased text, wherever they stand.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("centre", "center"), ("customis", "customiz"), ("defence", "defense"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("https:", "http:"), ("judgement", "judgment"),
    ("labour", "labor"), ("licence", "license"), ("modelling", "modeling"), ("offence", "offense"), ("optimis", "optimiz"), ("organis", "organiz"), 
    ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
)
#: Phrases that count as equal, in canonical form, across lines too.
PHRASES = (("copyright holder", "copyright owner"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense"))
#: A line with a copyright statement: the word or sign, then a year, the sign or what stands for them.
COPYRIGHT = r"(^|\n)[^\na-z0-9(©]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|<|\[|\{)[^\n]*"
#: What numbers or marks an item of a list.
ITEM = r"(^|\n)[ \t]*([0-9a-z]{1,2}[.)]|\([0-9a-z]{1,3}\)|[*•-])[ \t]+"
#: Lines, in canonical form, that licence files may have or not.
TITLES = (
    "mit license", "the mit license", "the mit license mit", "mit license mit", "license mit", "isc license", "the isc license", "isc license isc", "bsd license", "the bsd license", "bsd 2 clause license", "the bsd 2 clause license",
    "simplified bsd license", "bsd 3 clause license", "the bsd 3 clause license", "new bsd license", "modified bsd license", "bsd zero clause license", "zero clause bsd license", "bsd zero clause license 0bsd", "the unlicense", "unlicense", "boost software license version 1 0 august 17th 2003", "apache license", "license", "copyright notice", "all rights reserved",
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r\v\f ‘’“”–—©"

_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_FREE = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
#: Identifiers that a line may name.
IDENTIFIERS = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0",
    "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "MS-PL",
    "MulanPSL-2.0", "NCSA", "OFL-1.1", "PostgreSQL", "PSF-2.0", "Unlicense", "UPL-1.0", "Vim", "WTFPL", "X11", "Zlib",
)
#: Notices and short licences that are known, by SPDX identifier.
NOTICES = (
    *[(i, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS],
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0-or-later", _FREE.format("program", ":", "General Public License", ",", 3)),
    ("GPL-2.0-or-later", _FREE.format("program", ";", "General Public License", ";", 2)),
    ("AGPL-3.0-or-later", _FREE.format("program", ":", "Affero General Public License", ",", 3)),
    ("LGPL-3.0-or-later", _FREE.format("program", ":", "Lesser General Public License", ",", 3)),
    ("LGPL-2.1-or-later", _FREE.format("library", ";", "Lesser General Public License", ";", "2.1")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("PSF-2.0", "Licensed to PSF under a Contributor Agreement."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _WARRANTY + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n' + _WARRANTY + ", TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format(_ENDORSE)),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
)
#: Digests and characters of the canonical forms of published full texts, by SPDX identifier.
DIGESTS = (
    ("Apache-2.0", "2d3a56efeeb46168d72acb8e9c256983dc0731f1380bbed8e8d7322b91fd6f8c", 9841),
    ("Apache-2.0", "b228b1088b761f923226ec5f7ef06e533dc728a495b02ec5be32ced9ac0f541a", 8825),
    ("Apache-2.0 WITH LLVM-exception", "9dd437995f5caf338f16026662e990a051309fcb1b3bd7e3feb84ee5783c4865", 10689),
    ("Artistic-1.0-Perl", "13caa6a0bc52f01d305d07b8139a4750d73ad358309326b68cc4acee2a5d977f", 5786),
    ("CC0-1.0", "8a20adffc7304b14c6abf18e4f5b5dd165c30fe18458e37e657014e4a1e7241a", 6663),
    ("GFDL-1.2", "547516be957ae32fee766d10b189f587e8f2d09498906d42c05d5e2194cf2daa", 19523),
    ("GFDL-1.3", "16b6e40aadeb1156523cc9f5b906bbe46eee9ef7f901168bb4b81f734621eff2", 21947),
    ("GPL-1.0", "6a33f26d5c86427c832672b0ab3915bbf94ebe4d01dc6b19f4180035af2d2345", 11721),
    ("GPL-2.0", "1ef3cc55061da7c7f1cfc95a05358eae49d757341f10d9b4d28d846bb97e3e34", 17068),
    ("GPL-3.0", "8621f2b758ed7debe0deba99006cdd5056127960bd32c099c69b3fed055f64a9", 33309),
    ("LGPL-2.0", "7bee82a3f6b4deac2fbc1fa2bc32a36736a2a441f8bfd70a0c1fe50fb23a7192", 24060),
    ("LGPL-2.1", "52602f02a5e90ec1c1c5d1739619223c0fa9814261ddab755e3bfb448afed970", 25145),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45", 7064),
    ("MPL-1.1", "1c9c5a36f4143da9517b2bec7ceadc1e0d0012e9f491e8d05352a866e3ea9cfb", 22367),
    ("MPL-2.0", "d2954ecddd82787482d526252c2595f628a7e2ccd8c32b969382705b61c7ed8d", 14302),
    ("Unicode-DFS-2016", "1f2749af31d35bc19b598494c2e077419b5915a3c774b0a0d27cee2c40aacb48", 1891),
    ("Zlib", "9ddc78a5797b5008d488969fd959f4281a97821e07ddc5d19ca9c163fdbeeb73", 778),
)


def _lines(text: Column) -> Column:
    """The canonical lines of a text, empty ones included."""
    t = F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, r"$1"), ITEM, r"$1")
    for one, other in SPELLINGS:
        t = F.replace(t, F.lit(one), F.lit(other))
    t = F.regexp_replace(F.translate(t, PUNCTUATION, " " * len(PUNCTUATION)), " +", " ")
    t = F.regexp_replace(t, " ?\\n ?", "\n")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: ~x.isin(*TITLES))


def _phrased(form: Column) -> Column:
    for one, other in PHRASES:
        form = F.replace(form, F.lit(one), F.lit(other))
    return form


def _whole(lines: Column) -> Column:
    return _phrased(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def _units(lines: Column) -> Column:
    """Lines, and paragraphs of several lines as one."""
    paragraphs = F.filter(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda x: F.instr(F.trim(x, F.lit("\n")), "\n") > 0)
    units = F.concat(F.filter(lines, lambda x: x != ""), F.transform(paragraphs, lambda x: F.replace(F.trim(x, F.lit("\n")), F.lit("\n"), F.lit(" "))))
    return F.transform(units, lambda x: _phrased(x))


def digest(text: Column) -> Column:
    return F.sha2(_whole(_lines(text)), 256)


def known_digests(spark: SparkSession, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """license, digest, size; one row for each known canonical form. size: characters of the form, null where only its digest is known."""
    rows = spark.createDataFrame(list(notices), "license string, text string").select("license", _whole(_lines(F.col("text"))).alias("form"))
    rows = rows.select("license", F.sha2("form", 256).alias("digest"), F.length("form").alias("size"))
    if digests:
        rows = rows.unionByName(spark.createDataFrame(list(digests), "license string, digest string, size int"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.max("size").alias("size"))


def scan(docs: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_known: int = 100_000) -> DataFrame:
    """For each row: digest of its canonical form, license (its whole text's, or null), n_notices (lines, and
    paragraphs of several lines, that are known) and notice_licenses (their distinct licences, sorted, comma-joined).

    known: license, digest and size, as known_digests() gives them for any texts.  Only what is as long as a known form
    is looked up; where a size is null everything is.  Null and empty texts have the digest of the empty form and no
    licence; an empty table gives an empty result.  Each row is judged alone, so repeated rows give repeated results;
    other columns are not looked at.  Known digests of up to max_known rows are broadcast; more are joined by a shuffle.
    """
    seen = known.select("size").distinct().limit(max_known + 1).collect()  # numbers only
    sizes = sorted({r["size"] for r in seen if r["size"] is not None})
    some = len(seen) <= max_known and all(r["size"] is not None for r in seen)
    small = known.limit(max_known + 1).count() <= max_known
    side = F.broadcast if small else (lambda x: x)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _lines(text).alias("canonical"), F.monotonically_increasing_id().alias("row"))
    units = F.filter(_units(F.col("canonical")), lambda x: F.length(x).isin(*sizes)) if some and sizes else F.array().cast("array<string>") if some else _units(F.col("canonical"))
    rows = rows.select("id", "row", F.sha2(_whole(F.col("canonical")), 256).alias("digest"), F.transform(units, lambda x: F.sha2(x, 256)).alias("units"))
    found = rows.select("id", "digest", "row", F.explode_outer("units").alias("unit"))
    found = found.join(side(known.select(F.col("digest").alias("unit"), F.col("license").alias("notice"))), "unit", "left")
    per = found.groupBy("id", "digest", "row").agg(F.count("notice").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notice_licenses"))
    whole = per.join(side(known.select("digest", "license")), "digest", "left")
    return whole.select(F.col("id").alias(id_col), "digest", "license", "n_notices", "notice_licenses")


def report(docs: DataFrame) -> DataFrame:
    """Query op7; a row for each row of docs."""
    return scan(docs, known_digests(docs.sparkSession))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lines_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '\\1', 'g'), '{ITEM}', '\\1', 'g')"
    for one, other in SPELLINGS:
        t = f"replace({t}, '{one}', '{other}')"
    chars = " || ".join(f"chr({ord(c)})" for c in PUNCTUATION)
    return f"list_filter(list_transform(string_split(translate({t}, {chars}, repeat(' ', {len(PUNCTUATION)})), chr(10)), lambda l: trim(regexp_replace(l, ' +', ' ', 'g'), ' ')), lambda l: l not in ({', '.join(map(_sql_text, TITLES))}))"


def oracle() -> str:
    known = ", ".join(f"({_sql_text(k)}, {_sql_text(t)})" for k, t in NOTICES)
    full = "".join(f", ({_sql_text(k)}, {_sql_text(x)})" for k, x, _ in DIGESTS)[2:]
    def phrased(x: str) -> str:
        for one, other in PHRASES:
            x = f"replace({x}, '{one}', '{other}')"
        return x

    whole = lambda x: phrased(f"array_to_string(list_filter({x}, lambda l: l <> ''), ' ')")
    return f"""
    with texts as (select k, {_lines_sql("t")} as c from (values {known}) v(k, t)),
    known as (select digest, min(k) as license from (select k, sha256({whole("c")}) as digest from texts{f" union all select * from (values {full}) w(k, digest)" if full else ""}) group by 1),
    d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
    c as (select r, doc_id, {_lines_sql("text")} as lines from d),
    p as (select r, list_filter(list_transform(regexp_split_to_array(array_to_string(lines, chr(10)), '\n\n+'), lambda x: trim(x, chr(10))), lambda x: contains(x, chr(10))) as several from c),
    units as (select r, unnest(list_filter(lines, lambda l: l <> '')) as unit from c union all select r, replace(unnest(several), chr(10), ' ') from p),
    notes as (select r, k.license from units join known k on k.digest = sha256({phrased('unit')})),
    agg as (select r, count(*) as n, string_agg(distinct license, ',' order by license) as names from notes group by r),
    whole as (select r, doc_id, sha256({whole("lines")}) as digest from c)
    select w.doc_id, w.digest, k.license, coalesce(a.n, 0) as n_notices, coalesce(a.names, '') as notice_licenses
    from whole w left join agg a on a.r = w.r left join known k on k.digest = w.digest"""
