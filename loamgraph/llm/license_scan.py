"""License scans by canonical digest lookup.

A text is normalised (case, punctuation, copyright lines, equivalent spellings) and hashed; the digest is
joined to the digests of known licence texts, normalised the same way. The known table is small and its number of
rows is checked, so it is broadcast and the scan needs no shuffle, whatever number of copies a text has.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line that only names the holder of rights; it starts with a mark, a year or a placeholder after "copyright".
COPYRIGHT_LINE = r"(?m)^[ \t*#/;<!-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[)|\(c\)|©|all rights reserved)[^\n]*$"

#: Equivalent spellings (from, to), on words in lower case between spaces. Fixed values.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("behaviour", "behavior"), ("catalogue", "catalog"), ("centre", "center"), ("copyright holder", "copyright owner"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelled", "labeled"), ("labelling", "labeling"),
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("recognise", "recognize"),
    ("sub license", "sublicense"), ("sub licensable", "sublicensable"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)

_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n"
)
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
    "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Short public licence texts by SPDX identifier, without titles. Fixed values; the long ones are files in licenses/.
KNOWN = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _NO_WARRANTY,
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
    "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
    "whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, "
    "this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such "
    "copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT "
    "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO "
    "EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
    "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": _BSD + _AS_IS,
    "BSD-3-Clause": _BSD
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission.\n" + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
    "and this permission notice appear in all copies.\n" + _NO_WARRANTY,
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software.\n" + _MIT_WARRANTY,
    "Unlicense": "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
    "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or "
    "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and "
    "to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
    "software under copyright law.\n" + _MIT_WARRANTY + "\nFor more information, please refer to <https://unlicense.org/>",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n"
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
    "this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
    "subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
    "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked "
    "as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
}
#: Titles that may stand before a short text. Fixed values.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License", "The 3-Clause BSD License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License Version 1.0"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004",),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}
#: One-line notices that stand for a licence. Fixed values.
NOTICES = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
#: Up to this many known texts are broadcast; with more, both sides are shuffled.
MOST_BROADCAST = 10_000


def known_texts() -> list[tuple[str, str]]:
    """(SPDX identifier, text) of all known texts: short ones with and without title and list numbers, long ones, notices."""
    rows = [*NOTICES.items()]
    for name, text in KNOWN.items():
        bare = re.sub(r"(?m)^[0-9]\. ", "", text)
        rows += [(name, f"{title}\n\n{body}") for title in ("", *TITLES[name]) for body in sorted({text, bare})]
    folder = Path(__file__).with_name("licenses")
    return rows + [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(folder.glob("*.txt"))]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, letters and digits only between single spaces, one spelling a word."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit("  "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit("  "))  # two blanks: neighbours share none
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """Hex SHA-256 of the canonical text."""
    return F.sha2(F.encode(canonical(text), "UTF-8"), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id and known_digest of the known texts (identifier, text), a digest once (the least identifier)."""
    rows = spark.createDataFrame(sorted(known_texts() if texts is None else texts), "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("known_digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_chars, canonical_sha256 and license_id (null: not a known licence text) of every document.

    A null text counts as empty; a text without letters and digits has the digest of the empty text and no
    licence. Repeated rows keep a result each. Other columns are ignored; an empty table gives no rows. A very long
    text is read whole, a row at a time.
    """
    own = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), digest(F.col("text")).alias("canonical_sha256"))
    texts = known_texts() if texts is None else texts
    known = known_digests(docs.sparkSession, texts)
    known = F.broadcast(known) if len(texts) <= MOST_BROADCAST else known
    return own.join(known, own["canonical_sha256"] == known["known_digest"], "left").select("doc_id", "n_chars", "canonical_sha256", "license_id")
