r"""License scans by canonical digests, on DataFrame functions alone.

A text is normalised as a whole (lower case, copyright lines away, equivalent spellings made one, everything but letters and digits
one space) and its SHA-256 is hash-joined to the digests of known licence texts. The same join over a text's lines finds known
notices: a line whose canonical length no known text has can be none, all others are joined. The known texts are a parameter;
KNOWN has common short licences and notices, and texts_of_folder() reads a folder of whole licence texts.

Defined cases: null text is empty; a text that is empty once normalised matches nothing; repeated rows get a row each; a licence
known under two names takes the first in order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, text_of

#: Spellings that mean the same.
SPELLINGS = {"licence": "license", "licenced": "licensed", "sublicence": "sublicense", "organisation": "organization", "favour": "favor", "non commercial": "noncommercial", "merchantibility": "merchantability", "per cent": "percent", "copyright holder": "copyright owner"}
#: Licence texts and notices, as published.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
    "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL '
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.\n\n" + _WARRANTY
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} "
    "of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details.\n\nYou should have received a copy of the GNU {0}General Public License along with "
    "this program. If not, see <https://www.gnu.org/licenses/>."
)
KNOWN = {
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD + _BSD_WARRANTY,
    "BSD-2-Clause-untitled": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + _BSD + _BSD_3 + _BSD_WARRANTY,
    "BSD-3-Clause-untitled": _BSD + _BSD_3 + _BSD_WARRANTY,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
    "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
    "copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be "
    "an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit '
    "third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this "
    "restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
    "solely in the form of machine-executable object code generated by a source language processor.\n\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND '
    "NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
    "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
    "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0-or-later-header": _GNU.format("", "2"),
    "GPL-3.0-or-later-header": _GNU.format("", "3"),
    "LGPL-3.0-or-later-header": _GNU.format("Lesser ", "3"),
    "AGPL-3.0-or-later-header": _GNU.format("Affero ", "3"),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    **{f"{i}-tag": f"SPDX-License-Identifier: {i}" for i in ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "CC0-1.0", "Unlicense")},
    "MIT-untitled": _MIT,
    "MIT-0": _MIT.split(", subject to the following")[0] + ".\n\n" + _WARRANTY,
    "MIT": "MIT License\n\n" + _MIT,
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies.\n\n" + _ISC,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC,
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: A copyright line: a mark, a year or a placeholder stands after its first word. A wrapped licence has other lines that begin with that word.
_COPYRIGHT = r"(?im)^[ \t]*(?:copyright[ \t:]*(?:\(c\)|©|[0-9]{4}|[\[<{])|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]{4}|[\[<{]))[^\n]*$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.regexp_replace(text, _COPYRIGHT, "")), "[^a-z0-9]+", " ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def canonical_text(text: str) -> str:
    """The same in Python, for the known texts."""
    out = " " + re.sub("[^a-z0-9]+", " ", re.sub(_COPYRIGHT, "", text).lower()).strip() + " "
    for a, b in SPELLINGS.items():
        out = out.replace(f" {a} ", f" {b} ")
    return out.strip()


def digests(known: dict[str, str] = KNOWN) -> dict[str, str]:
    """Digest to name."""
    out: dict[str, str] = {}
    for name, text in sorted(known.items()):
        out.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
    return out


def known_table(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    return spark.createDataFrame(sorted(digests(known).items()), "digest string, license string")


def texts_of_folder(spark: SparkSession, folder: str) -> dict[str, str]:
    """Whole licence texts of a folder of .txt files, by file name: for known. A list of licences is small by its nature."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.input_file_name().alias("f"), "value").collect()
    return {r["f"].rsplit("/", 1)[-1].removesuffix(".txt"): r["value"] for r in rows}


def scan(docs: DataFrame, known: dict[str, str] = KNOWN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, canonical_sha256, license (of the whole text, else null), notices (of its lines: sorted names)."""
    table = known_table(docs.sparkSession, known)
    digest = lambda t: F.sha2(t.cast("binary"), 256)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    lengths = sorted({len(canonical_text(t)) for t in known.values()} - {0})
    lines = F.filter(F.transform(F.split("text", r"\n"), canonical), lambda x: F.length(x).isin(lengths))
    rows = rows.select("doc_id", digest(canonical(F.col("text"))).alias("canonical_sha256"), F.array_sort(F.array_distinct(F.transform(lines, digest))).alias("lines"))
    rows = materialize(rows, "digests")  # texts are read once; from here on only digests move
    some = rows.filter(F.size("lines") > 0).select("lines").distinct()
    names = some.select("lines", F.explode("lines").alias("digest")).join(table.withColumnRenamed("license", "name"), "digest").groupBy("lines").agg(F.array_sort(F.collect_set("name")).alias("notices"))
    names = materialize(names, "notices")  # one row per distinct set of lines, so that a common one can be split on the other side
    found = rows.join(table, F.col("canonical_sha256") == F.col("digest"), "left").join(names, "lines", "left")
    return found.select("doc_id", "canonical_sha256", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op8_license_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "canonical_sha256", "license", F.array_join("notices", ",").alias("notices"))


def _sql_canonical(text: str) -> str:
    out = f"' ' || trim(regexp_replace(lower(regexp_replace({text}, '{_COPYRIGHT}', '', 'g')), '[^a-z0-9]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS.items():
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


OP8_SQL = f"""
WITH known(digest, license) AS (VALUES {", ".join(f"('{d}', '{n}')" for d, n in sorted(digests().items()))}),
d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (
  SELECT row_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT row_id, sha256({_sql_canonical("line")}) AS digest FROM l) x JOIN known USING (digest) GROUP BY row_id
), w AS (SELECT row_id, doc_id, sha256({_sql_canonical("text")}) AS canonical_sha256 FROM d)
SELECT doc_id, canonical_sha256, license, coalesce(notices, '') AS notices FROM w LEFT JOIN known ON canonical_sha256 = digest LEFT JOIN n USING (row_id)
"""
