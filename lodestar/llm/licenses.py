"""Licence scans by canonical digests.

A text is canonicalised: case, punctuation, white space, list marks, equivalent
spellings, copyright lines, lines that reserve rights, and lines that are only a
licence's title. Its digest is hash-joined to those of known licence texts. Lines
are canonicalised alike, and a line that as a whole is a known notice is
reported apart, so that documents which only name their licence show.

Known texts are short ones given whole, from which digests are made, and a
table of digests of the long ones (each licence whole, and without the
instructions that follow its terms).

Cases. A null or empty text, or one of punctuation or titles only, has no
digest and no licence. Very long texts are canonicalised whole. A digest known
for two licences names the first by id. Repeated rows are looked up alike, and
notices are named once, by id. No rows: no result. Columns beside doc_id and
text don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted

# Whole licence texts, without titles and copyright lines.
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS,
    "BSD-2-Clause": f"{_BSD_START}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD_START}\n{_BSD_NAMES}\n{_BSD_END}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n" + _AS_IS,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\nFor more information, please refer to <https://unlicense.org>",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
}
# Canonical digests of long licences, whole and without the instructions after their terms.
DIGESTS = {
    "4ff861c75a85d14a22ef345b861391b5": "Apache-2.0",  # whole
    "efc22f6d9541ba120b0610a29bfe15a4": "Apache-2.0",  # to the end line
    "1b41b6ee9d2608371de600f9a4ee53ab": "Apache-2.0",  # terms
    "6abc428af45281a1531ed1fb0263c579": "Artistic-1.0-Perl",  # whole
    "33b60d2bcc436a336d1830b3b1c03687": "CC0-1.0",  # whole
    "745844caf82f8151052145fca68bb6cf": "GFDL-1.2",  # whole
    "a94785d0e73aa7e3b763067f2f0e5935": "GFDL-1.3",  # whole
    "8c823a9adf5cbce56c0f4f4a93511202": "GPL-1.0",  # whole
    "8596f4e2dbcbd416b5cd53a513583bb0": "GPL-1.0",  # to the end line
    "8fe03fbd9471ff4ea3a9c4a715078424": "GPL-1.0",  # terms
    "fca3854390634db9672d584b3039c1e9": "GPL-2.0",  # whole
    "c0c91f542845034015300f4fafad3912": "GPL-2.0",  # to the end line
    "0f50bf05fb8392f7452b150508137254": "GPL-2.0",  # terms
    "2619083e8783d99aa5d1ae90f76b3d19": "GPL-3.0",  # whole
    "abc048d8879e34e3c8e3fd693fd103b1": "GPL-3.0",  # to the end line
    "29688b918ae860e7b79c7f50e4704da6": "GPL-3.0",  # terms
    "3decd8f0137155c4db40fbefd03c12ef": "LGPL-2.0",  # whole
    "1fc26f8c34fe8d0366dbad7bd2b98085": "LGPL-2.0",  # to the end line
    "2dfc6072b983d92472492daaaba74577": "LGPL-2.0",  # terms
    "91ba25ca8f9f00804cd852c0fdac9dda": "LGPL-2.1",  # whole
    "cec1622275ab5e49efbec66d4548c0d6": "LGPL-2.1",  # to the end line
    "93573ef3d8b2d05732099e21d91f5190": "LGPL-2.1",  # terms
    "45ec14853d944805ef573d0b3a40cda3": "LGPL-3.0",  # whole
    "ff18fd2034daa157f078fb9bf3c9f9fa": "MPL-1.1",  # whole
    "ef6d2afa8495693e1399599484c831ae": "MPL-2.0",  # whole
}
# Notices of one line.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."],
    "ISC": ["SPDX-License-Identifier: ISC"],
}
# Lines that are only a title or reserve rights, canonical.
TITLES = ["all rights reserved", "mit license", "the mit license", "the mit license mit", "mit license mit", "expat license", "isc license", "the isc license", "isc license isc", "bsd license", "the bsd license", "new bsd license", "simplified bsd license", "bsd 2 clause license", "the bsd 2 clause license", "bsd 3 clause license", "the bsd 3 clause license", "bsd 2 clause simplified license", "bsd 3 clause new or revised license", "zlib license", "the zlib license", "bsd zero clause license", "mit no attribution", "the unlicense", "unlicense", "boost software license version 1 0 august 17th 2003"]
# Equivalent spellings, in lower case; the second stands for both.
SPELLINGS = [("licence", "license"), ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("fulfil ", "fulfill "), ("fulfilment", "fulfillment"), ("https", "http"), ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("noncommercial", "non-commercial"), ("noninfringement", "non-infringement"), ("non infringement", "non-infringement"), ("offence", "offense"), ("organis", "organiz"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful")]
#: Replacements in lower-cased text, in this order (Java and RE2 spelling): copyright lines, list marks, punctuation, line breaks.
STEPS = [
    (r"(^|\n)[^a-z0-9\n]*(copyright[ \t:]*(\(c\)|©|[0-9]{4}|by |[<\[{])|\(c\)|©)[^\n]*", r"$1"),
    (r"(^|\n)[ \t]*(\(?([0-9]{1,2}|[a-z])[.)]|[*•-])[ \t]+", r"$1"),
    (r"[^\p{L}\p{N}\n]+", " "),
    (r" ?\n[ \n]*", "\n"),
]


def canonical(text: Column) -> Column:
    """The text's canonical lines."""
    out = F.lower(F.coalesce(text, F.lit("")))
    # One search tells whether any spelling has to be replaced.
    spelt = out
    for a, b in SPELLINGS:
        spelt = F.replace(spelt, F.lit(a), F.lit(b))
    out = F.when(out.rlike("|".join(a for a, _ in SPELLINGS)), spelt).otherwise(out)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.btrim(out, F.lit(" \n"))


def digest(canonical_text: Column) -> Column:
    """Of the words, wherever lines break, without titles; null without any."""
    lines = F.filter(F.split(canonical_text, "\n"), lambda x: ~x.isin(TITLES))
    plain = F.translate(canonical_text, "\n", " ")
    # Titles are sought only where a line can be one.
    titled = F.concat(F.lit("\n"), canonical_text, F.lit("\n")).rlike("\n(?:" + "|".join(TITLES) + ")\n")
    out = F.when(titled, F.array_join(lines, " ")).otherwise(plain)
    return F.when(out != "", F.md5(out))


def known(spark: SparkSession, texts: dict[str, str], digests: dict[str, str] | None = None) -> DataFrame:
    """digest and license of each known text, and of each known digest."""
    rows = spark.createDataFrame(list(texts.items()), "license string, text string")
    rows = rows.select(digest(canonical(F.col("text"))).alias("digest"), "license")
    if digests:
        rows = rows.unionByName(spark.createDataFrame(list(digests.items()), "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None, digests: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license (of the whole text, or null), notices (licences that lines name, in order of their ids, comma-joined).

    digests: known digests and their licences; as a table (digest, license) of any number, which is broadcast up to a measured size."""
    notices = NOTICES if notices is None else notices
    spark, given = docs.sparkSession, DIGESTS if texts is None and digests is None else digests
    whole = known(spark, TEXTS if texts is None else texts, given if isinstance(given, dict) else None)
    if isinstance(given, DataFrame):
        whole = whole.unionByName(given.select("digest", "license")).groupBy("digest").agg(F.min("license").alias("license"))
    whole = counted(whole)
    line = {k: [F.md5(canonical(F.lit(x))) for x in v] for k, v in sorted(notices.items())}
    # The notices' digests are constants of the plan; licences are few.
    df = docs.select("doc_id", canonical(F.col("text")).alias("_c"))
    lines = F.split("_c", "\n")
    if all("licen" in x.lower() for v in notices.values() for x in v):  # then so must a line be
        lines = F.filter(lines, lambda x: x.contains("licen"))
    df = df.select("doc_id", digest(F.col("_c")).alias("digest"), F.transform(lines, lambda x: F.md5(x)).alias("_lines"))
    named = F.concat_ws(",", *(F.when(F.arrays_overlap("_lines", F.array(*v)), F.lit(k)) for k, v in line.items()))
    df = df.withColumn("notices", F.when(F.size("_lines") > 0, named).otherwise(""))
    return df.join(whole, "digest", "left").select("doc_id", "digest", "license", "notices")
