"""Licence scans by canonical digest, by DataFrame operations only.

A text's canonical form drops case, copyright lines, punctuation and differences of spelling that licences are
known to have. Texts are known licences if the digests of their canonical forms are equal; so are single lines,
which find the short notices that stand in for a licence.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable
from functools import lru_cache
from hashlib import sha256
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.plans.shared import few, sized, written

# Equivalent spellings (word, canonical word).
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("owner", "holder"),
    ("https", "http"),
]

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_GPL_HEADER = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {what}. If not, see <http://www.gnu.org/licenses/>."""

# The short licences, and the headers of files, as entire texts.
SHORT = [
    ("MIT", _MIT), ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")), ("0BSD", _ISC.format("")),
    ("BSD-2-Clause", _BSD.format("")), ("BSD-3-Clause", _BSD.format(_BSD3)), ("Zlib", _ZLIB), ("Unlicense", _UNLICENSE), ("BSL-1.0", _BSL), ("Apache-2.0", _APACHE_HEADER), ("MPL-2.0", _MPL_HEADER),
    *[(f"{short}-{version}", _GPL_HEADER.format(what=what, colon=colon, name=name, version=version.removesuffix(".0"))) for short, name, version in (
        ("GPL", "General Public License", "2.0"), ("GPL", "General Public License", "3.0"), ("AGPL", "Affero General Public License", "3.0"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Lesser General Public License", "3.0"))
      for what, colon in (("program", ":"), ("program", ";"), ("library", ";"))],
]
# Names under which licences are known.
NAMES = {
    "MIT": ["MIT License", "MIT", "Expat License"], "ISC": ["ISC License", "ISC"], "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"], "Zlib": ["zlib License"], "Unlicense": ["Unlicense"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License", "Apache License Version 2.0, January 2004"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"], "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1"],
    **{f"{short}-{v}": [form for n in dict.fromkeys((v.removesuffix(".0"), v)) for form in (f"{name}, version {n}", f"{name} version {n}", f"{name} v{n}", f"{short} v{n}", f"{short}v{n}", f"{short}-{n}", f"GNU {short} v{n}", f"GNU {short} version {n}")]
       for short, name, vs in (("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",)), ("GFDL", "GNU Free Documentation License", ("1.2", "1.3"))) for v in vs},
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0"],
    **{f"CC-{short}-{v}": [f"CC {short} {v}", f"CC-{short}-{v}", f"Creative Commons {name} {v} License", f"Creative Commons {name} {v} {'International' if v == '4.0' else 'Unported'} License"]
       for short, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("3.0", "4.0")},
}
# Parts of the notices that name a licence.
SUBJECTS = ["", "this work is", "this software is", "this project is", "this program is", "this library is", "this file is", "this document is", "this code is", "this repository is", "it is"]
VERBS = ["licensed", "released", "distributed", "published", "available", "made available"]
ARTICLES = ["", "the", "the terms of the"]

#: Lines that name a holder, not terms: copyright with a sign, a year or nothing but names.
COPYRIGHT_LINE = (
    r"(?m)^[ \t*#/;-]*(?:(?i:copyright[ \t]*(?:\(c\)|©|[0-9]|\[|<|\{)|\(c\)[ \t]*(?:copyright|[0-9])|©|all rights reserved)"
    r"|[Cc]opyright[ \t]+(?:by[ \t]+)?\p{Lu}[^ \t\n]*(?:[ \t]+(?:and|of|the|&|\p{Lu}[^ \t\n]*|[0-9(<][^ \t\n]*))*[ \t]*$).*$"
)
MARKS = r"[^\p{L}\p{N}\n]+"


def _words(text: Column) -> Column:
    """The canonical words of a text, line ends among them."""
    t = F.regexp_replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\r"), F.lit(" ")), COPYRIGHT_LINE, "")
    t = F.replace(F.regexp_replace(F.lower(t), MARKS, " "), F.lit("\n"), F.lit(" \n "))
    other = F.create_map(*[F.lit(w) for pair in SPELLINGS for w in pair])
    return F.filter(F.transform(F.split(t, " "), lambda w: F.when(w.isin([a for a, _ in SPELLINGS]), other[w]).otherwise(w)), lambda w: w != "")


def canonical_lines(text: Column) -> Column:
    """array of the lines' canonical forms: lower-case words with one space between; of a null text, one empty line."""
    return F.transform(F.split(F.array_join(_words(text), " "), "\n"), lambda s: F.trim(s))


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda s: s != ""), " ")


def canonical(text: Column) -> Column:
    """The canonical form: lower-case words with one space between; of a null text, the empty string."""
    return _joined(canonical_lines(text))


_COPYRIGHT = re.compile(COPYRIGHT_LINE.removeprefix("(?m)").replace(r"\p{Lu}", "[A-Z]"), re.M)


def canonical_text(text: str) -> str:
    """canonical() of a text whose capitals at the head of names are ASCII."""
    t = re.sub(r"[\W_]+", " ", _COPYRIGHT.sub("", text.replace("\r", " ")).lower())
    other = dict(SPELLINGS)
    return " ".join(other.get(w, w) for w in t.split())


def known_texts() -> list[tuple[str, str]]:
    """(id, text): the entire texts of the short and the long licences, under their names as headings and without them; of long ones also
    only the terms."""
    out = []
    for path in sorted(Path(__file__).with_name("license_texts").glob("*.txt")):
        text = path.read_text("utf-8")
        terms, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        out += [(path.stem, t) for t in dict.fromkeys((text, terms + end, terms))]
    for name, text in SHORT:
        heads = ["", *[h for n in NAMES.get(name, []) for h in (n, f"The {n}", f"{n} ({name})", f"The {n} ({name})")]]
        out += [(name, f"{h}\n\n{text}") for h in heads]
    return out


def notices() -> Iterable[tuple[str, str]]:
    """(id, canonical form) of all notices that name a licence."""
    for (name, forms), subject, verb, article in itertools.product(NAMES.items(), SUBJECTS, VERBS, ARTICLES):
        for form in forms:
            yield name, canonical_text(f"{subject} {verb} under {article} {form}")


@lru_cache(1)
def known_forms() -> dict[str, str]:
    """Canonical form -> id, of texts and notices; of several ids the least."""
    forms: dict[str, str] = {}
    for name, form in itertools.chain(((i, canonical_text(t)) for i, t in known_texts()), notices()):
        forms[form] = min(name, forms.get(form, name))
    return forms


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest, n): the digests and lengths of the canonical forms of known licences; without a list those of this module."""
    if known is None:
        rows = [(name, sha256(form.encode()).hexdigest(), len(form)) for form, name in known_forms().items()]
        return spark.createDataFrame(rows, "license_id string, digest string, n int")
    rows = spark.createDataFrame(known, "license_id string, text string").withColumn("form", canonical(F.col("text")))
    return rows.where("form <> ''").groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("form")).alias("n"))


#: Lengths of known texts up to which lines of other lengths are left out before they are hashed.
LENGTHS = 10_000


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, canonical_sha256, license_id, n_license_lines, line_license_ids) for every row of docs.

    known: (license_id, digest, n) as of known_licenses(), any number; of several licences with one digest the least id. license_id is
    that of the licence that the entire text is, else null. n_license_lines counts the lines that are a known text on
    their own, line_license_ids joins their distinct ids by commas, sorted. Null, blank and wordless texts have
    the digest of the empty string and no licence. Rows are judged one by one, also equal ones; other columns are ignored.

    One pass over the texts writes the digest of each and of its lines that are as long as a known text; all else is hash joins of
    digests, in which a common text or line is as good as any.
    """
    known = known.groupBy(F.unhex("digest").alias("digest")).agg(F.min("license_id").alias("license_id"), F.max("n").alias("n"))
    known = sized(written(known, "known-licenses"))
    lengths = few(known.select("n").distinct(), LENGTHS)
    text = docs.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col)).alias("lines"))
    asked = F.filter("lines", lambda s: F.length(s).isin([r["n"] for r in lengths]) if lengths is not None else s != "")
    digest = lambda s: F.unhex(F.sha2(s, 256))
    forms = text.select("id", digest(_joined(F.col("lines"))).alias("digest"), F.transform(asked, digest).alias("lines"))
    forms = written(forms.withColumn("row", F.monotonically_increasing_id()), "license-forms")
    hits = forms.select("row", F.explode("lines").alias("digest")).join(known, "digest").groupBy("row").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("license_id")).alias("ids"))
    hits = sized(written(hits, "license-lines"))
    out = forms.drop("lines").join(known.drop("n"), "digest", "left").join(hits, "row", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("digest")).alias("canonical_sha256"), "license_id", F.coalesce("n", F.lit(0)).alias("n_license_lines"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("line_license_ids"))
