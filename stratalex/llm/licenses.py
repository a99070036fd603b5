"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines taken out, punctuation and white
space made one blank, equivalent spellings made one. The digests of the canonical forms of known
licence texts and notices are the catalogue; a document is a licence if the digest of its entire text is
in it (hash join), and it carries a notice if that of one of its lines is.

The catalogue is fixed data of a few entries, short texts and notices in full and long licences as digests; more texts can be given as
(name, text) pairs, a list that the caller holds in the driver. A table of any size is scanned in the same way: whole texts are joined by digest (the
planner sends the catalogue along while it is small), and a text's lines are looked up where they stand, in the set of the catalogue's digests.

Defined results: a null text is an empty one, which is no licence; a very long text is judged whole; repeated rows, rows that share a doc_id and rows without one are
judged one by one, by their texts; two catalogue texts with one canonical form are reported by the first name in order; a line that is there twice counts twice;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that licence matching treats as one, as public matching guidelines list them.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("non commercial", "noncommercial"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("behaviour", "behavior"),
    ("honour", "honor"), ("centre", "center"), ("programme", "program"), ("wilful", "willful"), ("fulfil ", "fulfill "), ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"), ("merchantability", "merchantability"), ("per cent", "percent"), ("while st", "whilst"), ("copyright owner", "copyright holder"), ("https ", "http "),
)
#: Notices, and the texts of short public licences.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = "\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_REST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEXTS = {
    "MIT": (_MIT_GRANT, f"MIT License\n\n{_MIT_GRANT}", f"The MIT License (MIT)\n\n{_MIT_GRANT}"),
    "ISC": (f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.{_ISC_REST}", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.{_ISC_REST}"),
    "0BSD": (f"{_ISC_GRANT}.{_ISC_REST}", f"BSD Zero Clause License\n\n{_ISC_GRANT}.{_ISC_REST}"),
    "BSD-2-Clause": (_BSD_TWO + _BSD_REST, f"BSD 2-Clause License\n\n{_BSD_TWO}{_BSD_REST}"),
    "BSD-3-Clause": (_BSD_TWO + _BSD_THREE + _BSD_REST, f"BSD 3-Clause License\n\n{_BSD_TWO}{_BSD_THREE}{_BSD_REST}"),
}
CATALOGUE = [(name, text) for known in (NOTICES, TEXTS) for name, texts in known.items() for text in texts]
#: Digests of the canonical forms of long licence texts, as Debian's common-licenses has them (Boost and Unlicense: as their
#: projects publish them); those with an "END OF TERMS" line also cut before and after it, Apache-2.0 also with its appendix filled in.
DIGESTS = {
    "Apache-2.0": ("824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    "Artistic-1.0-Perl": ("08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",),
    "BSD-3-Clause": ("21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",),
    "BSL-1.0": ("4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",),
    "GFDL-1.3": ("2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",),
    "GPL-1.0": ("89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    "GPL-2.0": ("6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    "GPL-3.0": ("092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", "5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d"),
    "LGPL-2.0": ("430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    "LGPL-2.1": ("bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",),
    "MPL-2.0": ("6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",),
    "Unlicense": ("e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229",),
}
#: A line that states a copyright: the word or sign first, and a year or a second sign after it.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©)[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"


def canonical_lines(text: Column) -> Column:
    """The canonical form, with line breaks kept."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.when(low.contains("copyright") | low.contains("©") | low.contains("(c)") | low.contains("reserved"), F.regexp_replace(low, COPYRIGHT_LINE.replace("(?m)", "(?md)"), "")).otherwise(low)
    out = F.regexp_replace(low, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def catalogue(spark, texts: list[tuple[str, str]] = CATALOGUE) -> DataFrame:
    """digest, name: a row for each canonical form, those of ``DIGESTS`` among them."""
    known = spark.createDataFrame(texts, "name string, text string")
    long = spark.createDataFrame([(name, d) for name, found in DIGESTS.items() for d in found], "name string, digest string")
    return known.select("name", F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("digest")).union(long).groupBy("digest").agg(F.min("name").alias("name"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] = CATALOGUE) -> DataFrame:
    """doc_id, text_sha256 (of the canonical form), license (of the entire text), n_notices, notices for every row."""
    known = catalogue(docs.sparkSession, texts)
    names = {r["digest"]: r["name"] for r in known.collect()}  # no more than ``texts`` has
    rows = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("lines")), 256).alias("text_sha256"), F.transform(F.filter(F.split("lines", "\n"), lambda x: F.length(x) > 1), lambda x: F.sha2(F.trim(x), 256)).alias("lines"))
    whole = rows.join(known.select(F.col("digest").alias("text_sha256"), F.col("name").alias("license")), "text_sha256", "left")
    hits = whole.withColumn("hits", F.filter("lines", lambda x: x.isin(list(names))))
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = hits.withColumn("names", F.transform("hits", lambda x: F.element_at(name, x)))
    return found.select("doc_id", "text_sha256", "license", F.size("names").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("names")), ",").alias("notices"))
