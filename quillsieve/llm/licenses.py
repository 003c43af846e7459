"""Whole texts that are a known licence, by the digest of a canonical form."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spellings that count as equal, after punctuation is gone.
EQUIVALENT = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("initialise", "initialize"),
    ("merchantibility", "merchantability"),
    ("whilst", "while"),
    ("non infringement", "noninfringement"),
    ("https", "http"),
    ("all rights reserved", ""),
)
# Titles that may stand before a text, in canonical form; the longest that fits goes.
TITLES = (
    "mit license", "mit license mit", "mit no attribution", "mit no attribution license", "expat license",
    "isc license", "isc license isc", "bsd zero clause license", "zero clause bsd license", "0bsd license",
    "bsd license", "bsd 2 clause license", "2 clause bsd license", "bsd 2 clause simplified license", "simplified bsd license", "freebsd license",
    "bsd 3 clause license", "3 clause bsd license", "bsd 3 clause new or revised license", "new bsd license", "modified bsd license", "revised bsd license",
    "zlib license", "zlib libpng license", "unlicense", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0",
    "apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004", "apache license version 2 0", "apache license 2 0",
    "gnu general public license version 2 june 1991", "gnu general public license version 3 29 june 2007",
    "gnu lesser general public license version 2 1 february 1999", "gnu lesser general public license version 3 29 june 2007",
    "mozilla public license version 2 0", "mozilla public license version 1 1", "creative commons legal code cc0 1 0 universal", "cc0 1 0 universal",
)
_YEAR = r"(?:19|20)[0-9][0-9]"
#: A notice on a line of its own: the word with a mark, a year or a placeholder, or a mark with a year. A wrapped sentence that begins with the word is none.
_COPYRIGHT_LINE = (
    r"(^|\n)[^\p{L}\p{N}\n]*(?:(?:portions )?(?:copyright|copr)[ \t:.]*(?:\(c\)|©|" + _YEAR + r"|[<\[{(] ?(?:year|yyyy)|year\b|yyyy\b)|\(c\)[ \t]*" + _YEAR + r"|©)[^\n]*"
)
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
#: A list mark such as 1. or (b), wherever it stands, as line ends don't count.
_LIST_MARK = r"(^| )\(?[0-9a-z]{1,2}[.)]( |$)"
_TITLE = "^(?:the )?(?:" + "|".join(sorted(TITLES, key=lambda t: (-len(t), t))) + ")( |$)"
_APART = r"[^\p{L}\p{N}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One after the other, what each pattern becomes; spaces are doubled so that each list mark has its own two.
_STEPS = ((_COPYRIGHT_LINE, "\n"), (_SPACE, "  "), (_LIST_MARK, " "), (_APART, " "))

# Short licences of public use in full, without title and copyright line.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <http://unlicense.org/>"
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
KNOWN_LICENSES = (
    ("MIT", f"{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT-0", f"{_GRANT}.\n\n{_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}{_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}{_BSD_THIRD}{_BSD_AS_IS}"),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
)
# Digests of the canonical form of long licences, as Debian ships them in common-licenses; with and without what follows the terms.
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "22cf795b86d03f03251e2d6d4ad1a0e7f71862ffac750d0b75254d9929eec46f"),
    ("Apache-2.0", "298312773fc46b7fe770063ee870b86ef5237c3db942fb4363bbbf1665e17289"),
    ("Apache-2.0", "8258b2ea0c043a2cc55669a5c8f4f9655d8e8d30236fd20ac3bdf60a5b15ac2b"),
    ("Artistic-1.0-Perl", "60deae445a75529fa14ff60aa89efa3652116316f97c0d43bc241c7580c30def"),
    ("CC0-1.0", "10e06f6f8cbc2965c1cb93e26157d8b943a5fe5ea740558b1c021fa87e9e94a2"),
    ("GFDL-1.2", "960724eb9e89dbd474ed55a141c03fdbac1b8a5a468fcec6e01a6389458d5778"),
    ("GFDL-1.3", "1926b38efd85c303f8f302093701e2e6856db0b2f033e1843b626885d372b454"),
    ("GPL-1.0", "4eef51cddf70d228f8f679f34a1f60d57827c77d20f7ad22b172620c9d4b0f0b"),
    ("GPL-1.0", "a50f697a389577a1e8771c8d1059c1182835ad02c0ddafec7dd7d6913acc036b"),
    ("GPL-1.0", "5a62f478c7ab7d11704158469e14ed8fc6ef15a45cd64108f935ccfa5d6cd181"),
    ("GPL-2.0", "18f27e0b9aff9c76ba9c5d7382b29c68b5100c0492ad7af80f3e030be382b41c"),
    ("GPL-2.0", "9ed91a4e2e6b67364361d1d18b10305f9a9ac00b798ba4d6898469d2f93b6e11"),
    ("GPL-2.0", "389235bd4bb0ed49b5a150c7ae00585bda275dd3b951bcf0daa9ce78f02acbde"),
    ("GPL-3.0", "936513540912c72b84974919d99d5d76ab0ffed42e2d5b0910852f14688519de"),
    ("GPL-3.0", "2a9a4136a24e78679067222a1f0749ecd28b663bcaa60aa6f1124bf6dafb7ac9"),
    ("GPL-3.0", "a81da4a0541798bd7141bc65b6107a75d417888749b99272882cb06c31d57252"),
    ("LGPL-2.0", "0a7f44a9b678a2df8528bf0a7e634db0e30fefd3c55d176cf46fe9986edc4ffe"),
    ("LGPL-2.0", "4397e1f617675f6743641f494350ff3672adae9c8e4c0db765eb03b8ca44d66a"),
    ("LGPL-2.0", "0629af5034c8688ea9f61cc81d957022a38c20bf56e36a52bb98edc97b3fbc0d"),
    ("LGPL-2.1", "d05b77eef0408dca450b9ca41ff6347c3abf4e6d7b46a96eb78a8db2b0834d88"),
    ("LGPL-2.1", "72ed0544f48e3659689b83eb28db296371b3b905561e0d06e6b0a372b8b0ea47"),
    ("LGPL-2.1", "89dcced9bbb46974d528392ee6f051033bd83da40d4beaa91530a2d71118ecd0"),
    ("LGPL-3.0", "1ac7e0cd0c7ebfa17768b6a458b0ea69f68c8871f6d49b752212f9fab17b136a"),
    ("MPL-1.1", "1ef22d19314f456d8db84e31fdae641014e0e3cea3ccb967f91d42aadcf37123"),
    ("MPL-2.0", "89813fb41c80fb575f61472b752d600b0a889098466ee4e7ffe3a3f2d5bd3695"),
    # the same texts joined to one line, where notices inside are no lines of their own
    ("Apache-2.0", "d9141e44669266bdd78bbfc82208c8c258059ea96c78e692ca48b7dd49d697a6"),
    ("GFDL-1.2", "811e67a1c5f1677ff1e2cbef7290a703f8802007202ac844df643475b65bf541"),
    ("GFDL-1.3", "fabd73b24d5bb479015ee8e685aa972f1527d3c6231f38ddfe6f978334cc824d"),
    ("GPL-1.0", "4b868f9487ece89d587f6687d03da0a3ac461cea80ace517b847ba711015ec73"),
    ("GPL-1.0", "92ca3acc2c0d5900604964460398bb690c392df3f3d3a55065f71aa9e4e3d1c5"),
    ("GPL-1.0", "fb33e7b9d43e3c16100a2bec6db7c119200a234c7bbe0156c523ae8349b84191"),
    ("GPL-2.0", "337e2434d5d89daada354559c4965bea586f45534eb6ee5cf978908ae759c160"),
    ("GPL-2.0", "66ca62f13728ad6fc4c93362bcf2640c14dab0177ff274c8f5abacbdf586d05e"),
    ("GPL-2.0", "ef082089dff28a4f29ceff824f8c5bd1ec2d666d6a049dfb01d173fea3cd4447"),
    ("GPL-3.0", "a3534c34d00111ec747f0a3a7b3cd40bff04ff4bc4497aa3f8486bd4ba35282f"),
    ("GPL-3.0", "fb61822e63097d0355c56ccfaec357daf86b1f5a85440776908e32340c74093d"),
    ("GPL-3.0", "fee2393fa7972192c1d27f601a5ebe9c2fa81f991fe60042f1905bb178ffcc35"),
    ("LGPL-2.0", "47b4a37933c0d1a84e76b7a1afc49c6ef7f97ea58dde2c45b1fc8293eee04481"),
    ("LGPL-2.0", "57cf14a61edbd9cc42f0f5905686a007e0793930fe83c964162b1c2962bc3933"),
    ("LGPL-2.0", "f59df7c49aa61b4825ef7eb340e87ffd91c049f8908c0a8d0bbdd4fa1c1da6d7"),
    ("LGPL-2.1", "7751855912bf1457647820cad7218e5dc1cebb0bbc29e0d99698e3b9841b24b9"),
    ("LGPL-2.1", "e15de6494eb86c862bf3fed00d3cffde0201694cfa0b3623926fa85c27a49061"),
    ("LGPL-2.1", "e55106adc3a220b7ce4af61be3760a72e6d05160dfc2285f24c55a07e562fe87"),
    ("LGPL-3.0", "2408da74cde6f739a071b49769e31ca16e59bf356ad46e543ee8cc537a27927b"),
)


def openings(known: tuple[tuple[str, str], ...], words: int = 5) -> tuple[str, ...]:
    """The first words of every known text, in lower case with single spaces."""
    found = {" ".join(re.findall(r"[^\W_]+", text.lower())[:words]) for _, text in known}
    return tuple(sorted(found - {""}))


def _head(openers: tuple[str, ...]) -> str:
    """A leading notice of up to 400 characters, on one line or several, with or without a year, up to one of the opening words, which are group 1."""
    loose = [("|".join(re.escape(t).replace(r"\ ", _APART) for t in some)) for some in (TITLES, openers)]
    title = f"(?:(?:the{_APART})?(?:{loose[0]}){_APART})?"
    return rf"(?s)^[^\p{{L}}\p{{N}}]*{title}(?:portions )?(?:copyright|copr|\(c\)|©).{{0,400}}?[^\p{{L}}\p{{N}}]((?:{loose[1]})(?:[^\p{{L}}\p{{N}}]|$))"


def _firsts(openers: tuple[str, ...]) -> tuple[tuple[str, ...], ...]:
    """What may follow a leading notice: the first words of a known text, else a title."""
    return (openers, TITLES) if openers else ()


def canonical(text: F.Column, openers: tuple[str, ...] = ()) -> F.Column:
    """The canonical form: a leading notice before one of ``openers`` or a title and copyright lines out, A-Z in lower case, white space, list marks and punctuation as single spaces, equal spellings, no title."""
    text = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    for first in _firsts(openers):
        text = F.regexp_replace(text, _head(first), "$1")
    for pattern, new in _STEPS:
        text = F.regexp_replace(text, pattern, new)
    for old, new in EQUIVALENT:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.trim(F.regexp_replace(text, " {2,}", " "))
    return F.regexp_replace(text, _TITLE, "")


def oracle_text(text: str, openers: tuple[str, ...] = ()) -> str:
    """The same form as a DuckDB expression of an expression."""
    text = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    for first in _firsts(openers):
        text = f"regexp_replace({text}, {_sql(_head(first))}, '\\1')"
    for pattern, new in _STEPS:
        text = f"regexp_replace({text}, {_sql(pattern)}, {'chr(10)' if new == chr(10) else _sql(new)}, 'g')"
    for old, new in EQUIVALENT:
        text = f"replace({text}, {_sql(old)}, {_sql(new)})"
    return f"regexp_replace(trim(regexp_replace({text}, ' {{2,}}', ' ', 'g'), ' '), {_sql(_TITLE)}, '')"


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def known_digests(spark, known: tuple[tuple[str, str], ...], digests: tuple[tuple[str, str], ...]) -> DataFrame:
    """(known_digest, license_id) of each distinct canonical text; of licences with one text the first name by the alphabet counts."""
    texts = spark.createDataFrame(list(known) or [("", "")], "license_id string, text string")
    texts = texts.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("known_digest"), "license_id")
    given = spark.createDataFrame([(d, n) for n, d in digests] or [("", "")], "known_digest string, license_id string")
    found = texts.unionByName(given).where(~F.col("known_digest").isin("", hashlib.sha256(b"").hexdigest()))
    return found.groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str], ...] = KNOWN_LICENSES,
    digests: tuple[tuple[str, str], ...] = KNOWN_DIGESTS, most_broadcast: int = 10_000,
) -> DataFrame:
    """One row per document: id, ``digest`` of the canonical text and ``license_id`` or null.

    Only a whole text that equals a known one is a licence, whatever its line ends, title,
    copyright lines, quotes and list marks are. A notice that leads the text goes up to the
    first words of a known text or else a title, also without a year, over several lines or on the text's own
    line, if it has at most 400 characters; notices inside must be lines. Long licences are
    known in lines and joined to one line. Null and empty texts have the digest of an
    empty text and no licence, as has a text of copyright lines alone. ``known`` gives
    licences as texts, ``digests`` as (id, digest). The registry is broadcast up to
    ``most_broadcast`` entries and joined by hash beyond that. Repeated rows keep a row each.
    """
    registry = known_digests(docs.sparkSession, known, digests)
    rows = docs.select(F.col(id_col), F.sha2(canonical(F.col(text_col), openings(known)).cast("binary"), 256).alias("digest"))
    registry = F.broadcast(registry) if len(known) + len(digests) <= most_broadcast else registry
    return rows.join(registry, F.col("digest") == F.col("known_digest"), "left").select(id_col, "digest", "license_id")


def oracle(docs: str = "documents") -> str:
    """SQL for the rows of ``scan_licenses``; the known texts are brought to their form by SQL as well."""
    texts = ", ".join(f"({_sql(n)}, {_sql(t)})" for n, t in KNOWN_LICENSES)
    given = "".join(f" union all select {_sql(d)}, {_sql(n)}" for n, d in KNOWN_DIGESTS)
    return f"""
        with texts(license_id, known_text) as (values {texts}),
        every(known_digest, license_id) as (select sha256({oracle_text('known_text')}), license_id from texts{given}),
        known as (select known_digest, min(license_id) as license_id from every group by known_digest),
        digested as (select doc_id, sha256({oracle_text('text', openings(KNOWN_LICENSES))}) as digest from {docs})
        select doc_id, digest, license_id from digested left join known on digest = known_digest
    """
