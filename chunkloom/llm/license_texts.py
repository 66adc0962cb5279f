"""Wordings of license bodies and headers, and SPDX identifiers, for the license scan.

Texts are as the scan brings them to words: lower-cased, with one blank for what stands between words.
"""

from __future__ import annotations

_LIB = "(?:library|program|software|package|file)"
_WHO = "(?:[^ ]+ ){1,16}"
_FREE = f"{_LIB} is free software you can redistribute it and or modify it under the terms of (?:version {{0}} of )?the gnu {{1}}general public licen[sc]e"
_FSF = "(?: as published by the free software foundation)?"


def _gnu(label: str, kind: str, versions: tuple[str, ...]) -> list[tuple]:
    out = []
    for v in versions:
        tag, head = f"{label}-{v.replace(' ', '.')}", _FREE.format(v, kind)
        out.append((f"{tag}-or-later", "is free software", f"{head}{_FSF} either version {v} of the licen[sc]e or (?:at your option )?any later version", 97, 1.0))
        out.append((tag, "is free software", f"{head}{_FSF} version {v}(?: of the licen[sc]e)?", 96, 1.0))
        out.append((tag, "is free software", _FREE.replace("(?:version {0} of )?", "version {0} of ").format(v, kind), 96, 1.0))
    out.append((label, "is free software", f"{_FREE.replace('(?:version {0} of )?', '').format('', kind)}{_FSF}", 92, 1.0))
    out.append((label, "you should have received", f"you should have received a copy of the gnu {kind}general public licen[sc]e along with this {_LIB}", 75, 0.9))
    return out


#: Label, keyword, regex, priority, weight.
BODIES = (
    # MIT and what shares its opening
    ("mit", "hereby granted free of charge", "permission is hereby granted free of charge", 60, 0.8),
    ("mit", "hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?", 90, 1.0),
    ("mit", "to deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[sc]e and or sell copies of the software", 85, 0.95),
    ("mit", "shall be included in all copies", "(?:the )?above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 85, 0.9),
    ("mit", "authors or copyright holders be liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", 70, 0.8),
    ("ncsa", "to deal with the software", "(?:permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:the software )?)?to deal with the software without restriction including without limitation", 92, 0.95),
    ("boost", "any person or organization obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e", 92, 1.0),
    ("ofl", "copy of the font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 92, 1.0),
    ("ofl", "font software", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", 90, 0.95),
    ("unicode", "unicode data files", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", 92, 1.0),
    ("json", "good not evil", "the software shall be used for good not evil", 90, 0.95),
    # BSD
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms", 75, 0.9),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?", 88, 1.0),
    ("bsd", "redistributions of source code must", "redistributions of source code must retain the(?: above)? copyright notice(?: this list of conditions and the following disclaimer)?", 80, 0.9),
    ("bsd", "redistributions in binary form must", "redistributions in binary form must reproduce the(?: above)? copyright notice(?: this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution)?", 80, 0.9),
    ("bsd-3-clause", "endorse or promote products", f"neither the names? of {_WHO}may be used to endorse or promote products derived from this software without specific prior written permission", 88, 0.95),
    ("bsd-3-clause", "endorse or promote products", f"the names? of {_WHO}may not be used to endorse or promote products derived from this software without specific prior written permission", 86, 0.9),
    ("bsd-4-clause", "advertising materials mentioning", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 90, 0.95),
    ("bsd", "and any express or implied warranties", f"this software is provided by {_WHO}as is and any express or implied warranties", 70, 0.8),
    ("bsd-3-clause-clear", "no express or implied licenses", "no express or implied licenses to any party s patent rights are granted by this licen[sc]e", 90, 0.95),
    # other short permissive ones
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 80, 0.9),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 90, 1.0),
    ("0bsd", "with or without fee is hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is", 92, 1.0),
    ("warranty", "author disclaims all warranties", "the software is provided as is and the author disclaims all warranties with regard to this software", 70, 0.8),
    ("hpnd", "software and its documentation for any purpose", "permission to use copy modify(?: and)?(?: or)?(?: distribute)?(?: and)?(?: sell)? this software and its documentation for any purpose(?: (?:and )?without fee)? is hereby granted(?: without fee)?", 85, 0.9),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 92, 1.0),
    ("w3c", "without fee or royalty is hereby granted", "permission to(?: use)? copy modify and distribute this (?:software|work)(?: and its documentation)? with or without modification for any purpose and without fee or royalty is hereby granted", 92, 1.0),
    ("zlib", "permission is granted to anyone to use", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 92, 1.0),
    ("zlib", "be held liable", "in no event will the authors? be held liable for any damages arising from the use of this software", 80, 0.9),
    ("zlib", "must not be misrepresented", "the origin of this (?:software|source code) must not be misrepresented", 80, 0.9),
    ("zlib", "plainly marked as such", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 80, 0.9),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain", 92, 1.0),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software", 85, 0.95),
    ("wtfpl", "what the fuck you want", "(?:you just )?do what the fuck you want to(?: public licen[sc]e)?", 85, 0.95),
    ("beerware", "you can do whatever you want with this stuff", "as long as you retain this notice you can do whatever you want with this stuff", 90, 1.0),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group", 85, 0.9),
    ("openssl", "openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit", 88, 0.95),
    ("openssl", "written by eric young", "this product includes (?:cryptographic )?software written by eric young", 80, 0.9),
    ("php", "php software", "this product includes php software freely available from", 88, 0.95),
    ("python-2.0", "python software foundation", "this licen[sc]e agreement is between the python software foundation", 88, 0.95),
    ("ms-pl", "governs use of the accompanying software", "this licen[sc]e governs use of the accompanying software if you use the software you accept this licen[sc]e", 85, 0.9),
    # Apache
    ("licensed", "you may not use this file except", "you may not use this file except in compliance with the licen[sc]e", 25, 0.4),
    ("apache-2.0", "www apache org licenses", "you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at https? www apache org licenses license 2 0", 95, 1.0),
    ("apache-2.0", "www apache org licenses", "www apache org licenses(?: license)? 2 0", 75, 0.9),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis(?: without warranties or conditions of any kind either express or implied)?", 88, 0.95),
    ("apache-2.0", "each contributor hereby grants to you", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?(?:copyright|patent) licen[sc]e", 88, 0.95),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation", 75, 0.8),
    # GNU
    *_gnu("gpl", "", ("2", "3")),
    *_gnu("lgpl", "lesser ", ("2 1", "3")),
    *_gnu("lgpl", "library ", ("2",)),
    *_gnu("agpl", "affero ", ("3",)),
    ("gpl", "in the hope that it will be useful", "this program is distributed in the hope that it will be useful but without any warranty", 45, 0.7),
    ("lgpl", "in the hope that it will be useful", "this library is distributed in the hope that it will be useful but without any warranty", 45, 0.7),
    ("gpl-2", "designed to take away your freedom", "the licen[sc]es for most software are designed to take away your freedom to share and change it", 80, 0.9),
    ("gpl-3", "is a free copyleft", "the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 88, 0.95),
    ("agpl-3", "is a free copyleft", "the gnu affero general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", 88, 0.95),
    ("lgpl-2.1", "specially designated software packages", "this licen[sc]e the lesser general public licen[sc]e applies to some specially designated software packages", 88, 0.95),
    ("lgpl-3", "incorporates the terms and conditions of version 3", "this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3 of the gnu general public licen[sc]e", 88, 0.95),
    ("gfdl", "copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 92, 1.0),
    ("gfdl", "invariant sections", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e version 1 [123] or any later version published by the free software foundation with no invariant sections", 93, 1.0),
    ("gnu-verbatim", "verbatim copies of this", "everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed", 50, 0.6),
    # Mozilla, Eclipse and others with weak copyleft
    ("mpl-2.0", "source code form is subject", "this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0", 95, 1.0),
    ("mpl-2.0", "if a copy of the mpl was not", "if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0", 90, 0.95),
    ("mpl-1.1", "contents of this file are subject", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 95, 1.0),
    ("cddl", "contents of this file are subject", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 92, 1.0),
    ("epl-1.0", "accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v(?:ersion)? ?1 0", 95, 1.0),
    ("epl-2.0", "accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v(?:ersion)? ?2 0", 95, 1.0),
    ("epl", "accompanying program is provided", "the accompanying program is provided under the terms of this eclipse public licen[sc]e", 90, 0.95),
    ("artistic-1.0", "under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 92, 1.0),
    ("artistic-2.0", "given free software package may be copied", "this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 92, 1.0),
    # Creative Commons
    ("cc0-1.0", "to the extent possible under law", f"to the extent possible under law {_WHO}(?:has|have) waived all copyright and related or neighbou?ring rights", 92, 1.0),
    ("creative-commons", "by exercising the licensed rights", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons", 85, 0.95),
    ("creative-commons", "copy and redistribute the material", "copy and redistribute the material in any medium or format", 60, 0.7),
)

#: Identifiers that are a license after the tag, or behind an "or" or "and" up to 80 characters after it.
SPDX = """0BSD AAL AFL-2.1 AFL-3.0 AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0
Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear
BSD-3-Clause-LBNL BSD-4-Clause BSD-4-Clause-UC BSL-1.0 BUSL-1.1 bzip2-1.0.6 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0
CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0
CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.0 EUPL-1.1
EUPL-1.2 FTL GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0
GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC JSON LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng LPL-1.02 LPPL-1.3c MIT MIT-0 MIT-CMU MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0
NAIST-2003 NCSA NPL-1.1 ODbL-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby
SISSL Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.0 ZPL-2.1""".split()

#: Names whose identifiers with a version are a license wherever they stand.
ALONE = ("apache", "mpl", "epl", "cddl", "eupl", "ofl", "lppl", "odbl", "bsl", "artistic")

_TAG = "spdx licen[sc]e identifier"


def handwritten() -> list[tuple]:
    # curved quotes are parts of words
    out = [(label, keyword, regex.replace(" as is", " [^ 0-9a-z]?as is[^ 0-9a-z]?"), priority, weight) for label, keyword, regex, priority, weight in BODIES]
    for name in SPDX:
        words, label = name.lower().replace("-", " ").replace(".", " "), name.lower().removesuffix("-only")
        out.append((label, "spdx", f"{_TAG} {words}", 98, 1.0))
        out.append((label, "spdx", f"(?<= {_TAG} [0-9a-z ]{{1,80}})(?:or|and) {words}", 98, 1.0))
        if words.split()[0] in ALONE:
            out.append((label, words, words, 65, 0.8))
    return out
