"""License scans by ordered signature rules.

A rule is a hand-written regular expression over normalised text (lower-cased words, joined by single spaces), the label
it detects, a keyword without which it cannot match, and its place in the order.  A text is searched by a rule only if
it holds the rule's keyword, and by the rules at all only if it holds any keyword.  Detections are word
intervals.  One that lies within another of the same or an earlier rank is suppressed; of equal intervals the earlier
rule's stays.

The base phrases (four, with fixed labels) are found exactly and never suppressed; the rules add labels.

Defined results: a null text counts as empty; a text without words has no labels and score 0; repeated rows are judged
alike; other columns pass unused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.columns import let, running_max, running_sums
from lexiforge.llm.common import table

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Licenses with version-bearing names: label stem, the name as it is written out, short names, versions.  "{v}" in a
# label stands for the version, whose dot the normalised text has as a blank.
_VERSIONED = [
    ("gpl-{v}", r"gnu general public licen[cs]e", "gpl", ("1", "2", "3")),
    ("lgpl-{v}", r"gnu (?:lesser|library) general public licen[cs]e", "lgpl", ("2", "2.1", "3")),
    ("agpl-{v}", r"(?:gnu )?affero general public licen[cs]e", "agpl", ("1", "3")),
    ("gfdl-{v}", r"gnu free documentation licen[cs]e", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache-{v}", r"apache (?:software )?licen[cs]e", "apache", ("1", "1.1", "2")),
    ("mpl-{v}", r"mozilla public licen[cs]e", "mpl", ("1", "1.1", "2")),
    ("epl-{v}", r"eclipse public licen[cs]e", "epl", ("1", "2")),
    ("cddl-{v}", r"common development and distribution licen[cs]e", "cddl", ("1", "1.1")),
    ("eupl-{v}", r"european union public licen[cs]e", "eupl", ("1", "1.1", "1.2")),
    ("osl-{v}", r"open software licen[cs]e", "osl", ("1", "2", "2.1", "3")),
    ("afl-{v}", r"academic free licen[cs]e", "afl", ("1.1", "2", "2.1", "3")),
    ("bsl-{v}", r"boost software licen[cs]e", "bsl", ("1",)),
    ("artistic-{v}", r"artistic licen[cs]e", "artistic", ("1", "2")),
    ("lppl-{v}", r"latex project public licen[cs]e", "lppl", ("1", "1.1", "1.2", "1.3c")),
    ("php-{v}", r"php licen[cs]e", "php", ("3", "3.01")),
    ("zpl-{v}", r"zope public licen[cs]e", "zpl", ("1.1", "2", "2.1")),
    ("cpl-{v}", r"common public licen[cs]e", "cpl", ("1",)),
    ("ipl-{v}", r"ibm public licen[cs]e", "ipl", ("1",)),
    ("ofl-{v}", r"(?:sil )?open font licen[cs]e", "ofl", ("1", "1.1")),
    ("busl-{v}", r"business source licen[cs]e", "busl", ("1", "1.1")),
    ("sspl-{v}", r"server side public licen[cs]e", "sspl", ("1",)),
    ("elastic-{v}", r"elastic licen[cs]e", "elastic", ("1", "2")),
    ("odbl-{v}", r"open (?:data commons )?(?:open )?database licen[cs]e", "odbl", ("1",)),
    ("upl-{v}", r"universal permissive licen[cs]e", "upl", ("1",)),
    ("ecl-{v}", r"educational community licen[cs]e", "ecl", ("1", "2")),
    ("cecill-{v}", r"cecill free software licen[cs]e", "cecill", ("1", "2", "2.1")),
]

# Creative Commons: short conditions, the same written out, versions.
_CC = {
    "by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?",
    "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Single signatures: label, pattern, keyword.
_SINGLE = [
    ("mit", r"the mit licen[cs]e", "mit licen"), ("mit", r"mit x11 licen[cs]e", "x11"), ("mit", r"(?:expat|x11) licen[cs]e", "licen"), ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied", "without warranty"), ("mit", r"spdx licen[cs]e identifier mit", "spdx"), ("mit-0", r"mit no attribution", "no attribution"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution"), ("bsd-2", r"(?:2|two) clause bsd", "bsd"), ("bsd-2", r"bsd 2 clause", "bsd"), ("bsd-2", r"simplified bsd licen[cs]e", "bsd"),
    ("bsd-3", r"(?:3|three) clause bsd", "bsd"), ("bsd-3", r"bsd 3 clause", "bsd"), ("bsd-3", r"(?:new|modified|revised) bsd licen[cs]e", "bsd"), ("bsd-3", r"neither the name of .{1,120}? nor the names of its contributors", "nor the names"),
    ("bsd-4", r"(?:4|four) clause bsd", "bsd"), ("bsd-4", r"all advertising materials mentioning features or use of this software", "advertising materials"), ("bsd", r"bsd (?:style )?licen[cs]e", "bsd"), ("0bsd", r"(?:zero clause bsd|bsd zero clause)", "bsd"), ("0bsd", r"0bsd", "0bsd"),
    ("isc", r"isc licen[cs]e", "isc"), ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use"), ("zlib", r"zlib (?:libpng )?licen[cs]e", "zlib"), ("zlib", r"this software is provided as is without any express or implied warranty in no event", "in no event"),
    ("unlicense", r"(?:the unlicense|unlicense org)", "unlicense"), ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"), ("public-domain", r"(?:released|dedicated|placed|is) (?:in)?to? ?the public domain", "public domain"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", "do what"), ("wtfpl", r"wtfpl", "wtfpl"), ("beerware", r"beer ?ware licen[cs]e", "beer"), ("psf", r"python software foundation licen[cs]e", "python"), ("python", r"python licen[cs]e(?: agreement)?", "python"),
    ("ruby", r"ruby licen[cs]e", "ruby"), ("vim", r"vim licen[cs]e", "vim"), ("openssl", r"openssl licen[cs]e", "openssl"), ("ssleay", r"ssleay licen[cs]e", "ssleay"), ("curl", r"curl licen[cs]e", "curl"), ("json", r"the software shall be used for good not evil", "not evil"),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", "ncsa"), ("postgresql", r"postgresql licen[cs]e", "postgresql"), ("icu", r"icu licen[cs]e", "icu"), ("libpng", r"libpng licen[cs]e", "libpng"), ("ijg", r"independent jpeg group", "jpeg group"),
    ("freetype", r"freetype (?:project )?licen[cs]e", "freetype"), ("imagemagick", r"imagemagick licen[cs]e", "imagemagick"), ("qpl", r"q public licen[cs]e", "q public"), ("sleepycat", r"sleepycat licen[cs]e", "sleepycat"), ("watcom", r"sybase open watcom public licen[cs]e", "watcom"),
    ("w3c", r"w3c software (?:notice and )?licen[cs]e", "w3c"), ("x11", r"x consortium licen[cs]e", "consortium"), ("bittorrent", r"bittorrent open source licen[cs]e", "bittorrent"), ("ms-pl", r"microsoft public licen[cs]e", "microsoft"), ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft"),
    ("nasa", r"nasa open source agreement", "nasa"), ("intel", r"intel open source licen[cs]e", "intel"), ("apple", r"apple public source licen[cs]e", "apple"), ("sun", r"sun (?:public|industry standards source) licen[cs]e", "sun "), ("mulan", r"mulan (?:psl|permissive software licen[cs]e)", "mulan"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0"), ("cc0", r"creative commons (?:zero|public domain dedication)", "creative commons"), ("cc", r"creative commons licen[cs]e", "creative commons"), ("openrail", r"(?:creativeml )?openrail(?: [ms])?(?: licen[cs]e)?", "openrail"), ("openrail", r"open rail(?: [ms])?(?: licen[cs]e)?", "open rail"),
    ("llama", r"llama (?:2|3|3 1|3 2)? ?community licen[cs]e", "llama"), ("commons-clause", r"commons clause", "commons clause"), ("proprietary", r"all rights reserved", "all rights"), ("proprietary", r"proprietary and confidential", "proprietary"), ("proprietary", r"unauthorized copying of this file", "unauthorized"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "free software"), ("gpl-2+", r"either version 2 of the licen[cs]e or (?:at your option )?any later version", "later version"), ("gpl-3+", r"either version 3 of the licen[cs]e or (?:at your option )?any later version", "later version"),
    ("agpl", r"remote network interaction use with the gnu general public licen[cs]e", "remote network"), ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e", "applicable law"), ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "source code form"),
]

# Sentences of license texts and of the notices that refer to them: label, pattern, keyword.
_SENTENCES = [
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies", "to deal in the software"),
    ("mit", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software", "substantial portions"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright holders"),
    ("mit", r"(?:released|licen[cs]ed|distributed|available) under the (?:terms of the )?mit licen[cs]e", "mit licen"),
    ("x11", r"except as contained in this notice the name of .{1,80}? shall not be used in advertising or otherwise to promote the sale", "except as contained"),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary"),
    ("bsd", r"this software is provided by the (?:copyright holders|author|regents) and contributors as is and any express or implied warranties", "this software is provided by"),
    ("bsd", r"loss of use data or profits or business interruption however caused and on any theory of liability", "business interruption"),
    ("bsd-3", r"may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote"),
    ("bsd", r"use of this source code is governed by a bsd style licen[cs]e that can be found in the licen[cs]e file", "source code is governed"),
    ("bsd-4", r"this product includes software developed by the university of california berkeley", "this product includes software"),
    ("bsd-3-lbnl", r"you are under no obligation whatsoever to provide any bug fixes patches or upgrades", "no obligation whatsoever"),
    ("bsd-3-clear", r"no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e", "no express or"),
    ("bsd-2-patent", r"subject to the terms and conditions of this licen[cs]e each copyright holder and contributor hereby grants", "each copyright holder"),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "disclaims all warranties"),
    ("isc", r"whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance", "tortious action"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose", "and its documentation"),
    ("hpnd", r"makes no representations about the suitability of this software for any purpose it is provided as is", "no representations about"),
    ("ntp", r"the name .{1,60}? not be used in advertising or publicity pertaining to distribution of the software", "publicity pertaining"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "the origin of this software"),
    ("zlib", r"this notice may not be removed or altered from any source distribution", "this notice may not be"),
    ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "person or organization"),
    ("bsl-1", r"must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies", "unless such copies"),
    ("apache-2", r"licen[cs]ed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e", "except in compliance"),
    ("apache-2", r"you may obtain a copy of the licen[cs]e at (?:http|https) www apache org licen[cs]es licen[cs]e 2 0", "obtain a copy of the"),
    ("apache-2", r"without warranties or conditions of any kind either express or implied", "warranties or conditions"),
    ("apache-2", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e", "royalty free"),
    ("apache", r"licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements", "asf under"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "this product includes software"),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e along with this program", "should have received"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty", "in the hope that it will"),
    ("gpl", r"the licen[cs]es for most software are designed to take away your freedom to share and change it", "take away your"),
    ("gpl-2", r"free software foundation inc (?:51 franklin st|59 temple place|675 mass ave)", "free software foundation"),
    ("gpl-2", r"you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program", "you must cause"),
    ("gpl-3", r"the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works", "free copyleft"),
    ("gpl-3", r"corresponding source for a work in object code form means all the source code needed to generate install", "corresponding source"),
    ("gpl-3", r"you may convey verbatim copies of the program s source code as you receive it", "convey verbatim"),
    ("gpl-classpath", r"as a special exception the copyright holders of this library give you permission to link this library", "as a special exception"),
    ("gpl-gcc-exception", r"gcc runtime library exception", "gcc runtime"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "this library is"),
    ("lgpl-2.1", r"either version 2 1 of the licen[cs]e or (?:at your option )?any later version", "later version"),
    ("lgpl", r"a program that contains no derivative of any portion of the library but is designed to work with the library", "no derivative of"),
    ("agpl-3", r"if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", "prominently offer"),
    ("agpl-3", r"specifically designed to ensure cooperation with the community in the case of network server software", "network server software"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "modify this document"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant sections"),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl"),
    ("mpl-2", r"this source code form is incompatible with secondary licen[cs]es", "secondary licen"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "contents of this file"),
    ("mpl-1.1", r"software distributed under the licen[cs]e is distributed on an as is basis without warranty of any kind either express or implied", "on an as is basis"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "the accompanying materials"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e agreement", "accompanying program"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "contents of this file"),
    ("cddl", r"include this cddl header notice in each file", "cddl header"),
    ("cpl", r"the accompanying program is provided under the terms of this common public licen[cs]e agreement", "accompanying program"),
    ("eupl", r"licen[cs]ed under the eupl", "eupl"), ("eupl", r"unless required by applicable law or agreed to in writing software distributed under the eupl", "eupl"),
    ("osl-3", r"licen[cs]ed under the open software licen[cs]e version 3 0", "open software"), ("afl-3", r"licen[cs]ed under the academic free licen[cs]e version 3 0", "academic free"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "the intent of this document"),
    ("artistic-2", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction", "the standard version"),
    ("perl", r"this (?:program|library|module) is free software you can redistribute it and or modify it under the same terms as perl itself", "as perl itself"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public licen[cs]e", "latex project"),
    ("lppl", r"this work has the lppl maintenance status", "lppl"),
    ("ofl-1.1", r"this font software is licen[cs]ed under the sil open font licen[cs]e", "font software"),
    ("ofl-1.1", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself", "individual components"),
    ("ofl-1.1", r"no modified version of the font software may use the reserved font name", "reserved font"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free"),
    ("unlicense", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors", "heirs and successors"),
    ("cc0", r"to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", "extent possible"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "this deed"),
    ("cc", r"this work is licen[cs]ed under a creative commons", "this work is licen"), ("cc", r"creativecommons org licen[cs]es", "creativecommons"),
    ("cc-by", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made", "appropriate credit"),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e", "remix transform"),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "for commercial purposes"),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", "remix transform"),
    ("wtfpl", r"you just do what the fuck you want to", "you just do"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", "buy me a beer"),
    ("psf", r"psf hereby grants licen[cs]ee a nonexclusive royalty free world wide licen[cs]e", "psf hereby"),
    ("psf", r"this licen[cs]e agreement is between the python software foundation", "python software"),
    ("cnri", r"this licen[cs]e agreement is between the corporation for national research initiatives", "national research initiatives"),
    ("php-3", r"products derived from this software may not be called php", "called php"), ("php-3", r"this product includes php software freely available from", "php software"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic software"),
    ("unicode", r"unicode (?:inc )?licen[cs]e agreement data files and software", "unicode"), ("icu", r"icu licen[cs]e icu 1 8 1 and later", "icu"),
    ("libtiff", r"the names of sam leffler and silicon graphics may not be used in any advertising", "sam leffler"),
    ("libpng", r"the png reference library is supplied as is", "png reference"), ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg group"),
    ("freetype", r"portions of this software are copyright .{1,40}? the freetype project", "freetype project"),
    ("curl", r"copyright and permission notice copyright c 1996", "and permission notice"), ("vim", r"there are no restrictions on distributing unmodified copies of vim", "copies of vim"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", "give away verbatim"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation", "hereby grant permission"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "written agreement"),
    ("ncsa", r"to deal with the software without restriction including without limitation the rights to use copy modify", "to deal with the software"),
    ("zpl-2.1", r"this licen[cs]e has been certified as open source", "certified as open"), ("w3c", r"this work is being provided by the copyright holders under the following licen[cs]e", "being provided by"),
    ("ms-pl", r"this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e", "accompanying software"),
    ("json", r"the software shall be used for good", "used for good"), ("mulan", r"mulan permissive software licen[cs]e", "mulan permissive"),
    ("cecill", r"this software is governed by the cecill(?: [bc])? licen[cs]e under french law", "cecill"),
    ("odbl", r"this .{1,40}? is made available under the open database licen[cs]e", "open database"), ("odc-by", r"open data commons attribution licen[cs]e", "open data commons"), ("pddl", r"(?:open data commons )?public domain dedication and licen[cs]e", "public domain"),
    ("busl-1.1", r"the business source licen[cs]e this document or the licen[cs]e is not an open source licen[cs]e", "business source"), ("busl-1.1", r"effective on the change date or the fourth anniversary", "change date"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "functionality of the program"),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed"), ("commons-clause", r"the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell", "right to sell"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) licen[cs]e", "polyform"), ("parity", r"the parity public licen[cs]e", "parity"), ("blueoak", r"blue oak model licen[cs]e", "blue oak"),
    ("llama", r"llama 2 is licen[cs]ed under the llama 2 community licen[cs]e", "llama"), ("gemma", r"gemma is provided under and subject to the gemma terms of use", "gemma"), ("bigscience-rail", r"bigscience (?:rail|bloom rail) licen[cs]e", "bigscience"),
    ("proprietary", r"this software is the (?:confidential and )?proprietary (?:information|property) of", "proprietary"), ("proprietary", r"you shall not disclose such confidential information and shall use it only in accordance with", "confidential information"),
    ("proprietary", r"no part of this (?:publication|document|work|software) may be reproduced", "may be reproduced"), ("proprietary", r"redistribution and use .{0,40}?are not permitted without (?:prior|express) written", "not permitted without"), ("proprietary", r"for internal use only", "for internal use"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    rank: int  # 0 comes first: whole notices, then names with versions, then names, then short names


def _dotted(version: str) -> str:
    head, *tail = version.split(".")
    return head + "".join(f" {t}" for t in tail) + ("" if tail else "(?: 0)?")


def rules() -> list[Rule]:
    """All rules in order.  A version ends at a word's end, so 2 does not match 2 1."""
    out = [Rule(label, pattern, keyword, 0) for label, pattern, keyword in (*_SENTENCES, *_SINGLE)]
    for label, name, short, versions in _VERSIONED:
        word = name.replace("(?:gnu )?", "").replace("(?:sil )?", "").replace("gnu (?:lesser|library) ", "").split(" (?:")[0].split(" licen")[0]
        for v in versions:
            end = r"(?! [0-9] )" if "." not in v else ""
            out.append(Rule(label.format(v=v), rf"{name} (?:v|version |ver )?{_dotted(v)}{end}", word, 1))
            out.append(Rule(label.format(v=v), rf"(?:spdx licen[cs]e identifier )?{short} (?:v|version |ver )?{_dotted(v)}(?: only| or later)?{end}", short, 3))
        out.append(Rule(label.split("-{")[0], name, word, 2))
    for short, name in _CC.items():
        label = "cc-" + short.replace(" ", "-")
        for v in _CC_VERSIONS:
            out.append(Rule(f"{label}-{v}", rf"cc {short} {v.replace('.', ' ')}", "cc by", 1))
            out.append(Rule(f"{label}-{v}", rf"creative commons {name} {v.replace('.', ' ')}", "creative commons", 1))
        out.append(Rule(label, rf"cc {short}(?! (?:sa|nc|nd) )", "cc by", 2))
        out.append(Rule(label, rf"creative commons {name}", "creative commons", 2))
        out.append(Rule(label, rf"creativecommons org licen[cs]es {short}", "creativecommons", 1))
    return sorted(out, key=lambda r: r.rank)


RULES = rules()

FOUND = "array<struct<low:int,high:int,rank:int,label:string>>"


def normalised(text: Column) -> Column:
    """The words of a text, lower-cased, with one blank before, between and after them.

    Lower-casing is that of Unicode.  What it changes beyond A-Z stays a word character, and no letter of a base phrase
    comes from outside ASCII, so words and base places are those of lower-casing A-Z alone.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), _SEPARATOR, " ")), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _intervals(norm: Column, pattern: Column, rank: Column, label: Column) -> Column:
    """Word intervals [low, high) of the places where ``pattern`` begins at a blank; places may overlap."""

    def of(pieces: Column, matches: Column) -> Column:
        # the pieces before a place hold as many blanks as there are words before it
        low = running_sums(F.transform(pieces, _blanks))
        return let(low, lambda a: F.transform(matches, lambda m, i: F.struct(F.get(a, i).alias("low"), (F.get(a, i) + _blanks(m) + 1).alias("high"), rank.alias("rank"), label.alias("label"))))

    # a first character keeps the empty piece before a place at the very beginning
    pieces = F.split(F.concat(F.lit("|"), norm), F.concat(F.lit("(?= "), pattern, F.lit(" )")), -1)
    matches = F.regexp_extract_all(norm, F.concat(F.lit("(?= ("), pattern, F.lit(") )")), F.lit(1))
    return let(matches, lambda m: F.when(F.size(m) == 0, F.array().cast(FOUND)).otherwise(let(pieces, lambda p: of(p, m))))


def base_places(norm: Column) -> Column:
    """All places of the base phrases, by start."""
    one = lambda phrase, label: F.when(F.contains(norm, F.lit(f" {phrase} ")), _intervals(norm, F.lit(phrase), F.lit(-1), F.lit(label))).otherwise(F.array().cast(FOUND))
    return F.sort_array(F.concat(*[one(p, label) for p, label in BASE.items()]))


def gate(keywords: list[str]) -> str:
    """A pattern for any of the keywords at a word's beginning, branched by their first two characters, so that most
    places are passed over after one or two of them."""

    def branches(words: list[str], depth: int) -> str:
        if not depth or "" in words or len(words) == 1:
            return "|".join(sorted(words))
        return "|".join(f"{c}(?:{branches([w[1:] for w in words if w[0] == c], depth - 1)})" for c in sorted({w[0] for w in words}))

    return f" (?:{branches(sorted(set(keywords)), 2)})"


#: Hits of a text up to which all are compared with all; more are swept, with the same result.
_FEW = 64


def uncontained(hits: Column, classes: list[int]) -> Column:
    """The hits that no wider one of an equal or better class contains and no better one of the same span repeats, in
    n log n: sorted by begin and then by end downwards, what contains a hit stands before it, so that the furthest end so
    far of its class or better ones decides."""
    keyed = F.sort_array(F.transform(hits, lambda x: F.struct(x["low"].alias("low"), (-x["high"]).alias("end"), x["rank"].alias("rank"), x["label"].alias("label"))))
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["low"] != x["low"]) | (F.get(a, i - 1)["end"] != x["end"]))

    def kept(a: Column) -> Column:
        class_of = lambda x: F.floor(x["rank"] / 1000)
        ends = lambda c: F.transform(a, lambda x: F.when(class_of(x) <= c, -x["end"]).otherwise(-1))
        furthest = F.array(*[running_max(ends(c)) for c in classes])
        at = lambda x: F.array_position(F.array(*[F.lit(c) for c in classes]), class_of(x).cast("int")).cast("int") - 1
        free = let(furthest, lambda f: F.filter(a, lambda x, i: (i == 0) | (F.get(F.get(f, at(x)), i - 1) < -x["end"])))
        return F.transform(free, lambda x: F.struct(x["low"].alias("low"), (-x["end"]).alias("high"), x["rank"].alias("rank"), x["label"].alias("label")))

    return let(let(keyed, first), kept)


def detections(norm: Column, ordered: list[Rule] | None = None) -> Column:
    """What the rules find, without what others contain."""
    ordered = RULES if ordered is None else ordered
    listed = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.pattern).alias("pattern"), F.lit(r.keyword).alias("keyword"), F.lit(r.rank * 1000 + i).alias("rank")) for i, r in enumerate(ordered)])
    hits = F.flatten(F.transform(F.filter(listed, lambda r: F.contains(norm, F.concat(F.lit(" "), r["keyword"]))), lambda r: _intervals(norm, r["pattern"], r["rank"], r["label"])))
    within = lambda x, y: (y["low"] <= x["low"]) & (x["high"] <= y["high"])
    wider = lambda x, y: (y["high"] - y["low"]) > (x["high"] - x["low"])
    class_of = lambda x: F.floor(x["rank"] / 1000)
    beaten = lambda x, y: within(x, y) & F.when(wider(x, y), class_of(y) <= class_of(x)).otherwise(y["rank"] < x["rank"])
    few = lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: beaten(x, y)))
    left = let(hits, lambda a: F.when(F.size(a) <= _FEW, few(a)).otherwise(let(a, lambda b: uncontained(b, sorted({r.rank for r in ordered})))))
    return F.when(norm.rlike(gate([r.keyword for r in ordered])), left).otherwise(F.array().cast(FOUND))


def scanned(text: Column) -> Column:
    """A struct of n_words, n_base, first_word, last_word, base_labels, labels and score."""
    labels = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"])))

    def of(norm: Column, base: Column, found: Column) -> Column:
        n = F.when(norm == "  ", 0).otherwise(_blanks(norm) - 1).cast("long")
        all_ = F.concat(base, found)
        # how sure: the words of the longest detection against ten, and a half at least for any detection
        longest = F.array_max(F.transform(all_, lambda x: x["high"] - x["low"]))
        return F.struct(
            n.alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda x: x["low"])).cast("long").alias("first_word"),
            F.array_max(F.transform(base, lambda x: x["low"])).cast("long").alias("last_word"), F.array_join(labels(base), ",").alias("base_labels"), F.array_join(labels(all_), ",").alias("labels"),
            F.when(F.size(all_) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 0.5 + longest / 20)).alias("score"), found.alias("detections"),
        )

    return let(normalised(F.coalesce(text, F.lit(""))), lambda norm: let(base_places(norm), lambda base: let(detections(norm), lambda found: of(norm, base, found))))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", scanned(F.col("text")).alias("_s"))
    return docs.select("doc_id", *[f"_s.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
