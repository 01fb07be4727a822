r"""License scans by ordered signature rules.

Text becomes a line of lower-case words (runs of digits, a-z and characters beyond ASCII) between single blanks. A rule is a
regular expression over such a line with a label, a priority and a keyword. Sentences of notices, grants, exceptions and choices of licenses are rules by
themselves; names and identifiers of licenses in six kinds of context (an SPDX line, a line of metadata, grants
by name and by identifier, a reference to terms, a bare mention) give the others. A text goes on only if a cheap
expression finds what every name needs or a notice's keyword, and a rule is tried only where its own keyword stands; no match of a rule fails either. Detections contained in a longer one, or in an equal one of higher
priority, are suppressed; of partial overlaps the detection of lower priority goes.

Besides, three base phrases are counted wherever their words stand consecutively; their labels are always reported.
Everything is made of DataFrame functions. Defined results: a null text counts as empty; texts without words have 0 words,
null places, empty label strings and score 0; of ties in place and priority the rule that comes first stands; repeated rows give repeated rows; an empty table gives no
rows; very long texts are scanned whole, by patterns that repeat no group without bound. scan() puts what it finds into a column of the caller's naming.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between words before lower-casing
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label | keyword | name in running text | SPDX identifier, both over lower-case words.
NAMES = r"""
mit | mit|expat | (?:the )?(?:mit|expat)(?: x11)?(?: style)? licen[sc]e | mit
mit-0 | mit | (?:the )?mit no attribution licen[sc]e | mit 0
x11 | x11 | (?:the )?x11 licen[sc]e | x11
apache-2 | apache | (?:the )?apache (?:software )?licen[sc]e(?: v| version)? ?2(?: 0)? | apache(?: v| version)? ?2(?: 0)?
apache-1.1 | apache | (?:the )?apache (?:software )?licen[sc]e(?: version)? 1 1 | apache 1 1
apache-1.0 | apache | (?:the )?apache (?:software )?licen[sc]e(?: version)? 1 0 | apache 1 0
gpl-3 | g(?:pl|nu|eneral) | (?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?(?:v)?3(?: 0)?(?: of the licen[sc]e)?(?: only)? | gpl 3 0(?: only)?
gpl-3-or-later | g(?:pl|nu|eneral) | (?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?(?:v)?3(?: 0)?(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)? | gpl 3 0 or later
gpl-2 | g(?:pl|nu|eneral) | (?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?(?:v)?2(?: 0)?(?: of the licen[sc]e)?(?: only)? | gpl 2 0(?: only)?
gpl-2-or-later | g(?:pl|nu|eneral) | (?:the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?(?:v)?2(?: 0)?(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)? | gpl 2 0 or later
gpl-1 | g(?:pl|nu|eneral) | (?:the )?(?:gnu )?(?:general public licen[sc]e|gpl) (?:version |v)1 | gpl 1 0(?: only| or later)?
gpl | g(?:pl|nu|eneral) | (?:the )?gnu (?:general public licen[sc]e|gpl) | gpl
lgpl-3 | l(?:gpl|esser) | (?:the )?(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?(?:v)?3(?: 0)? | lgpl 3 0(?: only| or later)?
lgpl-2.1 | l(?:gpl|esser) | (?:the )?(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)? ?(?:v)?2 1 | lgpl 2 1(?: only| or later)?
lgpl-2 | l(?:gpl|ibrary) | (?:the )?(?:gnu )?(?:library general public licen[sc]e|lgpl)(?: version| v)? ?(?:v)?2(?: 0)? | lgpl 2 0(?: only| or later)?
lgpl | l(?:gpl|esser) | (?:the )?gnu (?:lesser general public licen[sc]e|lgpl) | lgpl
agpl-3 | a(?:gpl|ffero) | (?:the )?(?:gnu )?(?:affero general public licen[sc]e|agpl)(?: version| v)? ?(?:v)?3(?: 0)? | agpl 3 0(?: only| or later)?
agpl | a(?:gpl|ffero) | (?:the )?gnu (?:affero general public licen[sc]e|agpl) | agpl
gfdl | g?fdl|documentation | (?:the )?gnu free documentation licen[sc]e(?: version 1 [0-9])? | gfdl 1 [0-9](?: only| or later)?
bsd-3 | bsd | (?:the )?(?:3 clause|three clause|new|modified|revised) bsd licen[sc]e | bsd 3 clause
bsd-3 | bsd | (?:the )?bsd 3 clause(?: new| modified| revised)?(?: licen[sc]e)? | bsd 3 clause clear
bsd-2 | bsd | (?:the )?(?:(?:2 clause|two clause|simplified|freebsd) bsd licen[sc]e|bsd (?:2|two) clause(?: licen[sc]e)?) | bsd 2 clause
bsd-4 | bsd | (?:the )?(?:(?:4 clause|four clause|original) bsd|bsd (?:4|four) clause) licen[sc]e | bsd 4 clause
bsd-0 | 0?bsd | (?:the )?(?:zero clause bsd|bsd zero clause|0bsd) licen[sc]e | 0bsd
bsd | bsd | (?:the |a )?bsd(?: style| type)? licen[sc]e | bsd
isc | isc | (?:the )?isc licen[sc]e | isc
mpl-2 | m(?:pl|ozilla) | (?:the )?(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?(?:v)?2(?: 0)? | mpl 2 0
mpl-1.1 | m(?:pl|ozilla) | (?:the )?(?:mozilla public licen[sc]e|mpl)(?: version| v)? ?(?:v)?1 1 | mpl 1 1
epl-2 | e(?:pl|clipse) | (?:the )?(?:eclipse public licen[sc]e|epl)(?: version| v)? ?2(?: 0)? | epl 2 0
epl-1 | e(?:pl|clipse) | (?:the )?(?:eclipse public licen[sc]e|epl)(?: version| v)? ?1(?: 0)? | epl 1 0
edl-1 | e(?:dl|clipse) | (?:the )?eclipse distribution licen[sc]e(?: version| v)? ?1(?: 0)? | edl 1 0
eupl-1.2 | eupl|european | (?:the )?(?:european union public licen[sc]e|eupl)(?: version| v)? ?1 2 | eupl 1 2
eupl-1.1 | eupl|european | (?:the )?(?:european union public licen[sc]e|eupl)(?: version| v)? ?1 1 | eupl 1 1
cddl-1.1 | cddl|common | (?:the )?(?:common development and distribution licen[sc]e|cddl)(?: version| v)? ?1 1 | cddl 1 1
cddl-1 | cddl|common | (?:the )?(?:common development and distribution licen[sc]e|cddl)(?: version| v)? ?1(?: 0)? | cddl 1 0
cpl-1 | c(?:pl|ommon) | (?:the )?common public licen[sc]e(?: version| v)? ?1(?: 0)? | cpl 1 0
artistic-2 | artistic | (?:the )?artistic licen[sc]e(?: version| v)? ?2(?: 0)? | artistic 2 0
artistic-1 | artistic | (?:the )?artistic licen[sc]e(?: version| v)? ?1(?: 0)? | artistic 1 0
artistic | artistic | (?:the )?(?:perl )?artistic licen[sc]e | artistic 1 0 perl
zlib | zlib | (?:the )?zlib(?: libpng)? licen[sc]e | zlib
libpng | (?:lib)?png | (?:the )?(?:lib)?png licen[sc]e | libpng(?: 2 0)?
boost-1 | boost|bsl | (?:the )?boost software licen[sc]e(?: version| v)?(?: 1(?: 0)?)? | bsl 1 0
unlicense | unlicense | (?:the )?unlicense | unlicense
wtfpl | wtfpl|what | (?:the )?(?:wtfpl|do what the f[a-z]* you want to public licen[sc]e) | wtfpl
public-domain | domain|cc pddc | (?:(?:in|into|to) the )?public domain | (?:cc pddc|public domain)
cc0-1 | cc0|zero | (?:the )?(?:creative commons (?:cc0|zero)|cc0)(?: 1 0)?(?: universal)? | cc0 1 0
cc-by-4 | cc|commons | (?:the )?(?:creative commons attribution|cc by) 4 0(?: international)? | cc by 4 0
cc-by-3 | cc|commons | (?:the )?(?:creative commons attribution|cc by) 3 0(?: unported)? | cc by 3 0
cc-by | cc|commons | (?:the )?(?:creative commons attribution(?: licen[sc]e)?|cc by) | cc by
cc-by-sa-4 | cc|commons | (?:the )?(?:creative commons attribution share ?alike|cc by sa) 4 0(?: international)? | cc by sa 4 0
cc-by-sa-3 | cc|commons | (?:the )?(?:creative commons attribution share ?alike|cc by sa) 3 0(?: unported)? | cc by sa 3 0
cc-by-sa | cc|commons | (?:the )?(?:creative commons attribution share ?alike|cc by sa) | cc by sa
cc-by-nd | cc|commons | (?:the )?(?:creative commons attribution no ?deriv(?:ative)?s?|cc by nd)(?: [234] 0)? | cc by nd [234] 0
cc-by-nc-4 | cc|commons | (?:the )?(?:creative commons attribution non ?commercial|cc by nc) 4 0(?: international)? | cc by nc 4 0
cc-by-nc-3 | cc|commons | (?:the )?(?:creative commons attribution non ?commercial|cc by nc) 3 0(?: unported)? | cc by nc 3 0
cc-by-nc | cc|commons | (?:the )?(?:creative commons attribution non ?commercial|cc by nc) | cc by nc
cc-by-nc-sa | cc|commons | (?:the )?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [234] 0)? | cc by nc sa [234] 0
cc-by-nc-nd | cc|commons | (?:the )?(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?|cc by nc nd)(?: [234] 0)? | cc by nc nd [234] 0
odbl-1 | odbl|database | (?:the )?(?:open data commons )?(?:open database licen[sc]e|odbl)(?: v?1 0)? | odbl 1 0
odc-by-1 | odc|commons | (?:the )?(?:open data commons attribution licen[sc]e|odc by)(?: v?1 0)? | odc by 1 0
pddl-1 | pddl|dedication | (?:the )?(?:public domain dedication and licen[sc]e|pddl)(?: v?1 0)? | pddl 1 0
psf-2 | python|psf | (?:the )?(?:python software foundation|psf) licen[sc]e(?: version 2)? | psf 2 0
python-2 | python | (?:the )?python licen[sc]e(?: 2 0)? | python 2 0
ruby | ruby | (?:the )?ruby licen[sc]e | ruby
php-3 | php | (?:the )?php licen[sc]e(?: version)? 3(?: 01| 0)? | php 3 0 ?1?
postgresql | postgresql | (?:the )?postgresql licen[sc]e | postgresql
openssl | openssl | (?:the )?openssl(?: ssleay)? licen[sc]e | openssl
ofl-1.1 | ofl|font | (?:the )?(?:sil )?(?:open font licen[sc]e|ofl)(?: version)?(?: 1 1)? | ofl 1 1
ms-pl | m(?:s|icrosoft) | (?:the )?(?:microsoft public licen[sc]e|ms pl) | ms pl
ms-rl | m(?:s|icrosoft) | (?:the )?(?:microsoft reciprocal licen[sc]e|ms rl) | ms rl
osl-3 | osl|open | (?:the )?(?:open software licen[sc]e|osl)(?: v?3(?: 0)?) | osl 3 0
afl-3 | afl|academic | (?:the )?(?:academic free licen[sc]e|afl)(?: v?3(?: 0)?) | afl 3 0
ecl-2 | ecl|educational | (?:the )?(?:educational community licen[sc]e|ecl)(?: version)? ?2(?: 0)? | ecl 2 0
upl-1 | upl|universal | (?:the )?(?:universal permissive licen[sc]e|upl)(?: version| v)? ?1(?: 0)? | upl 1 0
vim | vim | (?:the )?vim licen[sc]e | vim
w3c | w3c | (?:the )?w3c(?: software)?(?: notice and)? licen[sc]e | w3c
ncsa | ncsa | (?:the )?(?:university of illinois )?ncsa(?: open source)? licen[sc]e | ncsa
blueoak-1 | blue | (?:the )?blue oak model licen[sc]e(?: 1 0 0)? | blueoak 1 0 0
mulan-2 | mulan | (?:the )?mulan (?:psl|permissive software licen[sc]e)(?: v2| version 2) | mulanpsl 2 0
elastic-2 | elastic | (?:the )?elastic licen[sc]e(?: 2 0)? | elastic 2 0
sspl-1 | sspl|server | (?:the )?(?:server side public licen[sc]e|sspl)(?: v?1)? | sspl 1 0
busl-1.1 | bu?sl|business | (?:the )?(?:(?:business source licen[sc]e|busl)(?: 1 1)?|bsl 1 1) | bu?sl 1 1
openrail | open ?rail | (?:the )?(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[sc]e)? | openrail(?: m)?
all-rights-reserved | reserved | all rights reserved | all rights reserved
proprietary | proprietary | (?:proprietary and confidential|proprietary licen[sc]e) | licenseref proprietary
"""
#: Sentences of notices, grants, exceptions and choices of licenses: label | keyword | pattern. A keyword opens both gates.
NOTICES = r"""
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | deal in the software | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
boost-1 | permission is hereby granted | permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the software and accompanying documentation
isc | permission to use | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
bsd-0 | permission to use | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is granted
hpnd | permission to use | permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification(?: are| is) permitted
bsd-3 | neither the name | neither the name(?: [^ ]+){0,12} nor the names of(?: [^ ]+){1,4} contributors may be used to endorse or promote products
bsd-4 | advertising materials mentioning | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2 | this list of conditions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
apache-2 | use this file except | you may not use this file except in compliance with the licen[sc]e
apache-2 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis
apache-1.1 | this product includes software | this product includes software developed by the apache (?:software foundation|group)
gnu-notice | free software | this (?:program|library|file|package|software) is free software you can redistribute it and or modify it
gnu-notice | hope that it will be useful | (?:is )?distributed in the hope that it will be useful but without any warranty
gnu-notice | you should have received | you should have received a copy of the gnu (?:lesser |affero |library )?general public licen[sc]e along with this
agpl-3 | interacting with it remotely | all users interacting with it remotely through a computer network
gfdl | permission is granted to copy | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
mpl-2 | this source code form | this source code form is subject to the terms of the mozilla public licen[sc]e
mpl-1.1 | contents of this file | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
cddl-1 | contents of this file | the contents of this file are subject to the terms of the common development and distribution licen[sc]e
epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
unlicense | unencumbered software | this is free and unencumbered software released into the public domain
public-domain | dedicated to the public | (?:is |are )?(?:hereby )?dedicated to the public domain
public-domain | disclaims? copyright | the author(?:s)? disclaims? copyright to this source code
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | origin of this software | the origin of this software must not be misrepresented
cc0-1 | waived all copyright | waived all copyright and related or neighbou?ring rights
wtfpl | you just do what the | you just do what the f[a-z]* you want to
beerware | beer ?ware | (?:the )?beer ?ware licen[sc]e
ofl-1.1 | this font software | this font software is licen[sc]ed under the sil open font licen[sc]e
python-2 | licensee agrees | by copying installing or otherwise using python licensee agrees to be bound
postgresql | university of california | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
ncsa | university of illinois | neither the names of(?: [^ ]+){0,8} university of illinois(?: [^ ]+){0,8} nor the names of its contributors
w3c | this work is being provided | this work is being provided by the copyright holders under the following licen[sc]e
warranty-disclaimer | without warranty | (?:the |this )?software is provided as is without warranty of any kind express or implied
warranty-disclaimer | express or implied warrant | as is and any express or implied warranties(?: including but not limited to)?
classpath-exception-2 | classpath exception | (?:with (?:the )?)?(?:gnu )?classpath exception(?: 2 0)?
gcc-exception-3.1 | runtime library exception | (?:with (?:the )?)?gcc runtime library exception(?: version)?(?: 3 1)?
linking-exception | as a special exception | as a special exception the copyright holders of this library give you permission to link this library
autoconf-exception | autoconf exception | (?:with (?:the )?)?autoconf exception(?: [23] 0)?
bison-exception-2.2 | bison exception | (?:with (?:the )?)?bison exception(?: 2 2)?
font-exception-2 | font exception | (?:with (?:the )?)?font exception(?: 2 0)?
llvm-exception | llvm exception | (?:with (?:the )?)?llvm exceptions?
mit-or-apache-2 | either of | under either of(?: the)? (?:apache licen[sc]e version 2 0|mit licen[sc]e) or(?: the)? (?:mit licen[sc]e|apache licen[sc]e version 2 0) at your option
mit-or-apache-2 | mit (?:or )?apache | mit (?:or )?apache 2(?: 0)?
mit-or-apache-2 | mit licen[sc]e or | mit licen[sc]e or(?: the)? apache licen[sc]e(?: version)? 2(?: 0)?
mit-or-apache-2 | apache 2 | apache 2(?: 0)?(?: or)? mit
mit-or-gpl | gpl | gpl(?: v?[23])?(?: 0)?(?: only| or later)? or mit
mit-or-gpl | mit or gpl | mit or gpl(?: v?[23])?
mit-or-gpl | dual licen[sc]ed | dual licen[sc]ed under(?: the)? mit (?:and|or) gpl(?: v?[23])?(?: licen[sc]es?)?
proprietary | unauthori[sz]ed copying | unauthori[sz]ed copying of this (?:file|software|document) via any medium is strictly prohibited
proprietary | trade secrets? of | contains(?: confidential information and)? trade secrets? of
non-commercial | non ?commercial use | (?:for )?non ?commercial use only
non-commercial | commercial use is | commercial use is (?:strictly )?(?:prohibited|forbidden|not (?:allowed|permitted))
no-redistribution | redistribution is | redistribution is (?:strictly )?(?:prohibited|forbidden|not (?:allowed|permitted))
internal-use | internal use only | (?:for )?internal use only
"""
NOTICE_PRIORITY, NOTICE_SURE = 5, 0.98
#: priority, confidence, pattern around the name or identifier.
CONTEXTS = (
    (4, 1.0, "spdx licen[sc]e identifier {id}"),
    (3, 0.95, "(?:licen[sc]ed|released|distributed|available|published|provided|covered|dual licen[sc]ed) (?:under|by|with) (?:the terms (?:of|and conditions of) )?(?:the )?{name}"),
    (3, 0.95, "(?:dual )?licen[sc]ed under(?: the)?(?: terms of)?(?: the)? {id}"),
    (3, 0.9, "licen[sc]es?(?: osi approved| id| name| type| expression| key| file| text| is)? {id}"),
    (2, 0.9, "(?:under|subject to|pursuant to|in accordance with)(?: the)? (?:terms|conditions|provisions)(?: and conditions)? of {name}"),
    (1, 0.6, "{name}"),
)
_GAP = "[^0-9A-Za-z]+"


def _notices() -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ", 2)] for line in NOTICES.strip().splitlines()]


#: What a text must hold to go on: something of every name and identifier, or a notice's keyword. Most places fail at their first letter; abbreviations
#: stand as words, or before a version.
STEM = (
    rf"(?i)(?=[lscgprowmbeau])(?:licen[sc]|spdx|cc{_GAP}by|cc0|gpl|public{_GAP}domain|rights{_GAP}reserved|creative{_GAP}commons|open(?:{_GAP})?rail|proprietary|odbl|pddl|wtfpl|ms{_GAP}[pr]l|bsd{_GAP}[23t]"
    rf"|(?<![0-9A-Za-z])(?:(?:[me]pl|eupl|cddl|[oa]fl|osl|ecl|upl|sspl|bu?sl)(?![a-uw-z])|mulan{_GAP}psl|odc{_GAP}by))"
    + "|(?<![0-9A-Za-z])(?:" + "|".join(k.replace(" ?", f"(?:{_GAP})?").replace(" ", _GAP) for k in dict.fromkeys(k for _, k, _ in _notices())) + ")"
)


def _literal(keyword: str) -> str:
    """The longest word that whatever a keyword's expression matches holds, without what is optional or a choice."""
    plain = re.sub(r"\([^)]*\)\??|\[[^]]*\]|.\?|[^a-z]", " ", keyword)
    return max(plain.split(), key=lambda w: (w != "mit", len(w)))


#: Each text that STEM matches holds one of the words, in some case, or what SHORT matches: names too short or too common in other words for a plain search.
WORDS = sorted({"licen", "spdx", "gpl", "domain", "reserved", "creative", "rail", "proprietary", "odbl", "pddl", "wtfpl", *(_literal(k) for _, k, _ in _notices())})
WORDS = [w for w in WORDS if not any(x in w for x in WORDS if x != w)]
SHORT = rf"(?i)(?=[cmbeouas])(?:cc{_GAP}by|cc0|ms{_GAP}[pr]l|bsd{_GAP}[23t]|(?<![0-9A-Za-z])(?:(?:[me]pl|eupl|cddl|[oa]fl|osl|ecl|upl|sspl|bu?sl)(?![a-uw-z])|mulan{_GAP}psl|odc{_GAP}by))"


def goes_on(text: Column) -> Column:
    """Whether a text holds something of a rule: plain words are searched for first, STEM only where one of them stands."""
    low = F.transform(F.array(F.lower(text)), lambda t: reduce(lambda a, b: a | b, (t.contains(w) for w in WORDS)))[0]
    return (low | text.rlike(SHORT)) & text.rlike(STEM)


def rules() -> list[tuple[str, int, float, str, str]]:
    """(label, priority, confidence, keyword expression, pattern) in order of precedence."""
    out = [(label, NOTICE_PRIORITY, NOTICE_SURE, f" (?:{keyword})", f" (?:{pattern})(?= )") for label, keyword, pattern in _notices()]
    for line in NAMES.strip().splitlines():
        label, keyword, name, spdx = _fields(line)
        out += [(label, priority, sure, f" (?:{keyword})", f" (?:{context.format(name=name, id=spdx)})(?= )") for priority, sure, context in CONTEXTS]
    return sorted(out, key=lambda r: -r[1])


def _fields(line: str) -> tuple[str, str, str, str]:
    label, rest = line.split(" | ", 1)
    rest, spdx = rest.rsplit(" | ", 1)
    keyword, name = rest.split(" | ", 1)
    return label.strip(), keyword.strip(), name.strip(), spdx.strip()


def line_of(text: Column) -> Column:
    """The lower-case words of a text with a blank before and after each; A-Z only change case."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), " "), F.lit(" "))


def _spans(line: Column, matches: Column) -> Column:
    """Places (first, end) in the line of consecutive matches of one pattern."""
    def step(acc: Column, m: Column) -> Column:
        at = F.transform(F.array(F.call_function("locate", m, line, acc["next"])), lambda p: F.struct(p.alias("first"), (p + F.length(m)).alias("end")))
        return F.transform(at, lambda s: F.struct(s["end"].alias("next"), F.concat(acc["out"], F.array(s)).alias("out")))[0]

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<first:int,end:int>>").alias("out"))
    return F.aggregate(matches, start, step)["out"]


def detections(line: Column) -> Column:
    """All matches of all rules whose keyword is in the line, as (first, end, priority, rank, label, sure)."""
    ordered = list(enumerate(rules()))
    rule = lambda k, r: {"rank": k, "label": r[0], "priority": r[1], "sure": r[2], "pattern": r[4]}
    by_keyword = [{"keyword": w, "rules": [rule(k, r) for k, r in ordered if r[3] == w]} for w in dict.fromkeys(r[3] for _, r in ordered)]
    # One constant, however many rules there are: an expression for each of their fields would take the planner seconds.
    table = F.from_json(F.lit(json.dumps(by_keyword)), "array<struct<keyword:string,rules:array<struct<rank:int,label:string,priority:int,sure:double,pattern:string>>>>")
    ready = F.flatten(F.transform(F.filter(table, lambda g: F.rlike(line, g["keyword"])), lambda g: g["rules"]))
    found = lambda r: F.transform(
        _spans(line, F.regexp_extract_all(line, r["pattern"], F.lit(0))),
        lambda s: F.struct(s["first"].alias("first"), (-s["end"]).alias("back"), (-r["priority"]).alias("order"), r["rank"].alias("rank"), r["label"].alias("label"), r["sure"].alias("sure")),
    )
    return F.flatten(F.transform(ready, found))


def unsuppressed(found: Column) -> Column:
    """Detections that no other one contains or beats; found: from detections()."""
    def step(acc: Column, d: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        apart = last.isNull() | (d["first"] >= -last["back"])
        inside = d["back"] >= last["back"]
        weaker = d["order"] >= last["order"]
        return F.when(apart, F.concat(acc, F.array(d))).when(inside | weaker, acc).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(d)))

    kind = "array<struct<first:int,back:int,order:int,rank:int,label:string,sure:double>>"
    return F.aggregate(F.array_sort(found), F.array().cast(kind), step)


def scan(docs: DataFrame, into: str = "licenses") -> DataFrame:
    """docs with a column (it replaces one of that name): n_words, the line of texts that go on (else null) and the detections that stand."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.size(F.array_remove(F.split(text, _RAW_GAP), "")).cast("long").alias("n_words"), F.when(goes_on(text), line_of(text)).alias("line"))
    found = F.when(F.col("line").isNotNull(), unsuppressed(detections(F.col("line"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != into], F.struct("n_words", "line", found.alias("found")).alias(into))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs."""
    out = scan(docs.select("doc_id", "text")).select("doc_id", F.col("licenses.n_words").alias("n_words"), F.col("licenses.line").alias("_line"), F.col("licenses.found").alias("_found"))
    line = F.col("_line")
    count, first, last, names = [], [], [], []
    for phrase, label in BASE.items():
        spaced = F.lit(f" {phrase} ")
        has = line.contains(f" {phrase} ")
        word = lambda place: F.regexp_count(F.substr(line, F.lit(1), place), F.lit(" ")).cast("long") - 1
        count.append(F.when(has, F.regexp_count(line, F.lit(f" {phrase}(?= )"))).otherwise(0).cast("long"))
        first.append(F.when(has, word(F.locate(f" {phrase} ", line))))
        last.append(F.when(has, word(F.length(line) - F.length(F.substring_index(line, f" {phrase} ", -1)) - F.length(spaced) + 1)))
        names.append(F.when(has, F.lit(label)))
    base = F.array_compact(F.array(*names))
    found = F.coalesce(F.col("_found"), F.array().cast("array<struct<first:int,back:int,order:int,rank:int,label:string,sure:double>>"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    sure = F.greatest(F.coalesce(F.array_max(F.transform(found, lambda d: d["sure"])), F.lit(0.0)), F.when(F.size(base) > 0, 0.9).otherwise(0.0))
    return out.select(
        "doc_id", "n_words", reduce(lambda a, b: a + b, count).alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform(found, lambda d: d["label"]))).alias("labels"), sure.alias("score"),
    )
