"""Signature rules for licences, in order of priority.

A line is ``label | confidence | keyword | pattern``. Patterns read a text's lower-case words with one space between
them; they are regular expressions of the kind that Java and RE2 read alike. A rule is tried only where its keyword
starts a word of the text, so each alternative of a pattern holds the keyword. Of overlapping detections those contained in one of an earlier rule are dropped, so long
signatures stand before short ones.
"""

from __future__ import annotations

RULES = r"""
apache-2.0 | 1.00 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 1.00 | apache | spdx license identifier apache 2 0
apache-2.0 | 0.98 | apache | (?:licensed|released|distributed|available|provided|published) under the (?:terms of the )?apache (?:software )?license version 2(?: 0)?
apache-2.0 | 0.97 | apache | (?:licensed|released|distributed|available) under (?:the )?apache 2(?: 0)?(?: license)?
apache-2.0 | 0.97 | apache | www apache org licenses license 2 0(?: txt| html)?
apache-2.0 | 0.95 | apache | apache (?:software )?license (?:version |v)?2(?: 0)?
apache-2.0 | 0.90 | apache | (?:asl|al) 2 0 apache
apache-2.0 | 0.90 | royalty | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce
apache-1.1 | 0.98 | apache | the apache software license version 1 1
apache-1.1 | 0.95 | apache | this product includes software developed by the apache software foundation
apache-1.0 | 0.95 | apache | apache (?:group )?license version 1 0
apache | 0.70 | apache | (?:licensed|released|distributed) under (?:the|an) apache(?: style)? license
apache | 0.60 | apache | apache (?:software )?license
mit | 1.00 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | 1.00 | identifier | spdx license identifier mit
mit | 0.98 | mit | (?:licensed|released|distributed|available|provided|published) under the (?:terms of the )?mit license
mit | 0.97 | mit | (?:licensed|released) under (?:the )?mit
mit | 0.97 | opensource | opensource org licenses mit(?: license)?(?: php| html)?
mit | 0.95 | mit | the mit license(?: mit)?
mit | 0.90 | mit | mit (?:x11 )?(?:style )?license
mit | 0.85 | merge | use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 0.85 | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 0.95 | mit | mit (?:0|no attribution)(?: license)?
x11 | 0.90 | x11 | (?:the )?x11 license
x11 | 0.80 | consortium | the name of the x consortium shall not be used in advertising
agpl-3.0 | 1.00 | affero | gnu affero general public license as published by the free software foundation either version 3 of the license
agpl-3.0 | 1.00 | identifier | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 | 0.98 | affero | (?:licensed|released|distributed) under the (?:terms of the )?gnu affero general public license(?: version 3| v3)?
agpl-3.0 | 0.97 | affero | (?:gnu )?affero general public license (?:version |v)3(?: 0)?
agpl-3.0 | 0.90 | agpl | agpl ?v?3(?: 0)?(?: or later| only)?
agpl-1.0 | 0.95 | affero | affero general public license version 1
agpl | 0.85 | affero | (?:gnu )?affero general public license
agpl | 0.75 | agpl | (?:licensed|released) under (?:the )?(?:gnu )?agpl
lgpl-3.0 | 1.00 | lesser | gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-3.0 | 1.00 | identifier | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 | 0.97 | lesser | (?:gnu )?lesser general public license (?:version |v)3(?: 0)?
lgpl-3.0 | 0.90 | lgpl | (?:gnu )?lgpl ?v?3(?: 0)?(?: or later| only)?
lgpl-2.1 | 1.00 | lesser | gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-2.1 | 1.00 | identifier | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | 0.97 | lesser | (?:gnu )?lesser general public license (?:version |v)2 1
lgpl-2.1 | 0.90 | lgpl | (?:gnu )?lgpl ?v?2 1(?: or later| only)?
lgpl-2.0 | 0.97 | library | (?:gnu )?library general public license(?: version 2| v2)?(?: 0)?
lgpl-2.0 | 0.90 | lgpl | (?:gnu )?lgpl ?v?2(?: 0)?(?: or later| only)?
lgpl | 0.85 | lesser | (?:gnu )?lesser general public license
lgpl | 0.75 | lgpl | (?:licensed|released) under (?:the )?(?:gnu )?lgpl
gpl-3.0 | 1.00 | general | (?:this (?:work|program|software|file) is )?(?:licensed|released|distributed) under the (?:terms of the )?gnu general public license version 3(?: 0)?
gpl-3.0 | 1.00 | identifier | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3.0 | 1.00 | general | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0 | 0.97 | general | (?:gnu )?general public license (?:version |v)3(?: 0)?
gpl-3.0 | 0.95 | gnu | www gnu org licenses gpl 3 0(?: html| txt| en html)?
gpl-3.0 | 0.90 | gpl | (?:gnu )?gpl ?v?3(?: 0)?(?: or later| only)?
gpl-3.0 | 0.90 | gplv3 | (?:gnu )?gplv3(?: or later)?
gpl-2.0 | 1.00 | general | (?:this (?:work|program|software|file) is )?(?:licensed|released|distributed) under the (?:terms of the )?gnu general public license version 2(?: 0)?
gpl-2.0 | 1.00 | identifier | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2.0 | 1.00 | general | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0 | 0.97 | general | (?:gnu )?general public license (?:version |v)2(?: 0)?
gpl-2.0 | 0.95 | gnu | www gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-2.0 | 0.90 | gpl | (?:gnu )?gpl ?v?2(?: 0)?(?: or later| only)?
gpl-2.0 | 0.90 | gplv2 | (?:gnu )?gplv2(?: or later)?
gpl-1.0 | 0.97 | general | (?:gnu )?general public license (?:version |v)1(?: 0)?
gpl | 0.95 | gnu | you should have received a copy of the gnu general public license along with this (?:program|file|software|library)
gpl | 0.90 | general | (?:licensed|released|distributed) under the (?:terms of the )?(?:gnu )?general public license
gpl | 0.85 | gnu | gnu general public license
gpl | 0.75 | gpl | (?:licensed|released|distributed) under (?:the )?(?:gnu )?gpl
gpl | 0.70 | general | general public license
gfdl-1.3 | 0.97 | documentation | (?:gnu )?free documentation license (?:version |v)1 3
gfdl-1.2 | 0.97 | documentation | (?:gnu )?free documentation license (?:version |v)1 2
gfdl-1.1 | 0.97 | documentation | (?:gnu )?free documentation license (?:version |v)1 1
gfdl | 0.85 | documentation | (?:gnu )?free documentation license
gfdl | 0.70 | gfdl | (?:licensed|released) under (?:the )?(?:gnu )?gfdl
cc0-1.0 | 1.00 | cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 0.97 | cc0 | cc0 1 0 universal(?: public domain dedication)?
cc0-1.0 | 0.95 | creativecommons | creativecommons org publicdomain zero 1 0
cc0-1.0 | 0.85 | cc0 | (?:licensed|released|available) under (?:the )?(?:creative commons )?cc0
cc0-1.0 | 0.80 | cc0 | (?:creative commons )?cc0(?: 1 0)?
cc-by-nc-nd-4.0 | 0.98 | cc | (?:licensed under )?(?:a )?(?:creative commons )?cc by nc nd 4 0
cc-by-nc-nd-3.0 | 0.98 | cc | (?:licensed under )?cc by nc nd 3 0
cc-by-nc-nd | 0.95 | noncommercial | creative commons attribution noncommercial noderiv(?:s|atives)(?: [1-4] 0)?(?: international| unported)?(?: license)?
cc-by-nc-nd | 0.93 | commercial | creative commons attribution non commercial no deriv(?:s|atives)(?: [1-4] 0)?(?: international| unported)?(?: license)?
cc-by-nc-nd | 0.85 | cc | (?:licensed under )?cc by nc nd
cc-by-nc-sa-4.0 | 0.98 | cc | (?:licensed under )?(?:creative commons )?cc by nc sa 4 0
cc-by-nc-sa-3.0 | 0.98 | cc | (?:licensed under )?cc by nc sa 3 0
cc-by-nc-sa | 0.95 | noncommercial | creative commons attribution noncommercial sharealike(?: [1-4] 0)?(?: international| unported)?(?: license)?
cc-by-nc-sa | 0.93 | commercial | creative commons attribution non commercial share alike(?: [1-4] 0)?(?: international| unported)?(?: license)?
cc-by-nc-sa | 0.85 | cc | (?:licensed under )?cc by nc sa
cc-by-nc-4.0 | 0.98 | cc | (?:licensed under )?(?:creative commons )?cc by nc 4 0
cc-by-nc-3.0 | 0.98 | cc | (?:licensed under )?cc by nc 3 0
cc-by-nc-2.0 | 0.98 | cc | (?:licensed under )?cc by nc 2 0
cc-by-nc | 0.95 | noncommercial | creative commons attribution noncommercial(?: [1-4] 0)?(?: international| unported)?(?: license)?
cc-by-nc | 0.93 | commercial | creative commons attribution non commercial(?: [1-4] 0)?(?: international| unported)?(?: license)?
cc-by-nc | 0.90 | creativecommons | creativecommons org licenses by nc(?: [1-4] 0)?
cc-by-nc | 0.85 | cc | (?:licensed under )?cc by nc
cc-by-nd-4.0 | 0.98 | cc | (?:licensed under )?cc by nd 4 0
cc-by-nd-3.0 | 0.98 | cc | (?:licensed under )?cc by nd 3 0
cc-by-nd | 0.95 | creative | creative commons attribution no ?deriv(?:s|atives)(?: [1-4] 0)?(?: international| unported)?(?: license)?
cc-by-nd | 0.85 | cc | (?:licensed under )?cc by nd
cc-by-sa-4.0 | 0.98 | cc | (?:licensed under )?(?:creative commons )?cc by sa 4 0
cc-by-sa-3.0 | 0.98 | cc | (?:licensed under )?cc by sa 3 0
cc-by-sa-2.5 | 0.98 | cc | (?:licensed under )?cc by sa 2 5
cc-by-sa | 0.95 | creative | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-sa | 0.90 | creativecommons | creativecommons org licenses by sa(?: [1-4] 0)?
cc-by-sa | 0.85 | cc | (?:licensed under )?cc by sa
cc-by-4.0 | 0.98 | cc | (?:licensed under )?(?:creative commons )?cc by 4 0
cc-by-3.0 | 0.98 | cc | (?:licensed under )?cc by 3 0
cc-by-2.0 | 0.98 | cc | (?:licensed under )?cc by 2 0
cc-by | 0.95 | creative | creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)?(?: license)?
cc-by | 0.90 | creativecommons | creativecommons org licenses by(?: [1-4] 0)?
cc-by | 0.75 | cc | licensed under cc by
cc | 0.70 | creative | (?:licensed under )?(?:a )?creative commons license
bsd-4-clause | 1.00 | identifier | spdx license identifier bsd 4 clause
bsd-4-clause | 0.95 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4-clause | 0.90 | bsd | (?:original|4 clause|four clause) bsd license
bsd-3-clause | 1.00 | identifier | spdx license identifier bsd 3 clause
bsd-3-clause | 0.97 | endorse | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause | 0.95 | bsd | bsd 3 clause(?: [a-z]+)? license
bsd-3-clause | 0.95 | bsd | (?:new|revised|modified|3 clause|three clause) bsd license
bsd-3-clause | 0.93 | opensource | opensource org licenses bsd 3 clause
bsd-3-clause | 0.85 | bsd | bsd 3 clause
bsd-2-clause | 1.00 | identifier | spdx license identifier bsd 2 clause
bsd-2-clause | 0.95 | bsd | bsd 2 clause(?: [a-z]+)? license
bsd-2-clause | 0.95 | bsd | (?:simplified|freebsd|2 clause|two clause) bsd license
bsd-2-clause | 0.93 | opensource | opensource org licenses bsd 2 clause
bsd-2-clause | 0.85 | bsd | bsd 2 clause
0bsd | 0.95 | bsd | (?:zero clause bsd|bsd zero clause)(?: license)?
0bsd | 0.95 | 0bsd | 0bsd(?: license)?
bsd | 0.90 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 0.80 | bsd | (?:licensed|released|distributed) under (?:the|a) bsd(?: style)?(?: license)?
bsd | 0.65 | bsd | bsd (?:style )?license
isc | 1.00 | identifier | spdx license identifier isc
isc | 0.97 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 0.90 | isc | (?:the )?isc license
isc | 0.85 | isc | (?:licensed|released) under (?:the )?isc
mpl-2.0 | 1.00 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 1.00 | identifier | spdx license identifier mpl 2 0
mpl-2.0 | 0.97 | mozilla | mozilla public license (?:version |v ?)?2 0
mpl-2.0 | 0.95 | mozilla | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-2.0 | 0.85 | mpl | mpl (?:version |v)?2 0
mpl-1.1 | 1.00 | identifier | spdx license identifier mpl 1 1
mpl-1.1 | 0.97 | mozilla | mozilla public license (?:version |v ?)?1 1
mpl-1.1 | 0.85 | mpl | mpl (?:version |v)?1 1
mpl-1.0 | 0.97 | mozilla | mozilla public license (?:version |v ?)?1 0
mpl | 0.80 | mozilla | mozilla public license
epl-2.0 | 1.00 | identifier | spdx license identifier epl 2 0
epl-2.0 | 0.97 | eclipse | eclipse public license (?:version |v ?)?2(?: 0)?
epl-2.0 | 0.95 | eclipse | (?:www )?eclipse org legal epl (?:v20|2 0)
epl-1.0 | 1.00 | identifier | spdx license identifier epl 1 0
epl-1.0 | 0.97 | eclipse | eclipse public license (?:version |v ?)?1(?: 0)?
epl-1.0 | 0.95 | eclipse | (?:www )?eclipse org legal epl v10
epl | 0.80 | eclipse | eclipse public license
edl-1.0 | 0.95 | eclipse | eclipse distribution license(?: version| v)?(?: 1 0)?
cpl-1.0 | 0.95 | common | common public license(?: version| v)?(?: 1 0)?
ipl-1.0 | 0.95 | ibm | ibm public license(?: version| v)?(?: 1 0)?
cddl-1.1 | 0.97 | cddl | cddl (?:version |v ?)?1 1
cddl-1.1 | 0.97 | development | common development and distribution license (?:version |v ?)?1 1
cddl-1.0 | 0.97 | development | common development and distribution license(?: cddl)?(?: version| v)? 1 0
cddl | 0.85 | development | common development and distribution license
cddl | 0.70 | cddl | (?:licensed|released) under (?:the )?cddl
eupl-1.2 | 0.97 | eupl | eupl (?:version |v ?)?1 2
eupl-1.2 | 0.97 | european | european union public licen[cs]e (?:version |v ?)?1 2
eupl-1.1 | 0.97 | eupl | eupl (?:version |v ?)?1 1
eupl-1.1 | 0.97 | european | european union public licen[cs]e (?:version |v ?)?1 1
eupl | 0.85 | european | european union public licen[cs]e
bsl-1.0 | 1.00 | identifier | spdx license identifier bsl 1 0
bsl-1.0 | 0.97 | boost | (?:distributed under the )?boost software license(?: version)?(?: 1 0)?
bsl-1.0 | 0.95 | boost | (?:www )?boost org license 1 0 txt
busl-1.1 | 1.00 | identifier | spdx license identifier busl 1 1
busl-1.1 | 0.95 | business | business source license(?: version)?(?: 1 1)?
sspl-1.0 | 0.97 | sspl | spdx license identifier sspl 1 0
sspl-1.0 | 0.95 | server | server side public license(?: version| v)?(?: 1)?
elastic-2.0 | 0.95 | elastic | elastic license (?:version |v)?2 0
elastic | 0.80 | elastic | (?:licensed|released) under the elastic license
unlicense | 1.00 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 1.00 | identifier | spdx license identifier unlicense
unlicense | 0.90 | unlicense | (?:the unlicense|unlicense org|released under the unlicense)
wtfpl | 0.97 | want | do what the (?:fuck|f) you want to public license
wtfpl | 0.90 | wtfpl | (?:the )?wtfpl
zlib | 1.00 | identifier | spdx license identifier zlib
zlib | 0.95 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 0.90 | zlib | (?:the )?zlib(?: libpng)? license
libpng | 0.90 | libpng | libpng license
artistic-2.0 | 1.00 | identifier | spdx license identifier artistic 2 0
artistic-2.0 | 0.97 | artistic | (?:the )?artistic license (?:version |v)?2 0
artistic-1.0 | 0.95 | artistic | (?:the )?artistic license (?:version |v)?1 0
artistic | 0.80 | artistic | (?:the )?(?:perl )?artistic license
perl | 0.90 | perl | (?:under )?the same terms as perl(?: itself)?
psf-2.0 | 0.95 | python | python software foundation license(?: version)?(?: 2)?
psf | 0.85 | psf | psf license(?: agreement)?
ruby | 0.85 | ruby | (?:the )?ruby license
php-3.01 | 0.95 | php | (?:the )?php license(?: version)?(?: 3 01?)?
openssl | 0.95 | openssl | (?:the )?openssl license
openssl | 0.90 | openssl | this product includes software developed by the openssl project
postgresql | 0.95 | postgresql | (?:the )?postgresql licen[cs]e
ofl-1.1 | 1.00 | identifier | spdx license identifier ofl 1 1
ofl-1.1 | 0.97 | font | (?:sil )?open font license(?: version)?(?: 1 1)?
odbl-1.0 | 0.97 | database | open (?:data commons open )?database license(?: v| version)?(?: 1 0)?
odbl-1.0 | 0.90 | odbl | (?:licensed under )?(?:the )?odbl(?: 1 0)?
odc-by-1.0 | 0.95 | odc | odc by(?: v| version)?(?: 1 0)?
odc-by-1.0 | 0.95 | commons | open data commons attribution license(?: v| version)?(?: 1 0)?
pddl-1.0 | 0.95 | dedication | public domain dedication and license(?: pddl)?
ogl-3.0 | 0.95 | government | open government licen[cs]e(?: version| v)?(?: 3 0)?
ncsa | 0.95 | ncsa | (?:university of illinois )?ncsa open source license
afl-3.0 | 0.95 | academic | academic free license(?: version| v)?(?: 3 0)?
osl-3.0 | 0.95 | open | open software license(?: version| v)?(?: 3 0)?
ms-pl | 0.95 | microsoft | microsoft public license(?: ms pl)?
ms-rl | 0.95 | microsoft | microsoft reciprocal license(?: ms rl)?
upl-1.0 | 0.95 | universal | universal permissive license(?: version| v)?(?: 1 0)?
mulan-2.0 | 0.95 | mulan | mulan (?:permissive software license|psl)(?: v2| version 2)?
cecill-2.1 | 0.95 | cecill | cecill(?: free software)?(?: license)?(?: agreement)?(?: v| version)? 2 1
cecill | 0.80 | cecill | (?:licence |license )?cecill(?: b| c)?
qpl-1.0 | 0.90 | public | (?:the )?q public license(?: version)?(?: 1 0)?
sleepycat | 0.90 | sleepycat | sleepycat license
beerware | 0.95 | beer | the beer ?ware license
json | 0.95 | evil | the software shall be used for good not evil
openrail | 0.95 | rail | open rail(?: m| s)?
openrail | 0.95 | openrail | openrail(?: m| s)?
openrail | 0.95 | responsible | responsible ai license(?: m| s)?
llama-community | 0.95 | llama | llama [1-9](?: [0-9])? community license(?: agreement)?
public-domain | 0.85 | domain | (?:this (?:work|file|code|document|text) is |is hereby |released |placed |dedicated )(?:in|into|to) the public domain
public-domain | 0.70 | domain | public domain mark(?: 1 0)?
proprietary | 0.90 | proprietary | (?:this (?:software|document|work) is )?proprietary and confidential
proprietary | 0.85 | unauthorized | unauthorized (?:copying|reproduction|distribution)(?: or [a-z]+)* (?:of this (?:file|work|document|material) )?(?:via any medium )?is strictly prohibited
all-rights-reserved | 0.60 | reserved | copyright(?: c)?(?: [0-9]{4}){0,2}(?: [^ ]+){1,6} all rights reserved
all-rights-reserved | 0.50 | reserved | all rights reserved
mit | 0.60 | mit | mit license
apache | 0.55 | apache | apache license
gpl | 0.55 | general | general public license
"""


def rules() -> list[tuple[int, str, float, str, str]]:
    """(priority, label, confidence, keyword, pattern) by priority.

    Keyword and pattern are for texts whose words stand between two spaces on either side: each takes one of them, so
    that neighbouring detections don't contend for a space.
    """
    out = []
    for line in RULES.strip().splitlines():
        label, confidence, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        spread = _spread(pattern)
        out.append((len(out), label, float(confidence), keyword, f" (?:{spread}) "))
    return out


def _spread(pattern: str) -> str:
    """Each space of ``pattern`` as two, but for those in brackets and before a question mark (an optional gap)."""
    parts, inside = [], False
    for i, ch in enumerate(pattern):
        inside = ch == "[" or (inside and ch != "]")
        if ch == " " and not inside:
            parts.append("(?:  )" if pattern[i + 1 : i + 2] == "?" else "  ")
        else:
            parts.append(ch)
    return "".join(parts)
