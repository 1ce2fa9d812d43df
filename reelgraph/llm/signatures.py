"""Signatures of licences written one by one: sentences of their bodies, notices of file headers, links and short forms."""

from __future__ import annotations

#: What a signature is, and its priority: sentences and headers of a licence above links, those above short forms.
PRIORITY = {"text": 5, "header": 5, "link": 4, "short": 2}

#: A text that holds none of these is not looked at; a keyword stands under the first of them that it holds.
ROOTS = (
    "licen", "permi", "warrant", "distribut", "copyright", "copyleft", "public domain", "gpl", "software", "source", "apache", "mozilla",
    "creative", "commons", "gnu", "bsd", "liab", "confidential", "reserved", "documentation", "attribution", "consequential", "library",
    "eclipse", "cddl", "legal", "wtf", "cc0", "same terms as", "openssl", "profits", "fee is hereby", "beer", "program", "affirmer",
    "exercising", "unicode", "latex", "artistic", "scripts sil org", "w3 org", "functionality", "network", "x window", "royalty free", "contributions", "fuck", "commercial advantage",
)

_NAMES = r"[^ ]+(?: [^ ]+){0,11}?"  # one to twelve words: a holder's name
_HTTP = r"(?:https? )?(?:www )?"

#: Fixed values from the public texts of the licences, as words in lower case: label -> (kind, keyword, pattern). Each match
#: of a pattern holds the keyword.
SIGNATURES = {
    "mit": [
        ("text", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of th(?:is|e) software and associated documentation files"),
        ("text", "publish distribute sublicense", r"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
        ("text", "substantial portions of the software", r"(?:the above|this) copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
        ("text", "the software is provided as is without warranty", r"the software is provided as is without warranty of any kind express or implied(?: including but not limited to the warranties of merchantability)?"),
        ("text", "or other liability whether in an action", r"authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
        ("header", "style licen", r"(?:governed|covered) by (?:the|an?) mit style licen[sc]e"),
        ("link", "opensource org licenses mit", r"opensource org licenses mit(?: license(?: php)?)?"),
        ("link", "mit license org", r"mit license org"),
        ("short", "mit licen", r"mit licen[sc]ed"),
    ],
    "mit-0": [("short", "mit no attribution", r"mit no attribution(?: licen[sc]e)?"), ("link", "licenses mit 0", r"(?:opensource|spdx) org licenses mit 0")],
    "x11": [
        ("text", "dealings in this software", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software(?: without prior written authorization)?"),
        ("text", "x window system", r"x window system is a trademark of the x consortium"),
    ],
    "hpnd": [
        ("text", "its documentation for any purpose", r"permission to use copy modify(?: and)?(?: or)?(?: distribute)?(?: and)?(?: sell)? this software and its documentation for any purpose (?:and without fee )?is hereby granted"),
        ("text", "permission notice appear in supporting documentation", r"(?:that )?both that copyright notice and this permission notice appear in supporting documentation"),
        ("text", "representations about the suitability of this software", r"makes? no representations about the suitability of this software for any purpose"),
    ],
    "apache": [
        ("header", "licensed under the apache license", r"licensed under the apache license version 2 0 the license you may not use this (?:file|software|work|library|project) except in compliance with the license"),
        ("header", "except in compliance with the license", r"you may not use this (?:file|software|work|library|project) except in compliance with the license"),
        ("header", "distributed under the license is distributed on an", r"software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
        ("header", "governing permissions and limitations", r"see the license for the specific language governing permissions and limitations under the license"),
        ("header", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
        ("text", "no charge royalty free irrevocable", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? (?:copyright|patent) license"),
        ("text", "submission of contributions", r"submission of contributions unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work"),
        ("text", "attribution notices contained within such notice file", r"readable copy of the attribution notices contained within such notice file"),
        ("text", "trademarks this license does not grant", r"trademarks this license does not grant permission to use the trade names trademarks service marks or product names of the licensor"),
        ("text", "developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)"),
        ("link", "apache org licenses", _HTTP + r"apache org licenses(?: license(?: [12] [01])?)?"),
        ("short", "apache 2", r"apache 2(?: 0)?(?: licensed)?"),
        ("short", "apache licensed", r"apache licensed"),
        ("short", "apache v2", r"apache v2(?: 0)?"),
        ("short", "apache software license", r"apache software license version [12](?: [01])?"),
    ],
    "bsd": [
        ("text", "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
        ("text", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
        ("text", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
        ("text", "endorse or promote products derived from this software", r"neither the names? of " + _NAMES + r" nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
        ("text", "promote products derived from this software", r"the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"),
        ("text", "mentioning features or use of this software", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
        ("text", "software is provided by the", r"this software is provided by the (?:copyright holders? and contributors|regents and contributors|authors?|copyright holders?) as is and any express or implied warranties"),
        ("text", "exemplary or consequential damages", r"(?:be liable )?for any direct indirect incidental special exemplary or consequential damages(?: including but not limited to procurement of substitute goods)?"),
        ("header", "governed by a bsd style licen", r"use of this source code is governed by a bsd style licen[sc]e(?: that can be found in the license file)?"),
        ("link", "opensource org licenses bsd", r"opensource org licenses bsd(?: license(?: php)?| [0234] clause)?"),
        ("short", "bsd licensed", r"bsd licensed"),
        ("short", "bsd style", r"bsd style"),
        ("short", "clause bsd", r"(?:[234]|two|three|four) clause bsd"),
        ("short", "bsd 2 clause", r"bsd 2 clause"),
        ("short", "bsd 3 clause", r"bsd 3 clause"),
        ("short", "bsd 4 clause", r"bsd 4 clause"),
        ("text", "the regents of the university of california all rights reserved", r"the regents of the university of california all rights reserved"),
    ],
    "0bsd": [
        ("text", "with or without fee is hereby granted the software", r"distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
        ("short", "0bsd", r"0bsd"),
        ("short", "zero clause bsd", r"zero clause bsd"),
    ],
    "isc": [
        ("text", "with or without fee is hereby granted", r"permission to use copy modify (?:and|or|and or) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
        ("text", "disclaims all warranties with regard to this software", r"the software is provided as is and (?:the authors?|isc|internet systems consortium(?: inc)?) disclaims all warranties with regard to this software"),
        ("text", "resulting from loss of use data or profits whether in an action of contract negligence", r"any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action"),
        ("link", "opensource org licenses isc", r"opensource org licenses isc(?: license(?: txt)?)?"),
        ("short", "isc licensed", r"isc licensed"),
    ],
    "zlib": [
        ("text", "any express or implied warranty in no event will the author", r"this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software"),
        ("text", "permission is granted to anyone to use this software", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
        ("text", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
        ("text", "altered source versions must be plainly marked", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
        ("text", "altered from any source distribution", r"this notice may not be removed or altered from any source distribution"),
        ("link", "opensource org licenses zlib", r"opensource org licenses zlib(?: license(?: php)?)?"),
    ],
    "libpng": [
        ("text", "permission is hereby granted to use copy modify and distribute this source code", r"permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee"),
        ("text", "altered from any source or altered source distribution", r"this copyright notice may not be removed or altered from any source or altered source distribution"),
        ("text", "png reference library is supplied", r"the png reference library is supplied as is"),
    ],
    "gpl": [
        ("header", "under the terms of the gnu general public license", r"(?:is free software )?(?:you can redistribute it and or modify it )?under the terms of the gnu general public license(?: as published by the free software foundation)?(?: either version [23](?: of the license)?)?(?: or at your option any later version)?"),
        ("header", "copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with"),
        ("header", "see the gnu general public license", r"see the gnu general public license for more details"),
        ("header", "under the terms of version 2 of the gnu general public license", r"under the terms of version 2 of the gnu general public license"),
        ("text", "gnu general public license version", r"gnu general public license version [123](?: 0)? (?:june 1991|29 june 2007|1 february 1989)"),
        ("text", "the licenses for most software", r"the licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
        ("text", "general public license is intended to guarantee your freedom", r"the gnu general public license is intended to guarantee your freedom to share and change"),
        ("text", "is a free copyleft license for software", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
        ("text", "any program or other work which contains a notice", r"this license applies to any program or other work which contains a notice placed by the copyright holder"),
        ("text", "comes with absolutely no warranty", r"comes with absolutely no warranty for details type show w"),
        ("link", "gnu org licenses gpl", _HTTP + r"gnu org licenses gpl(?: [123] 0)?(?: html| txt)?"),
        ("link", "gnu org copyleft gpl", _HTTP + r"gnu org copyleft gpl(?: html| txt)?"),
        ("link", "opensource org licenses gpl", r"opensource org licenses gpl(?: [123] 0| license)?"),
        ("short", " gplv", r"gplv[123](?: or later| only)?"),
        ("short", " gpl v", r"gpl v ?[123](?: or later| only)?"),
        ("short", " gpl ", r"gpl [123](?: 0)?(?: or later| only)?"),
        ("short", "gnu gpl", r"gnu gpl"),
        ("short", "gpl compatible", r"gpl compatible"),
        ("short", "gpl licensed", r"gpl licensed"),
    ],
    "gpl-classpath": [
        ("text", "linking this library statically or dynamically with other modules", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
        ("short", "gnu classpath exception", r"gnu classpath exception"),
        ("short", "gpl 2 0 with classpath exception", r"gpl 2 0 with classpath exception"),
    ],
    "lgpl": [
        ("header", "under the terms of the gnu lesser general public license", r"(?:is free software )?(?:you can redistribute it and or modify it )?under the terms of the gnu lesser general public license(?: as published by the free software foundation)?(?: either version [23](?: 1)?(?: of the license)?)?(?: or at your option any later version)?"),
        ("header", "under the terms of the gnu library general public license", r"under the terms of the gnu library general public license"),
        ("header", "copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license along with"),
        ("header", "see the gnu lesser general public license", r"see the gnu lesser general public license for more details"),
        ("text", "this version of the gnu lesser general public license incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
        ("text", "first released version of the lesser gpl", r"this is the first released version of the lesser gpl"),
        ("link", "gnu org licenses lgpl", _HTTP + r"gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"),
        ("short", " lgplv", r"lgplv[23](?: 1)?(?: or later| only)?"),
        ("short", " lgpl v", r"lgpl v ?[23](?: [01])?(?: or later| only)?"),
        ("short", " lgpl ", r"lgpl [23](?: [01])?(?: or later| only)?"),
        ("short", "gnu lgpl", r"gnu lgpl"),
    ],
    "agpl": [
        ("header", "under the terms of the gnu affero general public license", r"under the terms of the gnu affero general public license(?: as published by the free software foundation)?(?: either version 3(?: of the license)?)?(?: or at your option any later version)?"),
        ("header", "copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license along with"),
        ("text", "gnu affero general public license is a free copyleft license", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
        ("text", "interacting with it remotely through a computer network", r"(?:all )?users interacting with it remotely through a computer network"),
        ("link", "gnu org licenses agpl", _HTTP + r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
        ("short", " agplv", r"agplv[13](?: or later| only)?"),
        ("short", " agpl ", r"agpl (?:v ?)?[13](?: 0)?(?: or later| only)?"),
        ("short", "gnu agpl", r"gnu agpl"),
    ],
    "gfdl": [
        ("header", "under the terms of the gnu free documentation license", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
        ("text", "or any later version published by the free software foundation with no invariant sections", r"or any later version published by the free software foundation with no invariant sections no front cover texts and no back cover texts"),
        ("link", "gnu org licenses fdl", _HTTP + r"gnu org licenses fdl(?: 1 [123])?(?: html| txt)?"),
    ],
    "gnu": [
        ("text", "verbatim copies of this license document", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
        ("header", "distributed in the hope that it will be useful", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ],
    "gnu-all-permissive": [
        ("text", "permitted in any medium without royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
        ("text", "gives unlimited permission to copy", r"this file is free software the free software foundation gives unlimited permission to copy and or distribute it"),
    ],
    "mpl": [
        ("header", "subject to the terms of the mozilla public license", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
        ("header", "if a copy of the mpl was not distributed", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
        ("header", "subject to the mozilla public license version", r"the contents of this file are subject to the mozilla public license version 1 [01]"),
        ("text", "incompatible with secondary licenses", r"incompatible with secondary licenses"),
        ("text", "covered software under the terms of this license", r"covered software under the terms of this license"),
        ("link", "mozilla org mpl", _HTTP + r"mozilla org mpl(?: [12] [01])?"),
        ("link", "mozilla org en us mpl", _HTTP + r"mozilla org en us mpl(?: [12] [01])?"),
        ("short", "mpl licensed", r"mpl licensed"),
    ],
    "epl": [
        ("header", "under the terms of the eclipse public license", r"made available under the terms of the eclipse public license(?: v ?[12] 0)?"),
        ("text", "this eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license"),
        ("link", "eclipse org legal epl", _HTTP + r"eclipse org legal epl (?:v10|2 0|v20)(?: html)?"),
    ],
    "edl": [("header", "under the terms of the eclipse distribution license", r"under the terms of the eclipse distribution license(?: v ?1 0)?"), ("link", "eclipse org org documents edl", _HTTP + r"eclipse org org documents edl v10(?: php| html)?")],
    "cpl": [("text", "this common public license", r"the accompanying program is provided under the terms of this common public license"), ("header", "under the terms of the common public license", r"under the terms of the common public license(?: v ?1 0)?")],
    "cddl": [
        ("header", "terms of the common development and distribution license", r"subject to the terms of the common development and distribution license"),
        ("text", "include this cddl header", r"when distributing covered code include this cddl header(?: notice)? in each file"),
        ("link", "opensource org licenses cddl", r"opensource org licenses cddl ?1(?: 0)?(?: php| txt)?"),
    ],
    "unlicense": [
        ("text", "free and unencumbered software released into the public domain", r"this is free and unencumbered software released into the public domain"),
        ("text", "anyone is free to copy modify publish use compile sell or distribute", r"anyone is free to copy modify publish use compile sell or distribute this software"),
        ("text", "dedicate any and all copyright interest in the software to the public domain", r"dedicate any and all copyright interest in the software to the public domain"),
        ("link", "unlicense org", r"unlicense org"),
    ],
    "public-domain": [
        ("header", "released into the public domain", r"released into the public domain"),
        ("header", "placed in the public domain", r"placed in the public domain"),
        ("header", "placed into the public domain", r"placed into the public domain"),
        ("header", "dedicated to the public domain", r"dedicated to the public domain"),
        ("header", "this file is in the public domain", r"this file is in the public domain"),
        ("header", "this software is in the public domain", r"this software is in the public domain"),
        ("header", "author disclaims copyright to this source code", r"the author disclaims copyright to this source code"),
    ],
    "blessing": [("text", "in place of a legal notice here is a blessing", r"in place of a legal notice here is a blessing may you do good and not evil may you find forgiveness for yourself and forgive others may you share freely never taking more than you give")],
    "wtfpl": [
        ("text", "you just do what the fuck you want to", r"you just do what the fuck you want to"),
        ("text", "do what the fuck you want to public license", r"do what the fuck you want to public license"),
        ("link", "wtfpl net", _HTTP + r"wtfpl net"),
    ],
    "cc0": [
        ("text", "waived all copyright and related", r"(?:has )?waived all copyright and related (?:or|and) neighboring rights"),
        ("text", "affirmer hereby overtly fully permanently", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright"),
        ("link", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero(?: 1 0)?(?: legalcode)?"),
        ("short", "cc0 1 0 universal", r"cc0 1 0 universal"),
        ("short", "creative commons zero", r"creative commons zero"),
    ],
    "cc-by": [
        ("header", "under a creative commons attribution", r"licensed under a creative commons attribution(?: [1-4] 0)? (?:international |unported |generic )?license"),
        ("link", "creativecommons org licenses by", r"creativecommons org licenses by(?: [1-4] 0)?"),
        ("short", "creative commons attribution", r"creative commons attribution [1-4] 0(?: international| unported| generic)?"),
    ],
    "cc-by-sa": [
        ("header", "under a creative commons attribution share", r"licensed under a creative commons attribution share ?alike(?: [1-4] 0)? (?:international |unported |generic )?license"),
        ("header", "under a creative commons attribution noncommercial share", r"licensed under a creative commons attribution noncommercial share ?alike"),
        ("header", "under the creative commons attribution share", r"under the creative commons attribution share ?alike license"),
        ("link", "creativecommons org licenses by sa", r"creativecommons org licenses by sa(?: [1-4] 0)?"),
        ("short", "creative commons attribution share", r"creative commons attribution share ?alike [1-4] 0"),
    ],
    "cc-by-nc": [
        ("header", "under a creative commons attribution non", r"licensed under a creative commons attribution non ?commercial(?: [1-4] 0)? (?:international |unported |generic )?license"),
        ("link", "creativecommons org licenses by nc", r"creativecommons org licenses by nc(?: [1-4] 0)?"),
        ("text", "primarily intended for or directed towards commercial advantage", r"(?:not )?primarily intended for or directed towards commercial advantage(?: or monetary compensation)?"),
    ],
    "cc-by-nd": [
        ("header", "under a creative commons attribution no", r"licensed under a creative commons attribution no ?deriv[a-z]*(?: [1-4] 0)? (?:international |unported |generic )?license"),
        ("link", "creativecommons org licenses by nd", r"creativecommons org licenses by nd(?: [1-4] 0)?"),
    ],
    "cc-by-nc-sa": [("link", "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa(?: [1-4] 0)?")],
    "cc-by-nc-nd": [("link", "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd(?: [1-4] 0)?")],
    "cc": [
        ("header", "some rights reserved", r"some rights reserved"),
        ("text", "creative commons corporation is not a law firm", r"creative commons corporation is not a law firm and does not provide legal services"),
        ("text", "by exercising the licensed rights", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ],
    "boost": [
        ("header", "distributed under the boost software license", r"distributed under the boost software license version 1 0"),
        ("text", "permission is hereby granted free of charge to any person or organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
        ("text", "machine executable object code generated by a source language processor", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
        ("link", "boost org license", _HTTP + r"boost org license 1 0(?: txt)?"),
    ],
    "artistic": [
        ("text", "copyright holder maintains some semblance of artistic control", r"the copyright holder maintains some semblance of artistic control over the development of the package"),
        ("text", "copyright holder maintains some artistic control", r"the copyright holder maintains some artistic control over the development of that package"),
        ("header", "under the same terms as perl itself", r"(?:redistribute it and or modify it|distributed|licensed) under the same terms as perl itself"),
        ("link", "opensource org licenses artistic", r"opensource org licenses artistic license(?: [12] 0)?(?: php)?"),
    ],
    "python": [
        ("text", "python software foundation license version", r"python software foundation license version 2"),
        ("text", "agreement is between the python software foundation", r"this license agreement is between the python software foundation psf and the individual or organization"),
        ("text", "beopen com license agreement", r"beopen com license agreement for python 2 0"),
        ("text", "name of stichting mathematisch centrum or cwi not be used in advertising or publicity pertaining to distribution", r"name of stichting mathematisch centrum or cwi not be used in advertising or publicity pertaining to distribution"),
    ],
    "php": [("text", "this source file is subject to version 3", r"this source file is subject to version 3 0(?:1)? of the php license"), ("text", "includes php software freely available from", r"this product includes php software freely available from"), ("link", "php net license", _HTTP + r"php net license(?: 3 01?)?(?: txt)?")],
    "ruby": [("header", "the same terms as ruby", r"(?:under|on) the same terms as ruby(?: itself)?"), ("text", "place your modifications in the public domain or otherwise make them freely available", r"place your modifications in the public domain or otherwise make them freely available")],
    "openssl": [("text", "developed by the openssl project", r"this product includes software developed by the openssl project for use in the openssl toolkit"), ("text", "cryptographic software written by eric young", r"this product includes cryptographic software written by eric young")],
    "postgresql": [("text", "this software and its documentation for any purpose without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted")],
    "ofl": [
        ("header", "licensed under the sil open font license", r"this font software is licensed under the sil open font license version 1 1"),
        ("text", "original or modified versions of the font software may be sold by itself", r"original or modified versions of the font software may be sold by itself"),
        ("link", "scripts sil org ofl", r"scripts sil org ofl"),
    ],
    "eupl": [("header", "licensed under the eupl", r"licensed under the eupl(?: version| v)? 1 [0-2]"), ("text", "european union public licence", r"european union public licence(?: v ?1 [0-2])?")],
    "osl": [("header", "licensed under the open software license", r"licensed under the open software license version [123] [01]")],
    "afl": [("header", "licensed under the academic free license", r"licensed under the academic free license version [123] [01]")],
    "ms-pl": [("text", "license governs use of the accompanying software", r"this license governs use of the accompanying software if you use the software you accept this license"), ("short", "microsoft public license ms pl", r"microsoft public license ms pl")],
    "ms-rl": [("short", "microsoft reciprocal license ms rl", r"microsoft reciprocal license ms rl"), ("text", "reciprocal grants for any file you distribute", r"reciprocal grants for any file you distribute that contains code from the software")],
    "ncsa": [("text", "to deal with the software without restriction", r"to deal with the software without restriction"), ("text", "this software and associated documentation files the software to deal with", r"obtaining a copy of this software and associated documentation files the software to deal with")],
    "upl": [("text", "a larger work to which the software is contributed", r"(?:each )?a larger work to which the software is contributed by such licensors?"), ("text", "universal permissive license upl", r"universal permissive license upl version 1 0")],
    "w3c": [("text", "w3c software notice and license", r"w3c software notice and license"), ("text", "w3c software and document notice and license", r"w3c software and document notice and license"), ("link", "w3 org consortium legal", _HTTP + r"w3 org consortium legal 20[0-9]{2} copyright software(?: [0-9]+)?")],
    "sleepycat": [("text", "how to obtain complete source code for the db software", r"how to obtain complete source code for the db software and any accompanying software")],
    "beerware": [("text", "you can buy me a beer in return", r"(?:if we meet some day and you think this stuff is worth it )?you can buy me a beer in return"), ("text", "the beer ware license", r"the beer ware license(?: revision [0-9]+)?")],
    "cecill": [("header", "under french law and abiding by the rules of distribution of free software", r"under french law and abiding by the rules of distribution of free software"), ("link", "cecill info licences", r"cecill info licences")],
    "json": [("text", "software shall be used for good not evil", r"the software shall be used for good not evil")],
    "lppl": [("header", "conditions of the latex project public license", r"under the conditions of the latex project public license"), ("text", "may be distributed and or modified under the conditions of the latex project", r"may be distributed and or modified under the conditions of the latex project(?: public license)?"), ("link", "latex project org lppl", _HTTP + r"latex project org lppl(?: txt)?")],
    "odbl": [("header", "made available under the open database license", r"made available under the open database license"), ("link", "opendatacommons org licenses odbl", r"opendatacommons org licenses odbl(?: 1 0)?")],
    "odc-by": [("link", "opendatacommons org licenses by", r"opendatacommons org licenses by(?: 1 0)?")],
    "pddl": [("link", "opendatacommons org licenses pddl", r"opendatacommons org licenses pddl(?: 1 0)?"), ("header", "public domain dedication and license whose full text", r"made available under the public domain dedication and license whose full text")],
    "sspl": [("text", "making the functionality of the program or modified version available to third parties", r"making the functionality of the program or modified version available to third parties"), ("header", "server side public license version 1", r"under the terms of the server side public license version 1")],
    "busl": [("text", "licensor hereby grants you the right to copy modify create derivative works redistribute", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"), ("text", "business source license 1 1 parameters", r"business source license 1 1 parameters(?: licensor)?")],
    "elastic": [("text", "provide the software to third parties as a hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"), ("header", "under the elastic license", r"licensed under the elastic license(?: 2 0)?")],
    "curl": [("text", "copyright notice and this permission notice appear in all copies the software is provided as is without warranty", r"copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied")],
    "icu": [("text", "icu license icu 1 8 1 and later", r"icu license icu 1 8 1 and later")],
    "unicode": [("text", "unicode data files and any associated documentation", r"obtaining a copy of the unicode data files and any associated documentation"), ("text", "unicode inc license agreement data files and software", r"unicode inc license agreement data files and software")],
    "ijg": [("text", "software is based in part on the work of the independent jpeg group", r"this software is based in part on the work of the independent jpeg group")],
    "tcl": [("text", "use copy modify distribute and license this software and its documentation", r"(?:hereby grant )?permission to use copy modify distribute and license this software and its documentation(?: for any purpose)?")],
    "qpl": [("text", "q public license version 1 0 copyright", r"the q public license version 1 0 copyright"), ("header", "terms of the q public license", r"under the terms of the q public license(?: version 1 0)?")],
    "zpl": [("header", "zope public license version", r"subject to the provisions of the zope public license version [12] [01]")],
    "vim": [("text", "no restrictions on distributing unmodified copies of vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this license text")],
    "nasa": [("text", "nasa open source agreement version", r"nasa open source agreement version 1 3")],
    "rpl": [("text", "reciprocal public license version", r"reciprocal public license version 1 [15]")],
    "cpal": [("text", "common public attribution license version", r"common public attribution license version 1 0")],
    "apsl": [("text", "apple public source license version", r"(?:subject to the )?apple public source license version [12] [012]")],
    "npl": [("text", "subject to the netscape public license", r"the contents of this file are subject to the netscape public license version 1 [01]")],
    "ibm": [("text", "this ibm public license", r"the accompanying program is provided under the terms of this ibm public license")],
    "proprietary": [
        ("header", "proprietary and confidential", r"proprietary and confidential"),
        ("header", "via any medium is strictly prohibited proprietary and confidential", r"unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
        ("header", "confidential and proprietary", r"confidential and proprietary"),
        ("header", "trade secrets and confidential information", r"(?:contains|contain) trade secrets and confidential information"),
        ("text", "end user license agreement", r"end user license agreement(?: eula)?"),
        ("text", "the software is licensed not sold", r"the software is licensed not sold"),
        ("text", "reverse engineer decompile or disassemble the software", r"(?:may|shall|will) not reverse engineer decompile or disassemble the software"),
    ],
}


def root_of(keyword: str) -> str:
    return next(r for r in ROOTS if r in keyword)
