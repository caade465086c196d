"""Hand-written license signatures: identifiers, version forms, headers, notice wordings and addresses.

An expression is matched against lower-cased text; a space stands for whatever
may separate two words (line ends, comment marks, punctuation), so wrapped and
commented notices match. The keyword has to be in the text, as it is written
here (of several words each), before the expression is tried.
"""

#: Label, then (keyword, priority, confidence, expression) of its signatures.
RULES: dict[str, list[tuple[str, int, float, str]]] = {
    "mit": [
        ("spdx", 95, 1.0, r"spdx license identifier mit(?! 0)"),
        ("hereby granted", 92, 0.99, r"permission is hereby granted free of charge to any person obtaining a copy"),
        ("merchantab", 60, 0.7, r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
        ("substantial portions", 88, 0.95, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
        ("opensource.org/licenses/mit", 85, 0.98, r"opensource org licenses mit( license)?"),
        ("mit", 70, 0.95, r"licen[cs]e[ds]? (?:is |type |name |under )?(?:the )?mit"),
        ("mit", 75, 0.95, r"mit licen[cs]ed?"),
        ("style", 74, 0.9, r"mit style licen[cs]e"),
        ("x11", 70, 0.9, r"(?:mit x11|x11 mit|x11) licen[cs]e"),
        ("expat", 72, 0.95, r"expat licen[cs]e"),
    ],
    "mit-0": [
        ("mit-0", 96, 1.0, r"(?:spdx license identifier )?mit 0"),
        ("no attribution", 80, 0.95, r"mit no attribution(?: licen[cs]e)?"),
    ],
    "apache": [
        ("spdx", 95, 1.0, r"spdx license identifier apache [12] [01]"),
        ("apache", 78, 0.97, r"apache [12] [01]"),
        ("apache", 80, 0.98, r"apache licen[cs]e,? (?:version|v) ?[12](?: [01])?"),
        ("apache", 90, 0.99, r"licensed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance"),
        ("apache.org/licenses", 85, 0.98, r"www apache org licenses license [12] [01](?: txt| html)?"),
        ("asf", 88, 0.98, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
        ("apache", 70, 0.95, r"licen[cs]e[ds]? (?:is |type |name |under )?(?:the )?apache(?: [12](?: [01])?)?"),
        ("apache2", 76, 0.95, r"apache2(?: 0)? licen[cs]e"),
        ("asl", 74, 0.9, r"asl (?:version |v)?2 0"),
        ("apache software license", 79, 0.97, r"apache software licen[cs]e(?: version)? 1 [01]"),
    ],
    "gpl": [
        ("spdx", 95, 1.0, r"spdx license identifier gpl [123] 0(?: only| or later)?"),
        ("gpl", 78, 0.97, r"gpl [123](?: 0)?(?: only| or later)?"),
        ("gplv", 78, 0.97, r"gplv[123](?: or later)?"),
        ("gpl", 77, 0.95, r"gpl (?:version |v)[123](?: 0)?(?: only| or later| or any later version)?"),
        ("general public", 80, 0.98, r"gnu general public licen[cs]e,? (?:version |v)[123](?: 0)?(?: or (?:at your option )?any later version)?"),
        ("redistribute it", 90, 0.99, r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
        ("general public", 84, 0.97, r"you should have received a copy of the gnu general public licen[cs]e"),
        ("general public", 60, 0.9, r"see the gnu general public licen[cs]e for more details"),
        ("gnu.org", 82, 0.97, r"www gnu org (?:licenses|copyleft) gpl(?: [123] 0)?(?: html| txt)?"),
        ("gpl", 70, 0.93, r"licen[cs]e[ds]? (?:is |type |name |under )?(?:the )?(?:gnu )?gpl"),
        ("gpl", 50, 0.8, r"(?:dual mit gpl|gpl and additional rights)"),
        ("classpath", 83, 0.95, r"gpl(?: [123] 0)? with classpath exception"),
    ],
    "lgpl": [
        ("spdx", 95, 1.0, r"spdx license identifier lgpl [23] [01](?: only| or later)?"),
        ("lgpl", 79, 0.97, r"lgpl [23](?: [01])?(?: only| or later)?"),
        ("lgplv", 79, 0.97, r"lgplv[23](?: 1)?(?: or later)?"),
        ("lesser general", 81, 0.98, r"gnu lesser general public licen[cs]e,? (?:version |v)[23](?: [01])?"),
        ("lesser general", 91, 0.99, r"redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
        ("library general", 81, 0.97, r"gnu library general public licen[cs]e(?: version 2)?"),
        ("lesser general", 85, 0.97, r"you should have received a copy of the gnu lesser general public licen[cs]e"),
        ("gnu.org", 83, 0.97, r"www gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: [23] [01])?(?: html| txt)?"),
    ],
    "agpl": [
        ("spdx", 95, 1.0, r"spdx license identifier agpl [13] 0(?: only| or later)?"),
        ("agpl", 79, 0.97, r"agpl [13](?: 0)?(?: only| or later)?"),
        ("agplv", 79, 0.97, r"agplv[13](?: or later)?"),
        ("affero general", 82, 0.98, r"gnu affero general public licen[cs]e,? (?:version |v)[13](?: 0)?"),
        ("affero general", 91, 0.99, r"redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
        ("affero general", 85, 0.97, r"you should have received a copy of the gnu affero general public licen[cs]e"),
        ("gnu.org", 83, 0.97, r"www gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ],
    "gfdl": [
        ("spdx", 95, 1.0, r"spdx license identifier gfdl 1 [123](?: only| or later)?"),
        ("gfdl", 75, 0.93, r"gfdl(?: (?:version |v)?1 [123])?"),
        ("free documentation", 90, 0.99, r"copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
        ("free documentation", 82, 0.98, r"gnu free documentation licen[cs]e version 1 [123]"),
        ("gnu.org", 82, 0.95, r"www gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: html| txt)?"),
        ("invariant sections", 84, 0.95, r"with no invariant sections (?:with )?no front cover texts and (?:with )?no back cover texts"),
    ],
    "bsd": [
        ("spdx", 95, 1.0, r"spdx license identifier (?:bsd [0-4] clause(?: \w+)?|0bsd)"),
        ("bsd", 79, 0.97, r"bsd [0-4] clause(?: licen[cs]e| clear| patent)?"),
        ("0bsd", 79, 0.97, r"0bsd"),
        ("redistribution and use", 92, 0.99, r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
        ("redistributions of source", 85, 0.95, r"redistributions of source code must retain the above copyright notice"),
        ("redistributions in binary", 85, 0.95, r"redistributions in binary form must reproduce the above copyright notice"),
        ("endorse or promote", 80, 0.93, r"neither the name of [^.]{1,160}?may be used to endorse or promote products derived from this software"),
        ("this software is provided by", 70, 0.85, r"this software is provided by the (?:copyright holders?|regents|author)[^.]{0,60}?as is"),
        ("advertising materials", 84, 0.95, r"all advertising materials mentioning features or use of this software must display"),
        ("bsd", 75, 0.95, r"(?:new|modified|revised|simplified|original|free)? ?bsd (?:style )?licen[cs]ed?"),
        ("bsd", 70, 0.93, r"licen[cs]e[ds]? (?:is |type |name |under )?(?:the )?(?:a )?(?:new |modified |simplified )?bsd"),
        ("opensource.org/licenses/bsd", 85, 0.97, r"opensource org licenses bsd(?: [234] clause| license)?"),
        ("clause", 74, 0.93, r"two clause bsd(?: licen[cs]e)?"),
        ("clause", 74, 0.93, r"three clause bsd(?: licen[cs]e)?"),
    ],
    "isc": [
        ("spdx", 95, 1.0, r"spdx license identifier isc"),
        ("permission distribute fee", 90, 0.97, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("isc", 70, 0.93, r"licen[cs]e[ds]? (?:is |type |name |under )?(?:the )?isc"),
        ("isc licen", 75, 0.95, r"isc licen[cs]ed?"),
        ("the author disclaims all", 70, 0.85, r"the author disclaims all warranties with regard to this software"),
    ],
    "mpl": [
        ("spdx", 95, 1.0, r"spdx license identifier mpl [12] [01](?: no copyleft exception)?"),
        ("mpl", 79, 0.97, r"mpl [12] [01]"),
        ("mozilla public", 92, 0.99, r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
        ("mozilla public", 82, 0.98, r"mozilla public licen[cs]e,? (?:version |v) ?[12](?: [01])?"),
        ("mozilla.org/mpl", 85, 0.97, r"mozilla org mpl(?: [12] [01])?(?: txt)?"),
        ("contents of this file", 80, 0.93, r"the contents of this file are subject to the mozilla public licen[cs]e"),
    ],
    "epl": [
        ("spdx", 95, 1.0, r"spdx license identifier epl [12] 0"),
        ("epl-", 79, 0.96, r"epl [12] 0"),
        ("eclipse public", 90, 0.99, r"made available under the terms of the eclipse public licen[cs]e(?: (?:version |v) ?[12] 0)?"),
        ("eclipse public", 82, 0.98, r"eclipse public licen[cs]e,? (?:version |v) ?[12] 0"),
        ("eclipse.org/legal", 85, 0.97, r"www eclipse org legal epl (?:v10|2 0|v20)(?: html)?"),
    ],
    "edl": [
        ("eclipse distribution", 82, 0.97, r"eclipse distribution licen[cs]e(?: (?:version |v) ?1 0)?"),
        ("eclipse.org/org/documents/edl", 85, 0.97, r"eclipse org org documents edl v10(?: php| html)?"),
    ],
    "eupl": [
        ("spdx", 95, 1.0, r"spdx license identifier eupl 1 [0-2]"),
        ("eupl", 79, 0.96, r"eupl(?: v?1 [0-2])?"),
        ("licensed under the eupl", 90, 0.98, r"licensed under the eupl(?: version 1 [0-2])?"),
        ("european union public", 82, 0.97, r"european union public licen[cs]e,? (?:version |v)? ?1 [0-2]"),
        ("joinup", 80, 0.9, r"joinup ec europa eu (?:software page|collection) eupl"),
    ],
    "cddl": [
        ("spdx", 95, 1.0, r"spdx license identifier cddl 1 [01]"),
        ("cddl", 77, 0.95, r"cddl(?: (?:version |v)?1 [01])?"),
        ("common development", 90, 0.98, r"subject to the terms of the common development and distribution licen[cs]e"),
        ("common development", 82, 0.97, r"common development and distribution licen[cs]e(?: (?:version |v)?1 [01])?"),
        ("opensolaris", 82, 0.93, r"usr src opensolaris license|www opensolaris org os licensing"),
    ],
    "cpl": [
        ("cpl-1.0", 95, 0.97, r"(?:spdx license identifier )?cpl 1 0"),
        ("common public", 82, 0.95, r"common public licen[cs]e(?: (?:version |v) ?(?:1 0|0 5))?"),
    ],
    "artistic": [
        ("spdx", 95, 1.0, r"spdx license identifier artistic [12] 0(?: perl| cl8)?"),
        ("artistic-", 79, 0.96, r"artistic [12] 0"),
        ("artistic licen", 80, 0.96, r"artistic licen[cs]e(?: (?:version |v)?[12] 0)?"),
        ("same terms as perl", 82, 0.93, r"under the same terms as perl itself"),
        ("intent of this document", 60, 0.7, r"the intent of this document is to state the conditions under which a package may be copied"),
    ],
    "boost": [
        ("bsl-1.0", 95, 1.0, r"(?:spdx license identifier )?bsl 1 0"),
        ("boost software", 90, 0.99, r"distributed under the boost software licen[cs]e,? version 1 0"),
        ("boost.org/license", 85, 0.97, r"www boost org license 1 0 txt"),
        ("accompanying documentation covered", 88, 0.97, r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ],
    "zlib": [
        ("spdx", 95, 1.0, r"spdx license identifier zlib(?: acknowledgement)?"),
        ("held liable for any damages", 88, 0.95, r"in no event will the authors? be held liable for any damages arising from the use of this software"),
        ("must not be misrepresented", 85, 0.95, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
        ("zlib", 75, 0.93, r"zlib(?: libpng)? licen[cs]e"),
        ("altered source versions", 82, 0.93, r"altered source versions must be plainly marked as such"),
    ],
    "libpng": [
        ("libpng", 80, 0.93, r"(?:libpng licen[cs]e|png reference library licen[cs]e)(?: version 2)?"),
        ("spdx", 95, 1.0, r"spdx license identifier libpng(?: 2 0)?"),
    ],
    "unlicense": [
        ("spdx", 95, 1.0, r"spdx license identifier unlicense"),
        ("free and unencumbered", 92, 0.99, r"this is free and unencumbered software released into the public domain"),
        ("unlicense.org", 85, 0.97, r"(?:https? )?unlicense org"),
        ("anyone is free to copy", 85, 0.95, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ],
    "wtfpl": [
        ("spdx", 95, 1.0, r"spdx license identifier wtfpl"),
        ("what the fuck you want", 90, 0.98, r"do what the fuck you want to(?: public licen[cs]e)?"),
        ("wtfpl", 78, 0.96, r"wtfpl(?: (?:version |v)?[12](?: 0)?)?"),
        ("wtfpl.net", 85, 0.97, r"www wtfpl net"),
    ],
    "cc0": [
        ("cc0", 79, 0.97, r"(?:spdx license identifier )?cc0(?: 1 0)?(?: universal)?"),
        ("publicdomain/zero", 88, 0.98, r"creativecommons org publicdomain zero 1 0"),
        ("waived all copyright", 88, 0.95, r"waived all copyright and related or neighboring rights"),
        ("creative commons zero", 82, 0.96, r"creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?"),
    ],
    "cc-by": [
        ("cc-by-", 79, 0.97, r"(?:spdx license identifier )?cc by [1-4] [05](?: \w\w)?"),
        ("licenses/by/", 86, 0.98, r"creativecommons org licenses by [1-4] [05]"),
        ("creative commons attribution", 82, 0.97, r"creative commons attribution [1-4] [05](?: international| unported| generic)?(?: licen[cs]e)?"),
        ("creative commons", 70, 0.85, r"licensed under a creative commons attribution licen[cs]e"),
    ],
    "cc-by-sa": [
        ("cc-by-sa", 83, 0.97, r"(?:spdx license identifier )?cc by sa(?: [1-4] [05])?"),
        ("licenses/by-sa", 88, 0.98, r"creativecommons org licenses by sa [1-4] [05]"),
        ("alike", 84, 0.97, r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?"),
    ],
    "cc-by-nc": [
        ("cc-by-nc", 83, 0.97, r"(?:spdx license identifier )?cc by nc(?: [1-4] [05])?"),
        ("licenses/by-nc/", 88, 0.98, r"creativecommons org licenses by nc [1-4] [05]"),
        ("commercial", 83, 0.96, r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ],
    "cc-by-nd": [
        ("cc-by-nd", 83, 0.97, r"(?:spdx license identifier )?cc by nd(?: [1-4] [05])?"),
        ("licenses/by-nd", 88, 0.98, r"creativecommons org licenses by nd [1-4] [05]"),
        ("deriv", 83, 0.96, r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ],
    "cc-by-nc-sa": [
        ("cc-by-nc-sa", 86, 0.97, r"(?:spdx license identifier )?cc by nc sa(?: [1-4] [05])?"),
        ("licenses/by-nc-sa", 89, 0.98, r"creativecommons org licenses by nc sa [1-4] [05]"),
        ("alike", 86, 0.96, r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ],
    "cc-by-nc-nd": [
        ("cc-by-nc-nd", 86, 0.97, r"(?:spdx license identifier )?cc by nc nd(?: [1-4] [05])?"),
        ("licenses/by-nc-nd", 89, 0.98, r"creativecommons org licenses by nc nd [1-4] [05]"),
        ("deriv", 86, 0.96, r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?"),
    ],
    "ofl": [
        ("ofl-1.", 95, 1.0, r"(?:spdx license identifier )?ofl 1 [01](?: rfn| no rfn)?"),
        ("open font", 82, 0.97, r"sil open font licen[cs]e,? (?:version |v)? ?1 [01]"),
        ("font software is licensed", 92, 0.99, r"this font software is licensed under the sil open font licen[cs]e"),
        ("scripts.sil.org", 85, 0.97, r"scripts sil org ofl"),
        ("font software", 75, 0.9, r"the font software may be modified altered or added to"),
    ],
    "odbl": [
        ("odbl", 78, 0.96, r"(?:spdx license identifier )?odbl(?: (?:v)?1 0)?"),
        ("open database", 88, 0.98, r"made available under the open database licen[cs]e"),
        ("opendatacommons.org/licenses/odbl", 88, 0.98, r"opendatacommons org licenses odbl(?: 1 0| summary)?"),
    ],
    "odc-by": [
        ("odc-by", 79, 0.96, r"(?:spdx license identifier )?odc by(?: (?:v)?1 0)?"),
        ("open data commons attribution", 84, 0.97, r"open data commons attribution licen[cs]e"),
        ("opendatacommons.org/licenses/by", 86, 0.97, r"opendatacommons org licenses by(?: 1 0)?"),
    ],
    "pddl": [
        ("pddl", 78, 0.93, r"(?:spdx license identifier )?pddl(?: 1 0)?"),
        ("public domain dedication and", 84, 0.97, r"(?:open data commons )?public domain dedication and licen[cs]e"),
    ],
    "python": [
        ("python", 80, 0.96, r"python software foundation licen[cs]e(?: version 2)?"),
        ("p", 78, 0.95, r"(?:spdx license identifier )?psf 2 0|spdx license identifier python 2 0|psf licen[cs]e"),
        ("this license agreement is between the python", 90, 0.97, r"this licen[cs]e agreement is between the python software foundation"),
    ],
    "postgresql": [
        ("postgresql licen", 80, 0.96, r"postgresql licen[cs]e"),
        ("spdx", 95, 1.0, r"spdx license identifier postgresql"),
        ("without a written agreement", 88, 0.95, r"for any purpose without fee and without a written agreement is hereby granted"),
    ],
    "ms-pl": [
        ("ms-pl", 79, 0.96, r"(?:spdx license identifier )?ms pl"),
        ("microsoft public", 82, 0.97, r"microsoft public licen[cs]e(?: ms pl)?"),
    ],
    "ms-rl": [
        ("ms-rl", 79, 0.96, r"(?:spdx license identifier )?ms rl"),
        ("microsoft reciprocal", 82, 0.97, r"microsoft reciprocal licen[cs]e(?: ms rl)?"),
    ],
    "openssl": [
        ("openssl", 84, 0.96, r"openssl licen[cs]e"),
        ("openssl toolkit", 88, 0.97, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
        ("spdx", 95, 1.0, r"spdx license identifier openssl"),
    ],
    "php": [
        ("php licen", 80, 0.96, r"php licen[cs]e(?: (?:version |v)?3 0[01]?)?"),
        ("version 3.01 of the php", 90, 0.98, r"subject to version 3 0[01]? of the php licen[cs]e"),
        ("spdx", 95, 1.0, r"spdx license identifier php 3 0[01]?"),
    ],
    "ruby": [
        ("ruby", 80, 0.95, r"ruby(?: s)? licen[cs]e"),
        ("spdx", 95, 1.0, r"spdx license identifier ruby"),
        ("same terms as ruby", 82, 0.93, r"under the same terms as ruby itself"),
    ],
    "ncsa": [
        ("ncsa", 82, 0.96, r"(?:university of illinois )?(?:uiuc )?ncsa open source licen[cs]e"),
        ("spdx", 95, 1.0, r"spdx license identifier ncsa"),
    ],
    "upl": [
        ("upl-1.0", 95, 1.0, r"(?:spdx license identifier )?upl 1 0"),
        ("universal permissive", 84, 0.97, r"universal permissive licen[cs]e(?: upl)?(?: (?:version |v)?1 0)?"),
    ],
    "afl": [
        ("afl-", 79, 0.95, r"(?:spdx license identifier )?afl [123] [01]"),
        ("academic free", 82, 0.97, r"academic free licen[cs]e(?: (?:version |v)?[123] [01])?"),
    ],
    "osl": [
        ("osl-", 79, 0.95, r"(?:spdx license identifier )?osl [123] [01]"),
        ("open software licen", 82, 0.97, r"open software licen[cs]e(?: (?:version |v)?[123] [01])?"),
    ],
    "sspl": [
        ("sspl", 79, 0.96, r"(?:spdx license identifier )?sspl(?: (?:v)?1(?: 0)?)?"),
        ("server side public", 84, 0.98, r"server side public licen[cs]e(?: (?:version |v)?1)?"),
    ],
    "busl": [
        ("busl", 80, 0.96, r"(?:spdx license identifier )?busl 1 1"),
        ("business source", 84, 0.97, r"business source licen[cs]e(?: (?:version |v)?1 [01])?"),
    ],
    "elastic": [
        ("elastic licen", 82, 0.96, r"elastic licen[cs]e(?: (?:version |v)?2 0)?"),
        ("elastic-2.0", 95, 1.0, r"(?:spdx license identifier )?elastic 2 0"),
    ],
    "openrail": [
        ("rail", 82, 0.95, r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?"),
        ("responsible ai licen", 84, 0.95, r"responsible ai licen[cs]e"),
    ],
    "public-domain": [
        ("public domain", 80, 0.93, r"(?:this work|this file|this code|this software|it) (?:is|has been) (?:hereby )?(?:placed |released |dedicated )?(?:in|into|to) the public domain"),
        ("public domain", 70, 0.85, r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
        ("publicdomain/mark", 86, 0.96, r"creativecommons org publicdomain mark 1 0"),
    ],
    "proprietary": [
        ("proprietary", 80, 0.93, r"(?:confidential and proprietary|proprietary and confidential)"),
        ("copying", 82, 0.93, r"unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
        ("licenseref-proprietary", 95, 1.0, r"spdx license identifier licenseref proprietary"),
        ("no part of this", 78, 0.9, r"no part of this (?:publication|book|document|work) may be reproduced"),
    ],
}
