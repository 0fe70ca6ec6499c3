"""License scans by ordered signature rules, in DataFrame functions only.

A text is lower-cased (A to Z) and cut to words of digits, letters and non-ASCII characters. Base phrases
are counted at every place. Rules are regular expressions over the words, written by hand: SPDX tags and the bodies of
licenses come first, then grants and notices, then titles, then mentions. Each has a label and a keyword that every
match of it holds; a keyword is looked for once for all its rules, and only in texts that hold a word of the gate.
Detections overlap: one that lies inside another of the same or a better priority is dropped, so "gpl" never counts
inside "gnu lesser general public license".

Defined cases: a null or empty text has no words, no places, empty label strings and score 0; letters beyond ASCII keep
their case; a very long text is scanned whole, and what it takes grows little faster than its matches; repeated rows get
the same result each; an empty table gives no rows; columns named like a result are replaced, others are kept.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that always count, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Every keyword holds one of these; a text without any of them holds no detection.
GATE = ("licen", "spdx", "permission", "redistribut", "public domain", "copyright", "copyleft", "rights reserved", "creative commons", "warranty")

#: Priority (less is better), confidence, and rules: label, keyword, expression.
SIGNATURES = (
    (
        1,
        0.98,
        r"""
mit             | spdx license identifier | spdx license identifier mit
mit-0           | spdx license identifier | spdx license identifier mit 0
mit-modern      | spdx license identifier | spdx license identifier mit modern variant
x11             | spdx license identifier | spdx license identifier x11
apache-1.0      | spdx license identifier | spdx license identifier apache 1 0
apache-1.1      | spdx license identifier | spdx license identifier apache 1 1
apache-2        | spdx license identifier | spdx license identifier apache 2(?: 0)?
apache-2-llvm   | spdx license identifier | spdx license identifier apache 2 0 with llvm exception
bsd-0           | spdx license identifier | spdx license identifier 0bsd
bsd-1-clause    | spdx license identifier | spdx license identifier bsd 1 clause
bsd-2-clause    | spdx license identifier | spdx license identifier bsd 2 clause(?: freebsd| netbsd| patent| views)?
bsd-3-clause    | spdx license identifier | spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause    | spdx license identifier | spdx license identifier bsd 4 clause(?: uc)?
isc             | spdx license identifier | spdx license identifier isc
zlib            | spdx license identifier | spdx license identifier zlib(?: acknowledgement)?
libpng          | spdx license identifier | spdx license identifier libpng(?: 2 0)?
gpl-1           | spdx license identifier | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2           | spdx license identifier | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2-classpath | spdx license identifier | spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-2-linux     | spdx license identifier | spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note
gpl-3           | spdx license identifier | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3-gcc       | spdx license identifier | spdx license identifier gpl 3 0(?: only| or later)? with gcc exception 3 1
lgpl-2          | spdx license identifier | spdx license identifier lgpl 2 [01](?: only| or later)?
lgpl-3          | spdx license identifier | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-1          | spdx license identifier | spdx license identifier agpl 1 0(?: only| or later)?
agpl-3          | spdx license identifier | spdx license identifier agpl 3 0(?: only| or later)?
gfdl            | spdx license identifier | spdx license identifier gfdl 1 [123](?: only| or later| invariants only| no invariants only)?
mpl-1           | spdx license identifier | spdx license identifier mpl 1 0
mpl-1.1         | spdx license identifier | spdx license identifier mpl 1 1
mpl-2           | spdx license identifier | spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1           | spdx license identifier | spdx license identifier epl 1 0
epl-2           | spdx license identifier | spdx license identifier epl 2 0
cddl-1          | spdx license identifier | spdx license identifier cddl 1 [01]
cpl-1           | spdx license identifier | spdx license identifier cpl 1 0
eupl-1.1        | spdx license identifier | spdx license identifier eupl 1 1
eupl-1.2        | spdx license identifier | spdx license identifier eupl 1 2
osl-3           | spdx license identifier | spdx license identifier osl 3 0
afl-3           | spdx license identifier | spdx license identifier afl 3 0
artistic-1      | spdx license identifier | spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2      | spdx license identifier | spdx license identifier artistic 2 0
boost-1         | spdx license identifier | spdx license identifier bsl 1 0
business-source | spdx license identifier | spdx license identifier busl 1 1
elastic-2       | spdx license identifier | spdx license identifier elastic 2 0
sspl-1          | spdx license identifier | spdx license identifier sspl 1 0
cc0-1           | spdx license identifier | spdx license identifier cc0 1 0
cc-by           | spdx license identifier | spdx license identifier cc by [1-4] [05]
cc-by-sa        | spdx license identifier | spdx license identifier cc by sa [1-4] [05]
cc-by-nc        | spdx license identifier | spdx license identifier cc by nc [1-4] [05]
cc-by-nd        | spdx license identifier | spdx license identifier cc by nd [1-4] [05]
cc-by-nc-sa     | spdx license identifier | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd     | spdx license identifier | spdx license identifier cc by nc nd [1-4] [05]
unlicense       | spdx license identifier | spdx license identifier unlicense
wtfpl           | spdx license identifier | spdx license identifier wtfpl
python-2        | spdx license identifier | spdx license identifier (?:python 2 0|psf 2 0)
ofl-1.1         | spdx license identifier | spdx license identifier ofl 1 [01](?: rfn| no rfn)?
postgresql      | spdx license identifier | spdx license identifier postgresql
ncsa            | spdx license identifier | spdx license identifier ncsa
odbl-1          | spdx license identifier | spdx license identifier odbl 1 0
odc-by          | spdx license identifier | spdx license identifier odc by 1 0
pddl-1          | spdx license identifier | spdx license identifier pddl 1 0
ms-pl           | spdx license identifier | spdx license identifier ms pl
ms-rl           | spdx license identifier | spdx license identifier ms rl
openssl         | spdx license identifier | spdx license identifier openssl
php-3           | spdx license identifier | spdx license identifier php 3 0[1]?
ruby            | spdx license identifier | spdx license identifier ruby
vim             | spdx license identifier | spdx license identifier vim
curl            | spdx license identifier | spdx license identifier curl
unicode         | spdx license identifier | spdx license identifier unicode (?:dfs 2015|dfs 2016|3 0|tou)
upl-1           | spdx license identifier | spdx license identifier upl 1 0
blueoak-1       | spdx license identifier | spdx license identifier blueoak 1 0 0
mulan-2         | spdx license identifier | spdx license identifier mulanpsl 2 0
hpnd            | spdx license identifier | spdx license identifier hpnd
ecl-2           | spdx license identifier | spdx license identifier ecl 2 0
lppl            | spdx license identifier | spdx license identifier lppl 1 [0123]c?
beerware        | spdx license identifier | spdx license identifier beerware
mit             | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of (?:this|the) (?:software|package|code|material|program|library)
x11             | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .{0,600}except as contained in this notice the names? of
boost-1         | permission is hereby granted free of charge | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
ofl-1.1         | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of the font software
ncsa            | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,700}neither the names? of .{0,200}nor the names of its contributors may be used to endorse
unicode         | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode )?data files
upl-1           | permission is hereby granted free of charge | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software .{0,200}permission is hereby granted free of charge
mit-0           | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,400}to permit persons to whom the software is furnished to do so the software is provided as is
isc             | permission to use copy modify and | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
bsd-0           | permission to use copy modify and | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
postgresql      | permission to use copy modify and | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd            | permission to use copy modify and | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted provided that
curl            | permission to use copy modify and | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement of third party rights
python-2        | reproduce analyze test perform and or display publicly prepare derivative works copyright | reproduce analyze test perform and or display publicly prepare derivative works copyright
bsd             | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-1-clause    | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met (?:1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided
bsd-2-clause    | redistributions in binary form must reproduce | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met .{0,200}redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
bsd-3-clause    | redistributions in binary form must reproduce | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met .{0,200}redistributions in binary form must reproduce .{0,250}(?:3 )?(?:neither the names? of|the names? of the author may not|the names? of .{1,60}may not be used)
bsd-4-clause    | redistributions in binary form must reproduce | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met .{0,200}redistributions in binary form must reproduce .{0,250}all advertising materials mentioning features or use of this software must display
apache-1.1      | redistributions in binary form must reproduce | redistributions in binary form must reproduce .{0,250}the end user documentation included with the redistribution if any must include the following acknowledg
openssl         | redistributions of any form whatsoever must retain | redistributions of any form whatsoever must retain the following acknowledg[e]?ment this product includes software developed by the openssl project
php-3           | redistributions of any form whatsoever must retain | redistributions of any form whatsoever must retain the following acknowledg[e]?ment this product includes php software
zlib            | permission is granted to anyone to use this software | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
libpng          | permission is hereby granted to use copy modify and distribute this source code | permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee
gpl-1           | gnu general public license version 1 february 1989 | gnu general public license version 1 february 1989
gpl-2           | gnu general public license version 2 june 1991 | gnu general public license version 2 june 1991
gpl-3           | gnu general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
lgpl-2          | public license version 2 | gnu (?:library general public license version 2 june 1991|lesser general public license version 2 1 february 1999)
lgpl-3          | gnu lesser general public license version 3 29 june 2007 | gnu lesser general public license version 3 29 june 2007
agpl-3          | gnu affero general public license version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
gpl             | the licenses for most software are designed to take away your freedom | the licenses for most software are designed to take away your freedom to share and change it
apache-2        | apache license version 2 0 january 2004 | apache license version 2 0 january 2004
mpl-2           | mozilla public license version 2 0 1 definitions | mozilla public license version 2 0 1 definitions
epl-1           | eclipse public license v 1 0 the accompanying program | eclipse public license v 1 0 the accompanying program is provided under the terms of this eclipse public license
epl-2           | eclipse public license v 2 0 the accompanying program | eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license
artistic-1      | the intent of this document is to state the conditions under which a package may be copied such that the copyright | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2      | this license establishes the terms under which a given free software package | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
unlicense       | free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
wtfpl           | do what the fuck you want to public license | do what the fuck you want to public license(?: terms and conditions for copying distribution and modification)?
cc0-1           | commons corporation is not a law firm and does not provide legal services distribution of this document does not create an attorney client relationship creative commons | commons corporation is not a law firm and does not provide legal services distribution of this document does not create an attorney client relationship creative commons provides this information on an as is basis
ms-pl           | this license governs use of the accompanying software | this license governs use of the accompanying software if you use the software you accept this license
python-2        | python software foundation license version 2 1 this license agreement | python software foundation license version 2 1 this license agreement is between the python software foundation
""",
    ),
    (
        2,
        0.94,
        r"""
mit             | under the mit license | (?:is |are )?(?:licensed|released|distributed|published|available|provided|covered) under the mit license
mit             | under the terms of the mit license | under the terms of the mit license
mit             | under an mit license | under an mit license
mit             | licensed mit | licensed mit x11
mit             | under the expat license | under the expat license
mit             | mit license see | mit license see (?:the )?(?:license|copying|licence) (?:file|txt|md)
mit             | mit license | subject to the (?:terms of the )?mit license
apache-2        | under the apache license version 2 | licensed (?:to .{1,80} )?under the apache license version 2(?: 0)?
apache-2        | you may not use this file except in compliance with the license | you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2        | licenses license 2 0 | apache org licenses license 2 0
apache-2        | under the apache 2 0 license | under the apache 2 0 license
apache-2        | under the apache license 2 0 | under the apache license 2 0
apache-2        | apache software license version 2 | under the apache software license version 2(?: 0)?
apache-2        | subject to the apache license | subject to the apache license(?: version 2(?: 0)?)?
apache-1.1      | apache software license version 1 1 | under the (?:terms of the )?apache software license version 1 1
gpl-1           | either version 1 of the license | under the terms of the gnu general public license as published by the free software foundation either version 1 of the license(?: or at your option any later version)?
gpl-2           | either version 2 of the license | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license(?: or at your option any later version)?
gpl-2           | general public license version 2 | under the terms (?:and conditions )?of the gnu general public license version 2(?: only)? as published by the free software foundation
gpl-3           | either version 3 of the license | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license(?: or at your option any later version)?
gpl-3           | general public license version 3 | under the terms (?:and conditions )?of the gnu general public license version 3(?: only)? as published by the free software foundation
gpl-2           | gnu general public license version 2 | under (?:the )?(?:terms of )?(?:the )?gnu general public license version 2(?: 0)?
gpl-3           | gnu general public license version 3 | under (?:the )?(?:terms of )?(?:the )?gnu general public license version 3(?: 0)?
gpl-2           | gnu general public license v2 | under (?:the )?(?:terms of )?(?:the )?gnu general public license v2(?: 0)?
gpl-3           | gnu general public license v3 | under (?:the )?(?:terms of )?(?:the )?gnu general public license v3(?: 0)?
gpl             | under the terms of the gnu general public license | under the terms of the gnu general public license
gpl             | under the gnu general public license | under the gnu general public license
gpl             | a copy of the gnu general public license | you should have received a copy of the gnu general public license along with this (?:program|software|file|library|package)
gpl             | copyleft | copyleft under the (?:gnu )?gpl
gpl-2           | under the gpl v2 license | under the gpl v2 license
gpl-3           | under the gpl v3 license | under the gpl v3 license
gpl-2           | licensed under the gpl | licensed under the gpl (?:version |v)?2(?: 0)?
gpl-3           | licensed under the gpl | licensed under the gpl (?:version |v)?3(?: 0)?
gpl             | licensed under the gpl | licensed under the gpl
lgpl-2          | either version 2 1 of the license | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license(?: or at your option any later version)?
lgpl-2          | either version 2 of the license | under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license(?: or at your option any later version)?
lgpl-3          | either version 3 of the license | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license(?: or at your option any later version)?
lgpl-2          | gnu lesser general public license version 2 | under (?:the )?(?:terms of )?(?:the )?gnu lesser general public license version 2(?: [01])?
lgpl-3          | gnu lesser general public license version 3 | under (?:the )?(?:terms of )?(?:the )?gnu lesser general public license version 3(?: 0)?
lgpl            | under the terms of the gnu lesser general public license | under the terms of the gnu lesser general public license
lgpl            | under the gnu lesser general public license | under the gnu lesser general public license
lgpl            | under the gnu library general public license | under the gnu library general public license
lgpl            | a copy of the gnu lesser general public license | you should have received a copy of the gnu lesser general public license along with this (?:program|software|file|library|package)
lgpl-2          | licensed under the lgpl | licensed under the lgpl (?:version |v)?2(?: [01])?
lgpl-3          | licensed under the lgpl | licensed under the lgpl (?:version |v)?3(?: 0)?
lgpl            | licensed under the lgpl | licensed under the lgpl
agpl-3          | affero general public license as published by | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license(?: or at your option any later version)?
agpl-3          | affero general public license version 3 | under (?:the )?(?:terms of )?(?:the )?gnu affero general public license version 3(?: 0)?
agpl            | under the gnu affero general public license | under the gnu affero general public license
agpl            | under the terms of the gnu affero general public license | under the terms of the gnu affero general public license
agpl            | licensed under the agpl | licensed under the agpl(?: ?v?3(?: 0)?)?
gfdl            | under the terms of the gnu free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?: version 1 [123])?
bsd             | bsd license | under the (?:terms of the )?bsd license
bsd             | under a bsd style license | under a bsd style license
bsd             | governed by a bsd style license | use of this source code is governed by a bsd style license(?: that can be found in the license file)?
bsd-2-clause    | bsd license | under the (?:2 clause|two clause|simplified) bsd license
bsd-3-clause    | bsd license | under the (?:3 clause|three clause|new|revised|modified) bsd license
bsd-4-clause    | bsd license | under the (?:4 clause|four clause|original) bsd license
bsd-2-clause    | under the bsd 2 clause license | under the bsd 2 clause license
bsd-3-clause    | under the bsd 3 clause license | under the bsd 3 clause license
isc             | isc license | under the (?:terms of the )?isc license
zlib            | zlib license | under the (?:terms of the )?zlib license
zlib            | under the zlib libpng license | under the zlib libpng license
mpl-2           | subject to the terms of the mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1         | subject to the mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2           | under the mozilla public license | under the mozilla public license(?: version| v)? 2 0
mpl-1.1         | under the mozilla public license | under the mozilla public license(?: version| v)? 1 1
mpl             | under the mozilla public license | under the mozilla public license
epl-1           | under the terms of the eclipse public license | made available under the terms of the eclipse public license v ?1 0
epl-2           | under the terms of the eclipse public license | made available under the terms of the eclipse public license (?:v ?)?2 0
epl             | under the eclipse public license | under the eclipse public license
cddl-1          | common development and distribution license | subject to the terms of (?:either )?the .{0,120}common development and distribution license(?: the license)?
cpl-1           | under the common public license | under the common public license(?: version| v)?(?: 1 0)?
eupl-1.2        | licensed under the eupl | licensed under the eupl(?: version| v)? 1 2
eupl-1.1        | licensed under the eupl | licensed under the eupl(?: version| v)? 1 1
boost-1         | boost software license version 1 0 | (?:distributed|released|licensed) under the boost software license version 1 0
artistic-2      | artistic license | under the (?:terms of the )?(?:perl )?artistic license (?:version )?2 0
artistic-1      | same terms as perl itself under its license | same terms as perl itself under its license
ruby            | same terms as ruby license | under the same terms as ruby license
unlicense       | under the unlicense | (?:released|licensed) under the unlicense
wtfpl           | under the wtfpl license | under the wtfpl license
cc0-1           | creative commons | to the extent possible under law .{1,120}has waived all copyright and related (?:or|and) neighboring rights .{0,60}creative commons
cc0-1           | public domain dedication | cc0 (?:1 0 )?(?:universal )?public domain dedication
cc-by           | creative commons attribution | under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-sa        | creative commons attribution | under (?:a|the) creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc        | creative commons attribution | under (?:a|the) creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nd        | creative commons attribution | under (?:a|the) creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-sa     | creative commons attribution | under (?:a|the) creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd     | creative commons attribution | under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by           | licensed under cc by | licensed under cc by(?: [1-4] [05])?
cc-by-sa        | licensed under cc by | licensed under cc by sa(?: [1-4] [05])?
cc-by-nc        | licensed under cc by | licensed under cc by nc(?: [1-4] [05])?
cc-by-nd        | licensed under cc by | licensed under cc by nd(?: [1-4] [05])?
cc-by-nc-sa     | licensed under cc by | licensed under cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd     | licensed under cc by | licensed under cc by nc nd(?: [1-4] [05])?
cc-by           | creativecommons org licenses by | creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa        | creativecommons org licenses by | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc        | creativecommons org licenses by | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd        | creativecommons org licenses by | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa     | creativecommons org licenses by | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd     | creativecommons org licenses by | creativecommons org licenses by nc nd(?: [1-4] [05])?
ofl-1.1         | licensed under the sil open font license | this font software is licensed under the sil open font license(?: version 1 [01])?
python-2        | python software foundation license | under the (?:terms of the )?python software foundation license
postgresql      | under the postgresql license | under the postgresql license
odbl-1          | open database license | (?:available|licensed) under the (?:terms of the )?(?:odc )?open database license
odc-by          | open data commons attribution license | under the open data commons attribution license
pddl-1          | public domain dedication and license | under the (?:open data commons )?public domain dedication and license
ms-pl           | microsoft public license | under the (?:terms of the )?microsoft public license
ms-rl           | microsoft reciprocal license | under the (?:terms of the )?microsoft reciprocal license
llama-community | community license | licensed under the (?:meta )?llama [1-4](?: [0-9])? community license
gemma           | gemma license | subject to the gemma license
openrail        | rail license | under the (?:creativeml )?open ?rail license
sspl-1          | server side public license | under the (?:terms of the )?server side public license(?: version 1)?
business-source | business source license | (?:use of this software is governed by|licensed under) the business source license(?: 1 1)?
elastic-2       | elastic license | licensed under the elastic license(?: 2 0)?
public-domain   | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain   | public domain | this (?:file|work|code|software|document) is (?:hereby )?(?:in|placed in|released into) the public domain
gpl-mit         | under the mit and gpl licenses | dual licensed under the mit and gpl licenses
proprietary     | all rights reserved | (?:proprietary and confidential|confidential and proprietary) all rights reserved
proprietary     | unauthorized copying of this file via any medium is strictly prohibited copyright | unauthorized copying of this file via any medium is strictly prohibited copyright
proprietary     | end user license agreement | by (?:installing|using|copying) (?:this|the) (?:software|product) you agree to (?:be bound by )?(?:the terms of )?this end user license agreement
proprietary     | proprietary license | under (?:a|the) proprietary license
""",
    ),
    (
        3,
        0.8,
        r"""
mit             | license mit | license mit
mit             | licence mit | licence mit
mit             | the mit license | the mit license(?: mit)?
mit             | expat license | the expat license
mit-0           | mit no attribution license | mit no attribution license
x11             | x11 license | the x11 license
apache-1.1      | apache license version 1 1 | apache license version 1 1
apache-2        | apache license version 2 | apache license version 2(?: 0)?
apache-2        | apache license 2 0 | apache license 2 0
apache-2        | license apache 2 | license apache 2(?: 0)?
bsd             | license bsd | license bsd
bsd-2-clause    | license bsd 2 clause | license bsd 2 clause
bsd-3-clause    | license bsd 3 clause | license bsd 3 clause
bsd-2-clause    | bsd 2 clause license | bsd 2 clause license
bsd-3-clause    | bsd 3 clause license | bsd 3 clause license
bsd-4-clause    | bsd 4 clause license | bsd 4 clause license
isc             | license isc | license isc
zlib            | license zlib | license zlib
gpl-1           | license gpl | license gpl ?v?1(?: 0)?
gpl-2           | license gpl | license gpl ?v?2(?: 0)?
gpl-3           | license gpl | license gpl ?v?3(?: 0)?
gpl             | license gpl | license gpl
gpl-2           | gnu general public license version 2 | gnu general public license version 2(?: 0)?
gpl-3           | gnu general public license version 3 | gnu general public license version 3(?: 0)?
gpl-2           | gnu general public license v2 | gnu general public license v2(?: 0)?
gpl-3           | gnu general public license v3 | gnu general public license v3(?: 0)?
lgpl-2          | license lgpl | license lgpl ?v?2(?: [01])?
lgpl-3          | license lgpl | license lgpl ?v?3(?: 0)?
lgpl            | license lgpl | license lgpl
lgpl-2          | gnu lesser general public license version 2 | gnu lesser general public license version 2(?: 1)?
lgpl-3          | gnu lesser general public license version 3 | gnu lesser general public license version 3(?: 0)?
lgpl-2          | gnu library general public license version 2 | gnu library general public license version 2(?: 0)?
agpl-3          | gnu affero general public license version 3 | gnu affero general public license version 3(?: 0)?
agpl-3          | license agpl | license agpl ?v?3(?: 0)?
mpl-1           | mozilla public license version 1 0 | mozilla public license version 1 0
mpl-1.1         | mozilla public license version 1 1 | mozilla public license version 1 1
mpl-2           | mozilla public license version 2 0 | mozilla public license version 2 0
mpl-2           | license mpl 2 | license mpl 2(?: 0)?
mpl-1.1         | license mpl 1 1 | license mpl 1 1
epl-1           | eclipse public license version 1 | eclipse public license version 1(?: 0)?
epl-2           | eclipse public license version 2 | eclipse public license version 2(?: 0)?
epl-2           | license epl 2 | license epl 2(?: 0)?
cddl-1          | license cddl | license cddl(?: 1 [01])?
eupl-1.2        | european union public licence | european union public licence v ?1 2
eupl-1.1        | european union public licence | european union public licence v ?1 1
cc0-1           | license cc0 | license cc0(?: 1 0)?
cc-by           | license cc by | license cc by(?: [1-4] [05])?
cc-by-sa        | license cc by | license cc by sa(?: [1-4] [05])?
cc-by-nc        | license cc by | license cc by nc(?: [1-4] [05])?
cc-by-nd        | license cc by | license cc by nd(?: [1-4] [05])?
cc-by-nc-sa     | license cc by | license cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd     | license cc by | license cc by nc nd(?: [1-4] [05])?
cc-by           | creative commons attribution | creative commons attribution(?: [1-4] [05])?
cc-by-sa        | creative commons attribution | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-nc        | creative commons attribution | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd        | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?
cc-by-nc-sa     | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd     | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?
unlicense       | license unlicense | license unlicense
wtfpl           | license wtfpl | license wtfpl
artistic-2      | artistic license 2 0 | artistic license 2 0
boost-1         | boost software license | boost software license(?: version)? 1 0
python-2        | license python | license python software foundation
ofl-1.1         | sil open font license | sil open font license(?: version)?(?: 1 [01])?
ncsa            | university of illinois ncsa open source license | university of illinois ncsa open source license
odbl-1          | open database license | open data commons open database license(?: 1 0)?
php-3           | php license version 3 | php license version 3(?: 0[01]?)?
llama-community | community license agreement | llama [1-4](?: [0-9])? community license agreement
proprietary     | license proprietary | license proprietary
""",
    ),
    (
        4,
        0.6,
        r"""
mit             | mit licen | mit licen[cs]ed?
mit             | mit x11 licen | mit x11 licen[cs]e
apache-2        | apache 2 0 licen | apache 2 0 licen[cs]ed?
apache          | apache licen | apache licen[cs]ed?
bsd             | bsd licen | bsd licen[cs]ed?
bsd-2-clause    | bsd licen | (?:2 clause|two clause|simplified) bsd licen[cs]ed?
bsd-3-clause    | bsd licen | (?:3 clause|three clause|new|revised|modified) bsd licen[cs]ed?
bsd-4-clause    | bsd licen | (?:4 clause|original) bsd licen[cs]ed?
isc             | isc licen | isc licen[cs]ed?
zlib            | zlib licen | zlib licen[cs]ed?
gpl             | gpl licen | (?:gnu )?gpl licen[cs]ed?
gpl-2           | licen | gpl ?v?2(?: 0)? licen[cs]ed?
gpl-3           | licen | gpl ?v?3(?: 0)? licen[cs]ed?
gpl             | gnu general public licen | gnu general public licen[cs]e
lgpl            | lgpl licen | (?:gnu )?lgpl licen[cs]ed?
lgpl            | general public licen | (?:gnu )?(?:lesser|library) general public licen[cs]e
agpl            | agpl licen | (?:gnu )?agpl licen[cs]ed?
agpl            | affero general public licen | (?:gnu )?affero general public licen[cs]e
gfdl            | free documentation licen | (?:gnu )?free documentation licen[cs]e
mpl             | mozilla public licen | mozilla public licen[cs]e
mpl-2           | mpl 2 0 licen | mpl 2 0 licen[cs]ed?
epl             | eclipse public licen | eclipse public licen[cs]e
cddl-1          | cddl licen | cddl licen[cs]ed?
cc-by           | licen | cc by(?: [1-4] [05])? licen[cs]ed?
cc-by-sa        | licen | cc by sa(?: [1-4] [05])? licen[cs]ed?
cc-by-nc        | licen | cc by nc(?: [1-4] [05])? licen[cs]ed?
cc-by-nd        | licen | cc by nd(?: [1-4] [05])? licen[cs]ed?
cc-by-nc-sa     | licen | cc by nc sa(?: [1-4] [05])? licen[cs]ed?
cc-by-nc-nd     | licen | cc by nc nd(?: [1-4] [05])? licen[cs]ed?
creative-commons | creative commons licen | creative commons licen[cs]ed?
artistic-2      | artistic licen | artistic licen[cs]e 2(?: 0)?
artistic        | artistic licen | artistic licen[cs]e
boost-1         | boost licen | boost licen[cs]e
ofl-1.1         | open font licen | open font licen[cs]e
python-2        | python licen | python licen[cs]e
ruby            | ruby licen | ruby licen[cs]e
vim             | vim licen | vim licen[cs]e
wtfpl           | wtfpl licen | wtfpl licen[cs]ed?
unlicense       | unlicense | the unlicense
proprietary     | proprietary licen | proprietary licen[cs]ed?
""",
    ),
)


@lru_cache
def rules() -> tuple[tuple[str, str, int, float, str], ...]:
    """keyword, label, priority, confidence and expression of every rule, in order."""
    out = []
    for priority, sure, table in SIGNATURES:
        for line in table.strip().split("\n"):
            label, keyword, expression = (x.strip() for x in line.split(" | ", 2))
            out.append((keyword, label, priority, sure, f"(?<= )(?:{expression})(?= )"))
    return tuple(out)


def normal_words(text: Column) -> Column:
    """The words of a text, each after a space, and a space at the end; two spaces if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), F.lit(" "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _with(value: Column, then) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scan(items: Column, state: Column, none: Column, step) -> Column:
    """Walks an array: step(state, item) gives the next state and an array of what to put out, all of which is returned.

    Blocks of about the root of the array's length are walked one by one, so that appending does not copy all that is out.
    """

    def one(acc, x):
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc, part):
        return _with(
            F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one),
            lambda made: F.struct(made["state"].alias("state"), F.concat(acc["out"], made["out"]).alias("out")),
        )

    def walk(whole):
        size = F.size(whole)
        wide = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
        parts = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1)), wide), lambda at: F.slice(whole, at, wide))
        return F.aggregate(parts, F.struct(state.alias("state"), none.alias("out")), block)["out"]

    return _with(items, walk)


def _places(norm: Column, pattern: Column) -> Column:
    """Starts and ends (in characters) of a pattern's matches, left to right."""
    hits = F.transform(F.regexp_extract_all(norm, pattern, F.lit(0)), lambda x: F.length(x))
    gaps = F.transform(F.split(norm, pattern, -1), lambda x: F.length(x))

    def step(at, x):
        a = at + x["gap"]
        return a + x["hit"], F.array(F.struct(a.alias("a"), (a + x["hit"]).alias("b")))

    pairs = _with(hits, lambda h: F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, x: F.struct(g.alias("gap"), x.alias("hit"))))
    return _scan(pairs, F.lit(0), F.expr("cast(array() as array<struct<a:int,b:int>>)"), step)


DETECTIONS = "array<struct<a:int,z:int,priority:int,label:string,sure:double>>"


def _detections(norm: Column) -> Column:
    """All matches of all rules whose keyword the text holds: a, z (less the end), priority, label, confidence, in this order."""
    by_keyword: dict[str, list] = {}
    for keyword, label, priority, sure, pattern in rules():
        by_keyword.setdefault(keyword, []).append(F.struct(F.lit(priority).alias("priority"), F.lit(sure).alias("sure"), F.lit(label).alias("label"), F.lit(pattern).alias("pattern")))
    groups = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*own).alias("rules")) for k, own in by_keyword.items()])
    on = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(norm, g["keyword"])), lambda g: g["rules"]))

    def matches(rule):
        return F.transform(_places(norm, rule["pattern"]), lambda p: F.struct(p["a"].alias("a"), (-p["b"]).alias("z"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["sure"].alias("sure")))

    return F.array_sort(F.flatten(F.transform(on, matches)))


def _uncontained(found: Column) -> Column:
    """Drops what lies inside an earlier or longer detection of the same or a better priority.

    What a dropped one would cover, the one that covers it covers too, so the furthest end of each priority tells all.
    """

    def step(far, x):
        inside = F.array_max(F.slice(far, F.lit(1), x["priority"])) >= -x["z"]
        after = F.transform(far, lambda v, i: F.when(i == x["priority"] - 1, F.greatest(v, -x["z"])).otherwise(v))
        return after, F.when(inside, F.expr(f"cast(array() as {DETECTIONS})")).otherwise(F.array(x))

    return _scan(found, F.expr("array(-1, -1, -1, -1)"), F.expr(f"cast(array() as {DETECTIONS})"), step)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    detections: start and end (characters of the normalised words), label and confidence of what the rules kept.
    """
    out = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    keep = [c for c in docs.columns if c not in out]
    df = docs.select(*[docs[c] for c in keep], normal_words(docs["text"]).alias("_norm"))
    norm = F.col("_norm")
    df = df.withColumn("_n", F.when(F.length(norm) == 2, 0).otherwise(_spaces(norm) - 1))
    places = []
    for phrase, label in BASE:
        gaps = F.split(norm, f" {phrase}(?= )", -1)
        has = F.contains(norm, F.lit(f" {phrase} "))
        many = len(phrase.split())
        last = F.col("_n") - (_spaces(F.element_at(gaps, -1)) - 1) - many
        places.append(F.when(has, F.struct((F.size(gaps) - 1).alias("n"), _spaces(gaps[0]).alias("first"), last.alias("last"), F.lit(label).alias("label"))))
    df = df.withColumn("_base", F.array_compact(F.array(*places)))
    gate = F.lit(False)
    for word in GATE:
        gate |= F.contains(norm, F.lit(word))
    empty = F.expr(f"cast(array() as {DETECTIONS})")
    df = df.withColumn("_found", F.when(gate, _uncontained(_detections(norm))).otherwise(empty))
    base = F.transform("_base", lambda x: x["label"])
    own = F.transform("_found", lambda x: x["label"])
    total = F.aggregate("_base", F.lit(0), lambda acc, x: acc + x["n"])
    best = F.coalesce(F.array_max(F.transform("_found", lambda x: x["sure"])), F.lit(0.0))
    return df.select(
        *keep,
        F.col("_n").cast("long").alias("n_words"),
        total.cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["last"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(best).alias("score"),
        F.transform("_found", lambda x: F.struct(x["a"].alias("start"), (-x["z"]).alias("end"), x["label"].alias("label"), x["sure"].alias("confidence"))).alias("detections"),
    )
