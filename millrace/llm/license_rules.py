"""Signature rules of the licence scan, written by hand, as  label | level | keyword | regex.

They run on normalised text: lower-case words with one space before, between and behind them. Each
regex is gated by its keyword at a word's start, and its match ends before the space that follows. Levels order the
rules: 1 a mention, 2 a named licence, 3 a notice or grant, 4 the licence's own wording. A detection inside one of a higher
level, or inside a longer one of its level, is suppressed.
"""

RULES = r"""
gpl-1.0|3|general public| gnu general public licen[sc]e (as published by the free software foundation )?(version|v) ?1( 0)?
gpl-1.0|2|gpl| gpl ?v?1( 0)?( only| or later)?
gpl-2.0|3|general public| gnu general public licen[sc]e (as published by the free software foundation )?(either )?(version|v) ?2( 0)?
gpl-2.0|2|gpl| gpl ?v?2( 0)?( only)?
gpl-2.0|2|general public| general public licen[sc]e version 2
gpl-2.0-plus|3|general public| general public licen[sc]e (as published by the free software foundation )?(either )?version 2 (of the licen[sc]e )?or (at your option )?any later version
gpl-2.0-plus|2|gpl| gpl ?v?2( 0)? (or later|plus)
gpl-3.0|3|general public| gnu general public licen[sc]e (as published by the free software foundation )?(either )?(version|v) ?3( 0)?
gpl-3.0|2|gpl| gpl ?v?3( 0)?( only)?
gpl-3.0|2|general public| general public licen[sc]e version 3
gpl-3.0-plus|3|general public| general public licen[sc]e (as published by the free software foundation )?(either )?version 3 (of the licen[sc]e )?or (at your option )?any later version
gpl-3.0-plus|2|gpl| gpl ?v?3( 0)? (or later|plus)
gpl|1|general public| general public licen[sc]e
gpl|2|general public| (the )?gnu general public licen[sc]e
gpl|1|gpl| (gnu )?gpl
gpl|2|gpl| (under|licen[sc]ed under|terms of) the (gnu )?gpl
gpl|3|free software| this program is free software you can redistribute it and or modify it
gpl|4|freedom| the licen[sc]es for most software are designed to take away your freedom to share and change it
gpl|4|copyleft| the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works
gpl|3|without even| without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e
gpl|3|general public| you should have received a copy of the gnu general public licen[sc]e
gpl-linking-exception|3|special exception| as a special exception .{0,120}link
gpl-classpath-exception|3|classpath| classpath exception
gpl-font-exception|3|font exception| font exception
gpl-gcc-exception|3|runtime library| gcc runtime library exception
gpl-autoconf-exception|3|autoconf| autoconf exception
lgpl-2.0|3|general public| gnu library general public licen[sc]e (as published by the free software foundation )?(either )?version 2( 0)?
lgpl-2.0|2|lgpl| lgpl ?v?2 0( only| or later)?
lgpl-2.1|3|general public| gnu lesser general public licen[sc]e (as published by the free software foundation )?(either )?(version|v) ?2 1
lgpl-2.1|2|lgpl| lgpl ?v?2 1( only| or later)?
lgpl-3.0|3|general public| gnu lesser general public licen[sc]e (as published by the free software foundation )?(either )?(version|v) ?3( 0)?
lgpl-3.0|2|lgpl| lgpl ?v?3( 0)?( only| or later)?
lgpl|2|general public| (the )?(gnu )?(lesser|library) general public licen[sc]e
lgpl|1|lgpl| (gnu )?lgpl
lgpl|3|general public| you should have received a copy of the gnu (lesser|library) general public licen[sc]e
lgpl|3|free software| this library is free software you can redistribute it and or modify it
agpl-1.0|3|affero| affero general public licen[sc]e version 1
agpl-3.0|3|affero| (gnu )?affero general public licen[sc]e (as published by the free software foundation )?(either )?(version|v) ?3( 0)?
agpl-3.0|2|agpl| agpl ?v?3( 0)?( only| or later)?
agpl|2|affero| (the )?(gnu )?affero general public licen[sc]e
agpl|1|agpl| (gnu )?agpl
gfdl-1.1|3|free documentation| gnu free documentation licen[sc]e version 1 1
gfdl-1.2|3|free documentation| gnu free documentation licen[sc]e version 1 2
gfdl-1.3|3|free documentation| gnu free documentation licen[sc]e version 1 3
gfdl|2|free documentation| (gnu )?free documentation licen[sc]e
gfdl|1|gfdl| gfdl
apache-1.0|3|apache| apache licen[sc]e version 1 0
apache-1.1|3|apache| apache (software )?licen[sc]e version 1 1
apache-2.0|3|apache| apache licen[sc]e version 2 0
apache-2.0|2|apache| apache ?(licen[sc]e )?(v ?)?2( 0)?
apache-2.0|3|apache| licen[sc]ed under the apache licen[sc]e version 2( 0)?( the licen[sc]e)?
apache-2.0|3|apache| www apache org licen[sc]es licen[sc]e 2 0
apache-2.0|3|compliance| you may not use this file except in compliance with the licen[sc]e
apache-2.0|3|as is| distributed on an as is basis without warranties or conditions of any kind
apache-2.0|4|terms and conditions| terms and conditions for use reproduction and distribution
apache-2.0|4|unless required| unless required by applicable law or agreed to in writing software distributed under the licen[sc]e
apache|1|apache| apache (software )?licen[sc]e
apache|2|apache| licen[sc]ed (to|under) the apache( software foundation)?( licen[sc]e)?
mit|2|mit licen| (the )?mit licen[sc]e
mit|3|mit licen| (released|licen[sc]ed|distributed|available) under the( terms of the)? mit licen[sc]e
mit|1|spdx| spdx licen[sc]e identifier mit
mit|3|mit licen| opensource org licen[sc]es mit( licen[sc]e)?
mit|4|permission is| permission is hereby granted free of charge to any person obtaining a copy of this software
mit|4|permission notice| the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit|4|as is| the software is provided as is without warranty of any kind express or implied
mit|3|mit x11| mit x11( licen[sc]e)?
mit-0|3|mit no| mit no attribution
x11|2|x11| x11 licen[sc]e
x11|4|x consortium| x consortium
expat|2|expat| expat licen[sc]e
bsd-1-clause|3|bsd| bsd 1 clause( licen[sc]e)?
bsd-2-clause|3|bsd| bsd 2 clause( licen[sc]e)?
bsd-2-clause|3|bsd| (simplified|freebsd) bsd licen[sc]e
bsd-3-clause|3|bsd| bsd 3 clause( licen[sc]e)?
bsd-3-clause|3|bsd| (new|modified|revised) bsd licen[sc]e
bsd-4-clause|3|bsd| bsd 4 clause( licen[sc]e)?
bsd-4-clause|4|advertising| all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause|4|endorse| neither the name of .{1,80} may be used to endorse or promote products derived from this software
bsd|4|redistribut| redistribution and use in source and binary forms with or without modification are permitted
bsd|4|redistribut| redistributions of source code must retain the above copyright notice
bsd|4|redistribut| redistributions in binary form must reproduce the above copyright notice
bsd|2|bsd| (the )?bsd licen[sc]e
bsd|2|bsd| bsd style licen[sc]e
bsd|1|bsd| bsd licen[sc]ed
bsd-0-clause|3|zero clause| bsd zero clause licen[sc]e
bsd-0-clause|2|0bsd| 0bsd
isc|2|isc licen| (the )?isc licen[sc]e
isc|4|permission to| permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-1.0|3|mozilla| mozilla public licen[sc]e (version|v) ?1 0
mpl-1.1|3|mozilla| mozilla public licen[sc]e (version|v) ?1 1
mpl-2.0|3|mozilla| mozilla public licen[sc]e (version|v) ?2 0
mpl-2.0|2|mpl| mpl ?v?2( 0)?
mpl-1.1|2|mpl| mpl ?v?1 1
mpl|2|mozilla| mozilla public licen[sc]e
mpl|1|mpl| mpl
mpl-2.0|4|mozilla| this source code form is subject to the terms of the mozilla public licen[sc]e
epl-1.0|3|eclipse| eclipse public licen[sc]e (version |v ?)?1 0
epl-2.0|3|eclipse| eclipse public licen[sc]e (version |v ?)?2 0
epl|2|eclipse| eclipse public licen[sc]e
edl-1.0|3|eclipse| eclipse distribution licen[sc]e( version| v)? 1 0
cddl-1.0|3|common development| common development and distribution licen[sc]e (version )?1 0
cddl-1.1|3|common development| common development and distribution licen[sc]e (version )?1 1
cddl|2|common development| common development and distribution licen[sc]e
cddl|1|cddl| cddl
cpl-1.0|2|common public| common public licen[sc]e( version 1 0)?
ipl-1.0|2|ibm public| ibm public licen[sc]e( version 1 0)?
eupl-1.1|3|european union| european union public licen[sc]e (version |v ?)?1 1
eupl-1.2|3|european union| european union public licen[sc]e (version |v ?)?1 2
eupl|2|european union| european union public licen[sc]e
eupl|1|eupl| eupl
artistic-1.0|3|artistic| artistic licen[sc]e (version )?1 0
artistic-2.0|3|artistic| artistic licen[sc]e (version )?2 0
artistic|2|artistic| (the )?artistic licen[sc]e
artistic-perl|3|same terms| (under )?the same terms as perl( itself)?
zlib|2|zlib| zlib( libpng)? licen[sc]e
zlib|4|in no event| in no event will the authors be held liable for any damages arising from the use of this software
libpng|2|libpng| libpng licen[sc]e
boost-1.0|3|boost| boost software licen[sc]e (version )?1 0
boost|2|boost| boost software licen[sc]e
unlicense|2|unlicen| (the )?unlicen[sc]e
unlicense|4|public domain| this is free and unencumbered software released into the public domain
wtfpl|2|wtfpl| wtfpl
wtfpl|3|what the| do what the f.{1,6} you want to public licen[sc]e
public-domain|2|public domain| (released|dedicated|placed|is) (in|into|to) the public domain
public-domain|1|public domain| public domain
cc0-1.0|3|cc0| cc0 1 0( universal)?
cc0|2|cc0| cc0
cc0|3|creative commons| creative commons zero
cc-by-1.0|3|cc by| cc by 1 0
cc-by-2.0|3|cc by| cc by 2 0
cc-by-2.5|3|cc by| cc by 2 5
cc-by-3.0|3|cc by| cc by 3 0
cc-by-4.0|3|cc by| cc by 4 0
cc-by|2|cc by| cc by
cc-by-sa-1.0|3|cc by sa| cc by sa 1 0
cc-by-sa-2.0|3|cc by sa| cc by sa 2 0
cc-by-sa-2.5|3|cc by sa| cc by sa 2 5
cc-by-sa-3.0|3|cc by sa| cc by sa 3 0
cc-by-sa-4.0|3|cc by sa| cc by sa 4 0
cc-by-sa|2|cc by sa| cc by sa
cc-by-nc-2.0|3|cc by nc| cc by nc 2 0
cc-by-nc-2.5|3|cc by nc| cc by nc 2 5
cc-by-nc-3.0|3|cc by nc| cc by nc 3 0
cc-by-nc-4.0|3|cc by nc| cc by nc 4 0
cc-by-nc|2|cc by nc| cc by nc
cc-by-nc-sa-2.0|3|cc by nc| cc by nc sa 2 0
cc-by-nc-sa-3.0|3|cc by nc| cc by nc sa 3 0
cc-by-nc-sa-4.0|3|cc by nc| cc by nc sa 4 0
cc-by-nc-sa|2|cc by nc| cc by nc sa
cc-by-nc-nd-3.0|3|cc by nc| cc by nc nd 3 0
cc-by-nc-nd-4.0|3|cc by nc| cc by nc nd 4 0
cc-by-nc-nd|2|cc by nc| cc by nc nd
cc-by-nd-3.0|3|cc by nd| cc by nd 3 0
cc-by-nd-4.0|3|cc by nd| cc by nd 4 0
cc-by-nd|2|cc by nd| cc by nd
cc-by-1.0|3|creative commons| creative commons attribution 1 0
cc-by-2.0|3|creative commons| creative commons attribution 2 0
cc-by-3.0|3|creative commons| creative commons attribution 3 0
cc-by-4.0|3|creative commons| creative commons attribution 4 0( international)?
cc-by|2|creative commons| creative commons attribution( licen[sc]e)?
cc-by-sa-3.0|3|creative commons| creative commons attribution share ?alike 3 0
cc-by-sa-4.0|3|creative commons| creative commons attribution share ?alike 4 0( international)?
cc-by-sa|2|creative commons| creative commons attribution share ?alike
cc-by-nc-3.0|3|creative commons| creative commons attribution non ?commercial 3 0
cc-by-nc-4.0|3|creative commons| creative commons attribution non ?commercial 4 0
cc-by-nc|2|creative commons| creative commons attribution non ?commercial
cc-by-nc-sa|2|creative commons| creative commons attribution non ?commercial share ?alike
cc-by-nc-nd|2|creative commons| creative commons attribution non ?commercial no ?deriv(ative)?s
cc-by-nd|2|creative commons| creative commons attribution no ?deriv(ative)?s
cc-by|3|creativecommons| creativecommons org licen[sc]es by
cc-by-sa|3|creativecommons| creativecommons org licen[sc]es by sa
cc-by-nc|3|creativecommons| creativecommons org licen[sc]es by nc
cc-by-nc-sa|3|creativecommons| creativecommons org licen[sc]es by nc sa
cc-by-nc-nd|3|creativecommons| creativecommons org licen[sc]es by nc nd
cc-by-nd|3|creativecommons| creativecommons org licen[sc]es by nd
cc0|3|creativecommons| creativecommons org publicdomain zero
creative-commons|1|creative commons| creative commons( licen[sc]e)?
odbl-1.0|2|open database| open database licen[sc]e( v?1 0)?
odc-by|2|open data| open data commons attribution licen[sc]e
pddl|2|public domain| public domain dedication and licen[sc]e
ofl-1.1|3|open font| sil open font licen[sc]e (version )?1 1
ofl|2|open font| (sil )?open font licen[sc]e
ogl-uk|2|open government| open government licen[sc]e( v(ersion)? ?[123]( 0)?)?
psf-2.0|2|python software| python software foundation licen[sc]e( version 2)?
php-3.01|3|php licen| php licen[sc]e (version )?3 01
php|2|php licen| (the )?php licen[sc]e
ruby|2|ruby licen| (the )?ruby licen[sc]e
openssl|2|openssl| openssl licen[sc]e
openssl|4|openssl| this product includes software developed by the openssl project
ssleay|4|eric young| this product includes cryptographic software written by eric young
vim|2|vim licen| vim licen[sc]e
curl|2|curl licen| curl licen[sc]e
ncsa|2|ncsa| (university of illinois )?ncsa open source licen[sc]e
w3c|2|w3c| w3c software (notice and )?licen[sc]e
afl-3.0|2|academic free| academic free licen[sc]e( v(ersion)? ?3 0)?
osl-3.0|2|open software| open software licen[sc]e( v(ersion)? ?3 0)?
ms-pl|2|microsoft| microsoft public licen[sc]e
ms-rl|2|microsoft| microsoft reciprocal licen[sc]e
qpl|2|q public| q public licen[sc]e
sleepycat|2|sleepycat| sleepycat licen[sc]e
upl-1.0|2|universal permissive| universal permissive licen[sc]e( v(ersion)? ?1 0)?
ecl-2.0|2|educational community| educational community licen[sc]e( version 2 0)?
lppl|2|latex project| latex project public licen[sc]e( version)?( 1 3c?)?
mulan|2|mulan| mulan (psl|permissive software licen[sc]e)( v ?[12])?
sspl|2|server side| server side public licen[sc]e( version 1)?
busl-1.1|2|business source| business source licen[sc]e( version)?( 1 1)?
elastic-2.0|2|elastic licen| elastic licen[sc]e( 2 0)?
commons-clause|2|commons clause| commons clause( licen[sc]e condition)?
polyform|2|polyform| polyform (noncommercial|shield|strict|small business|perimeter|internal use) licen[sc]e
bigscience-rail|2|rail| (bigscience |open ?)?rail( m)? licen[sc]e
llama|2|llama| llama ?[23]?( [0-9])? community licen[sc]e
copyright|1|copyright| copyright( c)?( [0-9]{4})+
copyright|2|copyright| copyright (c )?([0-9]{4} )+.{1,60}? all rights reserved
reserved|1|rights reserved| all rights reserved
reserved|1|rights reserved| some rights reserved
reserved|3|no part of| no part of this (publication|work|document|book) may be reproduced
proprietary|3|proprietary| (this (software|document) (is|contains) )?proprietary and confidential
proprietary|2|proprietary| proprietary licen[sc]e
proprietary|2|commercial licen| commercial licen[sc]e( agreement)?
eula|2|end user| end user licen[sc]e agreement
eula|1|eula| eula
shareware|2|shareware| this (program|software) is shareware
freeware|2|freeware| this (program|software) is freeware
non-commercial|2|non commercial| for non commercial (use|purposes) only
internal-use|2|internal use| for internal use only
patent-grant|3|patent| grant of patent licen[sc]e
patents|2|patent| (us |u s )?patents? pending
warranty-disclaimer|2|warrant| without (any )?warrant(y|ies)( of any kind)?
warranty-disclaimer|2|warrant| no warrant(y|ies)
liability-disclaimer|2|liab| in no event shall .{1,80} be liable
spdx|1|spdx| spdx licen[sc]e identifier
see-license|1|licen| (see|refer to) (the )?(file )?licen[sc]e( file| txt| md)?( for details)?
licensed-unknown|1|licen| (licen[sc]ed|released|distributed|available) under( the| a| an)?( terms of)?( the| a| an)?
"""


def rules() -> list[tuple[str, int, str, str]]:
    out = []
    for line in RULES.strip().splitlines():
        label, level, keyword, regex = line.split("|", 3)
        out.append((label, int(level), keyword, regex.rstrip() + "(?= )"))
    return out
