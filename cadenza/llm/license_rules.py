"""Fixed values of the license scan: its signature rules, written one by one.

A line holds label, keyword, priority, confidence and pattern. The pattern is a regular expression over
the words of a text in small letters with single spaces between them (punctuation is a space). The
keyword is part of one word of every match, so a text without it need not be searched.

Priorities: 1 a bare name, 2 a short or versioned name, 3 a sentence of a header, notice or body, 4 an identifier.
"""

from __future__ import annotations

TABLE = r"""
afl             academic     1 0.7 academic free license
afl             academic     2 0.9 academic free license (?:version |v )?[123] [0-9]
afl             afl          4 1.0 spdx license identifier afl [123] [0-9]
agpl            affero       1 0.7 gnu affero general public license
agpl            affero       2 0.9 gnu affero general public license (?:version |v ?)?3(?: 0)?(?: only| or (?:any )?later(?: version)?)?
agpl            affero       2 0.8 affero gpl(?: (?:version |v ?)?[13])?
agpl            affero       3 1.0 under the terms of the gnu affero general public license as published by the free software foundation
agpl            affero       3 0.9 you should have received a copy of the gnu affero general public license along with this program
agpl            agpl         2 0.9 (?:gnu )?agpl (?:version |v ?)?[13](?: 0)?(?: only| or (?:any )?later(?: version)?)?
agpl            agpl         2 0.9 (?:gnu )?agplv[13](?: 0)?(?: only| or (?:any )?later(?: version)?)?
agpl            agpl         4 1.0 spdx license identifier agpl [13] 0(?: only| or later)?
agpl            remotely     3 0.9 your modified version must prominently offer all users interacting with it remotely through a computer network
apache          apache       1 0.7 apache (?:software )?license
apache          apache       2 0.9 apache (?:software )?license (?:version |v ?)?[12](?: [01])?
apache          apache       2 0.9 apache (?:version |v ?)?[12] [01]
apache          apache       2 0.7 apache v?2
apache          apache       2 0.8 apache licen[cs]ed
apache          apache       2 0.8 apache style licen[cs]e
apache          apache       3 1.0 licensed to the apache software foundation asf under one or more contributor license agreements
apache          apache       3 1.0 licensed under the apache license(?: version 2 0)?(?: the license)?
apache          apache       3 0.9 http www apache org licenses license 2 0
apache          apache       3 0.9 https www apache org licenses license 2 0
apache          apache       4 1.0 spdx license identifier apache [12] [01]
apache          compliance   3 0.9 you may not use this file except in compliance with the license
apache          warranties   3 0.7 distributed on an as is basis without warranties or conditions of any kind either express or implied
apache          governing    3 0.9 see the license for the specific language governing permissions and limitations under the license
apache          irrevocable  3 0.8 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache          notwithstanding 3 0.7 notwithstanding the above nothing herein shall supersede or modify the terms of any separate license agreement
apsl            apple        1 0.7 apple public source license
apsl            apple        2 0.9 apple public source license (?:version |v ?)?[12](?: [0-9])?
apsl            apsl         4 1.0 spdx license identifier apsl [12] [0-9]
artistic        artistic     1 0.7 (?:the )?(?:perl )?artistic license
artistic        artistic     2 0.9 artistic license (?:version |v ?)?[12](?: 0)?
artistic        artistic     3 0.9 same terms as perl itself either perl version .{0,40}or the artistic license
artistic        perl         3 0.8 (?:redistribute|modify) it (?:and or modify it )?under the same terms as perl(?: itself)?
artistic        artistic     4 1.0 spdx license identifier artistic [12] 0
bsd             bsd          1 0.7 bsd license
bsd             bsd          2 0.9 (?:[0234]|two|three|four) clause bsd license
bsd             bsd          2 0.9 bsd (?:[0234]|two|three|four) clause
bsd             bsd          2 0.8 (?:[0234]|two|three|four|new|modified|simplified|revised) (?:clause )?bsd
bsd             bsd          2 0.8 bsd (?:style licen[cs]e|licen[cs]ed)
bsd             freebsd      2 0.8 freebsd (?:documentation )?license
bsd             bsd          3 0.9 use of this source code is governed by a bsd style license that can be found in the license file
bsd             bsd          4 1.0 spdx license identifier bsd [0-9a-z]+ clause(?: [a-z]+)*
bsd             spdx         4 1.0 spdx license identifier 0bsd
bsd             redistribution 3 1.0 redistribution and use in source and binary forms with or without modification are permitted
bsd             redistribution 3 0.9 redistribution and use in source and binary forms
bsd             redistributions 3 0.9 redistributions of source code must retain the above copyright notice
bsd             redistributions 3 0.9 redistributions in binary form must reproduce the above copyright notice
bsd             endorse      3 0.9 may be used to endorse or promote products derived from this software
bsd             advertising  3 0.9 all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd             contributors 3 0.8 this software is provided by the copyright holders and contributors as is
bsd             regents      3 0.8 this software is provided by the regents and contributors as is
bsd             consequential 3 0.7 in no event shall the copyright (?:holder|owner)s? or contributors be liable for any direct indirect incidental special exemplary or consequential damages
bsl             boost        1 0.7 boost software license
bsl             boost        2 0.9 boost software license (?:version |v ?)?1 0
bsl             boost        3 1.0 distributed under the boost software license version 1 0
bsl             bsl          4 1.0 spdx license identifier bsl 1 0
bsl             organization 3 1.0 permission is hereby granted free of charge to any person or organization obtaining a copy of the software
busl            business     1 0.7 business source license
busl            business     2 0.9 business source license 1 1
busl            busl         4 1.0 spdx license identifier busl 1 1
busl            change       3 0.8 the change license the change date
busl            production   3 0.8 additional use grant you may make production use of the licensed work
cc-by           commons      1 0.7 creative commons attribution
cc-by           commons      2 0.9 creative commons attribution [1-4] [05](?: international| unported| generic)?
cc-by           commons      3 1.0 licensed under a creative commons attribution [1-4] [05] (?:international|unported|generic) license
cc-by           creativecommons 3 0.9 https? (?:www )?creativecommons org licenses by [1-4] [05]
cc-by           cc           2 0.9 cc by(?: [1-4] [05])?
cc-by           cc           4 1.0 spdx license identifier cc by [1-4] [05]
cc-by-nc        commons      1 0.8 creative commons attribution non ?commercial
cc-by-nc        commons      2 0.9 creative commons attribution non ?commercial [1-4] [05]
cc-by-nc        commons      3 1.0 creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc        commons      3 1.0 creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?
cc-by-nc        creativecommons 3 0.9 https? (?:www )?creativecommons org licenses by nc(?: sa| nd)? [1-4] [05]
cc-by-nc        cc           3 0.9 cc by nc(?: sa| nd)?(?: [1-4] [05])?
cc-by-nc        cc           4 1.0 spdx license identifier cc by nc(?: sa| nd)? [1-4] [05]
cc-by-nd        commons      3 1.0 creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?
cc-by-nd        creativecommons 3 0.9 https? (?:www )?creativecommons org licenses by nd [1-4] [05]
cc-by-nd        cc           3 0.9 cc by nd(?: [1-4] [05])?
cc-by-nd        cc           4 1.0 spdx license identifier cc by nd [1-4] [05]
cc-by-sa        commons      3 1.0 creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-sa        creativecommons 3 0.9 https? (?:www )?creativecommons org licenses by sa [1-4] [05]
cc-by-sa        cc           3 0.9 cc by sa(?: [1-4] [05])?
cc-by-sa        cc           4 1.0 spdx license identifier cc by sa [1-4] [05]
cc-by-sa        wikipedia    3 0.8 text is available under the creative commons attribution share ?alike license.{0,60}wikipedia
cc0             cc0          1 0.8 cc0
cc0             cc0          2 0.9 cc0 (?:version |v ?)?1 0(?: universal)?
cc0             cc0          2 0.9 cc0 universal
cc0             cc0          3 1.0 cc0 1 0 universal public domain dedication
cc0             commons      2 0.9 creative commons (?:zero|0)
cc0             creativecommons 3 0.9 https? (?:www )?creativecommons org publicdomain zero 1 0
cc0             waived       3 0.9 has waived all copyright and related or neighboring rights to this work
cc0             cc0          4 1.0 spdx license identifier cc0 1 0
cddl            cddl         2 0.9 cddl(?: (?:version |v ?)?1 [01])?
cddl            distribution 1 0.7 common development and distribution license
cddl            distribution 2 0.9 common development and distribution license (?:cddl )?(?:version |v ?)?1 [01]
cddl            distribution 3 1.0 subject to the terms of the common development and distribution license
cddl            cddl         4 1.0 spdx license identifier cddl 1 [01]
cecill          cecill       1 0.8 cecill(?: [abc])?(?: free software)? license(?: agreement)?
cecill          cecill       2 0.9 cecill (?:[abc]|v ?[12](?: [01])?)
cecill          cecill       4 1.0 spdx license identifier cecill [0-9abc](?: [0-9])?
copyfree        copyfree     1 0.6 copyfree (?:initiative|license)
cpal            attribution  1 0.7 common public attribution license
cpal            cpal         4 1.0 spdx license identifier cpal 1 0
cpl             common       1 0.7 common public license
cpl             common       2 0.9 common public license (?:version |v ?)?(?:0 5|1 0)
cpl             cpl          4 1.0 spdx license identifier cpl 1 0
elastic         elastic      1 0.7 elastic license
elastic         elastic      2 0.9 elastic license (?:version |v ?)?2(?: 0)?
elastic         elastic      4 1.0 spdx license identifier elastic 2 0
elastic         hosted       3 0.9 you may not provide the software to third parties as a hosted or managed service
epl             eclipse      1 0.7 eclipse public license
epl             eclipse      2 0.9 eclipse public license (?:version |v ?)?[12] 0
epl             eclipse      3 1.0 made available under the terms of the eclipse public license
epl             epl          2 0.9 epl (?:version |v ?)?[12] 0
epl             epl          4 1.0 spdx license identifier epl [12] 0
edl             eclipse      1 0.7 eclipse distribution license
eupl            eupl         2 0.9 eupl (?:version |v ?)?1 [012]
eupl            european     1 0.7 european union public licen[cs]e
eupl            european     3 1.0 licensed under the european union public licen[cs]e
eupl            eupl         4 1.0 spdx license identifier eupl 1 [012]
fdl             documentation 1 0.7 gnu free documentation license
fdl             documentation 2 0.9 gnu free documentation license (?:version |v ?)?1 [123](?: or any later version)?
fdl             documentation 3 1.0 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
fdl             gfdl         2 0.9 gfdl(?: (?:version |v ?)?1 [123])?
fdl             invariant    3 0.8 with no invariant sections no front cover texts and no back cover texts
fdl             gfdl         4 1.0 spdx license identifier gfdl 1 [123](?: [a-z]+)*
ftl             freetype     1 0.8 freetype (?:project )?license
ftl             freetype     3 0.9 portions of this software are copyright .{0,60}the freetype project
gpl             general      1 0.7 gnu general public license
gpl             general      2 0.9 gnu general public license (?:version |v ?)?[123](?: 0)?(?: only| or (?:at your option )?(?:any )?later(?: version)?)?
gpl             general      3 1.0 under the terms of the gnu general public license as published by the free software foundation
gpl             general      3 0.9 you should have received a copy of the gnu general public license along with this (?:program|software|library|file)
gpl             general      3 0.8 see the gnu general public license for more details
gpl             gpl          2 0.9 (?:gnu )?gpl (?:version |v ?)?[123](?: 0)?(?: only| or (?:any )?later(?: version)?)?
gpl             gpl          2 0.9 (?:gnu )?gplv[123](?: 0)?(?: only| or (?:any )?later(?: version)?)?
gpl             gpl          2 0.8 (?:gnu )?gpl licen[cs]ed?
gpl             gpl          2 0.7 (?:under|with) the (?:gnu )?gpl
gpl             gpl          2 0.8 gpl compatible
gpl             gpl          4 1.0 spdx license identifier gpl [123] [0-9](?: only| or later)?
gpl             redistribute 3 0.8 this program is free software you can redistribute it and or modify it
gpl             hope         3 0.8 distributed in the hope that it will be useful but without any warranty
gpl             merchantability 3 0.6 without even the implied warranty of merchantability or fitness for a particular purpose
gpl             verbatim     3 0.7 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl             franklin     3 0.8 free software foundation inc 51 franklin (?:street|st) fifth floor boston
gpl             temple       3 0.8 free software foundation inc 59 temple place suite 330 boston
gpl             classpath    3 0.9 linking this library statically or dynamically .{0,80}classpath exception
gpl             gnu          3 0.8 https? www gnu org licenses (?:old licenses )?gpl
hpnd            historical   1 0.7 historical permission notice and disclaimer
hippocratic     hippocratic  1 0.8 hippocratic license(?: [123](?: [0-9])?)?
ibm-pl          ibm          1 0.7 ibm public license
icu             icu          1 0.6 icu license
ijg             jpeg         3 0.8 this software is based in part on the work of the independent jpeg group
intel           intel        2 0.7 intel (?:simplified software|open source) license
ipa             ipa          1 0.6 ipa font license
isc             isc          1 0.7 isc license
isc             isc          2 0.9 isc licen[cs]ed
isc             isc          2 0.8 isc style licen[cs]e
isc             permission   3 1.0 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc             permission   3 0.9 permission to use copy modify and or distribute this software
isc             disclaims    3 0.8 the software is provided as is and the author disclaims all warranties with regard to this software
isc             isc          4 1.0 spdx license identifier isc
json            evil         3 0.9 the software shall be used for good not evil
lgpl            lesser       1 0.7 gnu lesser general public license
lgpl            library      1 0.7 gnu library general public license
lgpl            lesser       2 0.9 gnu lesser general public license (?:version |v ?)?[23](?: [01])?(?: only| or (?:any )?later(?: version)?)?
lgpl            library      2 0.9 gnu library general public license (?:version |v ?)?2(?: 0)?(?: only| or (?:any )?later(?: version)?)?
lgpl            lesser       3 1.0 under the terms of the gnu lesser general public license as published by the free software foundation
lgpl            lesser       3 0.9 you should have received a copy of the gnu lesser general public license along with this (?:program|software|library|file)
lgpl            library      3 0.9 this library is free software you can redistribute it and or modify it
lgpl            lgpl         2 0.9 (?:gnu )?lgpl (?:version |v ?)?[23](?: [01])?(?: only| or (?:any )?later(?: version)?)?
lgpl            lgpl         2 0.9 (?:gnu )?lgplv[23](?: [01])?(?: only| or (?:any )?later(?: version)?)?
lgpl            lgpl         4 1.0 spdx license identifier lgpl [23] [01](?: only| or later)?
libpng          libpng       1 0.7 libpng license(?: version 2)?
libpng          libpng       3 0.9 libpng is distributed according to the same disclaimer and license
llama           llama        2 0.9 llama (?:[234](?: [0-9])? )?community license(?: agreement)?
lppl            latex        1 0.7 latex project public license
lppl            latex        3 1.0 may be distributed and or modified under the conditions of the latex project public license
lppl            lppl         2 0.9 lppl (?:version |v ?)?1 [0123][abc]?
lppl            lppl         4 1.0 spdx license identifier lppl 1 [0-3][a-c]?
mit             license      1 0.7 (?:the )?mit license
mit             license      2 0.9 mit licensed
mit             licence      2 0.9 (?:the )?mit licenced?
mit             license      2 0.8 mit style license
mit             expat        2 0.8 expat (?:style )?licen[cs]e
mit             x11          2 0.8 (?:mit )?x11 licen[cs]e
mit             license      3 0.9 licensed under mit
mit             permission   3 1.0 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit             permission   3 1.0 permission is hereby granted free of charge to any person obtaining a copy
mit             sublicense   3 0.9 without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit             notice       3 0.9 the above copyright notice and this permission notice shall be included in all copies
mit             noninfringement 3 0.8 fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable
mit             opensource   3 0.9 https? (?:www )?opensource org licenses mit(?: license)?(?: php)?
mit             spdx         4 1.0 spdx license identifier mit
mit-0           attribution  2 0.9 mit no attribution
mit-0           spdx         4 1.0 spdx license identifier mit 0
mpl             mozilla      1 0.7 mozilla public license
mpl             mozilla      2 0.9 mozilla public license (?:version |v ?)?[12] [01]
mpl             mozilla      3 1.0 this source code form is subject to the terms of the mozilla public license
mpl             mozilla      3 0.9 if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org
mpl             mpl          2 0.9 mpl (?:version |v ?)?[12] [01]
mpl             mpl          4 1.0 spdx license identifier mpl [12] [01]
mpl             initial      3 0.8 the initial developer of the original code is
ms-pl           microsoft    1 0.7 microsoft public license
ms-pl           microsoft    2 0.9 microsoft public license ms pl
ms-pl           spdx         4 1.0 spdx license identifier ms pl
ms-rl           microsoft    1 0.7 microsoft reciprocal license
ms-rl           spdx         4 1.0 spdx license identifier ms rl
mulan           mulan        1 0.8 mulan (?:psl|permissive software license)(?: v?[12])?
nasa            nasa         1 0.8 nasa open source agreement
ncsa            ncsa         1 0.8 (?:university of illinois )?ncsa open source license
ncsa            ncsa         4 1.0 spdx license identifier ncsa
netscape        netscape     1 0.7 netscape public license
nvidia          nvidia       2 0.8 nvidia (?:source code|software|proprietary) license
odbl            database     1 0.7 open database license
odbl            odbl         2 0.9 odbl(?: (?:version |v ?)?1 0)?
odbl            opendatacommons 3 0.9 https? (?:www )?opendatacommons org licenses odbl
odbl            odbl         4 1.0 spdx license identifier odbl 1 0
odc-by          odc          2 0.9 odc by(?: (?:version |v ?)?1 0)?
odc-by          commons      2 0.9 open data commons attribution license
pddl            commons      2 0.9 open data commons public domain dedication and license
pddl            pddl         2 0.9 pddl (?:version |v ?)?1 0
ofl             font         1 0.7 (?:sil )?open font license
ofl             ofl          2 0.9 (?:sil )?ofl (?:version |v ?)?1 [01]
ofl             font         2 0.9 sil open font license (?:version |v ?)?1 [01]
ofl             font         3 1.0 this font software is licensed under the sil open font license
ofl             reserved     3 0.8 with reserved font names?
ofl             ofl          4 1.0 spdx license identifier ofl 1 [01](?: rfn| no rfn)?
ogl             government   1 0.8 open government licen[cs]e(?: v?[123](?: 0)?)?
openldap        openldap     1 0.7 openldap public license
openssl         openssl      1 0.7 openssl license
openssl         openssl      3 0.9 this product includes software developed by the openssl project for use in the openssl toolkit
osl             open         1 0.7 open software license
osl             open         2 0.9 open software license (?:version |v ?)?[123] [01]
osl             osl          4 1.0 spdx license identifier osl [123] [01]
parity          parity       2 0.8 parity public license(?: [67] 0 0)?
php             php          1 0.7 php license
php             php          2 0.9 php license (?:version |v ?)?[23] [0-9]+
php             php          3 0.9 this source file is subject to version [23] [0-9]+ of the php license
php             php          4 1.0 spdx license identifier php 3 0[01]?
polyform        polyform     1 0.9 polyform (?:noncommercial|small business|strict|shield|perimeter|internal use) license(?: 1 0 0)?
postgresql      postgresql   1 0.7 postgresql license
postgresql      postgresql   4 1.0 spdx license identifier postgresql
proprietary     reserved     1 0.4 all rights reserved
proprietary     confidential 2 0.7 (?:proprietary and confidential|confidential and proprietary)
proprietary     unauthorized 3 0.8 unauthorized copying of this file via any medium is strictly prohibited
proprietary     unauthorized 3 0.8 unauthorized (?:use|copying|reproduction|distribution) .{0,40}(?:is )?(?:strictly )?prohibited
proprietary     commercial   2 0.6 commercial license (?:agreement|required)
proprietary     agreement    2 0.6 end user license agreement
psf             python       1 0.7 python software foundation license
psf             python       2 0.9 psf license agreement for python [0-9](?: [0-9]+)*
psf             psf          2 0.8 psf licen[cs]ed?
psf             spdx         4 1.0 spdx license identifier (?:psf|python) 2 0
public-domain   domain       1 0.5 public domain
public-domain   domain       3 0.9 (?:released|dedicated|placed) (?:in)?to the public domain
public-domain   domain       3 0.9 (?:is|are) (?:hereby )?(?:released |placed )?in the public domain
public-domain   disclaims    3 0.8 the author disclaims copyright to this source code
public-domain   domain       3 0.8 no copyright is claimed .{0,40}public domain
public-domain   government   3 0.8 work of the (?:united states|u s|us) government .{0,60}not subject to copyright
qpl             qpl          2 0.8 (?:the )?qpl (?:version |v ?)?1 0
qpl             public       1 0.7 q public license
qpl             spdx         4 1.0 spdx license identifier qpl 1 0
rail            rail         2 0.9 (?:creativeml )?(?:open|big science|bigscience) ?rail(?:[ +]?[ms])?(?: license)?
realnetworks    realnetworks 1 0.7 realnetworks public source license
ruby            ruby         1 0.7 ruby license
ruby            ruby         3 0.8 (?:redistribute|distributed) .{0,40}under the (?:same )?terms (?:of|as) ruby
sgi             sgi          1 0.7 sgi free software license b
sissl           sissl        2 0.8 sissl
sissl           standards    1 0.8 sun industry standards source license
sleepycat       sleepycat    1 0.8 sleepycat license
spl             sun          1 0.7 sun public license
sspl            sspl         2 0.9 sspl(?: (?:version |v ?)?1(?: 0)?)?
sspl            server       1 0.8 server side public license
sspl            sspl         4 1.0 spdx license identifier sspl 1 0
unicode         unicode      1 0.7 unicode (?:inc )?license agreement data files and software
unlicense       unlicense    1 0.7 (?:the )?unlicense
unlicense       unencumbered 3 1.0 (?:this is )?free and unencumbered software released into the public domain
unlicense       anyone       3 0.9 anyone is free to copy modify publish use compile sell or distribute this software
unlicense       unlicense    4 1.0 spdx license identifier unlicense
upl             universal    1 0.7 universal permissive license
upl             universal    2 0.9 universal permissive license (?:upl )?(?:version |v ?)?1 0
upl             upl          4 1.0 spdx license identifier upl 1 0
vim             vim          1 0.6 vim license
vim             uganda       3 0.8 make a donation for needy children in uganda
w3c             w3c          1 0.7 w3c software(?: notice and)? license
w3c             w3c          2 0.8 w3c (?:document|test suite) license
w3c             w3c          4 1.0 spdx license identifier w3c
wtfpl           wtfpl        1 0.8 wtfpl
wtfpl           fuck         3 1.0 do what the fuck you want to public license
wtfpl           wtfpl        4 1.0 spdx license identifier wtfpl
wxwindows       wxwindows    1 0.8 wxwindows library licen[cs]e
x11             consortium   3 0.9 except as contained in this notice the name of the x consortium shall not be used
zlib            zlib         1 0.7 zlib license
zlib            zlib         2 0.8 zlib libpng license
zlib            altered      3 1.0 altered source versions must be plainly marked as such
zlib            misrepresented 3 0.9 the origin of this software must not be misrepresented
zlib            zlib         3 0.8 this software is provided as is without any express or implied warranty .{0,200}zlib
zlib            zlib         4 1.0 spdx license identifier zlib
zpl             zope         1 0.7 zope public license
zpl             zope         2 0.9 zope public license (?:zpl )?(?:version |v ?)?[12] [01]
zpl             zpl          4 1.0 spdx license identifier zpl [12] [01]
"""

ROWS = [tuple(line.split(None, 4)) for line in TABLE.strip().splitlines()]
