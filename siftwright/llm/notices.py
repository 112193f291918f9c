"""Short notices by which licences are told, with SPDX-like labels: names as texts cite them, and opening words of the licences.

Normalised like the texts that are searched: lower-case words and digits with one blank between them.
"""

_TABLE = """
gpl: licensed under the gnu general public license
gpl-1.0: gnu general public license version 1
gpl-2.0: gnu general public license version 2
gpl-3.0: gnu general public license version 3
gpl-3.0: this program is free software you can redistribute it and or modify
lgpl: gnu lesser general public license
lgpl-2.0: gnu library general public license
lgpl-2.1: gnu lesser general public license version 2 1
lgpl-3.0: gnu lesser general public license version 3
agpl-3.0: gnu affero general public license
gfdl: gnu free documentation license
apache: licensed under the apache license
apache-2.0: apache license version 2 0
apache-1.1: apache software license version 1 1
mit: released under the mit license
mit: permission is hereby granted free of charge
mit-0: mit no attribution license
x11: x11 license distribution
bsd: redistribution and use in source and binary forms
bsd-2-clause: bsd 2 clause simplified license
bsd-3-clause: bsd 3 clause new or revised license
bsd-4-clause: bsd 4 clause original license
0bsd: bsd zero clause license
bsd-1-clause: bsd 1 clause license
isc: permission to use copy modify and or distribute this software for any purpose
isc: internet systems consortium license
mpl: mozilla public license
mpl-1.1: mozilla public license version 1 1
mpl-2.0: mozilla public license version 2 0
epl-1.0: eclipse public license version 1 0
epl-2.0: eclipse public license version 2 0
epl: eclipse public license
cddl: common development and distribution license
cpl-1.0: common public license version 1 0
ipl-1.0: ibm public license version 1 0
cc-by: licensed under cc by
cc-by: creative commons attribution
cc-by-4.0: creative commons attribution 4 0 international
cc-by-3.0: creative commons attribution 3 0 unported
cc-by-sa: creative commons attribution sharealike
cc-by-nc: creative commons attribution noncommercial
cc-by-nd: creative commons attribution noderivatives
cc-by-nc-sa: creative commons attribution noncommercial sharealike
cc-by-nc-nd: creative commons attribution noncommercial noderivatives
cc0: creative commons zero universal
cc0: cc0 1 0 universal public domain dedication
public-domain: dedicated to the public domain
unlicense: this is free and unencumbered software released into the public domain
wtfpl: do what the fuck you want to public license
zlib: this software is provided as is without any express or implied warranty
zlib: zlib libpng license
libpng: png reference library license
bsl-1.0: boost software license version 1 0
boost: permission is hereby granted free of charge to any person or organization obtaining a copy
artistic-1.0: artistic license 1 0
artistic-2.0: artistic license 2 0
perl: same terms as perl itself
python-2.0: python software foundation license
psf: psf license agreement for python
ruby: ruby license conditions
php-3.01: php license version 3 01
postgresql: postgresql license agreement
openssl: openssl toolkit license
ssleay: original ssleay license
curl: curl license permission notice
ncsa: university of illinois ncsa open source license
afl-3.0: academic free license version 3 0
afl: academic free license
osl-3.0: open software license version 3 0
osl: licensed under the open software license
ecl-2.0: educational community license version 2 0
eupl-1.1: european union public licence v 1 1
eupl-1.2: european union public licence v 1 2
eupl: european union public licence
ofl-1.1: sil open font license version 1 1
ofl: this font software is licensed under the sil open font license
odbl-1.0: open data commons open database license
odc-by-1.0: open data commons attribution license
pddl-1.0: open data commons public domain dedication and license
ogl-uk: contains public sector information licensed under the open government licence
lppl: latex project public license
ms-pl: microsoft public license
ms-rl: microsoft reciprocal license
apsl-2.0: apple public source license
nasa: nasa open source agreement
qpl-1.0: q public license version
sleepycat: sleepycat license agreement
upl-1.0: universal permissive license
w3c: w3c software notice and license
zpl-2.1: zope public license
mulan: mulan permissive software license
cecill: cecill free software license agreement
cecill-b: cecill b free software license agreement
cern-ohl: cern open hardware licence
hpnd: historical permission notice and disclaimer
intel: intel open source license
json: the software shall be used for good not evil
bzip2: bzip2 and libbzip2 license
beerware: beer ware license revision 42
vim: vim license credit and conditions
unicode: unicode data files and software license
icu: icu license and copyright
ntp: ntp license permission notice
tcl: tcl tk license terms
xnet: x net license terms
naumen: naumen public license
nokia: nokia open source license
realnetworks: realnetworks public source license
sun-public: sun public license version
sybase: sybase open watcom public license
vovida: vovida software license
watcom: open watcom public license
ecos: ecos license version 2 0
frameworx: frameworx open license
ftl: freetype project license
ijg: independent jpeg group license
imagemagick: imagemagick license terms
libtiff: libtiff license permission
linux-openib: linux kernel variant of openib org license
catosl: computer associates trusted open source license
cpal: common public attribution license
cua-opl: cua office public license
entessa: entessa public license
eudatagrid: eu datagrid software license
fair: fair license usage of the works is permitted
lucent: lucent public license
miros: miros licence provided
motosoto: motosoto open source license
multics: multics license permission
ncgl: nethack general public license
oclc: oclc research public license
rpl: reciprocal public license
rscpl: ricoh source code public license
sspl-1.0: server side public license
busl-1.1: business source license 1 1
elastic-2.0: elastic license 2 0
commons-clause: commons clause license condition
polyform: polyform noncommercial license
llama: llama community license agreement
openrail: open responsible ai license
all-rights-reserved: all rights reserved
"""

NOTICES = {notice: label for label, notice in (line.split(": ", 1) for line in _TABLE.strip().splitlines())}
