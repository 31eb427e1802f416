"""Signature rules of licence texts, for ``license_scan``.

A rule is ``label | keywords | pattern``. Patterns are regular expressions over
a text's normal form: words of letters and digits, lower case, one space
between two; ``4.0`` is ``4 0`` and ``CC-BY`` is ``cc by``. A rule is tried only
on texts that have all its keywords, rarest first. Rules stand in classes; a
class that comes first is more certain, and within one the order of the list
decides. ``{v1}`` and the like stand for a version as it is usually written.
"""

from __future__ import annotations

#: Certainty of each class of rules, most certain first.
CLASSES = {"text": 1.0, "tag": 0.95, "notice": 0.9, "name": 0.7, "hint": 0.4}

#: Sentences of the licences themselves, or of their standard headers.
TEXT = r"""
mit | granted hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | sublicense copies | the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | hereby sell | the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | consortium advertising | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | fee granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | fee granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
hpnd | fee granted | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
bsd | redistributions source | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse promote | neither the names? of .{1,80}? nor the names of (?:its|their|the|any) contributors may be used to endorse or promote products
bsd-4-clause | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause-views | freebsd views | the views and conclusions contained in the software and documentation are those of the authors
bsd-3-clause-clear | patent express | no express or implied licenses to any party s patent rights are granted by this license
apache-2.0 | apache compliance | licensed under the apache license {v2} the license you may not use this file except in compliance with the license
apache-2.0 | perpetual worldwide | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-1.1 | apache acknowledgment | this product includes software developed by the apache software foundation
gpl-3.0-or-later | gnu redistribute | (?:it )?under the terms of the gnu general public license as published by the free software foundation either {v3} of the license or at your option any later version
gpl-2.0-or-later | gnu redistribute | (?:it )?under the terms of the gnu general public license as published by the free software foundation either {v2} of the license or at your option any later version
gpl-2.0-only | gnu redistribute | (?:it )?under the terms of the gnu general public license {v2} as published by the free software foundation
gpl-3.0-only | gnu redistribute | (?:it )?under the terms of the gnu general public license {v3} as published by the free software foundation
lgpl-2.1-or-later | lesser redistribute | (?:it )?under the terms of the gnu lesser general public license as published by the free software foundation either {v2_1} of the license or at your option any later version
lgpl-3.0-or-later | lesser redistribute | (?:it )?under the terms of the gnu lesser general public license as published by the free software foundation either {v3} of the license or at your option any later version
lgpl-2.0-or-later | library redistribute | (?:it )?under the terms of the gnu library general public license as published by the free software foundation either {v2} of the license or at your option any later version
agpl-3.0-or-later | affero redistribute | (?:it )?under the terms of the gnu affero general public license as published by the free software foundation either {v3} of the license or at your option any later version
gpl | warranty merchantability gnu | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |library |affero )?general public license
gpl-2.0 | 1991 foundation | gnu general public license version 2 june 1991
gpl-3.0 | 2007 foundation | gnu general public license version 3 29 june 2007
lgpl-2.1 | 1999 lesser | gnu lesser general public license version 2 1 february 1999
gfdl | invariant permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | mozilla obtain | this source code form is subject to the terms of the mozilla public license {v2}
mpl-1.1 | mozilla contents | the contents of this file are subject to the mozilla public license {v1_1}
mpl-1.0 | mozilla contents | the contents of this file are subject to the mozilla public license {v1}
npl-1.1 | netscape contents | the contents of this file are subject to the netscape public license {v1_1}
epl-2.0 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license {v2}
epl-1.0 | eclipse accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license {v1}
edl-1.0 | eclipse distribution | made available under the terms of the eclipse distribution license {v1}
cddl-1.0 | cddl contents | the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0 | accompanying common | the accompanying program is provided under the terms of this common public license
eupl-1.2 | eupl licensed | licensed under the eupl {v1_2}
eupl-1.1 | eupl licensed | licensed under the eupl {v1_1}
zlib | arising liable | in no event will the authors be held liable for any damages arising from the use of this software
zlib | misrepresented origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
bsl-1.0 | organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
wtfpl | everyone verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
cc0-1.0 | dedicated waiving | has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law
artistic-2.0 | artistic larry | copyright c 2000 2006 the perl foundation
artistic-1.0 | artistic reasonable | the intent of this document is to state the conditions under which a package may be copied
psf-2.0 | python psf | psf hereby grants licensee a nonexclusive royalty free world wide license
ofl-1.1 | sil font | this font software is licensed under the sil open font license {v1_1}
ofl-1.1 | font reserved | no modified version of the font software may use the reserved font names?
ms-pl | microsoft reciprocal | microsoft (?:permissive|public) license ms pl this license governs use of the accompanying software
ms-rl | microsoft reciprocal | microsoft reciprocal license ms rl this license governs use of the accompanying software
curl | fee documentation | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
ncsa | illinois university | university of illinois ncsa open source license
postgresql | fee agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
unicode | unicode files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
openssl | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ijg | jpeg independent | this software is based in part on the work of the independent jpeg group
bsl-1.1 | business change | the business source license this document or the license is not an open source license
sspl-1.0 | mongodb server | server side public license version 1 october 16 2018
elastic-2.0 | elastic hosted | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons sell | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
beerware | beer retain | as long as you retain this notice you can do whatever you want with this stuff
json | evil good | the software shall be used for good not evil
ogl-uk-3.0 | government information | contains public sector information licensed under the open government licence {v3}
odbl-1.0 | database open | this .{1,60}? is made available under the open database license
as-is | warranties merchantability | the software is provided as is without warranty of any kind express or implied
"""

#: Notices: a work put under a named licence.
NOTICE = r"""
apache-2.0 | apache | {under} apache (?:software )?(?:license|licence)(?: {v2})?
apache-1.1 | apache | {under} apache (?:software )?(?:license|licence) {v1_1}
mit | mit license | {under} mit license
mit | mit licence | {under} mit licence
isc | isc | {under} isc (?:license|licence)
bsd-3-clause | bsd | {under} (?:3 clause|three clause|new|modified|revised) bsd (?:license|licence)
bsd-3-clause | bsd | {under} bsd 3 clause(?: (?:license|licence))?
bsd-2-clause | bsd | {under} (?:2 clause|two clause|simplified|freebsd) bsd (?:license|licence)
bsd-2-clause | bsd | {under} bsd 2 clause(?: (?:license|licence))?
bsd | bsd | {under} bsd(?: style)? (?:license|licence)
gpl-3.0 | general public | {under} (?:gnu )?general public (?:license|licence) (?:gpl )?{v3}
gpl-2.0 | general public | {under} (?:gnu )?general public (?:license|licence) (?:gpl )?{v2}
gpl | general public | {under} (?:gnu )?general public (?:license|licence)
gpl-3.0 | gpl | {under} (?:gnu )?gpl {v3}
gpl-3.0 | gplv3 | {under} (?:gnu )?gplv3
gpl-2.0 | gpl | {under} (?:gnu )?gpl {v2}
gpl-2.0 | gplv2 | {under} (?:gnu )?gplv2
gpl | gpl | {under} (?:gnu )?gpl
lgpl-3.0 | lgpl | {under} (?:gnu )?lgpl {v3}
lgpl-2.1 | lgpl | {under} (?:gnu )?lgpl {v2_1}
lgpl | lgpl | {under} (?:gnu )?lgpl
lgpl | lesser | {under} (?:gnu )?lesser general public (?:license|licence)
agpl-3.0 | affero | {under} (?:gnu )?affero general public (?:license|licence)(?: {v3})?
agpl-3.0 | agpl | {under} (?:gnu )?agpl(?: {v3})?
mpl-2.0 | mozilla | {under} mozilla public (?:license|licence) {v2}
mpl | mozilla | {under} mozilla public (?:license|licence)
epl-2.0 | eclipse | {under} eclipse public (?:license|licence) {v2}
epl-1.0 | eclipse | {under} eclipse public (?:license|licence) {v1}
artistic-2.0 | artistic | {under} artistic (?:license|licence) {v2}
artistic | artistic | {under} artistic (?:license|licence)
perl | perl | {under} same terms as perl(?: itself)?
python | python | {under} python(?: software foundation)? (?:license|licence)
zlib | zlib | {under} zlib(?: libpng)? (?:license|licence)
bsl-1.0 | boost | {under} boost software (?:license|licence)(?: {v1})?
unlicense | unlicense | {under} unlicense
wtfpl | wtfpl | {under} wtfpl
cc0-1.0 | cc0 | {under} (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc | creative commons | {under} (?:a )?creative commons (?:license|licence)
cc | commons license | this work is licensed under (?:a )?creative commons
eupl | eupl | {under} eupl
cecill-2.1 | cecill | {under} cecill(?: (?:license|licence))? {v2_1}
cecill | cecill | {under} cecill
gfdl | documentation | {under} (?:gnu )?free documentation (?:license|licence)
ofl-1.1 | sil | {under} sil open font (?:license|licence)(?: {v1_1})?
odbl-1.0 | odbl | {under} odbl
odbl-1.0 | database | {under} open database (?:license|licence)
odc-by-1.0 | attribution data | {under} open data commons attribution (?:license|licence)
pddl-1.0 | pddl | {under} (?:odc )?pddl
ogl | government | {under} open government (?:license|licence)(?: {v3})?
ms-pl | microsoft public | {under} microsoft public (?:license|licence)
bsl-1.1 | business | {under} business source (?:license|licence)
sspl-1.0 | server side | {under} server side public (?:license|licence)
elastic-2.0 | elastic | {under} elastic (?:license|licence)(?: {v2})?
polyform | polyform | {under} polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use)(?: (?:license|licence))?(?: {v1})?
public-domain | public domain | (?:is|are|was|been|hereby) (?:placed |released |dedicated |put )?(?:in|into|to) the public domain
public-domain | public domain | released into the public domain
proprietary | proprietary confidential | (?:this (?:software|document|file|work) is )?(?:the )?proprietary and confidential
proprietary | prohibited reproduction | unauthorized (?:copying|reproduction|distribution|use) .{1,80}? (?:is )?(?:strictly )?prohibited
proprietary | reproduced permission | may not be reproduced .{1,80}? without (?:the )?(?:prior )?(?:written )?(?:permission|consent)
"""

#: Names and addresses of licences without a notice.
NAME = r"""
apache-2.0 | apache | apache (?:software )?(?:license|licence)(?: {v2})?
apache-2.0 | apache | www apache org licenses license 2 0
mit | mit license | (?:the )?mit license
mit | mit opensource | opensource org licenses mit(?: license)?
expat | expat | expat (?:license|licence)
isc | isc | isc (?:license|licence)
bsd-4-clause | bsd original | original bsd (?:license|licence)
bsd | bsd | bsd(?: style)? (?:license|licence)
bsd-3-clause | bsd opensource | opensource org licenses bsd 3 clause
gpl | general public | (?:gnu )?general public (?:license|licence)
gpl | gnu licenses | (?:www )?gnu org licenses(?: gpl(?: html)?)?
lgpl | lesser | (?:gnu )?lesser general public (?:license|licence)
lgpl | library general | (?:gnu )?library general public (?:license|licence)
agpl | affero | (?:gnu )?affero general public (?:license|licence)
gfdl | documentation | (?:gnu )?free documentation (?:license|licence)
mpl | mozilla | mozilla public (?:license|licence)
mpl-2.0 | mozilla org | (?:www )?mozilla org mpl 2 0
npl | netscape | netscape public (?:license|licence)
epl | eclipse | eclipse public (?:license|licence)
edl | eclipse | eclipse distribution (?:license|licence)
cddl | cddl | cddl(?: {v1})?
cddl | development distribution | common development and distribution (?:license|licence)
cpl-1.0 | common | common public (?:license|licence)(?: {v1})?
ipl-1.0 | ibm | ibm public (?:license|licence)
eupl | eupl | eupl(?: {v1_2})?
eupl | european | european union public (?:license|licence)
cecill | cecill | cecill(?: [abc])?
artistic | artistic | (?:perl )?artistic (?:license|licence)
psf-2.0 | python psf | psf (?:license|licence)(?: agreement)?
python | python | python software foundation (?:license|licence)
ruby | ruby | ruby s? ?(?:license|licence)
php-3.01 | php | php (?:license|licence)(?: {v3})?
zend-2.0 | zend | zend (?:engine )?(?:license|licence)
w3c | w3c | w3c software (?:notice and )?(?:license|licence)
zlib | zlib | zlib(?: libpng)? (?:license|licence)
libpng | libpng | libpng (?:license|licence)
bsl-1.0 | boost | boost software (?:license|licence)
unlicense | unlicense | (?:www )?unlicense org
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
wtfpl | fuck public | do what the fuck you want to public license
beerware | beerware | beerware(?: (?:license|licence))?
upl-1.0 | universal permissive | universal permissive (?:license|licence)
ncsa | ncsa | ncsa open source (?:license|licence)
afl | academic | academic free (?:license|licence)(?: {v3})?
osl | open software | open software (?:license|licence)(?: {v3})?
ecl-2.0 | educational | educational community (?:license|licence)(?: {v2})?
ofl-1.1 | open font | open font (?:license|licence)
ms-pl | microsoft | microsoft public (?:license|licence)
ms-rl | microsoft | microsoft reciprocal (?:license|licence)
cc0-1.0 | creativecommons zero | creativecommons org publicdomain zero 1 0
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-pdm | creativecommons mark | creativecommons org publicdomain mark 1 0
odbl-1.0 | odbl | odbl(?: {v1})?
odbl-1.0 | opendatacommons | opendatacommons org licenses odbl
odc-by-1.0 | opendatacommons | opendatacommons org licenses by
pddl-1.0 | opendatacommons | opendatacommons org licenses pddl
ogl | government | open government (?:license|licence)
etalab-2.0 | etalab | (?:etalab )?(?:licence ouverte|open licence)(?: etalab)?(?: {v2})?
dl-de-by-2.0 | namensnennung datenlizenz | datenlizenz deutschland namensnennung(?: {v2})?
dl-de-zero-2.0 | datenlizenz | datenlizenz deutschland zero(?: {v2})?
bsl-1.1 | business | business source (?:license|licence)
sspl-1.0 | sspl | sspl(?: {v1})?
elastic-2.0 | elastic | elastic (?:license|licence)
commons-clause | commons clause | commons clause(?: license condition)?
openrail | openrail | (?:creativeml )?(?:bigscience )?openrail(?: [mds])?
llama-community | llama | llama [2345]? ?[123]? ?community (?:license|licence)
gutenberg | gutenberg | project gutenberg (?:license|licence)
"""

#: Words that speak of rights without a licence's name.
HINT = r"""
reserved | rights reserved | all rights reserved
reserved | droits | tous droits r.{1,4}serv.{1,4}s
reserved | rechte vorbehalten | alle rechte vorbehalten
reserved | derechos reservados | todos los derechos reservados
copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9]
license-reference | license file | see (?:the )?(?:accompanying )?license file
license-reference | licensed | (?:is )?licensed under the terms of
license-reference | license terms | subject to (?:the )?license terms
cc | creative commons | creative commons
cc-by | cc by | cc by
cc | share alike | share alike
non-commercial | commercial | (?:for )?non commercial (?:use|purposes)(?: only)?
non-commercial | noncommercial | noncommercial (?:use|purposes)
no-derivatives | derivatives | no derivatives
copyleft | copyleft | copyleft
trademark | trademarks | registered trademarks? of
patent-grant | patent | patent (?:license|licence)
royalty-free | royalty | royalty free
public-domain | public domain | public domain
eula | eula | end user license agreement|eula
warranty-disclaimer | warranty | without (?:any )?warrant(?:y|ies)(?: of any kind)?
"""

#: Identifiers of software licences in tags, and those of the GNU family.
TAGGED = ("0bsd", "afl-3.0", "apache-1.1", "apache-2.0", "artistic-2.0", "bsd-2-clause", "bsd-3-clause",
          "bsd-4-clause", "bsl-1.0", "cc0-1.0", "cddl-1.0", "cecill-2.1", "ecl-2.0", "epl-1.0", "epl-2.0", "eupl-1.2",
          "isc", "mit", "mit-0", "mpl-1.1", "mpl-2.0", "ms-pl", "ms-rl", "ncsa", "odbl-1.0", "ofl-1.1", "openssl",
          "osl-3.0", "php-3.01", "postgresql", "psf-2.0", "python-2.0", "ruby", "unlicense", "upl-1.0", "vim", "w3c",
          "wtfpl", "x11", "zlib")
GNU = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0"), "gfdl": ("1.1", "1.2", "1.3")}
#: Creative Commons: kinds with their words, and versions.
CC_KINDS = {"by": "attribution", "by-sa": "attribution (?:share alike|sharealike)",
            "by-nc": "attribution (?:non commercial|noncommercial)",
            "by-nd": "attribution (?:no derivatives|noderivatives|noderivs)",
            "by-nc-sa": "attribution (?:non commercial|noncommercial) (?:share alike|sharealike)",
            "by-nc-nd": "attribution (?:non commercial|noncommercial) (?:no derivatives|noderivatives|noderivs)"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

UNDER = (r"(?:licen[cs]ed|released|distributed|available|published|provided|shared|covered|offered)"
         r"(?: to you)? (?:under|by|through|according to)(?: the)?(?: terms of)?(?: the)?")


def version(v: str) -> str:
    """A version as texts write it, in normal form."""
    major, _, minor = v.partition(".")
    tail = f" {minor}" if minor not in ("", "0") else "(?: 0)?"
    return rf"(?:version |ver |v ?)?{major}{tail}"


def spelled(identifier: str) -> str:
    return identifier.replace("-", " ").replace(".", " ")


def _listed(kind: str, lines: str):
    marks = {f"v{m}": version(m.replace("_", ".")) for m in ("1", "1_1", "1_2", "2", "2_1", "3")} | {"under": UNDER}
    for line in lines.strip().splitlines():
        label, keywords, pattern = line.split(" | ", 2)
        for mark, stands in marks.items():
            pattern = pattern.replace(f"{{{mark}}}", stands)
        yield kind, label, tuple(keywords.split()), pattern


def _families():
    """Rules that follow from identifiers, kinds and versions."""
    for x in TAGGED:
        yield "tag", x, ("spdx",), rf"spdx license identifier {spelled(x)}"
    for name, versions in GNU.items():
        for v in versions:
            for ending in ("only", "or-later"):
                yield "tag", f"{name}-{v}-{ending}", ("spdx",), rf"spdx license identifier {name} {spelled(v)} {spelled(ending)}"
            yield "tag", f"{name}-{v}", ("spdx",), rf"spdx license identifier {name} {spelled(v)}"
            yield "name", f"{name}-{v}-or-later", (name,), rf"{name} {version(v)} (?:or later|or any later version|or newer)"
            yield "name", f"{name}-{v}", (name,), rf"{name} {version(v)}"
            yield "name", f"{name}-{v}", (f"{name}v{v[0]}",), rf"{name}v{version(v)}"
    for kind, words in CC_KINDS.items():
        short = kind.replace("-", " ")
        for v in CC_VERSIONS:
            yield "tag", f"cc-{kind}-{v}", ("spdx",), rf"spdx license identifier cc {short} {spelled(v)}"
            yield "notice", f"cc-{kind}-{v}", ("cc",), rf"{UNDER} cc {short} {version(v)}"
            yield ("notice", f"cc-{kind}-{v}", ("commons",),
                   rf"{UNDER}(?: a)? creative commons {words}(?: {version(v)}| .{{1,30}}? {version(v)})")
            yield "name", f"cc-{kind}-{v}", ("creativecommons",), rf"creativecommons org licenses {short} {spelled(v)}"
            yield "name", f"cc-{kind}-{v}", ("cc",), rf"cc {short} {version(v)}"
            yield "name", f"cc-{kind}-{v}", ("commons",), rf"creative commons {words} {version(v)}"
        yield "notice", f"cc-{kind}", ("cc",), rf"{UNDER} cc {short}"
        yield "name", f"cc-{kind}", ("cc",), rf"cc {short}"
        yield "name", f"cc-{kind}", ("commons",), rf"creative commons {words}"


def rules() -> list[tuple[str, str, tuple[str, ...], str]]:
    """(class, label, keywords, pattern), in order of priority."""
    found = [*_listed("text", TEXT), *_listed("notice", NOTICE), *_listed("name", NAME), *_listed("hint", HINT), *_families()]
    order = list(CLASSES)
    return sorted(found, key=lambda r: order.index(r[0]))
