"""The signature rules of the license scan.

A text is matched as its words, lower-cased, each between two spaces of its own, so
`` mit  license `` is the phrase "mit license" and neighbouring matches share no
character. Rules stand in order: base rules, then identifiers and addresses, then
grants ("licensed under ..."), then bare names, then general wording.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    pattern: str
    #: Words that a text must hold before the pattern is tried.
    keyword: str
    #: 4: base, never suppressed; else the larger wins over what it contains.
    priority: int
    confidence: float


# The phrases that count as base places, with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# label, identifier words, names
_PLAIN = """
mit|mit|mit license;mit licence;expat license
mit-0|mit 0|mit no attribution license;mit no attribution
isc|isc|isc license;isc licence
x11|x11|x11 license
zlib|zlib|zlib license;zlib libpng license
libpng-2.0|libpng 2 0|png reference library license
bsl-1.0|bsl 1 0|boost software license;boost license
unlicense|unlicense|unlicense;the unlicense
wtfpl|wtfpl|do what the fuck you want to public license;wtfpl
0bsd|0bsd|zero clause bsd license;bsd zero clause license;0 clause bsd license
bsd-2-clause|bsd 2 clause|bsd 2 clause license;simplified bsd license;freebsd license;two clause bsd license
bsd-3-clause|bsd 3 clause|bsd 3 clause license;new bsd license;modified bsd license;revised bsd license;three clause bsd license
bsd-4-clause|bsd 4 clause|bsd 4 clause license;original bsd license;four clause bsd license
bsd|bsd|bsd license;bsd style license
postgresql|postgresql|postgresql license
python-2.0|python 2 0|python software foundation license;python license
psf-2.0|psf 2 0|psf license
php-3.01|php 3 01|php license
ruby|ruby|ruby license
perl|artistic perl|perl license;same terms as perl itself
ncsa|ncsa|university of illinois ncsa open source license
openssl|openssl|openssl license
curl|curl|curl license
vim|vim|vim license
icu|icu|icu license
unicode|unicode dfs 2016|unicode license;unicode data files and software license
ofl-1.1|ofl 1 1|sil open font license;open font license
beerware|beerware|beerware license;beer ware license
json|json|json license
ms-pl|ms pl|microsoft public license
ms-rl|ms rl|microsoft reciprocal license
cpl-1.0|cpl 1 0|common public license
ipl-1.0|ipl 1 0|ibm public license
sissl|sissl|sun industry standards source license
upl-1.0|upl 1 0|universal permissive license
blueoak-1.0.0|blueoak 1 0 0|blue oak model license
elastic-2.0|elastic 2 0|elastic license
sspl-1.0|sspl 1 0|server side public license
busl-1.1|busl 1 1|business source license
commons-clause|commons clause|commons clause
cecill|cecill|cecill free software license agreement;cecill license
hpnd|hpnd|historical permission notice and disclaimer
w3c|w3c|w3c software notice and license;w3c license
ncsa-httpd|ncsa httpd|ncsa httpd license
sleepycat|sleepycat|sleepycat license
zpl|zpl 2 1|zope public license
cc0-1.0|cc0 1 0|cc0;creative commons zero
pddl-1.0|pddl 1 0|public domain dedication and license
odbl-1.0|odbl 1 0|open database license
odc-by-1.0|odc by 1 0|open data commons attribution license
"""

# label, identifier words, names, versions
_VERSIONED = """
apache|apache|apache license;apache software license|1 0,1 1,2 0
gpl|gpl|gnu general public license;general public license;gnu gpl;gpl|1,2,3
lgpl|lgpl|gnu lesser general public license;gnu library general public license;lesser general public license;gnu lgpl;lgpl|2,2 1,3
agpl|agpl|gnu affero general public license;affero general public license;gnu agpl;agpl|1,3
gfdl|gfdl|gnu free documentation license;gfdl|1 1,1 2,1 3
mpl|mpl|mozilla public license;mpl|1 0,1 1,2 0
epl|epl|eclipse public license;epl|1 0,2 0
eupl|eupl|european union public licence;european union public license;eupl|1 0,1 1,1 2
cddl|cddl|common development and distribution license;cddl|1 0,1 1
artistic|artistic|artistic license|1 0,2 0
afl|afl|academic free license|1 1,2 0,2 1,3 0
osl|osl|open software license|1 0,2 0,2 1,3 0
ecl|ecl|educational community license|1 0,2 0
lppl|lppl|latex project public license|1 0,1 2,1 3
qpl|qpl|q public license|1 0
"""

_COMMONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_SPELLED = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
_COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# label, words, keyword, confidence; "a/b" is either word, "[a]" an optional one,
# "#" a year
_WORDING = """
proprietary|all rights reserved|reserved|0.6
proprietary|proprietary and confidential|proprietary|0.8
proprietary|may not be copied/reproduced/distributed without|without|0.6
public-domain|in/into/to the public domain|domain|0.8
public-domain|public domain dedication|domain|0.8
permissive|permission is hereby granted free of charge to any person obtaining a copy|hereby|0.9
permissive|redistribution and use in source and binary forms|redistribution|0.9
permissive|permission to use copy modify and or distribute this software|permission|0.9
copyleft|this program is free software you can redistribute it and or modify it|redistribute|0.9
copyleft|licensed under the same terms|licensed|0.5
no-warranty|without warranty of any kind|warranty|0.4
no-warranty|without any warranty|warranty|0.4
no-warranty|provided as is|provided|0.4
no-warranty|as is without warranty|warranty|0.5
no-warranty|express or implied warranties|implied|0.4
no-warranty|in no event shall the authors/author/copyright be liable|liable|0.5
permissive|the above copyright notice and this permission notice shall be included|permission|0.9
permissive|this notice may not be removed or altered from any source distribution|altered|0.8
permissive|neither the name of|neither|0.5
permissive|retain the above copyright notice|retain|0.7
copyleft|you should have received a copy of the gnu|received|0.9
copyleft|share alike|alike|0.5
proprietary|unauthorized copying|unauthorized|0.8
proprietary|trade secret/secrets of|trade|0.5
proprietary|for internal use only|internal|0.6
non-commercial|non commercial use only|commercial|0.7
non-commercial|noncommercial use only|noncommercial|0.7
non-commercial|not for commercial use|commercial|0.7
public-domain|dedicated to the public domain|dedicated|0.9
public-domain|no rights reserved|reserved|0.8
public-domain|no copyright is claimed|claimed|0.7
unknown-license|dual licensed|dual|0.6
unknown-license|triple licensed|triple|0.6
unknown-license|see [the] license [file] for details|details|0.5
unknown-license|under [the] terms of [the] [this] license|terms|0.4
unknown-license|license agreement|agreement|0.4
unknown-license|end user license|user|0.5
copyright|copyright [c] #|copyright|0.3
"""

_COMMON = frozenset("license licence public software general open free source the of and gnu agreement".split())
_GRANTED = "(?: licensed | released | distributed | available | published | provided | covered )(?: under | by )(?: the )?(?: terms  of (?: the )?)?"
_SPDX = " spdx  license  identifier "


def _lines(table: str) -> list[list[str]]:
    return [line.split("|") for line in table.strip().splitlines()]


def _phrase(text: str) -> str:
    return "".join(f" {w} " for w in text.split())


def _worded(text: str) -> str:
    out = []
    for token in text.split():
        if token == "#":
            out.append(" (?:19|20)[0-9][0-9] ")
        elif token[0] == "[":
            out.append(f"(?: {token[1:-1]} )?")
        elif "/" in token:
            out.append("(?:" + "|".join(f" {w} " for w in token.split("/")) + ")")
        else:
            out.append(f" {token} ")
    return "".join(out)


def _named(label: str, ids: str, names: list[str], tail: str = "") -> list[Rule]:
    found = [Rule(label, _SPDX + _phrase(ids), "spdx", 3, 0.99)]
    if " " in ids and not tail:  # an identifier of several words stands for itself
        found.append(Rule(label, _phrase(ids), _keyword(ids), 1, 0.8))
    for name in sorted(names, key=len, reverse=True):
        found.append(Rule(label, f"{_GRANTED}{_phrase(name)}{tail}", _keyword(name), 2, 0.95))
        found.append(Rule(label, _phrase(name) + tail, _keyword(name), 1, 0.7))
    return found


def _keyword(name: str) -> str:
    """The name's longest word that is not in most names."""
    return max((w for w in name.split() if w not in _COMMON), key=len, default=name.split()[0])


def rules() -> list[Rule]:
    """All rules in their order."""
    found = [Rule(label, _phrase(p), p.split()[-1], 4, 0.9) for p, label in BASE]
    for label, ids, names in _lines(_PLAIN):
        found += _named(label, ids, names.split(";"))
    for label, ids, names, versions in _lines(_VERSIONED):
        for v in versions.split(","):
            major, *rest = v.split()
            minor = "".join(_phrase(x) for x in rest)
            tail = f"(?: license | licence )?(?: version | v )? v?{major} {minor}"
            found += _named(f"{label}-{v.replace(' ', '.')}", f"{ids} {v}", names.split(";"), tail)
            found.append(Rule(f"{label}-{v.replace(' ', '.')}", f" {ids}  v?{major} {minor}", ids, 1, 0.8))
            for glued in (f"{ids}v{major}", f"{ids}{major}"):  # GPLv3, LGPLv2.1, AGPL3
                found.append(Rule(f"{label}-{v.replace(' ', '.')}", f" {glued} {minor}", glued, 1, 0.8))
        found += _named(label, ids, [n for n in names.split(";") if " " in n])
    for kind in _COMMONS:
        spelled = " ".join(_SPELLED[k] for k in kind.split())
        for v in _COMMONS_VERSIONS:
            label = f"cc-{kind.replace(' ', '-')}-{v.replace(' ', '.')}"
            found += _named(label, f"cc {kind} {v}", [f"cc {kind} {v}", f"creative commons {spelled} {v}"])
            found.append(Rule(label, _phrase(f"creativecommons org licenses {kind} {v}"), "creativecommons", 3, 0.99))
            found.append(Rule(label, _phrase(f"creative commons {spelled}") + "(?: international | unported | generic )?(?: license )?" + _phrase(v), "creative", 1, 0.9))
        found.append(Rule(f"cc-{kind.replace(' ', '-')}", _phrase(f"cc {kind}"), "cc", 1, 0.6))
    return found + [Rule(label, _worded(text), keyword, 1, float(confidence)) for label, text, keyword, confidence in _lines(_WORDING)]
