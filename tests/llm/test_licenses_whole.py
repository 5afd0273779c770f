"""License rules fire on texts that hold none of the usual license words."""

import re

from docweave.llm import license_rules, licenses

TEXTS = {
    "GPL v3": "gpl-3",
    "LGPL 2.1": "lgpl-2.1",
    "MPL 2.0": "mpl-2.0",
    "CC BY-SA 4.0": "cc-by-sa-4.0",
    "CC0": "cc0-1.0",
    "WTFPL": "wtfpl",
    "Commons Clause": "commons-clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "permissive",
    "Redistribution and use in source and binary forms": "permissive",
    "This program is free software: you can redistribute it and/or modify it": "copyleft",
    "proprietary and confidential": "proprietary",
    "may not be copied without": "proprietary",
    "in the public\ndomain": "public-domain",
    "all rights\nreserved": "proprietary",
    "Creative-Commons Attribution 4.0": "cc-by-4.0",
}


# Texts and their labels, written by hand from what the texts mean, not from the rules.
PAIRS = """
GPLv3|gpl-3
GPLv2+|gpl-2
released under GPLv2|gpl-2
LGPLv2.1|lgpl-2.1
LGPLv3|lgpl-3
AGPLv3|agpl-3
AGPL3|agpl-3
MPLv2.0|mpl-2.0
EPLv1.0|epl-1.0
EUPLv1.2|eupl-1.2
BSD-3-Clause|bsd-3-clause
BSD-2-Clause|bsd-2-clause
BSD-4-Clause|bsd-4-clause
MIT-0|mit-0
BSL-1.0|bsl-1.0
CC0-1.0|cc0-1.0
OFL-1.1|ofl-1.1
MS-PL|ms-pl
MS-RL|ms-rl
UPL-1.0|upl-1.0
BUSL-1.1|busl-1.1
SSPL-1.0|sspl-1.0
Elastic-2.0|elastic-2.0
PHP-3.01|php-3.01
PSF-2.0|psf-2.0
ODbL-1.0|odbl-1.0
ODC-By-1.0|odc-by-1.0
PDDL-1.0|pddl-1.0
BlueOak-1.0.0|blueoak-1.0.0
Apache-2.0|apache-2.0
Apache License, Version 2.0|apache,apache-2.0
Licensed under the Apache License, Version 2.0|apache,apache-2.0
the Apache Software License 1.1|apache-1.1
GNU General Public License version 3|gpl,gpl-3
GNU General Public License v2|gpl,gpl-2
the GNU Lesser General Public License, version 2.1|gpl,lgpl-2.1
GNU Affero General Public License 3|agpl-3,gpl
GNU Free Documentation License 1.3|gfdl-1.3
Mozilla Public License 2.0|mpl-2.0
Mozilla Public License, v. 2.0|mpl-2.0
Eclipse Public License 2.0|epl-2.0
Common Development and Distribution License 1.0|cddl-1.0
European Union Public Licence 1.2|eupl-1.2
Artistic License 2.0|artistic-2.0
Academic Free License 3.0|afl-3.0
Open Software License 3.0|osl-3.0
Educational Community License 2.0|ecl-2.0
LaTeX Project Public License 1.3|lppl-1.3
MIT License|mit
the MIT Licence|mit
Expat License|mit
ISC License|isc
X11 License|x11
zlib License|zlib
Boost Software License|bsl-1.0
The Unlicense|unlicense
Zero-Clause BSD License|0bsd
New BSD License|bsd-3-clause
Modified BSD license|bsd-3-clause
Simplified BSD License|bsd-2-clause
FreeBSD License|bsd-2-clause
BSD-style license|bsd
PostgreSQL License|postgresql
Python Software Foundation License|python-2.0
PHP License|php-3.01
Ruby license|ruby
under the same terms as Perl itself|perl
OpenSSL License|openssl
Vim License|vim
SIL Open Font License|ofl-1.1
Beerware License|beerware
JSON License|json
Microsoft Public License|ms-pl
Microsoft Reciprocal License|ms-rl
Common Public License|cpl-1.0
Universal Permissive License|upl-1.0
Server Side Public License|sspl-1.0
Business Source License|busl-1.1
Sleepycat License|sleepycat
Zope Public License|zpl
Open Database License|odbl-1.0
Creative Commons Zero|cc0-1.0
CC-BY-4.0|cc-by-4.0
CC BY-NC-ND 3.0|cc-by-nc-nd-3.0
https://creativecommons.org/licenses/by-sa/4.0/|cc-by-sa-4.0
SPDX-License-Identifier: MIT|mit
SPDX-License-Identifier: GPL-2.0-only|gpl-2
SPDX-License-Identifier: BSD-3-Clause|bsd-3-clause
SPDX-License-Identifier: MPL-2.0|mpl-2.0
Copyright (c) 2021 Somebody|copyright
All rights reserved.|proprietary
Unauthorized copying of this file|proprietary
for internal use only|proprietary
Not for commercial use|non-commercial
dedicated to the public domain|public-domain
No rights reserved|public-domain
provided "as is"|no-warranty
WITHOUT WARRANTY OF ANY KIND|no-warranty
The above copyright notice and this permission notice shall be included|permissive
You should have received a copy of the GNU|copyleft
dual-licensed|unknown-license
See the LICENSE file for details|unknown-license
the mitigation of licensed drivers|
GPLv3x, xGPLv3 and gplv33|
public and general|
apache helicopters 2 0|
zlib was compressed|
"""


def test_hand_written_pairs(spark):
    pairs = [line.rsplit("|", 1) for line in PAIRS.strip().splitlines()]
    frame = spark.createDataFrame([(i, f"Note: {text}; end") for i, (text, _) in enumerate(pairs)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(frame).collect()}
    assert {text: got[i] for i, (text, _) in enumerate(pairs) if got[i] != pairs[i][1]} == {}


def brute(text, rules):
    """Labels and number of what is kept, every rule tried on every text."""
    norm = "".join(f" {w} " for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)))
    found = [(norm[: m.start()].count(" ") // 2, -(norm[: m.end()].count(" ") // 2), -r.priority, i) for i, r in enumerate(rules) for m in re.finditer(r.pattern, norm)]
    kept = [a for a in found if a[2] == -4 or not any(b[2] != -4 and b[2] <= a[2] and b[0] <= a[0] and b[1] <= a[1] and b < a for b in found)]
    return ",".join(sorted({rules[k[3]].label for k in kept})), max((rules[k[3]].confidence for k in kept), default=0.0), len(kept)


def test_rules_fire_without_gate_strings(spark):
    rules = license_rules.rules()
    rows = [*enumerate(TEXTS), (100, "nothing of the kind"), (101, "submitted scc gplv3x")]
    got = {r.doc_id: (r.labels, r.score, r.n_found) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t, rules) for i, t in rows}
    assert all(label in got[i][0].split(",") for i, label in enumerate(TEXTS.values()))
    assert got[100] == got[101] == ("", 0.0, 0)


def test_every_match_of_a_rule_holds_its_keyword():
    for r in license_rules.rules():
        assert re.fullmatch("[0-9a-z]+", r.keyword), r
        required = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", "", r.pattern)
        assert f" {r.keyword} " in required, r
