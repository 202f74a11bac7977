"""The signature rules of the licence scan, over texts of lower-case words joined by one space.

Each rule is a regex of its own, with a label, a priority (1 comes first) and
a confidence by its kind.  A rule's keyword, the longest text that all its
matches contain, is read off the regex, so that the gate loses none.  Rules of
the kind `no licence` have no label: they suppress what they contain.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    order: int
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


# Priority and confidence of each kind of rule.
KINDS: dict[str, tuple[int, float]] = {"no licence": (1, 0.0), "identifier": (2, 0.99), "text": (3, 0.97), "url": (4, 0.95), "grant": (5, 0.9), "name": (6, 0.7), "mention": (7, 0.5)}
#: What nearly all keywords contain: a text with none of these, nor any other keyword, is tried by no rule.
STEMS = ("licen", "copyright", "gpl", "permi", "warrant", "redistribut", "public domain", "rights reserved", "creativecommons", "creative commons", "cc by", "cc0", "bsd", "apache", "mozilla", "spdx", "proprietary", "reproduc", "confidential", "commercial")

# Phrases that hold a licence's name without placing anything under it.
NO_LICENCE = (
    "not (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:[^ ]+ ){1,6}licen[cs]e",
    "not covered by (?:the )?(?:[^ ]+ ){0,5}licen[cs]e",
    "incompatible with (?:the )?(?:[^ ]+ ){0,5}licen[cs]e",
    "(?:unlike|instead of|rather than|other than) (?:the )?(?:[^ ]+ ){0,4}general public licen[cs]e",
    "without (?:any|a) licen[cs]e",
    "driver s? ?licen[cs]e",
    "driving licen[cs]e",
    "(?:liquor|fishing|hunting|marriage|business) licen[cs]e",
    "licen[cs]e plates?",
    "licen[cs]e (?:number|no) [^ ]*[0-9][^ ]*",
    "apache (?:http|web) server",
    "apache (?:spark|kafka|hadoop|tomcat|maven|hive|flink|cassandra)",
    "mozilla (?:firefox|thunderbird)",
    "mozilla 5 0",
    "creative commons (?:search|website|organi[sz]ation)",
    "in the public domain of (?:knowledge|debate|discussion)",
)

# Short identifiers, label: regex after "spdx license identifier".
IDENTIFIERS = {
    "0bsd": "0bsd",
    "afl-3.0": "afl 3 0",
    "agpl-3.0": "agpl 3 0(?: only| or later)?",
    "apache-1.1": "apache 1 1",
    "apache-2.0": "apache 2 0",
    "artistic-2.0": "artistic 2 0",
    "bsd-2-clause": "bsd 2 clause(?: patent| views)?",
    "bsd-3-clause": "bsd 3 clause(?: clear| lbnl)?",
    "bsd-4-clause": "bsd 4 clause",
    "blueoak-1.0.0": "blueoak 1 0 0",
    "bsl-1.0": "bsl 1 0",
    "busl-1.1": "busl 1 1",
    "cc-by-3.0": "cc by 3 0",
    "cc-by-4.0": "cc by 4 0",
    "cc-by-sa-4.0": "cc by sa 4 0",
    "cc-by-nc-4.0": "cc by nc 4 0",
    "cc0-1.0": "cc0 1 0",
    "cddl-1.0": "cddl 1 [01]",
    "cecill-2.1": "cecill 2 [01]",
    "ecl-2.0": "ecl 2 0",
    "epl-1.0": "epl 1 0",
    "epl-2.0": "epl 2 0",
    "eupl-1.2": "eupl 1 [12]",
    "gfdl-1.3": "gfdl 1 [123](?: only| or later)?",
    "gpl-1.0": "gpl 1 0(?: only| or later)?",
    "gpl-2.0": "gpl 2 0(?: only)?",
    "gpl-2.0-or-later": "gpl 2 0 or later",
    "gpl-3.0": "gpl 3 0(?: only)?",
    "gpl-3.0-or-later": "gpl 3 0 or later",
    "hpnd": "hpnd",
    "isc": "isc",
    "lgpl-2.0": "lgpl 2 0(?: only| or later)?",
    "lgpl-2.1": "lgpl 2 1(?: only| or later)?",
    "lgpl-3.0": "lgpl 3 0(?: only| or later)?",
    "libpng-2.0": "libpng 2 0",
    "lppl-1.3c": "lppl 1 3[abc]",
    "mit": "mit(?: 0)?",
    "mpl-1.1": "mpl 1 [01]",
    "mpl-2.0": "mpl 2 0(?: no copyleft exception)?",
    "ms-pl": "ms pl",
    "mulanpsl-2.0": "mulanpsl 2 0",
    "ncsa": "ncsa",
    "odbl-1.0": "odbl 1 0",
    "ofl-1.1": "ofl 1 [01](?: rfn| no rfn)?",
    "openssl": "openssl",
    "postgresql": "postgresql",
    "psf-2.0": "(?:python|psf) 2 0",
    "sspl-1.0": "sspl 1 0",
    "unicode": "unicode dfs 201[56]",
    "unlicense": "unlicense",
    "upl-1.0": "upl 1 0",
    "wtfpl": "wtfpl",
    "x11": "x11",
    "zlib": "zlib",
    "zpl-2.1": "zpl 2 [01]",
}

# Exceptions and choices of licence expressions.
EXPRESSIONS = {
    "classpath-exception": "with classpath exception 2 0",
    "gcc-exception": "with gcc exception [23] [01]",
    "bison-exception": "with bison exception 2 2",
    "font-exception": "with font exception 2 0",
    "linux-syscall-note": "with linux syscall note",
    "llvm-exception": "with llvm exceptions?",
    "openssl-exception": "with openssl exception",
    "autoconf-exception": "with autoconf exception [23] 0",
    "mit-or-apache-2.0": "(?:mit or apache|apache 2 0 or mit|mit apache 2 0)(?: 2 0)? licen[cs]ed?",
    "dual-licence": "dual licen[cs]ed under",
    "choice-of-licences": "at your choice(?: of)? (?:either )?(?:the )?(?:[^ ]+ ){1,6}licen[cs]e",
}

# Addresses where public licences stand, label: regex.
ADDRESSES = {
    "agpl-3.0": "gnu org licenses agpl(?: 3 0)?",
    "apache-1.1": "apache org licenses license 1 1",
    "apache-2.0": "apache org licenses license 2 0",
    "apache-2.0-osi": "opensource org licenses apache 2 0",
    "artistic-2.0": "opensource org licenses artistic license 2 0",
    "boost": "boost org license 1 0 txt",
    "bsd-2-clause": "opensource org licenses bsd 2 clause",
    "bsd-3-clause": "opensource org licenses bsd 3 clause",
    "bsd": "opensource org licenses bsd license",
    "cc0-1.0": "creativecommons org publicdomain zero 1 0",
    "public-domain-mark": "creativecommons org publicdomain mark 1 0",
    "cc-by-1.0": "creativecommons org licenses by 1 0",
    "cc-by-2.0": "creativecommons org licenses by 2 [05]",
    "cc-by-3.0": "creativecommons org licenses by 3 0",
    "cc-by-4.0": "creativecommons org licenses by 4 0",
    "cc-by-sa-2.0": "creativecommons org licenses by sa 2 [05]",
    "cc-by-sa-3.0": "creativecommons org licenses by sa 3 0",
    "cc-by-sa-4.0": "creativecommons org licenses by sa 4 0",
    "cc-by-nc-3.0": "creativecommons org licenses by nc 3 0",
    "cc-by-nc-4.0": "creativecommons org licenses by nc 4 0",
    "cc-by-nd-4.0": "creativecommons org licenses by nd [34] 0",
    "cc-by-nc-sa-4.0": "creativecommons org licenses by nc sa [34] 0",
    "cc-by-nc-nd-4.0": "creativecommons org licenses by nc nd [34] 0",
    "cddl-1.0": "opensource org licenses cddl(?: 1 0)?",
    "ecl-2.0": "opensource org licenses ecl 2 0",
    "epl-1.0": "eclipse org legal epl v10",
    "epl-2.0": "eclipse org legal epl (?:2 0|v20)",
    "eupl-1.2": "joinup ec europa eu (?:[^ ]+ ){0,6}eupl",
    "fdl-1.3": "gnu org (?:copyleft|licenses) fdl",
    "gpl-2.0": "gnu org licenses (?:old licenses )?gpl 2 0",
    "gpl-3.0": "gnu org licenses gpl 3 0",
    "gpl": "gnu org (?:copyleft|licenses) gpl(?: html)?",
    "isc": "opensource org licenses isc",
    "lgpl-2.1": "gnu org licenses (?:old licenses )?lgpl 2 1",
    "lgpl-3.0": "gnu org licenses lgpl 3 0",
    "lgpl": "gnu org (?:copyleft|licenses) (?:lesser|lgpl)",
    "mit": "opensource org licenses mit(?: license)?",
    "mpl-1.1": "mozilla org mpl mpl 1 1",
    "mpl-2.0": "mozilla org (?:en us )?mpl 2 0",
    "odbl-1.0": "opendatacommons org licenses odbl",
    "odc-by-1.0": "opendatacommons org licenses by",
    "pddl-1.0": "opendatacommons org licenses pddl",
    "ofl-1.1": "scripts sil org ofl",
    "sspl-1.0": "mongodb com licensing server side public license",
    "unlicense": "unlicense org",
    "wtfpl": "wtfpl net",
    "zlib": "opensource org licenses zlib",
    "zpl-2.1": "zope org resources zpl",
}

# Sentences of licence texts and of the notices that go with them.
TEXTS: dict[str, tuple[str, ...]] = {
    "afl-3.0": ("licen[cs]ed under the academic free licen[cs]e version 3 0",),
    "agpl-3.0": ("interacting with it remotely through a computer network", "all users interacting with it remotely", "gnu affero general public licen[cs]e as published by the free software foundation"),
    "apache-2.0": ("you may not use this file except in compliance with the licen[cs]e", "unless required by applicable law or agreed to in writing", "see the notice file distributed with this work for additional information", "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    "apache-1.1": ("this product includes software developed by the apache software foundation",),
    "artistic-2.0": ("this package is free software(?: and)? you (?:can|may) redistribute it (?:and or modify it )?under the (?:terms of the )?artistic licen[cs]e", "same terms as perl itself"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"),
    "bsd-3-clause": ("neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products",),
    "bsd-4-clause": ("all advertising materials mentioning features or use of this software must display",),
    "bsl-1.0": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "distributed under the boost software licen[cs]e"),
    "busl-1.1": ("the licensor may make an additional use grant", "on the change date (?:[^ ]+ ){0,10}the change licen[cs]e"),
    "cc0-1.0": ("to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighboring rights",),
    "cc-by": ("you are free to share copy and redistribute the material", "you must give appropriate credit provide a link to the licen[cs]e"),
    "cc-by-sa": ("you must distribute your contributions under the same licen[cs]e as the original",),
    "cc-by-nc": ("you may not use the material for commercial purposes",),
    "cc-by-nd": ("you may not distribute the modified material",),
    "cddl-1.0": ("the contents of this file are subject to the terms of the common development and distribution licen[cs]e",),
    "epl-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e",),
    "eupl-1.2": ("licen[cs]ed under the eupl",),
    "gpl": ("this program is free software you can redistribute it and or modify it", "you should have received a copy of the gnu general public licen[cs]e", "either version [123] of the licen[cs]e or at your option any later version", "published by the free software foundation", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    "fdl-1.3": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation", "with no invariant sections no front cover texts and no back cover texts"),
    "hpnd": ("permission to use copy modify and distribute this software and its documentation for any purpose",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "lgpl": ("you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "this library is free software you can redistribute it and or modify it"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "the above copyright notice and this permission notice shall be included in all copies"),
    "mpl-1.1": ("the contents of this file are subject to the mozilla public licen[cs]e version 1 1",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public licen[cs]e", "if a copy of the mpl was not distributed with this file"),
    "ms-pl": ("if you use the software you accept this licen[cs]e if you do not accept the licen[cs]e do not use the software",),
    "ncsa": ("permission is hereby granted (?:[^ ]+ ){0,12}to deal with the software without restriction",),
    "odbl-1.0": ("made available under the open database licen[cs]e", "any rights in individual contents of the database are licen[cs]ed"),
    "ofl-1.1": ("this font software is licen[cs]ed under the sil open font licen[cs]e", "the font software may be sold as part of a larger software package"),
    "openssl": ("this product includes software developed by the openssl project",),
    "php-3.01": ("this product includes php software freely available from", "this source file is subject to version 3 0?1 of the php licen[cs]e"),
    "postgresql": ("in no event shall the university of california be liable to any party",),
    "psf-2.0": ("psf is making python available to licensee on an as is basis",),
    "sspl-1.0": ("offering the program as a service requires",),
    "unicode": ("permission is hereby granted (?:[^ ]+ ){0,14}copy of the unicode data files",),
    "unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
    "upl-1.0": ("the above copyright notice and either this complete permission notice or at a minimum a reference to the upl",),
    "w3c": ("by obtaining using and or copying this work you the licensee agree",),
    "wtfpl": ("you just do what the fuck you want to",),
    "x11": ("x consortium shall not be used in advertising",),
    "zlib": ("this software is provided as is without any express or implied warranty", "this notice may not be removed or altered from any source distribution", "altered source versions must be plainly marked as such"),
    "zpl-2.1": ("this software is subject to the provisions of the zope public licen[cs]e",),
    "no-warranty": ("the software is provided as is without warranty of any kind", "without any warranty without even the implied warranty", "provided as is and without warrant(?:y|ies)", "the entire risk as to the quality and performance of the program is with you", "in no event shall the (?:authors?|copyright (?:holders?|owner)) (?:or (?:[^ ]+ ){1,3})?be liable"),
}

# Ways of granting or withholding rights without a licence's text.
GRANTS: dict[str, tuple[str, ...]] = {
    "all-rights-reserved": ("all rights reserved", "alle rechte vorbehalten", "tous droits r[^ ]serv[^ ]s", "todos los derechos reservados"),
    "some-rights-reserved": ("some rights reserved",),
    "no-rights-reserved": ("no rights reserved",),
    "commercial": ("for non ?commercial use only", "commercial use (?:is )?(?:prohibited|not permitted|forbidden)", "a commercial licen[cs]e is required", "subject to (?:the |a )?commercial licen[cs]e", "end user licen[cs]e agreement"),
    "confidential": ("proprietary and confidential", "confidential and proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "trade secrets? of [^ ]+"),
    "evaluation": ("for evaluation (?:purposes|use) only", "free trial licen[cs]e"),
    "academic": ("for academic (?:use|purposes) only", "for research (?:use|purposes) only", "for educational (?:use|purposes) only"),
    "personal-use": ("for personal use only",),
    "public-domain": ("dedicated to the public domain", "released (?:in)?to the public domain", "placed in the public domain", "public domain dedication"),
    "reproduction-reserved": ("no part of this (?:publication|book|document|work) may be reproduced", "reproduction (?:in whole or in part )?(?:is )?(?:prohibited|forbidden)", "may not be reproduced without (?:prior )?(?:written )?permission"),
    "permission": ("used with permission", "reprinted (?:here )?with permission", "reproduced with permission", "by permission of the (?:author|publisher)", "permission to copy [^ ]+(?: [^ ]+){0,6} is granted"),
    "attribution": ("free to use with attribution", "attribution required"),
    "copyright": ("copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright holders?", "copyright by [^ ]+"),
    "unknown-licence": ("(?:licen[cs]ed|released|distributed|published|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?[^ ]+(?: [^ ]+){0,3} licen[cs]e", "see (?:the )?licen[cs]e file", "see (?:the )?copying file", "licen[cs]e terms", "subject to the (?:following|accompanying) licen[cs]e", "under the same licen[cs]e"),
}

# Names of public licences.
NAMES: dict[str, tuple[str, ...]] = {
    "0bsd": ("0bsd", "zero clause bsd"),
    "afl-3.0": ("academic free licen[cs]e(?: v(?:ersion)? ?3(?: 0)?)?",),
    "agpl-3.0": ("(?:gnu )?affero general public licen[cs]e(?: v(?:ersion)? ?3(?: 0)?| v3)?",),
    "agpl": ("agpl(?: ?v?3(?: 0)?)?",),
    "apache-1.1": ("apache (?:software )?licen[cs]e(?: version| v)? ?1 1",),
    "apache-2.0": ("apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?", "apache 2(?: 0)?(?: licen[cs]e)?", "asl ?2(?: 0)?"),
    "artistic-1.0": ("(?:perl )?artistic licen[cs]e(?: version)? 1(?: 0)?",),
    "artistic-2.0": ("(?:perl )?artistic licen[cs]e(?: version)? 2(?: 0)?",),
    "artistic": ("artistic licen[cs]e",),
    "beerware": ("beer ?ware licen[cs]e",),
    "bsd-2-clause": ("(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?", "bsd (?:2|two) clause(?: licen[cs]e)?"),
    "bsd-3-clause": ("(?:new|revised|modified|3 clause|three clause) bsd(?: licen[cs]e)?", "bsd (?:3|three) clause(?: licen[cs]e)?"),
    "bsd-4-clause": ("(?:original|4 clause|four clause) bsd(?: licen[cs]e)?", "bsd (?:4|four) clause(?: licen[cs]e)?"),
    "bsd": ("bsd(?: style)? licen[cs]e",),
    "bsl-1.0": ("boost software licen[cs]e(?: version)?(?: 1 0)?",),
    "busl-1.1": ("business source licen[cs]e(?: version)?(?: 1 1)?",),
    "cc0-1.0": ("cc0(?: 1 0)?(?: universal)?", "cc zero"),
    "cc-by-4.0": ("cc by 4(?: 0)?", "creative commons attribution 4 0(?: international)?"),
    "cc-by-3.0": ("cc by 3(?: 0)?", "creative commons attribution 3 0(?: unported)?"),
    "cc-by-sa-4.0": ("cc by sa 4(?: 0)?", "creative commons attribution share ?alike 4 0(?: international)?"),
    "cc-by-sa": ("cc by sa(?: [123] [05])?", "creative commons attribution share ?alike(?: [123] [05])?"),
    "cc-by-nc-4.0": ("cc by nc 4(?: 0)?", "creative commons attribution non ?commercial 4 0(?: international)?"),
    "cc-by-nc": ("cc by nc(?: [123] [05])?", "creative commons attribution non ?commercial(?: [123] [05])?"),
    "cc-by-nc-sa": ("cc by nc sa(?: [1234] [05])?", "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"),
    "cc-by-nc-nd": ("cc by nc nd(?: [1234] [05])?", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1234] [05])?"),
    "cc-by-nd": ("cc by nd(?: [1234] [05])?", "creative commons attribution no ?deriv(?:ative)?s?(?: [1234] [05])?"),
    "creative-commons": ("creative commons(?: public)?(?: licen[cs]e)?",),
    "cddl-1.0": ("cddl(?: v(?:ersion)?)?(?: ?1 [01])?", "common development and distribution licen[cs]e(?: version)?(?: 1 [01])?"),
    "cecill": ("cecill(?: [abc])?(?: licen[cs]e)?",),
    "copyleft": ("copyleft licen[cs]e",),
    "cpal-1.0": ("common public attribution licen[cs]e(?: version)?(?: 1 0)?",),
    "cpl-1.0": ("common public licen[cs]e(?: version)?(?: 1 0)?",),
    "ecl-2.0": ("educational community licen[cs]e(?: version)?(?: 2 0)?",),
    "elastic-2.0": ("elastic licen[cs]e(?: version)?(?: 2(?: 0)?)?",),
    "epl-1.0": ("eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?",),
    "epl-2.0": ("eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?",),
    "epl": ("eclipse public licen[cs]e",),
    "eupl-1.2": ("european union public licen[cs]e(?: version)?(?: 1 [12])?",),
    "fdl-1.3": ("(?:gnu )?free documentation licen[cs]e(?: version)?(?: 1 [123])?",),
    "gpl-1.0": ("(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?",),
    "gpl-2.0": ("(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?", "(?:gnu )?gpl ?v?2(?: 0)?"),
    "gpl-3.0": ("(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?", "(?:gnu )?gpl ?v?3(?: 0)?"),
    "gpl": ("gnu general public licen[cs]e", "gnu gpl"),
    "hippocratic": ("hippocratic licen[cs]e(?: version)?(?: [23](?: [01])?)?",),
    "ijg": ("independent jpeg group licen[cs]e",),
    "intel": ("intel open source licen[cs]e",),
    "ipl-1.0": ("ibm public licen[cs]e(?: version)?(?: 1 0)?",),
    "isc": ("isc licen[cs]e",),
    "json": ("json licen[cs]e",),
    "lgpl-2.0": ("(?:gnu )?library general public licen[cs]e(?: version| v)?(?: ?2(?: 0)?)?",),
    "lgpl-2.1": ("(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2(?: 1)?",),
    "lgpl-3.0": ("(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?",),
    "lgpl": ("(?:gnu )?lgpl(?: ?v?[23](?: [01])?)?", "(?:gnu )?lesser general public licen[cs]e"),
    "llama": ("llama [234] community licen[cs]e(?: agreement)?",),
    "lppl-1.3": ("latex project public licen[cs]e(?: version)?(?: 1 [0-3][abc]?)?",),
    "mit": ("mit(?: x11)? licen[cs]e", "mit no attribution"),
    "mit-expat": ("expat licen[cs]e",),
    "mpl-1.1": ("mozilla public licen[cs]e(?: version| v)? ?1(?: [01])?",),
    "mpl-2.0": ("mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?",),
    "mpl": ("mozilla public licen[cs]e",),
    "ms-pl": ("microsoft public licen[cs]e",),
    "ms-rl": ("microsoft reciprocal licen[cs]e",),
    "mulanpsl-2.0": ("mulan permissive software licen[cs]e(?: v(?:ersion)? ?2)?",),
    "ncsa": ("(?:university of illinois )?ncsa(?: open source)? licen[cs]e",),
    "odbl-1.0": ("open database licen[cs]e(?: v?1 0)?",),
    "odc-by-1.0": ("open data commons attribution licen[cs]e(?: v?1 0)?",),
    "ofl-1.1": ("(?:sil )?open font licen[cs]e(?: version)?(?: 1 [01])?",),
    "ogl": ("open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?",),
    "openrail": ("openrail(?: m)?(?: licen[cs]e)?",),
    "openssl": ("openssl licen[cs]e",),
    "osl-3.0": ("open software licen[cs]e(?: version| v)?(?: ?3 0)?",),
    "pddl-1.0": ("public domain dedication and licen[cs]e(?: v?1 0)?",),
    "php-3.01": ("php licen[cs]e(?: version)?(?: 3 0?1)?",),
    "postgresql": ("postgresql licen[cs]e",),
    "psf-2.0": ("python software foundation licen[cs]e(?: version)?(?: 2)?",),
    "qpl-1.0": ("q public licen[cs]e(?: version)?(?: 1 0)?",),
    "ruby": ("ruby licen[cs]e",),
    "sissl": ("sun industry standards source licen[cs]e(?: version)?(?: 1 [12])?",),
    "sleepycat": ("sleepycat licen[cs]e",),
    "sspl-1.0": ("server side public licen[cs]e(?: version)?(?: 1)?",),
    "unlicense": ("(?:the )?unlicense",),
    "upl-1.0": ("universal permissive licen[cs]e(?: v(?:ersion)? ?1 0)?",),
    "vim": ("vim licen[cs]e",),
    "w3c": ("w3c software(?: notice)?(?: and)? licen[cs]e",),
    "wtfpl": ("wtfpl(?: v?2)?",),
    "zlib": ("zlib(?: libpng)? licen[cs]e",),
    "zpl-2.1": ("zope public licen[cs]e(?: version)?(?: 2 [01])?",),
}

# Words that only hint at a licence.
MENTIONS: dict[str, tuple[str, ...]] = {
    "open-source": ("open source (?:software )?licen[cs]e", "osi approved"),
    "free-software": ("free software licen[cs]e",),
    "freeware": ("freeware", "shareware"),
    "gpl": ("gpl",),
    "public-domain": ("public domain",),
    "proprietary": ("proprietary licen[cs]e", "proprietary software"),
    "permissive": ("permissive licen[cs]e",),
    "royalty-free": ("royalty free",),
}


def keyword(pattern: str) -> str:
    """The longest run of characters that every match of a rule's regex has, if possible one with a stem in it."""
    runs, run, depth, k = [], " ", 0, 0
    pattern += " "
    while k < len(pattern):
        c = pattern[k]
        stop = k + 1
        if c == "[":
            stop = pattern.index("]", k) + 1
        plain = depth == 0 and c not in "[()" and pattern[stop : stop + 1] not in ("?", "+", "{", "*")
        if plain:
            run += c
        elif run:
            runs.append(run)
            run = ""
        depth += (c == "(") - (c == ")")
        quantity = re.match(r"[?+*]|\{[^}]*\}", pattern[stop:])
        k = stop + (quantity.end() if quantity else 0)
    return max([*runs, run], key=lambda x: (any(s in x for s in STEMS), len(x)))


def rules() -> list[Rule]:
    """Every rule in order, by kind."""
    spdx = {label: (f"spdx license identifier {p}",) for label, p in IDENTIFIERS.items()}
    tables = (
        ("no licence", {"": NO_LICENCE}),
        ("identifier", spdx),
        ("identifier", {label: (p,) for label, p in EXPRESSIONS.items()}),
        ("text", TEXTS),
        ("url", {label: (p,) for label, p in ADDRESSES.items()}),
        ("grant", GRANTS),
        ("name", NAMES),
        ("mention", MENTIONS),
    )
    out: list[Rule] = []
    for kind, table in tables:
        for label, patterns in table.items():
            for p in patterns:
                out.append(Rule(len(out), label.removesuffix("-osi"), keyword(p), f"(?<= ){p}(?= )", *KINDS[kind]))
    return out


def stems(found_rules: list[Rule]) -> list[str]:
    """Texts of which every keyword contains one: the common ones, and keywords without any."""
    common = [s for s in STEMS if any(s in r.keyword for r in found_rules)]
    return common + sorted({r.keyword for r in found_rules if not any(s in r.keyword for s in common)})
