"""Signature rules for licences, over text reduced to lower-case words with one space between.

Each licence has a label, a keyword that every form of its name contains, a pattern of its name, patterns of its
identifiers and, where one is telling, a sentence of its text. The rules are ordered: a smaller priority is stronger.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


GPL = r"gnu general public licen[sc]e"
LGPL = r"gnu (?:lesser|library) (?:or library )?general public licen[sc]e"
AGPL = r"gnu affero general public licen[sc]e"
FDL = r"gnu free documentation licen[sc]e"
CC = r"(?:creative commons|cc)"
V = r"(?: version| v)? ?"
LATER = r"(?: 0)?(?: or (?:any |at your option any )?later(?: version)?| only)?"

#: label, keyword (empty: the rule always runs), name, identifiers, sentence of the licence's text. Hand-written; more specific licences first.
LICENSES = [
    ("agpl-3", "affero", AGPL + V + "3" + LATER, "agpl ?v?3(?: 0)?(?: only| or later)?", "remote network interaction use with the gnu general public license"),
    ("agpl", "affero", AGPL, "agpl", ""),
    ("lgpl-2.1", "general", LGPL + V + r"2 1" + LATER, "lgpl ?v?2 1(?: only| or later)?", ""),
    ("lgpl-2", "general", LGPL + V + "2" + LATER, "lgpl ?v?2(?: 0)?(?: only| or later)?", ""),
    ("lgpl-3", "general", LGPL + V + "3" + LATER, "lgpl ?v?3(?: 0)?(?: only| or later)?", "this version of the gnu lesser general public license incorporates the terms"),
    ("lgpl", "general", LGPL, "lgpl", ""),
    ("gpl-1", "general", GPL + V + "1" + LATER, "gpl ?v?1(?: 0)?(?: only| or later)?", ""),
    ("gpl-2", "general", GPL + V + "2" + LATER, "gpl ?v?2(?: 0)?(?: only| or later)?", "either version 2 of the license or at your option any later version"),
    ("gpl-3", "general", GPL + V + "3" + LATER, "gpl ?v?3(?: 0)?(?: only| or later)?", "either version 3 of the license or at your option any later version"),
    ("gpl", "general", GPL, "gnu gpl|gpl licen[sc]ed?", ""),
    ("gfdl-1.1", "documentation", FDL + V + "1 1" + LATER, "gfdl ?1 1", ""),
    ("gfdl-1.2", "documentation", FDL + V + "1 2" + LATER, "gfdl ?1 2", ""),
    ("gfdl-1.3", "documentation", FDL + V + "1 3" + LATER, "gfdl ?1 3", ""),
    ("gfdl", "documentation", FDL, "gfdl", ""),
    ("apache-1.1", "apache", "apache (?:software )?licen[sc]e" + V + "1 1", "apache 1 1", ""),
    ("apache-1", "apache", "apache (?:software )?licen[sc]e" + V + "1(?: 0)?", "apache 1 0", ""),
    ("apache-2", "apache", "apache (?:software )?licen[sc]e" + V + "2(?: 0)?", "apache ?2(?: 0)?|apache org licenses licen[sc]e 2 0", ""),
    ("apache", "apache", "apache (?:software )?licen[sc]e", "asl 2 0", ""),
    ("mit-0", "mit", "mit no attribution(?: licen[sc]e)?", "mit 0", ""),
    ("mit", "", "mit(?: expat)? licen[sc]ed?|expat licen[sc]e", "mit x11", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("x11", "x11", "x11 licen[sc]e", "x11", ""),
    ("isc", "isc", "isc licen[sc]e", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("0bsd", "bsd", "zero clause bsd(?: licen[sc]e)?|bsd zero clause(?: licen[sc]e)?", "0bsd", ""),
    ("bsd-1-clause", "bsd", "(?:1|one) clause bsd(?: licen[sc]e)?", "bsd 1 clause", ""),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd(?: licen[sc]e)?|(?:simplified|freebsd) bsd licen[sc]e|simplified bsd", "bsd 2 clause", ""),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd(?: licen[sc]e)?|(?:new|modified|revised) bsd licen[sc]e", "bsd 3 clause", "neither the name of the copyright holder nor the names of its contributors"),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: licen[sc]e)?|(?:original|old) bsd licen[sc]e", "bsd 4 clause", "all advertising materials mentioning features or use of this software"),
    ("bsd", "bsd", "bsd(?: style)? licen[sc]ed?", "", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-1.0", "mozilla", "mozilla public licen[sc]e" + V + "1 0", "mpl ?1 0", ""),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e" + V + "1 1", "mpl ?1 1", ""),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e" + V + "2(?: 0)?", "mpl ?2(?: 0)?", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla", "mozilla public licen[sc]e", "mpl licen[sc]ed?", ""),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e" + V + "1(?: 0)?", "epl ?1 0", ""),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e" + V + "2(?: 0)?", "epl ?2 0", ""),
    ("epl", "eclipse", "eclipse public licen[sc]e", "", ""),
    ("edl-1.0", "eclipse", "eclipse distribution licen[sc]e", "edl 1 0", ""),
    ("cddl-1.0", "common", "common development and distribution licen[sc]e" + V + "1 0", "cddl ?1 0", ""),
    ("cddl-1.1", "common", "common development and distribution licen[sc]e" + V + "1 1", "cddl ?1 1", ""),
    ("cddl", "common", "common development and distribution licen[sc]e", "cddl", ""),
    ("cpl-1.0", "common", "common public licen[sc]e(?: version 1 0)?", "cpl 1 0", ""),
    ("cpal-1.0", "common", "common public attribution licen[sc]e", "cpal 1 0", ""),
    ("eupl-1.1", "union", "european union public licen[sc]e" + V + "1 1", "eupl ?v?1 1", ""),
    ("eupl-1.2", "union", "european union public licen[sc]e" + V + "1 2", "eupl ?v?1 2", ""),
    ("eupl", "union", "european union public licen[sc]e", "eupl", ""),
    ("osl-3.0", "open", "open software licen[sc]e(?: version)? 3 0", "osl 3 0", ""),
    ("afl-3.0", "academic", "academic free licen[sc]e(?: version)? 3 0", "afl 3 0", ""),
    ("artistic-1.0", "artistic", "artistic licen[sc]e" + V + "1 0", "artistic 1 0", ""),
    ("artistic-2.0", "artistic", "artistic licen[sc]e" + V + "2(?: 0)?", "artistic 2 0", ""),
    ("artistic", "artistic", "artistic licen[sc]e", "", ""),
    ("bsl-1.0", "boost", "boost software licen[sc]e(?: version 1 0)?", "bsl 1 0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("busl-1.1", "business", "business source licen[sc]e(?: 1 1)?", "busl 1 1", ""),
    ("sspl-1.0", "server", "server side public licen[sc]e", "sspl(?: 1 0)?", ""),
    ("elastic-2.0", "elastic", "elastic licen[sc]e(?: 2 0)?", "elastic 2 0", ""),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|strict|shield) licen[sc]e", "", ""),
    ("prosperity", "prosperity", "prosperity public licen[sc]e", "", ""),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", "zlib acknowledgement", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("libpng", "libpng", "libpng licen[sc]e", "libpng 2 0", ""),
    ("unlicense", "unlicense", "the unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "", "do what the fuck you want to public licen[sc]e", "wtfpl", ""),
    ("beerware", "beer", "beer ?ware licen[sc]e", "beerware", ""),
    ("python-2.0", "", "python software foundation licen[sc]e|psf licen[sc]e", "python 2 0", ""),
    ("php-3.01", "php", "php licen[sc]e(?: version 3 01)?", "php 3 01", ""),
    ("ruby", "ruby", "ruby licen[sc]e", "", ""),
    ("perl", "perl", "same terms as perl(?: itself)?", "", ""),
    ("vim", "vim", "vim licen[sc]e", "", ""),
    ("postgresql", "postgresql", "postgresql licen[sc]e", "postgresql", ""),
    ("openssl", "openssl", "openssl licen[sc]e", "openssl", ""),
    ("curl", "curl", "curl licen[sc]e", "curl", ""),
    ("ncsa", "ncsa", "university of illinois ncsa open source licen[sc]e|ncsa licen[sc]e", "ncsa", ""),
    ("w3c", "w3c", "w3c software(?: notice and)? licen[sc]e", "w3c", ""),
    ("ofl-1.1", "font", "sil open font licen[sc]e(?: version 1 1)?|open font licen[sc]e", "ofl 1 1", ""),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", "ms pl", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", "ms rl", ""),
    ("ibm-ipl", "ibm", "ibm public licen[sc]e", "ipl 1 0", ""),
    ("sun-spl", "sun", "sun public licen[sc]e", "spl 1 0", ""),
    ("apsl-2.0", "apple", "apple public source licen[sc]e", "apsl 2 0", ""),
    ("nasa-1.3", "nasa", "nasa open source agreement", "nasa 1 3", ""),
    ("odbl-1.0", "database", "open database licen[sc]e", "odbl(?: 1 0)?", ""),
    ("odc-by", "attribution", "open data commons attribution licen[sc]e", "odc by(?: 1 0)?", ""),
    ("pddl", "domain", "public domain dedication and licen[sc]e", "pddl(?: 1 0)?", ""),
    ("cc0", "", CC + " (?:zero|0)(?: 1 0)?(?: universal)?", "cc0(?: 1 0)?", "to the extent possible under law the author has waived all copyright"),
    ("cc-by-nc-nd", "", CC + r"(?: attribution| by) (?:non ?commercial|nc) (?:no ?deriv\w*|nd)(?: [1-4] 0)?", "", ""),
    ("cc-by-nc-sa", "", CC + r"(?: attribution| by) (?:non ?commercial|nc) (?:share ?alike|sa)(?: [1-4] 0)?", "", ""),
    ("cc-by-nc", "", CC + r"(?: attribution| by) (?:non ?commercial|nc)(?: [1-4] 0)?", "", ""),
    ("cc-by-nd", "", CC + r"(?: attribution| by) (?:no ?deriv\w*|nd)(?: [1-4] 0)?", "", ""),
    ("cc-by-sa", "", CC + r"(?: attribution| by) (?:share ?alike|sa)(?: [1-4] 0)?", "", ""),
    ("cc-by", "", CC + r"(?: attribution| by)(?: [1-4] 0| licen[sc]e| international)", "", ""),
    ("creative-commons", "commons", "creative commons(?: public)? licen[sc]e", "", ""),
    ("public-domain", "domain", "(?:released|placed|dedicated|put) (?:in|into|to) the public domain|is in the public domain", "", ""),
    ("all-rights-reserved", "reserved", "all rights reserved", "", ""),
    ("proprietary", "proprietary", "proprietary and confidential|proprietary licen[sc]e", "", "unauthorized copying of this file via any medium is strictly prohibited"),
]

#: How a notice leads up to a name.
GRANT = r"(?:(?:is |are |was )?(?:dual )?(?:licen[sc]ed|released|distributed|published|available|provided|made available|offered|covered|governed|shared) (?:under|by|with|as) |under |subject to |pursuant to )(?:the )?(?:terms (?:and conditions )?of )?(?:an? |the )?"
IDENTIFIER = r"spdx licen[sc]e identifier "


def rules() -> list[Rule]:
    """All rules in order: an identifier tag is stronger than a grant, a grant than the licence's own text, that than its bare name."""
    out = []
    for label, keyword, name, ids, sentence in LICENSES:
        if ids:
            out.append(Rule(label, "spdx", rf"(?<= ){IDENTIFIER}(?:{ids})(?= )", 1, 1.0))
        out.append(Rule(label, "spdx", rf"(?<= ){IDENTIFIER}(?:{label.replace('-', ' ').replace('.', ' ')})(?: only| or later)?(?= )", 1, 1.0))
        if ids:
            out.append(Rule(label, ids_keyword(ids), rf"(?<= )(?:licen[sc]ed (?:under|by|as) (?:the )?(?:{ids})|under (?:an? |the )?(?:{ids}) licen[sc]e)(?= )", 3, 0.9))
        out.append(Rule(label, keyword, rf"(?<= ){GRANT}(?:{name})(?= )", 2, 0.95))
        if sentence:
            out.append(Rule(label, sentence.split(" ")[-1], rf"(?<= ){sentence}(?= )", 4, 0.9))
        out.append(Rule(label, keyword, rf"(?<= )(?:{name})(?= )", 5, 0.7))
    return out


def ids_keyword(ids: str) -> str:
    """A string that every form of an identifier begins with; empty where there is none, and the rule always runs."""
    forms = re.sub(r"\([^()]*\)\??", "", ids).split("|")
    head = re.split(r"[ ?]", forms[0])[0]
    return head if all(f.startswith(head) for f in forms) else ""
