"""License scans: ordered signature rules, with DataFrame expressions only.

A text becomes words (runs of letters, digits and non-ASCII characters, A-Z
lower-cased).  Rules are regular expressions over single-space word strings,
with a priority and a weight.  A text must have one of the words that all rules
need, and one of each set of a rule's keywords, before its expression is tried;
the sets are worked out from the expressions, so that every match of a rule has
one of each.  Each match is an interval of
words; an interval that lies inside one of a stronger rule (higher priority, or
equal priority and longer) is suppressed.  Base phrases are never suppressed.

Everything happens inside a row: no shuffle, no explode, and a text without
any of those words costs one pass.

Defined cases: a null text counts as empty: no words, no places, empty label
strings, null first and last word, score 0.  Ties in one place keep both labels
when neither interval is strictly stronger.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, SPDX-style identifier, names of the license (word expressions).
NAMES = [
    ("mit", "mit", "mit( x11)?"),
    ("mit", "x11", "(x11|mit x consortium|expat)"),
    ("mit-0", "mit 0", "mit (0|no attribution)"),
    ("apache-1", "apache 1( [01])?", "apache( software)?( license)?( version)? 1( [01])?"),
    ("apache-2", "apache 2( 0)?", "apache( software)?( license)?( version)? (2|v2)( 0)?"),
    ("bsd-1", "bsd 1 clause", "(bsd 1 clause|1 clause bsd)"),
    ("bsd-2", "bsd 2 clause", "(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd 3 clause", "(bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)"),
    ("bsd-4", "bsd 4 clause", "(bsd 4 clause|4 clause bsd|original bsd)"),
    ("bsd-2-patent", "bsd 2 clause patent", "bsd plus patent"),
    ("0bsd", "0bsd", "(0bsd|zero clause bsd|free public license 1 0 0)"),
    ("gpl-1", "gpl 1( 0)?( only| or later)?", "gnu general public license( as published by the free software foundation)?( either)? version 1"),
    ("gpl-2", "gpl 2( 0)?( only| or later)?", "(gnu )?general public license( as published by the free software foundation)?( either)? (version 2|v2)"),
    ("gpl-3", "gpl 3( 0)?( only| or later)?", "(gnu )?general public license( as published by the free software foundation)?( either)? (version 3|v3)"),
    ("gpl-2", "gpl v2", "(gnu )?(gplv2|gpl (v2|version 2|2))"),
    ("gpl-3", "gpl v3", "(gnu )?(gplv3|gpl (v3|version 3|3))"),
    ("lgpl-2", "lgpl 2( [01])?( only| or later)?", "(gnu )?(lgplv2|lgpl (v2|version 2|2)( 1)?)"),
    ("lgpl-3", "lgpl 3( 0)?( only| or later)?", "(gnu )?(lgplv3|lgpl (v3|version 3|3))"),
    ("lgpl-2", "lgpl 2 1 only", "(gnu )?(lesser|library) general public license( either)? (version 2|v2)( [01])?"),
    ("lgpl-3", "lgpl 3 0 only", "(gnu )?lesser general public license( either)? (version 3|v3)"),
    ("agpl-3", "agpl 3( 0)?( only| or later)?", "(gnu )?(agplv3|agpl (v3|version 3|3))"),
    ("agpl-3", "agpl 3 0 only", "(gnu )?affero general public license( version 3| v3)?"),
    ("agpl-1", "agpl 1( 0)?( only| or later)?", "affero general public license version 1"),
    ("sspl-1", "sspl 1( 0)?", "server side public license( version 1| v1)?"),
    ("busl-1", "busl 1( 1)?", "business source license( 1 1| version 1 1)?"),
    ("elastic-2", "elastic 2( 0)?", "elastic license( version)? 2( 0)?"),
    ("commons-clause", "commons clause", "commons clause( license)?( condition)?( v1 0)?"),
    ("mpl-1", "mpl 1( [01])?", "mozilla public license( version| v)? 1( [01])?"),
    ("mpl-2", "mpl 2( 0)?", "mozilla public license( version| v)? 2( 0)?"),
    ("epl-1", "epl 1( 0)?", "eclipse public license( version| v)? 1( 0)?"),
    ("epl-2", "epl 2( 0)?", "eclipse public license( version| v)? 2( 0)?"),
    ("edl-1", "edl 1( 0)?", "eclipse distribution license( version| v)?( 1 0)?"),
    ("cddl-1", "cddl 1( [01])?", "common development and distribution license"),
    ("cpl-1", "cpl 1( 0)?", "common public license"),
    ("ipl-1", "ipl 1( 0)?", "ibm public license"),
    ("cpal-1", "cpal 1( 0)?", "common public attribution license"),
    ("apsl-2", "apsl 2( 0)?", "apple public source license"),
    ("npl-1", "npl 1( [01])?", "netscape public license"),
    ("spl-1", "spl 1( 0)?", "sun public license"),
    ("sissl", "sissl( 1 2)?", "sun industry standards source license"),
    ("qpl-1", "qpl 1( 0)?", "q public license"),
    ("rpl-1", "rpl 1( [15])?", "reciprocal public license"),
    ("osl-3", "osl 3( 0)?", "open software license( version)? 3( 0)?"),
    ("osl-2", "osl 2( [01])?", "open software license( version)? 2( [01])?"),
    ("afl-3", "afl 3( 0)?", "academic free license( version)? 3( 0)?"),
    ("afl-2", "afl 2( [01])?", "academic free license( version)? 2( [01])?"),
    ("ecl-2", "ecl 2( 0)?", "educational community license( version)?( 2 0)?"),
    ("ncsa", "ncsa", "(ncsa|university of illinois ncsa open source)"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib( libpng)?"),
    ("libpng-2", "libpng 2( 0)?", "libpng"),
    ("ijg", "ijg", "independent jpeg group"),
    ("libtiff", "libtiff", "libtiff"),
    ("curl", "curl", "curl"),
    ("bzip2", "bzip2 1 0 [56]", "bzip2"),
    ("info-zip", "info zip", "info zip"),
    ("boost-1", "bsl 1( 0)?", "boost software license"),
    ("unlicense", "unlicense", "(the )?unlicense"),
    ("wtfpl", "wtfpl", "(wtfpl|do what the fuck you want to public license)"),
    ("beerware", "beerware", "beer ?ware"),
    ("artistic-1", "artistic 1( 0)?( perl| cl8)?", "(artistic license 1( 0)?|the artistic license)"),
    ("artistic-2", "artistic 2( 0)?", "artistic license 2( 0)?"),
    ("clartistic", "clartistic", "clarified artistic license"),
    ("ofl-1", "ofl 1( [01])?", "sil open font license( version)?( 1 [01])?"),
    ("eupl-1", "eupl 1( [012])?", "(eupl|european union public licen[cs]e)"),
    ("cecill-2", "cecill 2( [01])?", "cecill( license)?( version)? 2( [01])?"),
    ("cecill-b", "cecill b", "cecill b"),
    ("cecill-c", "cecill c", "cecill c"),
    ("lppl-1", "lppl 1( [0123])?[abc]?", "latex project public license"),
    ("psf-2", "psf 2( 0)?", "python software foundation license"),
    ("python-2", "python 2( 0)?( 1)?", "python license( version)? 2( 0)?"),
    ("php-3", "php 3( 0)?( 01)?", "php license( version)?( 3 01| 3 0| 3)?"),
    ("ruby", "ruby", "(the )?ruby"),
    ("perl", "perl", "same terms as perl itself"),
    ("tcl", "tcl", "tcl tk"),
    ("vim", "vim", "vim"),
    ("w3c", "w3c( 20150513)?", "w3c( software)?( notice and)?( document)?"),
    ("zpl-2", "zpl 2( [01])?", "zope public license( version)?( 2( [01])?)?"),
    ("postgresql", "postgresql", "postgresql license"),
    ("openssl", "openssl", "openssl license"),
    ("openldap", "oldap 2( [0-8])?", "openldap public license"),
    ("ms-pl", "ms pl", "microsoft public license"),
    ("ms-rl", "ms rl", "microsoft reciprocal license"),
    ("odbl-1", "odbl 1( 0)?", "open database license"),
    ("odc-by-1", "odc by 1( 0)?", "open data commons attribution license"),
    ("pddl-1", "pddl 1( 0)?", "(open data commons public domain dedication|public domain dedication and license)"),
    ("ogl-uk", "ogl uk [123]( 0)?", "open government licen[cs]e( v?[123]( 0)?)?"),
    ("cdla-permissive", "cdla permissive [12]( 0)?", "community data license agreement permissive"),
    ("cdla-sharing", "cdla sharing 1( 0)?", "community data license agreement sharing"),
    ("openrail-m", "openrail m", "(creativeml )?open ?rail( m| m)?"),
    ("llama", "llama [23]", "llama( [23])? community license"),
    ("gfdl-1", "gfdl 1( [123])?( only| or later)?", "(gnu )?free documentation license"),
    ("fal-1", "lal 1( [23])?", "free art license"),
    ("ddl-1", "pdl 1( 0)?", "public documentation license"),
    ("opl-1", "opubl 1( 0)?", "open publication license"),
    ("mulan-2", "mulanpsl 2( 0)?", "mulan (psl|permissive software license)( v2| version 2)?"),
    ("upl-1", "upl 1( 0)?", "universal permissive license"),
    ("blueoak-1", "blueoak 1( 0 0)?", "blue oak model license"),
    ("hippocratic", "hippocratic [23]( [01])?", "hippocratic license"),
    ("parity-7", "parity 7( 0 0)?", "parity public license"),
    ("polyform-nc", "polyform noncommercial 1( 0 0)?", "polyform noncommercial license"),
    ("nasa-1", "nasa 1( 3)?", "nasa open source agreement"),
    ("intel", "intel", "intel open source license"),
    ("nokia", "nokia", "nokia open source license"),
    ("watcom-1", "watcom 1( 0)?", "sybase open watcom public license"),
    ("cc0-1", "cc0 1( 0)?", "cc0( 1 0)?( universal)?"),
    ("cc-by", "cc by [1-4]( [05])?", "(creative commons )?cc by( [1-4]( [05])?)?"),
    ("cc-by-sa", "cc by sa [1-4]( [05])?", "(creative commons )?cc by sa( [1-4]( [05])?)?"),
    ("cc-by-nd", "cc by nd [1-4]( [05])?", "(creative commons )?cc by nd( [1-4]( [05])?)?"),
    ("cc-by-nc", "cc by nc [1-4]( [05])?", "(creative commons )?cc by nc( [1-4]( [05])?)?"),
    ("cc-by-nc-sa", "cc by nc sa [1-4]( [05])?", "(creative commons )?cc by nc sa( [1-4]( [05])?)?"),
    ("cc-by-nc-nd", "cc by nc nd [1-4]( [05])?", "(creative commons )?cc by nc nd( [1-4]( [05])?)?"),
    ("cc-by", "cc by 4 0 international", "creative commons attribution( [1-4] [05])?( international)?( license)?"),
    ("cc-by-sa", "cc by sa 4 0 international", "creative commons attribution share ?alike( [1-4] [05])?( international)?( license)?"),
    ("cc-by-nd", "cc by nd 4 0 international", "creative commons attribution no ?deriv(s|ative works|atives)( [1-4] [05])?( international)?( license)?"),
    ("cc-by-nc", "cc by nc 4 0 international", "creative commons attribution non ?commercial( [1-4] [05])?( international)?( license)?"),
    ("cc-by-nc-sa", "cc by nc sa 4 0 international", "creative commons attribution non ?commercial share ?alike( [1-4] [05])?( international)?( license)?"),
]
#: Ways to mention a license: priority, weight, expression ({n}: name, {i}: identifier).
FORMS = [
    (6, 1.0, "spdx license identifier {i}"),
    (5, 0.95, "(is )?(licensed|released|distributed|available|published|provided|dual licensed)( to you)? (under|subject to) (the )?(terms (and conditions )?of (the )?)?{n}( licen[cs]e)?"),
    (4, 0.9, "(under|subject to|governed by|pursuant to) (the )?(terms (and conditions )?of (the )?)?{n}( licen[cs]e)?"),
    (4, 0.9, "licen[cs]e {n}( licen[cs]e)?"),
    (3, 0.8, "{n} licen[cs]e( (version|v) ?[0-9]+( [0-9]+)?)?"),
]
#: Rules of their own: priority, weight, label, expression.  First sentences of license texts, then notices, then leads.
OWN = [
    (5, 0.95, "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    (5, 0.9, "mit", "the above copyright notice and this permission notice shall be included in all copies"),
    (5, 0.9, "mit", "to deal in the software without restriction including without limitation the rights"),
    (5, 0.95, "boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    (5, 0.95, "ofl-1", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    (5, 0.95, "isc", "permission to use copy modify (and )?(and or )?distribute this software for any purpose with or without fee is hereby granted"),
    (5, 0.9, "0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    (5, 0.9, "bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    (5, 0.9, "bsd", "redistributions of source code must retain the above copyright notice"),
    (5, 0.9, "bsd", "redistributions in binary form must reproduce the above copyright notice"),
    (5, 0.9, "bsd-3", "neither the name of (the copyright holder|the author|the university|the project|the organization)( nor the names of)?( its)?( contributors)?"),
    (5, 0.9, "bsd-4", "all advertising materials mentioning features or use of this software"),
    (5, 0.95, "apache-2", "you may not use this file except in compliance with the license"),
    (5, 0.9, "apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    (5, 0.9, "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (5, 0.9, "lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    (5, 0.8, "gpl", "you should have received a copy of the gnu general public license"),
    (5, 0.8, "lgpl", "you should have received a copy of the gnu (lesser|library) general public license"),
    (5, 0.8, "agpl-3", "you should have received a copy of the gnu affero general public license"),
    (4, 0.8, "gpl-2", "either version 2 of the license or at your option any later version"),
    (4, 0.8, "gpl-3", "either version 3 of the license or at your option any later version"),
    (4, 0.8, "lgpl-2", "either version 2 1 of the license or at your option any later version"),
    (5, 0.95, "mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    (5, 0.9, "mpl-1", "the contents of this file are subject to the mozilla public license"),
    (5, 0.9, "cddl-1", "the contents of this file are subject to the terms of the common development and distribution license"),
    (5, 0.9, "epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (5, 0.9, "zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    (5, 0.9, "zlib", "altered source versions must be plainly marked as such"),
    (5, 0.9, "zlib", "the origin of this software must not be misrepresented"),
    (5, 0.95, "unlicense", "this is free and unencumbered software released into the public domain"),
    (5, 0.9, "wtfpl", "you just do what the fuck you want to"),
    (5, 0.9, "beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    (5, 0.9, "cc0-1", "has waived all copyright and related or neighboring rights"),
    (5, 0.8, "cc0-1", "the person who associated a work with this deed has dedicated the work to the public domain"),
    (4, 0.8, "creative-commons", "this work is licensed under a creative commons"),
    (4, 0.8, "creative-commons", "except where otherwise noted content on this (site|wiki|page) is licensed under"),
    (4, 0.8, "cc-by-sa", "text is available under the creative commons attribution share ?alike license"),
    (5, 0.9, "gfdl-1", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (5, 0.9, "artistic-1", "this is free software you can redistribute it and or modify it under the same terms as (the )?perl"),
    (5, 0.9, "lppl-1", "this work may be distributed and or modified under the conditions of the latex project public license"),
    (5, 0.9, "psf-2", "this license agreement is between the python software foundation"),
    (5, 0.9, "php-3", "this product includes php software freely available from"),
    (5, 0.9, "openssl", "this product includes software developed by the openssl project"),
    (5, 0.9, "apache-1", "this product includes software developed by the apache (group|software foundation)"),
    (5, 0.9, "eupl-1", "licensed under the eupl version 1 [012]"),
    (5, 0.9, "w3c", "by obtaining using and or copying this (work|software) you the licensee agree"),
    (5, 0.9, "ncsa", "to deal with the software without restriction"),
    (5, 0.9, "mulan-2", "you can use this software according to the terms and conditions of the mulan psl v2"),
    (5, 0.9, "odbl-1", "is made available under the open database license"),
    (5, 0.9, "ogl-uk", "contains public sector information licen[cs]ed under the open government licen[cs]e"),
    (5, 0.9, "sspl-1", "you must make the service source code available"),
    (5, 0.9, "busl-1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    (5, 0.9, "commons-clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    (4, 0.7, "ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software"),
    (4, 0.7, "proprietary", "this software is the confidential and proprietary information of"),
    (4, 0.7, "proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    (4, 0.7, "proprietary", "no part of this (publication|book|work|document) may be reproduced"),
    (4, 0.7, "proprietary", "by (downloading|installing|using) (this|the) software you agree to (be bound by )?the terms"),
    (4, 0.7, "proprietary", "end user license agreement"),
    (4, 0.7, "proprietary", "for internal use only"),
    (4, 0.7, "us-government", "this is a work of the (u s|us|united states) government"),
    (4, 0.7, "us-government", "not subject to copyright protection in the united states"),
    (3, 0.7, "non-commercial", "for (non ?commercial|personal)( and educational)?( use| purposes)? only"),
    (3, 0.7, "non-commercial", "(may|can) not be used for commercial purposes"),
    (3, 0.7, "research-only", "for (academic|research)( and educational)? (use|purposes) only"),
    (3, 0.7, "no-derivatives", "no derivative works( are)? (allowed|permitted)"),
    (3, 0.6, "no-ai-training", "(may|must|can) not be used (to train|for training) (machine learning|artificial intelligence|ai|language) (models|systems)"),
    (3, 0.6, "freeware", "this (software|program) is freeware"),
    (3, 0.6, "shareware", "this (software|program) is shareware"),
    (2, 0.6, "public-domain", "(released|placed|dedicated|is) (in|into|to) the public domain"),
    (2, 0.6, "public-domain", "this (work|file|software|code|document) is public domain"),
    (2, 0.6, "public-domain", "no (copyright|rights) (is )?(claimed|reserved)"),
    (2, 0.6, "gpl", "gnu general public license"),
    (2, 0.6, "gpl", "(under|licensed under) (the )?(gnu )?gpl"),
    (2, 0.6, "lgpl", "gnu lesser general public license"),
    (2, 0.6, "lgpl", "(under|licensed under) (the )?(gnu )?lgpl"),
    (2, 0.6, "agpl-3", "(under|licensed under) (the )?(gnu )?agpl"),
    (2, 0.6, "bsd", "(under )?(the |a )?bsd (style )?licen[cs]e"),
    (2, 0.6, "mit", "(an |the )?mit style licen[cs]e"),
    (2, 0.6, "apache", "(under )?the apache( software)? licen[cs]e"),
    (2, 0.6, "mpl", "mozilla public licen[cs]e"),
    (2, 0.6, "epl", "eclipse public licen[cs]e"),
    (2, 0.6, "creative-commons", "creative commons( public)? licen[cs]e"),
    (2, 0.5, "copyleft", "(strong |weak )?copyleft licen[cs]e"),
    (2, 0.5, "permissive", "permissive (open source |free software )?licen[cs]e"),
    (2, 0.5, "proprietary", "all rights reserved"),
    (2, 0.5, "proprietary", "(proprietary and confidential|confidential and proprietary)"),
    (2, 0.5, "proprietary", "proprietary licen[cs]e"),
    (2, 0.5, "commercial", "(commercial|paid) licen[cs]e (is )?(required|available)"),
    (1, 0.3, "unknown-license", "licensed (under|to you)( the)?"),
    (1, 0.3, "unknown-license", "licenced under( the)?"),
    (1, 0.3, "unknown-license", "(see|read) (the )?(accompanying )?license( file)?( for details)?"),
    (1, 0.3, "unknown-license", "license (terms|text|agreement|header|notice)"),
    (1, 0.3, "unknown-license", "open source licen[cs]e"),
]
BASE_PRIORITY = 9
#: Strings of which every match of a rule has one: a text without any is looked at no further.
GATE = [
    "licen", "spdx ", " under ", "subject to ", "governed by ", "pursuant to ", "public domain", "all rights reserved", "confidential ", "cc by ", "permission ", "redistribution", " software ",
    "copyleft ", "neither the name of ", "altered source ", "the origin of ", "advertising ", "proprietary ", " is public ", "for internal ", "for non", "for personal ", "for academic ", "for research ",
    "be used ", "derivative works ", "no copyright ", "no rights ", "you just do ", "buy me a beer ", "unauthorized copying ", "copyright protection ", "may be reproduced ", "united states government ", " us government ", " u s government ",
    "copyright and related ", "copyright notice ", "is freeware ", "is shareware ", "service source code ",
]


class Rule(NamedTuple):
    priority: int
    weight: float
    label: str
    expression: str

    @property
    def keywords(self) -> tuple[tuple[str, ...], ...]:
        return keywords(self.expression)


#: Words of the forms: sets with one of them are no good first question.
COMMON = ("licen", "under", "subject to", "released", "published", "provided")


def _sequence(text: str, at: int, close: str):
    """Alternatives of a (sub)expression, each a list of (kind, value, optional), and where it ends."""
    branches, items = [], []
    while at < len(text) and text[at] != close:
        c = text[at]
        if c == "|":
            branches.append(items)
            items, at = [], at + 1
            continue
        if c == "(":
            inner, at = _sequence(text, at + 1, ")")
            item = ["group", inner]
        elif c == "[":
            at = text.index("]", at)
            item = ["any", None]
        else:
            item = ["text", c]
        at += 1
        optional = at < len(text) and text[at] == "?"
        at += at < len(text) and text[at] in "?+"
        items.append((*item, optional))
    return [*branches, items], at


def _starts_with_space(branches) -> bool:
    """Whether everything that the branches match starts with a space."""
    return all(bool(items) and not items[0][2] and (items[0][1] == " " if items[0][0] == "text" else items[0][0] == "group" and _starts_with_space(items[0][1])) for items in branches)


def _ends_with_space(branches) -> bool:
    return all(bool(items) and not items[-1][2] and (items[-1][1] == " " if items[-1][0] == "text" else items[-1][0] == "group" and _ends_with_space(items[-1][1])) for items in branches)


def _sets(items, before: bool, after: bool) -> list[tuple[str, ...]]:
    """Sets of strings, of each of which every match of a sequence has one; ``before`` and ``after``: whether spaces surround it."""
    left, right, space = [], [], before
    for kind, value, optional in items:  # is the place before each item surely behind a space, and that after it before one
        left.append(space)
        own = value == " " if kind == "text" else kind == "group" and _ends_with_space(value)
        space = own and (space or not optional)
    space = after
    for kind, value, optional in reversed(items):
        right.append(space)
        own = value == " " if kind == "text" else kind == "group" and _starts_with_space(value)
        space = own and (space or not optional)
    right.reverse()
    out, run, begin = [], "", 0
    for i, (kind, value, optional) in enumerate([*items, ("any", None, False)]):
        if kind == "text" and not optional:
            begin = i if not run else begin
            run += value
            continue
        if run:
            text = (" " if left[begin] and run[0] != " " else "") + run + (" " if right[i - 1] and run[-1] != " " else "")
            out.append((text,))
        run = ""
        if kind == "group" and not optional:
            found = [max(_sets(branch, left[i], right[i]), key=_worth, default=None) for branch in value]
            if None not in found:
                out.append(tuple(dict.fromkeys(k for f in found for k in f)))
    return [x for x in out if min(map(len, x)) > 2]


def _worth(found: tuple[str, ...]):
    return not any(c in k for k in found for c in COMMON), min(map(len, found)), -len(found)


def keywords(expression: str) -> tuple[tuple[str, ...], ...]:
    """Sets of strings, the most telling first: every match of the expression has one of each set (with the spaces around it)."""
    branches, _ = _sequence(expression, 0, "")
    (items,) = branches
    return tuple(sorted(_sets(items, True, True), key=_worth, reverse=True))


def rules() -> list[Rule]:
    """Base phrases, every name in every form, and the rules of their own, strongest first."""
    out = [Rule(BASE_PRIORITY, 1.0, label, phrase) for phrase, label in BASE.items()]
    for label, ident, name in NAMES:
        out += [Rule(p, w, label, form.format(n=f"({name})", i=f"({ident})")) for p, w, form in FORMS]
    out += [Rule(*r) for r in OWN]
    return sorted(out, key=lambda r: -r.priority)


def word_string(text: Column) -> Column:
    """The words, single-spaced, with a space at either end; one space if there are none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), "^  +|  +$", " ")


def _places(words: Column, rule: Column) -> Column:
    """Intervals of words where the rule's expression matches, by marking both ends of each match."""
    marked = F.regexp_replace(words, F.concat(F.lit("(?<= )("), rule["expression"], F.lit(")(?= )")), F.lit("\x01$1\x02"))
    parts = F.split(F.trim(marked), " ")
    at = F.transform(parts, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    first = F.transform(F.filter(at, lambda x: F.startswith(x["w"], F.lit("\x01"))), lambda x: x["i"])
    last = F.transform(F.filter(at, lambda x: F.endswith(x["w"], F.lit("\x02"))), lambda x: x["i"])
    return F.transform(
        F.arrays_zip(first.alias("a"), last.alias("b")),
        lambda x: F.struct(
            x["a"].cast("long").alias("start"), (-x["b"].cast("long")).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["label"].alias("label"), rule["weight"].alias("weight")
        ),
    )


SPAN = "struct<start:bigint,minus_end:bigint,minus_priority:int,label:string,weight:double>"


def _kept(spans: Column) -> Column:
    """Spans (in order of start, then longest, then strongest) that no stronger one contains.

    The fold carries the spans that still reach to where the next one starts.
    """

    def stronger(e, d):
        higher = e["minus_priority"] < d["minus_priority"]
        longer = (e["minus_priority"] == d["minus_priority"]) & ((e["minus_end"] < d["minus_end"]) | (e["start"] < d["start"]))
        return (e["minus_end"] <= d["minus_end"]) & (higher | longer)

    def step(acc, d):
        live = F.filter(acc["live"], lambda e: -e["minus_end"] >= d["start"])
        hidden = F.exists(live, lambda e: stronger(e, d)) & (d["minus_priority"] != -BASE_PRIORITY)
        return F.struct(F.concat(live, F.array(d)).alias("live"), F.when(hidden, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"))

    empty = F.array().cast(f"array<{SPAN}>")
    return F.aggregate(spans, F.struct(empty.alias("live"), empty.alias("out")), step, lambda acc: acc["out"])


def spans(words: Column, table: list[Rule] | None = None) -> Column:
    """All matches of the rules of which a keyword occurs, sorted; no match gives an empty array."""
    table = table or rules()
    families = {}
    for r in table:
        families.setdefault(r.keywords[0], []).append(r)

    def strings(values):
        return F.array(*[F.lit(x) for x in values])

    def rule(r):
        others = F.array(*[strings(x) for x in r.keywords[1:4]]) if len(r.keywords) > 1 else F.array().cast("array<array<string>>")
        return F.struct(F.lit(r.expression).alias("expression"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.weight).alias("weight"), others.alias("others"))

    def has(found):
        return F.exists(found, lambda k: F.contains(words, k))

    literal = F.array(*[F.struct(strings(k).alias("keywords"), F.array(*[rule(r) for r in found]).alias("rules")) for k, found in families.items()])
    hit = F.flatten(F.transform(F.filter(literal, lambda f: has(f["keywords"])), lambda f: f["rules"]))
    hit = F.filter(hit, lambda r: F.forall(r["others"], has))
    found = F.array_sort(F.flatten(F.transform(hit, lambda r: _places(words, r))))
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(words, F.lit(word))
    return F.when(gate, found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """``id, n_words, spans, kept`` for every row; spans have start, minus_end, minus_priority, label, weight."""
    words = docs.select(F.col(id_col).alias("id"), word_string(F.col(text_col)).alias("w"))
    n_spaces = F.length("w") - F.length(F.replace("w", F.lit(" "), F.lit("")))
    found = words.select("id", F.when(F.trim("w") == "", 0).otherwise(n_spaces - 1).cast("long").alias("n_words"), spans(F.col("w"), table).alias("spans"))
    return found.withColumn("kept", F.when(F.size("spans") > 1, _kept(F.col("spans"))).otherwise(F.col("spans")))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last base place, label strings and the score of scanned texts."""
    base = F.filter("kept", lambda s: s["minus_priority"] == -BASE_PRIORITY)

    def joined(found):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda s: s["label"]))), ",")

    weights = F.array_max(F.transform("kept", lambda s: s["weight"]))
    return scanned.withColumn("base", base).select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["start"])).alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["start"])).alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.col("kept")).alias("labels"),
        F.coalesce(weights, F.lit(0.0)).alias("score"),
    )
