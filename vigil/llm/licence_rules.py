"""Signature rules of the licence scan, as a plain table.

A pattern is a regular expression over lower-cased words with one space between them; "2.0" is the two words "2 0". It starts
with a fixed word, or a choice of fixed words, its head: the rule is tried only where one of them stands. A rule has a level:
3 for the wording of a licence itself, 2 for a name with its version or a notice that puts something under a licence, 1 for
a bare name or link, 0 for phrases that tell no more than the kind. A detection within one of the same or a higher level says
nothing new. `BASE` phrases are counted on their own as well.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Words that a pattern may span.
SPAN = 40

#: phrase -> label: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: How one puts a work under a licence: these words, and what stands between them and the name of a family below.
GRANT_HEADS = ("licensed", "licenced", "released", "distributed", "redistributed", "published", "available", "provided", "covered")
GRANT = "( [^ ]+){0,3} under( the)?( terms of)?( the)?( [^ ]+){0,2}?"

#: label: the family's names as words, most exact version first. From each come a name (level 1, or 2 with a digit), and a grant.
NAMES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "apache( software)?( license)?( version| v)? v?2( 0)?"),
    ("apache-1.1", "apache( software)?( license)?( version)? 1 1"),
    ("apache-1.0", "apache( software)?( license)?( version)? 1 0"),
    ("apache", "apache( software)? license"),
    ("mit", "mit license"),
    ("mit", "mit licence"),
    ("mit", "expat license"),
    ("mit-0", "mit no attribution"),
    ("x11", "x11 license"),
    ("isc", "isc license"),
    ("isc", "isc licence"),
    ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-2-clause", "simplified bsd"),
    ("bsd-2-clause", "freebsd license"),
    ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-3-clause", "new bsd"),
    ("bsd-3-clause", "modified bsd"),
    ("bsd-4-clause", "bsd 4 clause"),
    ("bsd-4-clause", "original bsd"),
    ("0bsd", "bsd zero clause"),
    ("0bsd", "0bsd"),
    ("bsd", "bsd( style)? licen[cs]e"),
    ("gpl-1.0", "gnu general public license( version| v)? v?1( 0)?"),
    ("gpl-2.0", "gnu general public license( version| v)? v?2( 0)?"),
    ("gpl-2.0", "gnu general public license as published by the free software foundation( either)? version 2"),
    ("gpl-2.0", "(gnu|gpl)( gpl)?( version| v)? v?2( 0)?"),
    ("gpl-2.0", "gplv2"),
    ("gpl-2.0", "gpl2"),
    ("gpl-3.0", "gnu general public license( version| v)? v?3( 0)?"),
    ("gpl-3.0", "gnu general public license as published by the free software foundation( either)? version 3"),
    ("gpl-3.0", "(gnu|gpl)( gpl)?( version| v)? v?3( 0)?"),
    ("gpl-3.0", "gplv3"),
    ("gpl-3.0", "gpl3"),
    ("gpl", "gnu general public licen[cs]e"),
    ("gpl", "gnu gpl"),
    ("lgpl-2.0", "gnu library general public license( version| v)? v?2( 0)?"),
    ("lgpl-2.1", "gnu lesser general public license( version| v)? v?2 1"),
    ("lgpl-2.1", "lgpl( version| v)? v?2 1"),
    ("lgpl-2.1", "lgplv2 1"),
    ("lgpl-3.0", "gnu lesser general public license( version| v)? v?3( 0)?"),
    ("lgpl-3.0", "lgpl( version| v)? v?3( 0)?"),
    ("lgpl-3.0", "lgplv3"),
    ("lgpl", "gnu (lesser|library) general public licen[cs]e"),
    ("lgpl", "lesser general public licen[cs]e"),
    ("lgpl", "lgpl"),
    ("agpl-3.0", "gnu affero general public license( version| v)? v?3( 0)?"),
    ("agpl-3.0", "agpl( version| v)? v?3( 0)?"),
    ("agpl-3.0", "agplv3"),
    ("agpl", "gnu affero general public licen[cs]e"),
    ("agpl", "affero general public licen[cs]e"),
    ("agpl", "agpl"),
    ("gfdl-1.3", "gnu free documentation license( version)? 1 3"),
    ("gfdl-1.2", "gnu free documentation license( version)? 1 2"),
    ("gfdl", "gnu free documentation license"),
    ("gfdl", "gfdl"),
    ("mpl-1.1", "mozilla public license( version| v)? v?1 1"),
    ("mpl-2.0", "mozilla public license( version| v)? v?2( 0)?"),
    ("mpl-2.0", "mpl( version| v)? v?2( 0)?"),
    ("mpl", "mozilla public license"),
    ("epl-1.0", "eclipse public license( version| v)? v?1( 0)?"),
    ("epl-2.0", "eclipse public license( version| v)? v?2( 0)?"),
    ("epl-2.0", "epl 2 0"),
    ("epl", "eclipse public license"),
    ("cddl-1.0", "common development and distribution license( cddl)?( version)? 1 0"),
    ("cddl-1.1", "common development and distribution license( cddl)?( version)? 1 1"),
    ("cddl", "common development and distribution license"),
    ("cpl-1.0", "common public license( version)? 1 0"),
    ("eupl-1.1", "european union public licen[cs]e( version| v)? v?1 1"),
    ("eupl-1.2", "european union public licen[cs]e( version| v)? v?1 2"),
    ("eupl-1.2", "eupl( version| v)? v?1 2"),
    ("eupl", "european union public licen[cs]e"),
    ("artistic-1.0", "artistic license( version)? 1( 0)?"),
    ("artistic-2.0", "artistic license( version)? 2( 0)?"),
    ("artistic", "artistic license"),
    ("bsl-1.0", "boost software license( version)? 1 0"),
    ("bsl-1.0", "boost software license"),
    ("busl-1.1", "business source license( version)? 1 1"),
    ("busl", "business source license"),
    ("sspl-1.0", "server side public license( version| v)? v?1"),
    ("sspl", "server side public license"),
    ("elastic-2.0", "elastic license( version| v)? v?2( 0)?"),
    ("fsl-1.1", "functional source license( version)? 1 1"),
    ("fsl", "functional source license"),
    ("polyform-noncommercial", "polyform noncommercial license"),
    ("polyform-shield", "polyform shield license"),
    ("cc0-1.0", "cc0( 1 0)?"),
    ("cc0-1.0", "creative commons zero"),
    ("cc0-1.0", "creative commons( legal code)? cc0"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("cc-by-nc-sa-3.0", "cc by nc sa 3 0"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("cc-by-nc-nd-3.0", "cc by nc nd 3 0"),
    ("cc-by-nc-nd", "cc by nc nd"),
    ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc-by-nc-3.0", "cc by nc 3 0"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc by sa 3 0"),
    ("cc-by-sa-2.0", "cc by sa 2 0"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-3.0", "cc by 3 0"),
    ("cc-by-2.0", "cc by 2 0"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-sa-4.0", "creative commons attribution non ?commercial share ?alike 4 0"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(ative)?s"),
    ("cc-by-nc-nd-4.0", "creative commons attribution non ?commercial no ?deriv(ative)?s 4 0"),
    ("cc-by-nc", "creative commons attribution non ?commercial"),
    ("cc-by-nc-4.0", "creative commons attribution non ?commercial 4 0"),
    ("cc-by-nd", "creative commons attribution no ?deriv(ative)?s"),
    ("cc-by-sa", "creative commons attribution share ?alike"),
    ("cc-by-sa-4.0", "creative commons attribution share ?alike 4 0"),
    ("cc-by-sa-3.0", "creative commons attribution share ?alike 3 0"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-4.0", "creative commons attribution 4 0"),
    ("cc-by-3.0", "creative commons attribution 3 0"),
    ("creative-commons", "creative commons licen[cs]e"),
    ("unlicense", "the unlicense"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl"),
    ("zlib", "zlib licen[cs]e"),
    ("zlib", "zlib libpng licen[cs]e"),
    ("libpng", "libpng licen[cs]e"),
    ("openssl", "openssl licen[cs]e"),
    ("ssleay", "ssleay licen[cs]e"),
    ("php-3.01", "php licen[cs]e( version)? 3 01"),
    ("php", "php licen[cs]e"),
    ("psf-2.0", "python software foundation license( version)? 2"),
    ("psf", "python software foundation license"),
    ("ruby", "ruby licen[cs]e"),
    ("postgresql", "postgresql licen[cs]e"),
    ("ncsa", "university of illinois( ncsa)? open source license"),
    ("ncsa", "ncsa open source license"),
    ("ms-pl", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license"),
    ("afl-3.0", "academic free license( version| v)? v?3( 0)?"),
    ("afl", "academic free license"),
    ("osl-3.0", "open software license( version| v)? v?3( 0)?"),
    ("osl", "open software license"),
    ("ofl-1.1", "sil open font license( version)? 1 1"),
    ("ofl", "sil open font license"),
    ("ofl", "open font license"),
    ("odbl-1.0", "open database license"),
    ("odc-by-1.0", "open data commons attribution license"),
    ("pddl-1.0", "public domain dedication and license"),
    ("cecill-2.1", "cecill( free software license agreement)?( version)? 2 1"),
    ("cecill", "cecill"),
    ("upl-1.0", "universal permissive license( version| v)? v?1 0"),
    ("upl-1.0", "universal permissive license"),
    ("blueoak-1.0.0", "blue oak model license( version)?( 1 0 0)?"),
    ("mulan-psl-2.0", "mulan permissive software license( v| version)? ?2"),
    ("json", "json licen[cs]e"),
    ("ijg", "independent jpeg group s license"),
    ("vim", "vim licen[cs]e"),
    ("tcl", "tcl tk licen[cs]e"),
    ("w3c", "w3c software( notice and)? license"),
    ("unicode", "unicode license agreement"),
    ("openrail", "openrail( m)?"),
    ("openrail", "responsible ai license"),
    ("llama-community", "llama [0-9 ]*community license"),
    ("commons-clause", "commons clause"),
    ("ogl-uk-3.0", "open government licence v3 0"),
    ("ogl-uk", "open government licence"),
    ("etalab-2.0", "licence ouverte"),
    ("jrl", "java research license"),
    ("oracle-bcl", "oracle binary code license"),
)

#: (label, level, score, pattern): wording of licences, links, tags and generic phrases.
WORDING: tuple[tuple[str, int, float, str], ...] = (
    ("mit", 3, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 3, 0.95, "permission is hereby granted free of charge( [^ ]+){0,8} to deal in the software without restriction"),
    ("mit", 2, 0.8, "above copyright notice and this permission notice shall be included in all copies"),
    ("mit-0", 3, 0.95, "permission is hereby granted free of charge( [^ ]+){0,20} to do so"),
    ("isc", 3, 1.0, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 3, 1.0, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", 3, 1.0, "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("bsd", 3, 0.95, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, 0.8, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 2, 0.8, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 3, 1.0, "neither the names? of( [^ ]+){1,12} may be used to endorse or promote products"),
    ("bsd-4-clause", 3, 1.0, "advertising materials mentioning features or use of this software must display the following"),
    ("apache-2.0", 3, 1.0, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", 3, 0.95, "grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-2.0", 2, 0.8, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 2, 0.9, "apache org licenses license 2 0"),
    ("apache", 1, 0.6, "apache org licenses"),
    ("gpl", 3, 0.95, "program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", 3, 1.0, "program is free software you can redistribute it and or modify it under the terms of the gnu general public license( [^ ]+){1,9} version 2"),
    ("gpl-3.0", 3, 1.0, "program is free software you can redistribute it and or modify it under the terms of the gnu general public license( [^ ]+){1,9} version 3"),
    ("lgpl", 3, 0.95, "library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agpl", 3, 0.95, "program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 2, 0.7, "should have received a copy of the gnu general public license"),
    ("lgpl", 2, 0.7, "should have received a copy of the gnu (lesser|library) general public license"),
    ("agpl", 2, 0.7, "should have received a copy of the gnu affero general public license"),
    ("gpl", 1, 0.6, "gnu org licenses( [^ ]+){0,2}"),
    ("gpl-3.0", 3, 0.9, "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-3.0", 2, 0.9, "gnu org licenses gpl 3 0"),
    ("gpl-2.0", 2, 0.9, "gnu org licenses( old licenses)? gpl 2 0"),
    ("lgpl-3.0", 2, 0.9, "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", 2, 0.9, "gnu org licenses agpl 3 0"),
    ("gpl-linking-exception", 3, 0.9, "special exception the copyright holders( of this library)? give you permission to link"),
    ("gpl-classpath-exception", 2, 0.9, "classpath exception"),
    ("mpl-2.0", 3, 1.0, "source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 3, 1.0, "contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", 2, 0.9, "mozilla org mpl 2 0"),
    ("mpl", 1, 0.6, "mozilla org mpl"),
    ("epl-1.0", 3, 0.95, "accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", 3, 0.95, "accompanying materials are made available under the terms of the eclipse public license v? ?2 0"),
    ("cddl", 3, 0.95, "contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", 3, 1.0, "free and unencumbered software released into the public domain"),
    ("unlicense", 2, 0.9, "unlicense org"),
    ("wtfpl", 3, 1.0, "do what the fuck you want to public license"),
    ("zlib", 3, 1.0, "origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 2, 0.8, "altered source versions must be plainly marked as such"),
    ("bsl-1.0", 3, 1.0, "boost software license version 1 0 august 17th 2003"),
    ("bsl-1.0", 2, 0.9, "boost org license 1 0"),
    ("openssl", 3, 1.0, "product includes software developed by the openssl project"),
    ("ssleay", 3, 1.0, "product includes cryptographic software written by eric young"),
    ("artistic-2.0", 3, 0.9, "package is free software you can redistribute it( [^ ]+){0,8} artistic license 2 0"),
    ("perl", 2, 0.9, "same terms as perl( itself)?"),
    ("ruby", 2, 0.8, "same terms as ruby( itself)?"),
    ("python", 2, 0.8, "same terms as python( itself)?"),
    ("ofl-1.1", 3, 1.0, "font software is licensed under the sil open font license version 1 1"),
    ("ofl", 2, 0.9, "scripts sil org ofl"),
    ("cc0-1.0", 3, 1.0, "waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 2, 0.9, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 2, 0.8, "creativecommons org publicdomain mark"),
    ("cc-by-4.0", 2, 0.9, "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", 2, 0.9, "creativecommons org licenses by 3 0"),
    ("cc-by-2.0", 2, 0.9, "creativecommons org licenses by 2 0"),
    ("cc-by-sa-4.0", 2, 0.9, "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", 2, 0.9, "creativecommons org licenses by sa 3 0"),
    ("cc-by-nd-4.0", 2, 0.9, "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-4.0", 2, 0.9, "creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4.0", 2, 0.9, "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 2, 0.9, "creativecommons org licenses by nc nd 4 0"),
    ("creative-commons", 1, 0.6, "creativecommons org( licenses)?"),
    ("creative-commons", 1, 0.6, "creative commons"),
    ("mit", 2, 0.9, "opensource org licenses mit( license)?"),
    ("bsd-3-clause", 2, 0.9, "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", 2, 0.9, "opensource org licenses bsd 2 clause"),
    ("isc", 2, 0.9, "opensource org licenses isc"),
    ("apache-2.0", 2, 0.9, "opensource org licenses apache 2 0"),
    ("open-source", 1, 0.5, "opensource org licenses"),
    ("open-source", 0, 0.4, "open source licen[cs]e"),
    ("busl-1.1", 3, 0.95, "licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("sspl-1.0", 3, 0.95, "make the functionality of the program or a modified version available to third parties as a service"),
    ("commons-clause", 3, 1.0, "license does not grant to you the right to sell the software"),
    ("json", 3, 1.0, "software shall be used for good not evil"),
    ("beerware", 3, 1.0, "(beer|beerware)( ware)? license"),
    ("beerware", 3, 1.0, "you can buy me a beer in return"),
    ("ncsa", 3, 0.95, "permission is hereby granted free of charge( [^ ]+){0,20} illinois( [^ ]+){0,4}"),
    ("public-domain", 2, 0.8, "dedicated to the public domain"),
    ("public-domain", 2, 0.8, "placed in the public domain"),
    ("public-domain", 2, 0.8, "released (in|into|to) the public domain"),
    ("public-domain", 1, 0.5, "public domain"),
    ("proprietary", 2, 0.8, "(unauthorized|unauthorised) (copying|use|reproduction|distribution)( [^ ]+){0,8} (strictly )?prohibited"),
    ("proprietary", 2, 0.8, "proprietary and confidential"),
    ("proprietary", 2, 0.8, "confidential and proprietary"),
    ("proprietary", 1, 0.6, "proprietary licen[cs]e"),
    ("proprietary", 2, 0.7, "commercial licen[cs]e (is )?required"),
    ("eula", 2, 0.7, "end user licen[cs]e agreement"),
    ("eula", 1, 0.5, "eula"),
    ("non-commercial", 2, 0.7, "non commercial use only"),
    ("non-commercial", 2, 0.7, "noncommercial use only"),
    ("non-commercial", 2, 0.7, "(academic|research|educational|evaluation) (use|purposes) only"),
    ("no-warranty", 2, 0.5, "software is provided as is without warranty of any kind"),
    ("no-warranty", 2, 0.5, "software is provided by the( [^ ]+){1,6} as is"),
    ("no-warranty", 1, 0.4, "without warranty of any kind"),
    ("no-warranty", 1, 0.4, "without any warranty"),
    ("copyright", 1, 0.4, "copyright (c )?(19|20)[0-9][0-9]( (19|20)[0-9][0-9])?( [^ ]+){1,4}"),
    ("copyright", 0, 0.3, "copyright"),
    ("licence-file", 1, 0.5, "see( the)? licen[cs]e( file)?( for( more)? details)?"),
    ("licence-file", 1, 0.5, "found in the licen[cs]e file"),
    ("dual", 2, 0.6, "dual licen[cs]ed"),
    ("dual", 2, 0.6, "licensed under either of"),
)

#: Identifiers in the notation of tags: words of each follow a tag, and are no rule of their own.
TAGS: tuple[str, ...] = (
    "0bsd", "afl-3.0", "agpl-3.0", "apache-1.1", "apache-2.0", "artistic-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "bsl-1.0", "busl-1.1", "cc-by-3.0", "cc-by-4.0", "cc-by-nc-4.0",
    "cc-by-nc-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nd-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc0-1.0", "cddl-1.0", "cddl-1.1", "cecill-2.1", "elastic-2.0", "epl-1.0", "epl-2.0", "eupl-1.2",
    "gfdl-1.3", "gpl-2.0", "gpl-3.0", "isc", "lgpl-2.1", "lgpl-3.0", "mit", "mit-0", "mpl-1.1", "mpl-2.0", "ms-pl", "ncsa", "odbl-1.0", "ofl-1.1", "osl-3.0", "openssl", "php-3.01",
    "postgresql", "psf-2.0", "sspl-1.0", "unlicense", "upl-1.0", "wtfpl", "x11", "zlib",
)


class Rule(NamedTuple):
    """need: a word that the text from the head on has to hold, before the pattern is tried."""

    ord: int
    head: str
    need: str
    label: str
    level: int
    score: float
    pattern: str
    base: bool


def _heads(pattern: str) -> list[str]:
    """The fixed words that a pattern may start with."""
    first = re.match(r"\(([a-z0-9|]+)\)(?= |$|\()|([a-z0-9]+)(?= |$|\()", pattern)
    if not first:
        raise ValueError(f"a pattern starts with a fixed word: {pattern}")
    return (first[1] or first[2]).split("|")


def compiled() -> list[Rule]:
    """All rules in order, one for each head and need. Notices that put something under a licence have the head ""."""
    rows = [(label, 0, 0.5, phrase, True) for phrase, label in BASE.items()]
    rows += [(label, level, score, pattern, False) for label, level, score, pattern in WORDING]
    rows += [(tag, 2, 1.0, f"spdx licen[cs]e identifier {re.sub('[-.]', ' ', tag)}( only| or later)?", False) for tag in TAGS]
    rows += [(label, *((2, 0.8) if re.search("[0-9]$", label) else (1, 0.6)), name, False) for label, name in NAMES]
    plain = [Rule(i, head, "", label, level, score, pattern, base) for i, (label, level, score, pattern, base) in enumerate(rows) for head in _heads(pattern)]
    notice = "|".join(GRANT_HEADS)
    return plain + [Rule(i, "", need, label, 2, 0.9, f"({notice}){GRANT} {name}", False) for i, (label, name) in enumerate(NAMES, len(rows)) for need in _heads(name)]
