"""License scans: ordered signature rules over normalised words.

A text becomes lower-case words joined by single spaces. One regular expression gates
whole texts, keywords gate each rule, and only then do the rule's patterns run. Places
are word positions; a sweep over them drops detections contained in another one of the
same or a stronger priority. All of it is DataFrame work on single rows: no shuffle, no
Python on executors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.columns import packed, without
from lemmaflow.llm.spans import before_each, let

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License label, keywords (every alternative of the pattern has one as a whole word), and the name as a pattern over normalised words.
NAMES = [
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e(?: v(?:ersion)?)? ?1(?: 1)?"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("mit", "mit", r"mit(?: x11)? licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd freebsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) licen[cs]e"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("0bsd", "bsd 0bsd", r"(?:zero clause bsd|0bsd)(?: licen[cs]e)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: v(?:ersion)?)? ?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("lgpl", "lesser library", r"(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("gpl-2.0", "general", r"(?:gnu )?general public licen[cs]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public licen[cs]e(?: v(?:ersion)?)? ?3(?: 0)?"),
    ("gpl-1.0", "general", r"(?:gnu )?general public licen[cs]e(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e(?: v(?:ersion)?)?(?: ?1 [0-3])?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: v(?:ersion)?)? ?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("cddl-1.0", "cddl cddl1", r"cddl(?: ?1 [01])?(?: licen[cs]e)?"),
    ("cddl", "development", r"common development and distribution licen[cs]e"),
    ("cpl-1.0", "common", r"common public licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("boost-1.0", "boost", r"boost software licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e(?: v(?:ersion)?)? ?1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: v(?:ersion)?)? ?2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?"),
    ("eupl", "european", r"european union public licen[cs]e(?: v(?:ersion)?)?(?: ?1 [0-2])?"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("osl-3.0", "open", r"open software licen[cs]e(?: v(?:ersion)?)?(?: ?3 0)?"),
    ("afl-3.0", "academic", r"academic free licen[cs]e(?: v(?:ersion)?)?(?: ?3 0)?"),
    ("python-2.0", "python psf", r"(?:python software foundation|psf|python) licen[cs]e(?: v(?:ersion)?)?(?: ?2(?: 0)?)?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("php-3.01", "php", r"php licen[cs]e(?: v(?:ersion)?)?(?: ?3 0 ?1?)?"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: v(?:ersion)?)?(?: ?1 1)?"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e"),
    ("odbl", "database", r"open database licen[cs]e"),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?: v(?:ersion)?)?(?: ?1(?: 0)?)?"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: v(?:ersion)?)?(?: ?1 1)?"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by", "cc", r"cc by(?: [1-4] 0)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] 0)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] 0)?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] 0)?"),
    ("public-domain", "domain", r"public domain(?: dedication)?"),
]

# Words that open a license notice.
GRANTS = [r"(?:licensed|relicensed|sublicensed) under", r"(?:released|published|distributed|redistributed) under", r"(?:available|provided|made available) under", r"(?:governed by|subject to|covered by)"]
TERMS = r" (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"

# Sentences and forms of notices, each written for its license: label, keywords (each alternative has one as a whole word), pattern, score.
NOTICES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software", 0.95),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.9),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.8),
    ("mit", "mit", r"mit licensed", 0.8),
    ("mit", "mit", r"(?:dual )?licen[cs]ed (?:under )?mit", 0.8),
    ("mit", "expat", r"expat licen[cs]e", 0.8),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("isc", "disclaims", r"the software is provided as is and the author disclaims all warranties", 0.8),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 0.9),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,80} nor the names of (?:its|their|any) contributors may be used to endorse", 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("bsd", "regents", r"the regents of the university of california", 0.5),
    ("apache-2.0", "apache", r"you may not use this file except in compliance with the licen[cs]e (?:.{1,120} )?apache org licenses licen[cs]e 2 0", 0.95),
    ("apache-2.0", "apache", r"(?:https? )?(?:www )?apache org licenses licen[cs]e 2 0(?: txt| html)?", 0.9),
    ("apache", "asf", r"licen[cs]ed to the apache software foundation asf under one or more contributor", 0.95),
    ("apache-2.0", "basis", r"distributed under the licen[cs]e is distributed on an as is basis", 0.7),
    ("apache-2.0", "asl asl2", r"asl ?2(?: 0)?", 0.6),
    ("apache-2.0", "apache", r"apache 2(?: 0)? licen[cs]ed?", 0.8),
    ("gpl", "free", r"this program is free software you can redistribute it and or modify", 0.9),
    ("gpl", "gpl gpl1 gpl2 gpl3", r"(?:gnu )?gpl(?: v(?:ersion)?)? ?[1-3](?: 0)?(?: only| or later)?", 0.8),
    ("gpl-2.0", "gplv2", r"gplv2(?: or later)?", 0.85),
    ("gpl-3.0", "gplv3", r"gplv3(?: or later)?", 0.85),
    ("gpl", "foundation", r"as published by the free software foundation either version [1-3] of the licen[cs]e", 0.9),
    ("gpl", "gnu", r"gnu org licenses gpl(?: [1-3] 0)?(?: html| txt)?", 0.85),
    ("gpl", "hope", r"distributed in the hope that it will be useful but without any warranty", 0.8),
    ("gpl", "copyleft", r"copyleft licen[cs]e", 0.5),
    ("gpl-classpath", "classpath", r"classpath exception", 0.8),
    ("gpl-linking", "linking", r"as a special exception (?:.{1,60} )?linking", 0.6),
    ("lgpl", "lgpl lgpl2 lgpl3", r"(?:gnu )?lgpl(?: v(?:ersion)?)? ?[23](?: [01])?(?: only| or later)?", 0.8),
    ("lgpl-2.1", "lgplv2", r"lgplv2(?: 1)?(?: or later)?", 0.85),
    ("lgpl-3.0", "lgplv3", r"lgplv3(?: or later)?", 0.85),
    ("lgpl", "lesser lgpl", r"gnu org licenses lgpl|this library is free software you can redistribute it and or modify it under the terms of the gnu lesser", 0.9),
    ("agpl", "agpl agpl3", r"(?:gnu )?agpl(?: v(?:ersion)?)? ?3(?: 0)?(?: only| or later)?", 0.85),
    ("agpl-3.0", "agplv3", r"agplv3(?: or later)?", 0.85),
    ("gfdl", "invariant", r"with no invariant sections", 0.8),
    ("gfdl", "gfdl", r"gfdl(?: 1 [0-3])?", 0.8),
    ("mpl-2.0", "mpl mpl2", r"mpl ?2(?: 0)?", 0.8),
    ("mpl-1.1", "mpl mpl1", r"mpl ?1 1", 0.8),
    ("mpl-2.0", "mozilla", r"subject to the terms of the mozilla public licen[cs]e v 2 0", 0.95),
    ("mpl-2.0", "mozilla", r"(?:https? )?mozilla org mpl 2 0", 0.9),
    ("epl-2.0", "epl epl2", r"epl ?2(?: 0)?", 0.8),
    ("epl-1.0", "epl epl1", r"epl ?1(?: 0)?", 0.8),
    ("epl", "eclipse", r"eclipse org legal epl v[12]0?(?: ?0)?", 0.85),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: v ?1 0)?", 0.85),
    ("cddl-1.0", "cddl", r"subject to the terms of the common development and distribution licen[cs]e (?:.{1,40} )?cddl|dual licensed under cddl", 0.9),
    ("cpl-1.0", "cpl cpl1", r"cpl ?1(?: 0)?", 0.7),
    ("ipl-1.0", "ibm", r"ibm public licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?", 0.85),
    ("spl-1.0", "sun", r"sun public licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?", 0.85),
    ("npl-1.1", "netscape", r"netscape public licen[cs]e(?: v(?:ersion)?)?(?: ?1 [01])?", 0.85),
    ("qpl-1.0", "q", r"q public licen[cs]e(?: v(?:ersion)?)?(?: ?1 0)?", 0.85),
    ("apsl-2.0", "apple", r"apple public source licen[cs]e(?: v(?:ersion)?)?(?: ?2 0)?", 0.85),
    ("nasa-1.3", "nasa", r"nasa open source agreement(?: v(?:ersion)?)?(?: ?1 3)?", 0.85),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", 0.85),
    ("llvm-exception", "llvm", r"(?:with )?llvm exceptions?", 0.8),
    ("intel", "intel", r"intel open source licen[cs]e", 0.8),
    ("x11", "x11", r"x11 licen[cs]e", 0.8),
    ("hpnd", "permission", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose", 0.85),
    ("curl", "curl", r"curl licen[cs]e", 0.8),
    ("libpng", "png", r"png reference library licen[cs]e", 0.8),
    ("libtiff", "libtiff", r"libtiff licen[cs]e", 0.8),
    ("ijg", "jpeg", r"independent jpeg group s? ?software", 0.7),
    ("freetype", "freetype", r"freetype (?:project )?licen[cs]e", 0.85),
    ("bzip2", "bzip2", r"bzip2 licen[cs]e", 0.8),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0.9),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 0.9),
    ("unicode", "unicode", r"unicode (?:data files and software )?licen[cs]e(?: agreement)?", 0.85),
    ("icu", "icu", r"icu licen[cs]e", 0.8),
    ("w3c", "w3c", r"w3c software (?:notice and )?(?:document )?licen[cs]e", 0.85),
    ("ogc", "geospatial", r"open geospatial consortium licen[cs]e", 0.8),
    ("tcl", "tcl", r"tcl(?: tk)? licen[cs]e", 0.8),
    ("perl", "perl", r"(?:under )?the same terms as perl(?: itself)?", 0.85),
    ("artistic-1.0", "clarified", r"clarified artistic licen[cs]e", 0.85),
    ("python-2.0", "cnri", r"cnri python licen[cs]e", 0.85),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: v(?:ersion)?)?(?: ?2 [01])?", 0.85),
    ("php-3.01", "php", r"version 3 01 of the php licen[cs]e", 0.9),
    ("wxwindows", "wxwindows", r"wxwindows library licen[cs]e", 0.85),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", 0.85),
    ("openldap-2.8", "openldap", r"openldap public licen[cs]e(?: v(?:ersion)?)?(?: ?2 8)?", 0.85),
    ("beerware", "beer beerware", r"beer ?ware licen[cs]e|you can buy me a beer in return", 0.85),
    ("wtfpl", "want", r"do what the f[a-z]* you want to", 0.85),
    ("json", "evil", r"the software shall be used for good not evil", 0.95),
    ("unlicense", "encumbered", r"software is not encumbered", 0.95),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 0.95),
    ("cc0-1.0", "waived", r"(?:has|have) waived all copyright and related or neighboring rights", 0.95),
    ("cc0-1.0", "zero", r"creative commons zero", 0.85),
    ("cc-by-4.0", "creativecommons", r"creativecommons org licenses by (?:1 0|2 [05]|3 0|4 0)", 0.9),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa (?:1 0|2 [05]|3 0|4 0)", 0.9),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc (?:1 0|2 [05]|3 0|4 0)", 0.9),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa (?:1 0|2 [05]|3 0|4 0)", 0.9),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd (?:1 0|2 [05]|3 0|4 0)", 0.9),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 0.95),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0", 0.9),
    ("pddl-1.0", "dedication", r"public domain dedication and licen[cs]e", 0.85),
    ("odc-by-1.0", "attribution", r"open data commons attribution licen[cs]e", 0.85),
    ("odbl", "odbl", r"odbl(?: v)?(?: 1)?(?: 0)?", 0.75),
    ("cdla", "community", r"community data licen[cs]e agreement(?: permissive| sharing)?", 0.85),
    ("ogl-uk-3.0", "government", r"open government licen[cs]e(?: v(?:ersion)?)?(?: ?[1-3] 0)?", 0.85),
    ("etalab-2.0", "etalab", r"etalab open licen[cs]e|licence ouverte etalab", 0.85),
    ("cecill-2.1", "cecill", r"cecill(?: [bc])? licen[cs]e(?: v(?:ersion)?)?(?: ?[12](?: [01])?)?|licence cecill", 0.85),
    ("eupl-1.2", "eupl", r"eupl(?: v(?:ersion)?)? 1 [0-2]", 0.85),
    ("mulan-2.0", "mulan", r"mulan psl(?: v ?2)?|mulan permissive software licen[cs]e", 0.85),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: v(?:ersion)?)?(?: ?2 0)?", 0.85),
    ("commons-clause", "clause", r"commons clause licen[cs]e condition", 0.9),
    ("polyform", "polyform", r"polyform (?:noncommercial|shield|strict|small business) licen[cs]e", 0.9),
    ("redis-source-available", "redis", r"redis source available licen[cs]e", 0.9),
    ("bigscience-openrail", "openrail rail", r"(?:bigscience )?open ?rail(?: m)?(?: licen[cs]e)?", 0.8),
    ("llama", "llama llama2 llama3 llama4", r"llama(?: ?[2-4])? community licen[cs]e", 0.85),
    ("shareware", "shareware", r"this (?:program|software) is shareware", 0.7),
    ("freeware", "freeware", r"this (?:program|software) is freeware", 0.7),
    ("non-commercial", "commercial noncommercial", r"(?:for )?non ?commercial (?:use|purposes) only", 0.6),
    ("academic-only", "academic", r"(?:for )?academic (?:use|purposes) only|free for academic use", 0.6),
    ("evaluation-only", "evaluation", r"(?:for )?evaluation (?:use|purposes) only", 0.6),
    ("warranty-disclaimer", "warranty warranties", r"without (?:any )?warrant(?:y|ies)(?: of any kind| expressed or implied)?|no warranty", 0.5),
    ("warranty-disclaimer", "warranties", r"without warranties or conditions of any kind", 0.5),
    ("warranty-disclaimer", "merchantability", r"implied warrant(?:y|ies) of merchantability", 0.5),
    ("liability-disclaimer", "liable", r"in no event shall .{1,80} be liable for any", 0.5),
    ("copyright", "copyright", r"copyright (?:c )?(?:1[89][0-9]{2}|20[0-9]{2})(?: (?:1[89][0-9]{2}|20[0-9]{2}))*", 0.4),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.6),
    ("proprietary", "confidential", r"confidential and proprietary", 0.6),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction)(?: or distribution)? of this .{1,40} is strictly prohibited", 0.7),
    ("proprietary", "eula", r"end user licen[cs]e agreement eula|subject to the eula", 0.6),
    ("reserved", "rights", r"(?:all|some|no) rights reserved", 0.5),
    ("public-domain", "domain", r"dedicated to the public domain", 0.9),
    ("public-domain", "domain", r"(?:is|are|been|placed) (?:hereby )?(?:in|into) the public domain", 0.85),
]

#: A text that none of these stands in has no match of any rule: the words that every pattern needs some of.
GATE = r"licen[cs]|copyright|spdx|rights reserved|creative ?commons|cc (?:by|0)|cc0|general public|public ?domain|permission|redistribution|warrant|proprietary|confidential|free software|free and unencumbered|not encumbered|wtfpl|0bsd|cddl|no attribution|zero clause bsd|as is |advertising materials|sublicense|endorse|regents|apache|as[fl] ?2|gpl|mpl ?[12]| epl|cpl ?1|eupl|gfdl|invariant sections|hope that|classpath exception|special exception|misrepresented|altered source|exceptions?|open source agreement|terms as perl|buy me a beer|you want to|good not evil|software and its documentation|jpeg group|odbl|mulan|open ?rail|shareware|freeware|commercial|academic|evaluation|merchantability|liable|prohibited|eula"


def rules() -> list[dict]:
    """Every name in every notice form; priority 1 is strongest, and order breaks further ties."""
    out = [{"label": label, "keywords": kw.split(), "pattern": p, "priority": 2, "score": s} for label, kw, p, s in NOTICES]
    for label, kw, name in NAMES:
        spdx = " ".join(label.replace(".", " ").replace("-", " ").split())
        out.append({"label": label, "keywords": ["spdx"], "pattern": f"spdx licen[cs]e identifier {spdx}(?: only| or later)?", "priority": 1, "score": 1.0})
        out += [{"label": label, "keywords": kw.split(), "pattern": grant + TERMS + name, "priority": 1, "score": 0.95} for grant in GRANTS]
        out.append({"label": label, "keywords": kw.split(), "pattern": "(?:the )?" + name, "priority": 2, "score": 0.7})
    return [r | {"rank": k, "pattern": f"(?<= )(?:{r['pattern']})(?= )"} for k, r in enumerate(out)]


RULE = "array<struct<label:string,keywords:array<string>,pattern:string,priority:int,score:double,rank:int>>"
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
FOUND = "array<struct<start:int,stop:int,priority:int,rank:int,label:string,score:double>>"


def normalised(text: Column) -> Column:
    """The words, each between single spaces, with a space at both ends; a text without words gives one space."""
    return F.regexp_replace(ascii_lower(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))), NOT_WORD, " ")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z. Other letters may change too where that can't make or break a word: none but two become ASCII letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[\u0130\u212a]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def places(w: Column, rule: Column) -> Column:
    """Word positions of one rule's matches in normalised text ``w``."""
    parts = F.arrays_zip(F.split(w, rule["pattern"], -1).alias("piece"), F.regexp_extract_all(w, rule["pattern"], F.lit(0)).alias("match"))
    found = F.transform(F.filter(parts, lambda x: x["match"].isNotNull()), lambda x: F.struct(spaces(x["piece"]).alias("gap"), spaces(x["match"]).alias("size")))

    def placed(xs: Column) -> Column:
        ahead = before_each(F.transform(xs, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, b: a + b)
        hit = lambda x, a: F.struct((a + x["gap"] - 1).alias("start"), (a + x["gap"] + x["size"]).alias("stop"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["score"].alias("score"))
        return F.zip_with(xs, ahead, hit)

    return let(found, placed)


def outermost(found: Column) -> Column:
    """Drops a detection that lies within an earlier, longer or stronger one of the same or a stronger priority.

    Sorted by start, then longest, then priority and rule order, a detection is covered
    if one before it ends as late: any of priority 1, or any at all for a weaker one.
    """
    key = lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("len"), x["priority"].alias("p"), x["rank"].alias("r"), x.alias("x"))
    ordered = F.transform(F.sort_array(F.transform(found, key)), lambda k: k["x"])

    def swept(xs: Column) -> Column:
        ends = F.transform(xs, lambda x: F.struct(F.when(x["priority"] == 1, x["stop"]).otherwise(F.lit(0)).alias("one"), x["stop"].alias("any")))
        further = lambda a, b: F.struct(F.greatest(a["one"], b["one"]).alias("one"), F.greatest(a["any"], b["any"]).alias("any"))
        seen = before_each(ends, F.struct(F.lit(0).alias("one"), F.lit(0).alias("any")), further)
        judged = F.zip_with(xs, seen, lambda x, s: F.struct(x.alias("x"), (F.when(x["priority"] == 1, s["one"]).otherwise(s["any"]) < x["stop"]).alias("stands")))
        return F.transform(F.filter(judged, lambda y: y["stands"]), lambda y: y["x"])

    return let(ordered, swept)


def scan_licenses(docs: DataFrame, extra_rules: list[dict] | None = None) -> DataFrame:
    """``docs`` with word and phrase counts, the detections that stand, their labels and a score.

    ``detections`` holds (start, stop, priority, rank, label, score) in word positions,
    stop exclusive. ``score`` is that of the surest detection, 0.3 if only a base phrase
    stands, else 0. Null and empty texts have no words: counts 0, places null, labels
    empty. A text's words meet all keywords once; only rules of those that it has are
    tried. ``extra_rules`` pass their own keywords alone, not the gate of the built-in
    ones. Rows are judged one by one, so ties and repeated rows don't matter. Columns of
    ``docs`` stay, apart from those that carry the names added here.
    """
    extra = [{"keywords": [r["keyword"]]} | r if "keyword" in r else r for r in extra_rules or []]
    table = lambda rows: F.from_json(F.lit(json.dumps(rows)), RULE)
    df = docs.select(packed(without(docs, ADDED)), normalised(F.col("text")).alias("w"))
    w = F.col("w")
    base = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    has = w.rlike(base)
    df = df.withColumn("phrases", F.when(has, F.regexp_extract_all("w", F.lit(base), F.lit(0)))).withColumn("between", F.when(has, F.split("w", base, -1)))
    last = spaces(w) - spaces(F.element_at("between", -1)) - spaces(F.element_at("phrases", -1)) - 1
    wanted = lambda rows: F.filter(table(rows), lambda r: F.exists(r["keywords"], lambda k: w.contains(F.concat(F.lit(" "), k, F.lit(" ")))))
    hits = lambda rows: F.flatten(F.transform(wanted(rows), lambda r: places(w, r)))
    none = F.array().cast(FOUND)
    built_in = rules()
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in built_in for k in r["keywords"]})])
    of_words = lambda there: F.flatten(F.transform(F.filter(table(built_in), lambda r: F.arrays_overlap(r["keywords"], there)), lambda r: places(w, r)))
    found = F.when(w.rlike(GATE), let(F.array_intersect(F.split(w, " "), keywords), of_words)).otherwise(none)
    df = df.withColumn("found", F.concat(found, hits(extra)) if extra else found)
    df = df.withColumn("detections", F.when(F.size("found") > 0, outermost(F.col("found"))).otherwise(none))
    label = F.create_map(*[F.lit(v) for kv in BASE.items() for v in kv])
    df = df.withColumn("own", F.when(F.size("phrases") > 0, F.sort_array(F.array_distinct(F.transform("phrases", lambda x: F.element_at(label, x))))).otherwise(F.array().cast("array<string>")))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda x: x["score"])), F.lit(0.0))
    return df.select(
        "row.*",
        F.greatest(spaces(w) - 1, F.lit(0)).cast("bigint").alias("n_words"),
        F.coalesce(F.size("phrases"), F.lit(0)).cast("bigint").alias("n_base"),
        F.when(has, spaces(F.get("between", F.lit(0))) - 1).cast("bigint").alias("first_word"),
        F.when(has, last).cast("bigint").alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("own", F.transform("detections", lambda x: x["label"]))), ",").alias("labels"),
        F.greatest(sure, F.when(has, F.lit(0.3)).otherwise(F.lit(0.0))).alias("score"),
        "detections",
    )
