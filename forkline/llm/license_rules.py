"""The signature rules of the license scan, written by hand, strongest first.

Each section has a priority and a confidence; each rule a label, a keyword that every text with a
match holds, a pattern over lower-cased words (one blank between words), and a notice that this
rule alone must find. A pattern is matched between word boundaries. Looking ahead or behind keeps
neighbours out of the interval, so that each part of an expression keeps its own detection.
"""

#: Identifiers as they stand in file headers and package files.
IDENTIFIERS = (
    ("apache-2.0", "apache 2 0", r"apache 2 0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-1.1", "apache 1 1", r"apache 1 1", "SPDX-License-Identifier: Apache-1.1"),
    ("apache-1.0", "apache 1 0", r"apache 1 0", "SPDX-License-Identifier: Apache-1.0"),
    ("mit", "identifier mit", r"(?<=identifier )mit(?! 0| cmu| modern| or)", "// SPDX-License-Identifier: MIT"),
    ("mit", "mit or", r"mit(?= or (?:apache|bsd|gpl|lgpl|mpl|isc|unlicense|zlib)(?!\S))", "license = (MIT OR GPL)"),
    ("mit", " or mit", r"(?<=\d or )mit(?! licen)", "license: Something-7.0 OR MIT"),
    ("mit", "license mit", r"(?<=license )mit(?! licen| or| 0)", '{"license": "MIT"}'),
    ("mit-0", "mit 0", r"(?<=identifier )mit 0", "SPDX-License-Identifier: MIT-0"),
    ("mit-cmu", "mit cmu", r"(?<=identifier )mit cmu", "SPDX-License-Identifier: MIT-CMU"),
    ("mit-modern-variant", "mit modern variant", r"mit modern variant", "SPDX-License-Identifier: MIT-Modern-Variant"),
    ("x11", "identifier x11", r"(?<=identifier )x11", "SPDX-License-Identifier: X11"),
    ("0bsd", "0bsd", r"0bsd", "SPDX-License-Identifier: 0BSD"),
    ("bsd-1-clause", "bsd 1 clause", r"bsd 1 clause", "SPDX-License-Identifier: BSD-1-Clause"),
    ("bsd-2-clause", "bsd 2 clause", r"bsd 2 clause(?! patent| views)", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-2-clause-patent", "bsd 2 clause patent", r"bsd 2 clause patent", "SPDX-License-Identifier: BSD-2-Clause-Patent"),
    ("bsd-2-clause-views", "bsd 2 clause views", r"bsd 2 clause views", "SPDX-License-Identifier: BSD-2-Clause-Views"),
    ("bsd-3-clause", "bsd 3 clause", r"bsd 3 clause(?! clear| lbnl| attribution)", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd-3-clause-clear", "bsd 3 clause clear", r"bsd 3 clause clear", "SPDX-License-Identifier: BSD-3-Clause-Clear"),
    ("bsd-3-clause-lbnl", "bsd 3 clause lbnl", r"bsd 3 clause lbnl", "SPDX-License-Identifier: BSD-3-Clause-LBNL"),
    ("bsd-3-clause-attribution", "bsd 3 clause attribution", r"bsd 3 clause attribution", "SPDX-License-Identifier: BSD-3-Clause-Attribution"),
    ("bsd-4-clause", "bsd 4 clause", r"bsd 4 clause(?: uc)?", "SPDX-License-Identifier: BSD-4-Clause-UC"),
    ("gpl-1.0-only", "gpl 1 0 only", r"gpl 1 0 only", "SPDX-License-Identifier: GPL-1.0-only"),
    ("gpl-1.0-or-later", "gpl 1 0 or later", r"gpl 1 0 or later", "SPDX-License-Identifier: GPL-1.0-or-later"),
    ("gpl-2.0-only", "gpl 2 0 only", r"gpl 2 0 only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl-2.0-or-later", "gpl 2 0 or later", r"gpl 2 0 or later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl-2.0", "gpl 2 0", r"(?<=identifier )gpl 2 0(?! only| or later)", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3.0-only", "gpl 3 0 only", r"gpl 3 0 only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl-3.0-or-later", "gpl 3 0 or later", r"gpl 3 0 or later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-3.0", "gpl 3 0", r"(?<=identifier )gpl 3 0(?! only| or later)", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl-2.0-only", "lgpl 2 0 only", r"lgpl 2 0 only", "SPDX-License-Identifier: LGPL-2.0-only"),
    ("lgpl-2.0-or-later", "lgpl 2 0 or later", r"lgpl 2 0 or later", "SPDX-License-Identifier: LGPL-2.0-or-later"),
    ("lgpl-2.1-only", "lgpl 2 1 only", r"lgpl 2 1 only", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("lgpl-2.1-or-later", "lgpl 2 1 or later", r"lgpl 2 1 or later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("lgpl-3.0-only", "lgpl 3 0 only", r"lgpl 3 0 only", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("lgpl-3.0-or-later", "lgpl 3 0 or later", r"lgpl 3 0 or later", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("agpl-1.0", "agpl 1 0", r"agpl 1 0(?: only| or later)?", "SPDX-License-Identifier: AGPL-1.0-only"),
    ("agpl-3.0-only", "agpl 3 0 only", r"agpl 3 0 only", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("agpl-3.0-or-later", "agpl 3 0 or later", r"agpl 3 0 or later", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("gfdl-1.1", "gfdl 1 1", r"gfdl 1 1(?: only| or later)?", "SPDX-License-Identifier: GFDL-1.1-only"),
    ("gfdl-1.2", "gfdl 1 2", r"gfdl 1 2(?: only| or later)?", "SPDX-License-Identifier: GFDL-1.2-or-later"),
    ("gfdl-1.3", "gfdl 1 3", r"gfdl 1 3(?: only| or later)?", "SPDX-License-Identifier: GFDL-1.3"),
    ("classpath-exception", "classpath exception 2 0", r"classpath exception 2 0", "WITH Classpath-exception-2.0"),
    ("gcc-exception", "gcc exception", r"gcc exception [23] [01]", "WITH GCC-exception-3.1"),
    ("llvm-exception", "llvm exception", r"llvm exception", "WITH LLVM-exception"),
    ("linux-syscall-note", "linux syscall note", r"linux syscall note", "WITH Linux-syscall-note"),
    ("bison-exception", "bison exception", r"bison exception 2 2", "WITH Bison-exception-2.2"),
    ("mpl-1.0", "mpl 1 0", r"mpl 1 0", "SPDX-License-Identifier: MPL-1.0"),
    ("mpl-1.1", "mpl 1 1", r"mpl 1 1", "SPDX-License-Identifier: MPL-1.1"),
    ("mpl-2.0", "mpl 2 0", r"(?<!org )mpl 2 0(?! no copyleft)", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2.0-no-copyleft-exception", "mpl 2 0 no copyleft", r"mpl 2 0 no copyleft exception", "SPDX-License-Identifier: MPL-2.0-no-copyleft-exception"),
    ("epl-1.0", "epl 1 0", r"epl 1 0", "SPDX-License-Identifier: EPL-1.0"),
    ("epl-2.0", "epl 2 0", r"(?<!legal )epl 2 0", "SPDX-License-Identifier: EPL-2.0"),
    ("cddl-1.0", "cddl 1 0", r"cddl 1 0", "SPDX-License-Identifier: CDDL-1.0"),
    ("cddl-1.1", "cddl 1 1", r"cddl 1 1", "SPDX-License-Identifier: CDDL-1.1"),
    ("cpl-1.0", "cpl 1 0", r"cpl 1 0", "SPDX-License-Identifier: CPL-1.0"),
    ("eupl-1.1", "eupl 1 1", r"eupl 1 1", "SPDX-License-Identifier: EUPL-1.1"),
    ("eupl-1.2", "eupl 1 2", r"eupl 1 2", "SPDX-License-Identifier: EUPL-1.2"),
    ("isc", "identifier isc", r"(?<=identifier )isc", "SPDX-License-Identifier: ISC"),
    ("isc", "license isc", r"(?<=license )isc(?! licen)", '{"license": "ISC"}'),
    ("zlib", "identifier zlib", r"(?<=identifier )zlib", "SPDX-License-Identifier: Zlib"),
    ("libpng-2.0", "libpng 2 0", r"libpng 2 0", "SPDX-License-Identifier: libpng-2.0"),
    ("unlicense", "identifier unlicense", r"(?<=identifier )unlicense", "SPDX-License-Identifier: Unlicense"),
    ("wtfpl", "identifier wtfpl", r"(?<=identifier )wtfpl", "SPDX-License-Identifier: WTFPL"),
    ("artistic-1.0", "artistic 1 0", r"artistic 1 0(?: perl| cl8)?", "SPDX-License-Identifier: Artistic-1.0-Perl"),
    ("artistic-2.0", "artistic 2 0", r"artistic 2 0", "SPDX-License-Identifier: Artistic-2.0"),
    ("bsl-1.0", "bsl 1 0", r"bsl 1 0", "SPDX-License-Identifier: BSL-1.0"),
    ("busl-1.1", "busl 1 1", r"busl 1 1", "SPDX-License-Identifier: BUSL-1.1"),
    ("sspl-1.0", "sspl 1 0", r"sspl 1 0", "SPDX-License-Identifier: SSPL-1.0"),
    ("elastic-2.0", "elastic 2 0", r"elastic 2 0", "SPDX-License-Identifier: Elastic-2.0"),
    ("ofl-1.0", "ofl 1 0", r"ofl 1 0(?: rfn| no rfn)?", "SPDX-License-Identifier: OFL-1.0"),
    ("ofl-1.1", "ofl 1 1", r"ofl 1 1(?: rfn| no rfn)?", "SPDX-License-Identifier: OFL-1.1-no-RFN"),
    ("psf-2.0", "psf 2 0", r"psf 2 0", "SPDX-License-Identifier: PSF-2.0"),
    ("python-2.0", "python 2 0", r"(?<=identifier )python 2 0(?: 1)?", "SPDX-License-Identifier: Python-2.0.1"),
    ("php-3.0", "php 3 0", r"php 3 0(?!1)", "SPDX-License-Identifier: PHP-3.0"),
    ("php-3.01", "php 3 01", r"php 3 01", "SPDX-License-Identifier: PHP-3.01"),
    ("ruby", "identifier ruby", r"(?<=identifier )ruby", "SPDX-License-Identifier: Ruby"),
    ("postgresql", "identifier postgresql", r"(?<=identifier )postgresql", "SPDX-License-Identifier: PostgreSQL"),
    ("ncsa", "identifier ncsa", r"(?<=identifier )ncsa", "SPDX-License-Identifier: NCSA"),
    ("openssl", "identifier openssl", r"(?<=identifier )openssl", "SPDX-License-Identifier: OpenSSL"),
    ("curl", "identifier curl", r"(?<=identifier )curl", "SPDX-License-Identifier: curl"),
    ("vim", "identifier vim", r"(?<=identifier )vim", "SPDX-License-Identifier: Vim"),
    ("w3c", "identifier w3c", r"(?<=identifier )w3c(?: 20150513| 19980720)?", "SPDX-License-Identifier: W3C-20150513"),
    ("ijg", "identifier ijg", r"(?<=identifier )ijg", "SPDX-License-Identifier: IJG"),
    ("tcl", "identifier tcl", r"(?<=identifier )tcl", "SPDX-License-Identifier: TCL"),
    ("ntp", "identifier ntp", r"(?<=identifier )ntp", "SPDX-License-Identifier: NTP"),
    ("icu", "identifier icu", r"(?<=identifier )icu", "SPDX-License-Identifier: ICU"),
    ("hpnd", "identifier hpnd", r"(?<=identifier )hpnd", "SPDX-License-Identifier: HPND"),
    ("json", "identifier json", r"(?<=identifier )json", "SPDX-License-Identifier: JSON"),
    ("beerware", "identifier beerware", r"(?<=identifier )beerware", "SPDX-License-Identifier: Beerware"),
    ("bzip2-1.0.6", "bzip2 1 0 6", r"bzip2 1 0 6", "SPDX-License-Identifier: bzip2-1.0.6"),
    ("ms-pl", "identifier ms pl", r"(?<=identifier )ms pl", "SPDX-License-Identifier: MS-PL"),
    ("ms-rl", "identifier ms rl", r"(?<=identifier )ms rl", "SPDX-License-Identifier: MS-RL"),
    ("cecill-2.1", "cecill 2 1", r"cecill 2 1", "SPDX-License-Identifier: CECILL-2.1"),
    ("cecill-b", "cecill b", r"cecill b", "SPDX-License-Identifier: CECILL-B"),
    ("cecill-c", "cecill c", r"cecill c", "SPDX-License-Identifier: CECILL-C"),
    ("afl-3.0", "afl 3 0", r"afl 3 0", "SPDX-License-Identifier: AFL-3.0"),
    ("osl-3.0", "osl 3 0", r"osl 3 0", "SPDX-License-Identifier: OSL-3.0"),
    ("upl-1.0", "upl 1 0", r"upl 1 0", "SPDX-License-Identifier: UPL-1.0"),
    ("ecl-2.0", "ecl 2 0", r"ecl 2 0", "SPDX-License-Identifier: ECL-2.0"),
    ("apsl-2.0", "apsl 2 0", r"apsl 2 0", "SPDX-License-Identifier: APSL-2.0"),
    ("lppl-1.3c", "lppl 1 3c", r"lppl 1 3c", "SPDX-License-Identifier: LPPL-1.3c"),
    ("qpl-1.0", "qpl 1 0", r"qpl 1 0", "SPDX-License-Identifier: QPL-1.0"),
    ("zpl-2.1", "zpl 2 1", r"zpl 2 1", "SPDX-License-Identifier: ZPL-2.1"),
    ("nasa-1.3", "nasa 1 3", r"nasa 1 3", "SPDX-License-Identifier: NASA-1.3"),
    ("mulanpsl-2.0", "mulanpsl 2 0", r"mulanpsl 2 0", "SPDX-License-Identifier: MulanPSL-2.0"),
    ("blueoak-1.0.0", "blueoak 1 0 0", r"blueoak 1 0 0", "SPDX-License-Identifier: BlueOak-1.0.0"),
    ("unicode-3.0", "unicode 3 0", r"(?<=identifier )unicode 3 0", "SPDX-License-Identifier: Unicode-3.0"),
    ("unicode-dfs-2016", "unicode dfs 2016", r"unicode dfs 2016", "SPDX-License-Identifier: Unicode-DFS-2016"),
    ("etalab-2.0", "etalab 2 0", r"etalab 2 0", "SPDX-License-Identifier: etalab-2.0"),
    ("ogl-uk-3.0", "ogl uk 3 0", r"ogl uk 3 0", "SPDX-License-Identifier: OGL-UK-3.0"),
    ("dl-de-by-2.0", "dl de by 2 0", r"dl de by 2 0", "SPDX-License-Identifier: DL-DE-BY-2.0"),
    ("cern-ohl-2.0", "cern ohl", r"cern ohl [psw] 2 0", "SPDX-License-Identifier: CERN-OHL-S-2.0"),
    ("polyform-noncommercial-1.0.0", "polyform noncommercial 1 0 0", r"polyform noncommercial 1 0 0", "SPDX-License-Identifier: PolyForm-Noncommercial-1.0.0"),
    ("polyform-small-business-1.0.0", "polyform small business 1 0 0", r"polyform small business 1 0 0", "SPDX-License-Identifier: PolyForm-Small-Business-1.0.0"),
    ("cc0-1.0", "cc0 1 0", r"cc0 1 0(?! universal)", "SPDX-License-Identifier: CC0-1.0"),
    ("cc-pddc", "cc pddc", r"cc pddc", "SPDX-License-Identifier: CC-PDDC"),
    ("pddl-1.0", "pddl 1 0", r"pddl 1 0", "SPDX-License-Identifier: PDDL-1.0"),
    ("odbl-1.0", "odbl 1 0", r"odbl 1 0", "SPDX-License-Identifier: ODbL-1.0"),
    ("odc-by-1.0", "odc by 1 0", r"odc by 1 0", "SPDX-License-Identifier: ODC-By-1.0"),
    ("cdla-permissive", "cdla permissive", r"cdla permissive [12] 0", "SPDX-License-Identifier: CDLA-Permissive-2.0"),
    ("cdla-sharing-1.0", "cdla sharing 1 0", r"cdla sharing 1 0", "SPDX-License-Identifier: CDLA-Sharing-1.0"),
    ("creativeml-openrail-m", "creativeml openrail m", r"creativeml openrail m", "license: creativeml-openrail-m"),
    ("bigscience-openrail-m", "bigscience openrail m", r"bigscience openrail m", "license: bigscience-openrail-m"),
)

#: Sentences of the licence texts and of the notices that they ask for.
SENTENCES = (
    ("apache-2.0", "licensed under the apache", r"licensed under the apache licen[cs]e version 2 0", "Licensed under the Apache License, Version 2.0 (the"),
    ("apache-2.0", "apache org licenses license 2 0", r"www apache org licenses license 2 0", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "you may not use this file except in compliance", r"you may not use this file except in compliance with the license", "you may not use this file except in compliance with the License."),
    ("apache-2.0", "terms and conditions for use reproduction", r"terms and conditions for use reproduction and distribution", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("mit", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "copyright notice and this permission notice shall", r"copyright notice and this permission notice shall be included in all copies or substantial portions", "The above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("bsl-1.0", "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy"),
    ("isc", "permission to use copy modify and", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission to use copy modify and", r"permission to use copy modify and distribute this software and its documentation for any purpose", "Permission to use, copy, modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source and binary", r"redistribution and use in source and binary forms with or without modification are permitted", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "neither the name of", r"neither the names? of (?:\S+ ){1,12}?may be used to endorse or promote products", "Neither the name of the Example Project nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning", r"all advertising materials mentioning features or use of this software", "All advertising materials mentioning features or use of this software"),
    ("gpl", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published"),
    ("lgpl", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published"),
    ("agpl", "redistribute it and or modify", r"redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published"),
    ("gpl-1.0-or-later", "either version 1", r"either version 1(?: of the licen[cs]e)? or (?:at your option )?any later version", "either version 1, or (at your option) any later version"),
    ("gpl-2.0-or-later", "either version 2", r"either version 2 of the licen[cs]e or (?:at your option )?any later version", "either version 2 of the License, or (at your option) any later version"),
    ("lgpl-2.1-or-later", "either version 2 1", r"either version 2 1 of the licen[cs]e or (?:at your option )?any later version", "either version 2.1 of the License, or (at your option) any later version"),
    ("gpl-3.0-or-later", "either version 3", r"either version 3 of the licen[cs]e or (?:at your option )?any later version", "either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0-only", "as published by the free software foundation", r"version 2 as published by the free software foundation", "version 2 as published by the Free Software Foundation."),
    ("gpl-3.0-only", "as published by the free software foundation", r"version 3 as published by the free software foundation", "version 3 as published by the Free Software Foundation."),
    ("gpl-2.0", "licensed under the", r"(?:is |are )?licensed under the (?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?", "is licensed under the GNU General Public License v2"),
    ("gpl-3.0", "licensed under the", r"(?:is |are )?licensed under the (?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?", "are licensed under the GNU General Public License v3"),
    ("lgpl", "licensed under the", r"(?:is |are )?licensed under the (?:gnu )?lesser general public licen[cs]e(?! version| v?[23])", "is licensed under the GNU Lesser General Public License"),
    ("gpl", "received a copy of the gnu general", r"received a copy of the gnu general public licen[cs]e along with", "You should have received a copy of the GNU General Public License along with"),
    ("gpl", "gnu org licenses gpl", r"www gnu org licenses gpl(?: [23] 0)?(?: html| txt)?", "https://www.gnu.org/licenses/gpl.html"),
    ("lgpl", "gnu org licenses lgpl", r"www gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?", "https://www.gnu.org/licenses/lgpl-2.1.html"),
    ("agpl", "gnu org licenses agpl", r"www gnu org licenses agpl(?: 3 0)?(?: html| txt)?", "https://www.gnu.org/licenses/agpl-3.0.html"),
    ("gfdl", "permission is granted to copy distribute", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"),
    ("mpl-2.0", "subject to the terms of the mozilla", r"subject to the terms of the mozilla public licen[cs]e v 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "mozilla org mpl 2 0", r"mozilla org mpl 2 0", "https://mozilla.org/MPL/2.0/"),
    ("mpl-1.1", "mozilla org mpl", r"mozilla org mpl(?: mpl 1 1 html)?(?! 2 0)", "http://www.mozilla.org/MPL/"),
    ("epl-2.0", "eclipse org legal epl 2 0", r"eclipse org legal epl 2 0", "https://www.eclipse.org/legal/epl-2.0/"),
    ("epl-1.0", "eclipse org legal epl v10", r"eclipse org legal epl v10(?: html)?", "http://www.eclipse.org/legal/epl-v10.html"),
    ("zlib", "this software is provided as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable"),
    ("zlib", "altered source versions must be", r"altered source versions must be plainly marked as such", "Altered source versions must be plainly marked as such"),
    ("unlicense", "free and unencumbered software", r"this is free and unencumbered software released into the public domain", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "unlicense org", r"unlicense org", "<https://unlicense.org/>"),
    ("wtfpl", "do what the fuck you want to", r"you just do what the fuck you want to", "0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("beerware", "you can buy me a beer", r"you can buy me a beer in return", "you can buy me a beer in return"),
    ("json", "shall be used for good not evil", r"the software shall be used for good not evil", "The Software shall be used for Good, not Evil."),
    ("bsl-1.0", "boost org license 1 0", r"www boost org license 1 0 txt", "http://www.boost.org/LICENSE_1_0.txt"),
    ("ofl-1.1", "scripts sil org ofl", r"scripts sil org ofl", "https://scripts.sil.org/OFL"),
    ("openssl", "developed by the openssl project", r"includes software developed by the openssl project", "This product includes software developed by the OpenSSL Project"),
    ("php-3.01", "php net license 3 01", r"www php net license 3 01 txt", "http://www.php.net/license/3_01.txt"),
    ("ncsa", "university of illinois ncsa open source", r"university of illinois ncsa open source licen[cs]e", "University of Illinois/NCSA Open Source License"),
    ("cc0-1.0", "creativecommons org publicdomain zero", r"creativecommons org publicdomain zero 1 0", "https://creativecommons.org/publicdomain/zero/1.0/"),
    ("public-domain-mark", "creativecommons org publicdomain mark", r"creativecommons org publicdomain mark 1 0", "https://creativecommons.org/publicdomain/mark/1.0/"),
    ("cc-by", "creativecommons org licenses by", r"creativecommons org licenses by(?! sa| nc| nd)(?: \d \d)?", "https://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa", "creativecommons org licenses by sa", r"creativecommons org licenses by sa(?: \d \d)?", "https://creativecommons.org/licenses/by-sa/3.0/"),
    ("cc-by-nd", "creativecommons org licenses by nd", r"creativecommons org licenses by nd(?: \d \d)?", "https://creativecommons.org/licenses/by-nd/4.0/"),
    ("cc-by-nc", "creativecommons org licenses by nc", r"creativecommons org licenses by nc(?! sa| nd)(?: \d \d)?", "https://creativecommons.org/licenses/by-nc/4.0/"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", r"creativecommons org licenses by nc sa(?: \d \d)?", "https://creativecommons.org/licenses/by-nc-sa/4.0/"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", r"creativecommons org licenses by nc nd(?: \d \d)?", "https://creativecommons.org/licenses/by-nc-nd/4.0/"),
    ("proprietary", "proprietary and confidential", r"(?:unauthorized copying of this file via any medium is strictly prohibited )?proprietary and confidential", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential"),
    ("no-redistribution", "may not be reproduced", r"may not be reproduced (?:or )?(?:distributed |redistributed )?(?:\S+ ){0,6}?without (?:the )?(?:prior |express )*(?:written )?permission", "may not be reproduced in any form without prior written permission"),
    ("no-text-mining", "text and data mining", r"rights? (?:for|to) (?:use this work for )?text and data mining (?:are|is) reserved", "rights for text and data mining are reserved"),
    ("no-ai-training", "train artificial intelligence", r"may not be used to train artificial intelligence", "This work may not be used to train artificial intelligence"),
)

#: Titles with their version.
VERSIONED = (
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?", "Apache License v2"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version )?1 1", "Apache Software License, Version 1.1"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e (?:version |v)?3(?: 0)?", "GNU Affero General Public License v3.0"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?", "GNU Lesser General Public License, version 3"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)?2 1", "GNU Lesser General Public License v2.1"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[cs]e (?:version |v)?2(?: 0)?", "GNU Library General Public License, version 2"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)1(?: 0)?", "GNU General Public License, version 1"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?", "GNU General Public License, version 2"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?", "GNU General Public License v3.0"),
    ("gpl-2.0", "of the gnu general", r"version 2 of the gnu general public licen[cs]e", "under version 2 of the GNU General Public License"),
    ("gpl-3.0", "of the gnu general", r"version 3 of the gnu general public licen[cs]e", "under version 3 of the GNU General Public License"),
    ("lgpl-2.1", "of the gnu lesser", r"version 2 1 of the gnu lesser general public licen[cs]e", "under version 2.1 of the GNU Lesser General Public License"),
    ("lgpl-3.0", "of the gnu lesser", r"version 3 of the gnu lesser general public licen[cs]e", "under version 3 of the GNU Lesser General Public License"),
    ("agpl-3.0", "of the gnu affero", r"version 3 of the gnu affero general public licen[cs]e", "under version 3 of the GNU Affero General Public License"),
    ("gfdl-1.2", "free documentation", r"(?:gnu )?free documentation licen[cs]e (?:version |v)?1 2", "GNU Free Documentation License, Version 1.2"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[cs]e (?:version |v)?1 3", "GNU Free Documentation License, Version 1.3"),
    ("bsd-2-clause", "2 clause bsd", r"2 clause bsd(?: licen[cs]e)?", "the 2-clause BSD license"),
    ("bsd-2-clause", "two clause bsd", r"two clause bsd(?: licen[cs]e)?", "the two-clause BSD licence"),
    ("bsd-2-clause", "simplified bsd", r"simplified bsd(?: licen[cs]e)?", "Simplified BSD License"),
    ("bsd-3-clause", "3 clause bsd", r"3 clause bsd(?: licen[cs]e)?", "a 3-clause BSD license"),
    ("bsd-3-clause", "three clause bsd", r"three clause bsd(?: licen[cs]e)?", "three clause BSD"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised) bsd licen[cs]e", "New BSD License"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd licen[cs]e", "the original BSD license"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e (?:version |v ?)?1 0", "Mozilla Public License Version 1.0"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version |v ?)?1 1", "Mozilla Public License 1.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?", "Mozilla Public License, version 2.0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version |v ?)?1 0", "Eclipse Public License v1.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?", "Eclipse Public License - v 2.0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e (?:cddl )?(?:version |v)?1 0", "Common Development and Distribution License (CDDL) Version 1.0"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (?:version )?1(?: 0)?", "Artistic License 1.0"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e (?:version )?2(?: 0)?", "The Artistic License 2.0"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e (?:version )?1 0", "Boost Software License - Version 1.0"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e (?:version |v ?)?1 2", "European Union Public Licence v. 1.2"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e (?:version )?1 1", "SIL Open Font License, Version 1.1"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database licen[cs]e (?:odbl )?(?:version |v)?1 0", "Open Database License v1.0"),
    ("ogl-uk-3.0", "open government", r"open government licen[cs]e (?:version |v)3(?: 0)?", "Open Government Licence v3.0"),
    ("busl-1.1", "business source", r"business source licen[cs]e (?:version )?1 1", "Business Source License 1.1"),
    ("sspl-1.0", "server side public", r"server side public licen[cs]e (?:version |v ?)?1", "Server Side Public License, version 1"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e (?:version )?2(?: 0)?", "Elastic License 2.0"),
    ("cc0-1.0", "cc0", r"cc0 1 0 universal", "CC0 1.0 Universal"),
    ("llama-community", "community license", r"llama [234](?: \d)? community license(?: agreement)?", "LLAMA 2 COMMUNITY LICENSE AGREEMENT"),
    ("creativeml-openrail-m", "creativeml open rail m", r"creativeml open rail m", "CreativeML Open RAIL-M"),
    ("gemma", "gemma terms of use", r"gemma terms of use", "Gemma Terms of Use"),
)

#: Titles without a version, and Creative Commons by its elements.
TITLES = (
    ("apache", "apache", r"apache (?:software )?licen[cs]e", "under the Apache licence"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "GNU Affero General Public License"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", "GNU Lesser General Public License"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[cs]e", "GNU Library General Public Licence"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "the GNU General Public License"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e", "GNU Free Documentation License"),
    ("mit", "mit licen", r"mit licen[cs]ed?", "MIT licensed"),
    ("mit", "expat", r"expat licen[cs]e", "the Expat License"),
    ("x11", "x11 licen", r"x11 licen[cs]e", "X11 License"),
    ("bsd", "bsd", r"bsd (?:style )?licen[cs]e", "a BSD-style license"),
    ("isc", "isc licen", r"isc licen[cs]e", "ISC License"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", "the Mozilla Public License"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", "Eclipse Public License"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", "Common Development and Distribution License"),
    ("cpl", "common public", r"common public licen[cs]e", "Common Public License"),
    ("artistic", "artistic", r"artistic licen[cs]e", "the Artistic License"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e", "Boost Software License"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib/libpng License"),
    ("unlicense", "the unlicense", r"the unlicense", "The Unlicense"),
    ("wtfpl", "do what the fuck", r"do what the fuck you want to public licen[cs]e", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("psf-2.0", "python software", r"python software foundation licen[cs]e", "Python Software Foundation License"),
    ("php", "php licen", r"php licen[cs]e", "The PHP License"),
    ("ruby", "ruby licen", r"ruby licen[cs]e", "Ruby License"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e", "PostgreSQL Licence"),
    ("openssl", "openssl licen", r"openssl licen[cs]e", "OpenSSL License"),
    ("eupl", "european union", r"european union public licen[cs]e", "European Union Public Licence"),
    ("cecill", "cecill", r"cecill (?:free software )?licen[cs]e", "CeCILL Free Software License"),
    ("afl", "academic free", r"academic free licen[cs]e", "Academic Free License"),
    ("osl", "open software licen", r"open software licen[cs]e", "Open Software License"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", "Universal Permissive License"),
    ("lppl", "latex project", r"latex project public licen[cs]e", "LaTeX Project Public License"),
    ("apsl", "apple public source", r"apple public source licen[cs]e", "Apple Public Source License"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", "Microsoft Public License"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", "Microsoft Reciprocal License"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", "SIL Open Font License"),
    ("odbl", "open database", r"open database licen[cs]e", "Open Database License"),
    ("odc-by", "open data commons attribution", r"open data commons attribution licen[cs]e", "Open Data Commons Attribution License"),
    ("pddl", "public domain dedication and", r"public domain dedication and licen[cs]e", "Public Domain Dedication and License"),
    ("ogl", "open government", r"open government licen[cs]e", "Open Government Licence"),
    ("busl", "business source", r"business source licen[cs]e", "Business Source License"),
    ("sspl", "server side public", r"server side public licen[cs]e", "Server Side Public License"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e)?(?: condition)?", "Commons Clause License Condition"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|free trial) licen[cs]e", "PolyForm Shield License"),
    ("mulanpsl", "mulan", r"mulan permissive software licen[cs]e", "Mulan Permissive Software License"),
    ("gpl", "publique générale gnu", r"licence publique générale gnu", "Licence publique générale GNU"),
    ("mit", "mit lizenz", r"mit lizenz", "steht unter der MIT-Lizenz"),
    ("apache", "apache lizenz", r"apache lizenz", "unter der Apache-Lizenz"),
    ("mit", "licencia mit", r"licencia mit", "bajo la licencia MIT"),
    ("mit", "licence mit", r"licence mit(?! licen)", "sous licence MIT"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: \d \d)?", "CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: \d \d)?", "CC BY-NC-ND 4.0"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?! sa| nd)(?: \d \d)?", "CC BY-NC 4.0"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: \d \d)?", "CC BY-SA 3.0"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: \d \d)?", "CC BY-ND 2.0"),
    ("cc-by", "cc by", r"cc by(?! nc| sa| nd)(?: \d \d)?", "CC BY 4.0"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike", "Creative Commons Attribution-NonCommercial-ShareAlike"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s", "Creative Commons Attribution-NonCommercial-NoDerivatives"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?! share| no)", "Creative Commons Attribution Non-Commercial"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike", "Creative Commons Attribution-ShareAlike"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s", "Creative Commons Attribution-NoDerivs"),
    ("cc-by", "creative commons", r"creative commons attribution(?! non| share| no)", "Creative Commons Attribution"),
    ("cc", "creative commons", r"creative commons licen[cs]e", "a Creative Commons license"),
)

#: Acronyms in running text, where a version or what stands before them shows a licence is meant.
ACRONYMS = (
    ("gpl-2.0", "gpl", r"gpl ?(?:version |v ?)?2(?: 0)?", "released as GPLv2"),
    ("gpl-3.0", "gpl", r"gpl ?(?:version |v ?)?3(?: 0)?", "GPL version 3"),
    ("lgpl-2.1", "lgpl", r"lgpl ?(?:version |v ?)?2 1", "LGPL v2.1"),
    ("lgpl-3.0", "lgpl", r"lgpl ?(?:version |v ?)?3(?: 0)?", "LGPLv3"),
    ("agpl-3.0", "agpl", r"agpl ?(?:version |v ?)?3(?: 0)?", "AGPL-3.0"),
    ("mpl-1.1", "mpl", r"mpl ?(?:version |v ?)1 1", "MPL v1.1"),
    ("mpl-2.0", "mpl", r"mpl ?(?:version |v ?)2(?: 0)?", "MPLv2"),
    ("apache-2.0", "apache", r"apache v?2(?! 0)", "Apache 2"),
    ("gpl", "under the gpl", r"(?<=under the )gpl(?! ?(?:version |v ?)?\d)", "distributed under the GPL"),
    ("gpl", "gnu gpl", r"gnu gpl(?! ?(?:version |v ?)?\d)", "the GNU GPL"),
    ("gpl", "gpl licen", r"gpl licen[cs]ed?", "GPL licensed"),
    ("lgpl", "under the lgpl", r"(?<=under the )lgpl(?! ?(?:version |v ?)?\d)", "under the LGPL"),
    ("lgpl", "gnu lgpl", r"gnu lgpl(?! ?(?:version |v ?)?\d)", "GNU LGPL"),
    ("agpl", "under the agpl", r"(?<=under the )agpl(?! ?(?:version |v ?)?\d)", "under the AGPL"),
    ("agpl", "gnu agpl", r"gnu agpl(?! ?(?:version |v ?)?\d)", "GNU AGPL"),
    ("mpl", "under the mpl", r"(?<=under the )mpl(?! ?(?:version |v ?)?\d)", "under the MPL"),
    ("cddl", "under the cddl", r"(?<=under the )cddl(?! ?(?:version |v ?)?\d)", "under the CDDL"),
    ("eupl", "under the eupl", r"(?<=under the )eupl(?! ?(?:version |v ?)?\d)", "under the EUPL"),
    ("odbl", "under the odbl", r"(?<=under the )odbl(?! ?(?:version |v ?)?\d)", "under the ODbL"),
    ("wtfpl", "under the wtfpl", r"(?<=under the )wtfpl", "under the WTFPL"),
    ("ofl", "sil ofl", r"sil ofl", "SIL OFL"),
    ("mit", "under mit", r"(?<=licensed under )mit(?! licen)", "licensed under MIT"),
    ("cc0-1.0", "cc0", r"cc0(?! 1 0)", "CC0"),
)

#: Notices that name no licence.
NOTICES = (
    ("public-domain", "public domain", r"public domain(?! dedication)", "in the public domain"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", "All rights reserved."),
    ("all-rights-reserved", "alle rechte vorbehalten", r"alle rechte vorbehalten", "Alle Rechte vorbehalten"),
    ("all-rights-reserved", "tous droits réservés", r"tous droits réservés", "Tous droits réservés"),
    ("all-rights-reserved", "todos los derechos reservados", r"todos los derechos reservados", "Todos los derechos reservados"),
)

#: Weak signs of a notice, with little weight of their own.
SIGNS = (
    ("copyright", "copyright", r"copyright (?:c |© )?\d{4}(?: \d{4})*", "Copyright (c) 2019-2020"),
    ("copyright", "©", r"(?<!copyright )© \d{4}(?: \d{4})*", "© 2021"),
    ("permission-notice", "permission is hereby granted", r"permission is hereby granted(?! free of charge to any person)", "permission is hereby granted"),
    ("redistribution-notice", "redistribution", r"redistribution (?:and use )?(?:is|are) (?:permitted|prohibited)", "redistribution is permitted"),
    ("warranty-disclaimer", "without warrant", r"without warrant(?:y|ies) of any kind", "without warranty of any kind"),
    ("warranty-disclaimer", "merchantability", r"(?:implied )?warrant(?:y|ies) of merchantability", "implied warranty of MERCHANTABILITY"),
)

#: Priority, confidence and rules of each section.
SECTIONS = (
    (60, 0.99, IDENTIFIERS),
    (50, 0.97, SENTENCES),
    (40, 0.95, VERSIONED),
    (30, 0.85, TITLES),
    (20, 0.8, ACRONYMS),
    (15, 0.6, NOTICES),
    (5, 0.3, SIGNS),
)
