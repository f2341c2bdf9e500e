"""Hand-written notices: label, a word that every match holds, and a regular expression over words.

Sentences of licence texts, headers and grants as they are commonly written, one rule each; more specific ones have labels with a version.
"""

from __future__ import annotations

NOTICES = [
    # permissive texts
    ("MIT", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MIT", "noninfringement", "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("MIT", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("MIT", "substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MIT", "holders", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("MIT-0", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software (?:[^ ]+ ){1,60}to do so the software is provided"),
    ("MIT-advertising", "acknowledgement", "include the following acknowledgement in (?:the )?documentation or in the software"),
    ("X11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("X11", "advertising", "except as contained in this notice the names? of (?:[^ ]+ ){1,12}shall not be used in advertising"),
    ("ISC", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0BSD", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("HPND", "supporting", "both that copyright notice and this permission notice appear in supporting documentation"),
    ("HPND", "publicity", "not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("NTP", "suitability", "makes no representations about the suitability (?:of )?this software for any purpose"),
    ("BSD-2-Clause", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD", "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD-3-Clause", "endorse", "neither the name of (?:[^ ]+ ){1,12}may be used to endorse or promote products"),
    ("BSD-3-Clause", "endorse", "the names? of (?:[^ ]+ ){1,10}may not be used to endorse or promote products"),
    ("BSD-3-Clause-Clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("BSD-4-Clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSD-2-Clause-Patent", "patent", "hereby grants to those receiving rights under this license a perpetual worldwide (?:[^ ]+ ){1,8}patent license"),
    ("BSD-2-Clause-Views", "representing", "should not be interpreted as representing official policies either expressed or implied"),
    ("Zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("Zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("Zlib", "arising", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("Libpng", "contributing", "the contributing authors and group 42 inc disclaim all warranties"),
    ("BSL-1.0", "distributed", "distributed under the boost software license"),
    ("BSL-1.0", "executable", "unless such copies or derivative works are solely in the form of machine executable object code"),
    ("Unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("Unlicense", "dedicate", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("WTFPL", "copying", "terms and conditions for copying distribution and modification 0 you just do what"),
    ("Beerware", "beer", "you can buy me a beer in return"),
    ("Beerware", "ware", "the beer ?ware license"),
    ("curl", "promote", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted (?:[^ ]+ ){1,40}shall not be used in advertising or otherwise to promote the sale"),
    ("Apache-1.1", "apache", "this product includes software developed by the apache software foundation"),
    ("Apache-1.1", "apache", "products derived from this software may not be called apache"),
    ("OpenSSL", "openssl", "this product includes software developed by the openssl project"),
    ("SSLeay", "eric", "this product includes cryptographic software written by eric young"),
    ("PHP-3.01", "php", "this product includes php software freely available from"),
    ("Python-2.0", "python", "psf is making python available to licensee on an as is basis"),
    ("PSF-2.0", "licensee", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test"),
    ("CNRI-Python", "cnri", "cnri is making python (?:[^ ]+ ){1,4}available to licensee on an as is basis"),
    ("PostgreSQL", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("NCSA", "software", "to deal with the software without restriction including without limitation the rights to use copy modify merge publish"),
    ("ICU", "provided", "provided that the above copyright notices? and this permission notice appear in all copies of the software and that both"),
    ("Unicode-DFS", "unicode", "to any person obtaining a copy of the unicode data files and any associated documentation"),
    ("W3C", "w3c", "permission to copy modify and distribute this software and its documentation (?:[^ ]+ ){1,40}w3c"),
    ("JSON", "evil", "the software shall be used for good not evil"),
    ("FTL", "freetype", "portions of this software are copyright (?:[^ ]+ ){1,4}the freetype project"),
    ("IJG", "independent", "this software is based in part on the work of the independent jpeg group"),
    ("bzip2", "product", "if you use this software in a product an acknowledgment in the product documentation would be appreciated"),
    ("Info-ZIP", "zip", "redistributions of source code (?:[^ ]+ ){1,40}info zip"),
    ("TCL", "verbatim", "the authors hereby grant permission to use copy modify distribute and license this software (?:[^ ]+ ){1,40}verbatim"),
    ("Vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("Ruby", "duplicate", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate"),
    ("Artistic-1.0", "package", "the intent of this document is to state the conditions under which a package may be copied"),
    ("Artistic-2.0", "package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("Perl", "perl", "(?:this program|this library|this module|it) is free software you can redistribute it and or modify it under the same terms as perl itself"),
    # apache
    ("Apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("Apache-2.0", "contributor", "licensed to the (?:[^ ]+ ){1,6}under one or more contributor license agreements"),
    ("Apache-2.0", "governing", "see the license for the specific language governing permissions and limitations under the license"),
    ("Apache-2.0", "conditions", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("Apache-2.0", "apache", "(?:https? )?(?:www )?apache org licenses license 2 0"),
    ("Apache-2.0", "irrevocable", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    ("Apache-2.0", "contributions", "any contribution intentionally submitted for inclusion in the work by you to the licensor (?:[^ ]+ ){0,30}contributions"),
    # gnu
    ("GPL", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("GPL-2.0", "version", "either version 2 (?:of the license )?or at your option any later version"),
    ("GPL-3.0", "version", "either version 3 (?:of the license )?or at your option any later version"),
    ("GPL-2.0-only", "version", "under the terms of (?:the )?gnu general public license version 2 as published by the free software foundation"),
    ("GPL-3.0-only", "version", "under the terms of (?:the )?gnu general public license version 3 as published by the free software foundation"),
    ("GPL-2.0-only", "version", "version 2 of the gnu general public license only"),
    ("GPL", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("GPL", "received", "you should have received a copy of the gnu general public license along with"),
    ("LGPL", "received", "you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("AGPL", "received", "you should have received a copy of the gnu affero general public license along with"),
    ("LGPL", "redistribute", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("LGPL-2.1", "version", "either version 2 1 of the license or at your option any later version"),
    ("AGPL", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("AGPL-3.0", "remotely", "prominently offer all users interacting with it remotely through a computer network"),
    ("GPL", "verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("GPL", "freedom", "the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change"),
    ("GPL", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("LGPL", "incorporates", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("GPL-3.0", "convey", "you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("GPL-3.0", "installation", "installation information for a user product means any methods procedures authorization keys"),
    ("GPL-2.0", "interactively", "if the modified program normally reads commands interactively when run"),
    ("GFDL", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("GFDL", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("GPL-exception-classpath", "linking", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("GPL-exception-classpath", "exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("GPL-exception-gcc", "runtime", "gcc runtime library exception"),
    ("GPL-exception-linking", "exception", "as a special exception (?:[^ ]+ ){1,12}permission to link (?:the )?(?:code|program|library)"),
    ("GPL-exception-autoconf", "configure", "if you distribute this file as part of a program that contains a configuration script generated by autoconf(?: [^ ]+){0,20} configure"),
    ("GPL", "dual", "dual licensed under (?:the )?(?:[^ ]+ ){1,4}(?:and|or) (?:the )?gpl"),
    # other copyleft
    ("MPL-2.0", "subject", "this source code form is subject to the terms of the mozilla public license"),
    ("MPL-2.0", "obtain", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("MPL-2.0", "secondary", "incompatible with secondary licenses as defined by the mozilla public license"),
    ("MPL-1.1", "subject", "the contents of this file are subject to the mozilla public license"),
    ("MPL-1.1", "alternatively", "alternatively the contents of this file may be used under the terms of (?:either )?the gnu general public license"),
    ("MPL-1.1", "initial", "the initial developer of the original code is"),
    ("NPL", "netscape", "the contents of this file are subject to the netscape public license"),
    ("EPL", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("EPL-1.0", "eclipse", "all rights reserved this program and the accompanying materials (?:[^ ]+ ){1,14}eclipse public license v1 0"),
    ("EPL-2.0", "eclipse", "all rights reserved this program and the accompanying materials (?:[^ ]+ ){1,14}eclipse public license (?:v )?2 0"),
    ("EDL-1.0", "eclipse", "eclipse distribution license(?: v| version)? ?1 0"),
    ("CPL-1.0", "accompanying", "this program and the accompanying materials are made available under the terms of the common public license"),
    ("CDDL", "subject", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("CDDL", "cddl", "you can obtain a copy of the license at (?:[^ ]+ ){1,12}cddl"),
    ("APSL", "apple", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("OSL-3.0", "licensed", "licensed under the open software license version 3 0"),
    ("AFL-3.0", "licensed", "licensed under the academic free license version 3 0"),
    ("RPL", "reciprocal", "reciprocal public license(?: version)?(?: 1 [15])?"),
    ("EUPL", "eupl", "licensed under the eupl"),
    ("CeCILL", "cecill", "this software is governed by the cecill(?: [bc])? license under french law"),
    ("CeCILL", "cecill", "cecill(?: [bc])?(?: version)? 2(?: [01])?"),
    ("SISSL", "industry", "sun industry standards source license"),
    ("SISSL", "sissl", "sissl"),
    ("MS-PL", "microsoft", "this license governs use of the accompanying software (?:[^ ]+ ){0,40}microsoft public license"),
    ("LPPL", "latex", "(?:may be|this work is) (?:distributed|released) (?:and or modified )?under the conditions of the latex project public license"),
    ("LPPL", "maintenance", "this work has the lppl maintenance status"),
    ("Sleepycat", "redistributions", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("QPL", "trolltech", "trolltech as"),
    ("Watcom", "sybase", "sybase open watcom public license"),
    ("OGC", "ogc", "this ogc software and documentation license"),
    # creative commons and data
    ("CC0-1.0", "dedicated", "dedicated (?:the work )?to the public domain"),
    ("CC0-1.0", "waiving", "by waiving all of his or her rights to the work worldwide under copyright law"),
    ("CC-BY", "creativecommons", "creativecommons org licenses by [0-9] [0-9]"),
    ("CC-BY-SA", "creativecommons", "creativecommons org licenses by sa [0-9] [0-9]"),
    ("CC-BY-NC", "creativecommons", "creativecommons org licenses by nc [0-9] [0-9]"),
    ("CC-BY-ND", "creativecommons", "creativecommons org licenses by nd [0-9] [0-9]"),
    ("CC-BY-NC-SA", "creativecommons", "creativecommons org licenses by nc sa [0-9] [0-9]"),
    ("CC-BY-NC-ND", "creativecommons", "creativecommons org licenses by nc nd [0-9] [0-9]"),
    ("CC0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("Public-Domain", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("CC-BY", "creative", "creative commons attribution (?:[0-9] [0-9] )?international license"),
    ("CC-BY", "creative", "creative commons attribution (?:[0-9] [0-9] )?(?:generic|unported) license"),
    ("CC-BY-SA", "creative", "creative commons attribution share ?alike (?:[0-9] [0-9] )?(?:international |unported )?license"),
    ("CC-BY-NC", "creative", "creative commons attribution non ?commercial (?:[0-9] [0-9] )?(?:international |unported )?license"),
    ("CC-BY-ND", "creative", "creative commons attribution no ?deriv(?:ative)?s (?:[0-9] [0-9] )?(?:international |unported )?license"),
    ("CC-BY-NC-SA", "creative", "creative commons attribution non ?commercial share ?alike (?:[0-9] [0-9] )?(?:international |unported )?license"),
    ("CC-BY-NC-ND", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s (?:[0-9] [0-9] )?(?:international |unported )?license"),
    ("CC-BY-SA", "wikipedia", "text is available under the creative commons attribution share ?alike license(?: [^ ]+){0,30} wikipedia"),
    ("CC-BY-SA", "stack", "user contributions licensed under cc by sa(?: [^ ]+){0,20} stack"),
    ("CC", "creative", "some rights reserved(?: [^ ]+){0,4} creative commons"),
    ("ODbL-1.0", "openstreetmap", "openstreetmap contributors(?: [^ ]+){0,12} (?:odbl|open database license)"),
    ("ODbL-1.0", "opendatacommons", "opendatacommons org licenses odbl"),
    ("ODC-By-1.0", "opendatacommons", "opendatacommons org licenses by"),
    ("PDDL-1.0", "opendatacommons", "opendatacommons org licenses pddl"),
    ("CDLA-Permissive", "community", "community data license agreement permissive(?: version)?(?: [12] 0)?"),
    ("CDLA-Sharing", "cdla", "cdla sharing(?: 1 0)?"),
    ("CDLA-Permissive", "cdla", "cdla permissive(?: [12] 0)?"),
    ("OGL-UK", "government", "contains public sector information licensed under the open government licence"),
    ("OGL-UK", "government", "open government licen[cs]e(?: v| version)? ?[123](?: 0)?"),
    ("Etalab", "etalab", "(?:licence ouverte )?etalab(?: 2 0)?"),
    ("DL-DE", "datenlizenz", "datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?"),
    ("NC-research", "noncommercial", "for noncommercial research (?:purposes )?only"),
    ("NC-research", "research", "(?:for )?non commercial research (?:and educational )?(?:use|purposes) only"),
    ("Academic", "academic", "(?:free )?for academic (?:and research )?use only"),
    ("Personal-use", "personal", "for (?:your )?personal (?:and )?non commercial use only"),
    # fonts, media
    ("OFL-1.1", "font", "this font software is licensed under the sil open font license"),
    ("OFL-1.1", "reserved", "with reserved font names?"),
    ("Ubuntu-font", "ubuntu", "ubuntu font licen[cs]e(?: version)?(?: 1 0)?"),
    ("Bitstream-Vera", "bitstream", "bitstream vera is a trademark of bitstream"),
    ("GUST-font", "gust", "gust font license"),
    ("FDL-art", "art", "free art license(?: 1 3)?"),
    # models
    ("OpenRAIL", "responsible", "(?:bigscience |creativeml )?responsible ai license"),
    ("OpenRAIL-M", "creativeml", "creativeml open ?rail(?: m)?"),
    ("Llama-2", "llama", "llama 2 is licensed under the llama 2 community license"),
    ("Llama-3", "llama", "(?:built with|meta) llama 3(?: [0-9])? (?:community )?license(?: agreement)?"),
    ("Gemma", "gemma", "gemma is provided under and subject to the gemma terms of use"),
    ("AI2-ImpACT", "impact", "ai2 impact license"),
    # source available
    ("BUSL-1.1", "additional", "business source license(?: [^ ]+){0,30} additional use grant"),
    ("BUSL-1.1", "change", "effective on the change date (?:or )?(?:[^ ]+ ){0,24}change license"),
    ("SSPL-1.0", "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("Elastic-2.0", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("Commons-Clause", "commons", "commons clause license condition(?: v1 0)?"),
    ("Commons-Clause", "sell", "the license does not grant to you the right to sell the software"),
    ("PolyForm", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license"),
    ("FSL", "functional", "functional source license"),
    ("Confluent", "confluent", "confluent community license"),
    ("Redis-RSAL", "redis", "redis source available license"),
    # public domain, proprietary, terms
    ("Public-Domain", "domain", "(?:is|are|placed|released) (?:in|into) the public domain"),
    ("Public-Domain", "domain", "(?:this work is (?:hereby )?(?:dedicated|given) to|has been (?:placed|put) in) the public domain"),
    ("Public-Domain", "government", "(?:is|as) a work of the (?:united states|u s) government"),
    ("SQLite-blessing", "blessing", "in place of a legal notice here is a blessing"),
    ("Proprietary", "confidential", "proprietary and confidential"),
    ("Proprietary", "unauthorized", "unauthorized copying of this file"),
    ("Proprietary", "trade", "(?:contains|constitutes) (?:[^ ]+ ){0,6}trade secrets? of"),
    ("Proprietary", "prohibited", "(?:reproduction|redistribution|copying|distribution) (?:[^ ]+ ){0,10}strictly prohibited"),
    ("Proprietary", "nondisclosure", "(?:under|subject to) (?:the terms of )?a (?:license|nondisclosure|confidentiality) (?:agreement or )?(?:a )?nondisclosure agreement"),
    ("Proprietary", "disassemble", "you may not reverse engineer decompile or disassemble"),
    ("EULA", "user", "end user licen[cs]e agreement"),
    ("EULA", "eula", "this eula is a legal agreement"),
    ("EULA", "licensor", "the software is licensed not sold(?: [^ ]+){0,30} licensor"),
    ("All-Rights-Reserved", "reserved", "all rights reserved"),
    ("All-Rights-Reserved", "reproduced", "no part of this (?:publication|book|document|work) may be reproduced"),
    ("Copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("Copyright", "copyright", "copyright (?:of|by|belongs to) (?:the )?(?:author|authors|owner|owners|publisher)"),
    ("Copyright", "permission", "(?:reprinted|reproduced|republished|used) with (?:the )?(?:kind )?permission of"),
    ("Open-Access", "access", "this is an open access article distributed under the terms of the creative commons"),
    ("Open-Access", "unrestricted", "which permits unrestricted use distribution and reproduction in any medium provided the original (?:work|author)"),
    ("Gutenberg", "gutenberg", "re use it under the terms of the project gutenberg license"),
    ("Terms", "governed", "use of this (?:web ?)?site is governed by (?:the|our|these) terms"),
]

# Names without a version, which yield to rules that know more.
PLAIN = [
    ("GPL", "gpl", "licensed under (?:the )?gpl"),
    ("GPL", "gpl", "(?:this is|is) gpl licensed"),
    ("LGPL", "lgpl", "licensed under (?:the )?lgpl"),
    ("AGPL", "agpl", "licensed under (?:the )?agpl"),
    ("BSD", "bsd", "bsd style license"),
    ("BSD", "bsd", "licensed under (?:the |a )?bsd"),
    ("MIT", "mit", "licensed under (?:the )?mit"),
    ("Apache", "apache", "licensed under (?:the )?apache"),
]
