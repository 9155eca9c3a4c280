"""Hand-written license signatures over the word stream of a text: lower case, one space between words.

Each is (label, keyword, expression): the keyword is a run of words that every match of the expression holds, so
that a text without it is never searched. Expressions stand in the order in which ties are settled.
"""

#: Sentences of license texts.
TEXTS = (
    ("mit", "hereby granted free", r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?(?: and associated documentation files)?"),
    ("mit", "shall be included in all copies", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "provided as is without", r"the software is provided as is without warranty of any kind(?: express or implied)?"),
    ("mit-0", "no attribution", r"mit no attribution(?: license)?"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions of source code must", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"neither the names? of \S+(?: \S+){0,15} may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "provided by the copyright holders", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", "provided by the regents", r"this software is provided by the regents and contributors as is"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose"),
    ("0bsd", "zero clause bsd", r"(?:bsd )?zero clause bsd(?: license)?"),
    ("isc", "author disclaims all warranties", r"the author disclaims all warranties with regard to this software"),
    ("hpnd", "permission to use copy modify and distribute", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("apache-2.0", "apache org licenses", r"(?:https? )?(?:www )?apache org licenses(?: license 2 0)?(?: txt| html)?"),
    ("apache-2.0", "you may not use this file except in compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "distributed on an as is basis", r"(?:software )?distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license"),
    ("apache", "apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("gpl", "redistribute it and or modify", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it and or modify", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "redistribute it and or modify", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "either version", r"as published by the free software foundation either version [0-9](?: [0-9])? of the license or at your option any later version"),
    ("gpl", "received a copy of the gnu general public license", r"you should have received a copy of the gnu general public license(?: along with this (?:program|software|file|library|package))?"),
    ("lgpl", "received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "received a copy of the gnu library", r"you should have received a copy of the gnu library general public license"),
    ("agpl", "received a copy of the gnu affero", r"you should have received a copy of the gnu affero general public license"),
    ("gpl", "everyone is permitted to copy", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "merchantability or fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "merchantability or fitness", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license"),
    ("gpl-linking-exception", "linking this library statically", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-classpath-exception", "classpath exception", r"(?:with )?classpath exception(?: 2 0)?"),
    ("gpl-gcc-exception", "gcc runtime library exception", r"gcc runtime library exception(?: version 3 1)?"),
    ("gpl-font-exception", "font exception", r"gpl (?:2 0 )?with font exception"),
    ("gpl-bison-exception", "bison exception", r"(?:with )?bison exception(?: 2 2)?"),
    ("gpl-openssl-exception", "combination with the openssl", r"permission to link the code of (?:\S+ ){1,12}in combination with the openssl(?: project s openssl)? library"),
    ("gfdl", "copy distribute and or modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "no invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-1.1", "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org mpl", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl-tri-license", "alternatively the contents of this file", r"alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("npl", "netscape public license", r"netscape public license(?: version 1 [01])?"),
    ("epl-1.0", "accompanying program is provided", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-1.0", "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl v10(?: html)?"),
    ("epl-2.0", "eclipse org legal", r"(?:https? )?(?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?"),
    ("edl-1.0", "eclipse distribution license", r"eclipse distribution license(?: v(?:ersion)?)?(?: 1 0)?"),
    ("cddl", "contents of this file are subject to the terms of the common development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "unlicense org", r"(?:https? )?(?:www )?unlicense org"),
    ("cc0", "waived all copyright", r"(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc0", "publicdomain zero", r"(?:https? )?creativecommons org publicdomain zero 1 0"),
    ("public-domain", "publicdomain mark", r"(?:https? )?creativecommons org publicdomain mark 1 0"),
    ("public-domain", "public domain", r"(?:released|placed|dedicated|donated|put) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"(?:is|are) in the public domain"),
    ("public-domain", "public domain", r"no copyright (?:is )?claimed(?: and)?(?: this)?(?: work)?(?: is)? (?:in the )?public domain"),
    ("us-government-work", "work of the united states government", r"(?:is|are) (?:a )?work of the united states government"),
    ("zlib", "without any express or implied", r"this software is provided as is without any express or implied warranty"),
    ("zlib", "origin of this software must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("boost", "boost org license", r"(?:https? )?(?:www )?boost org license 1 0(?: txt)?"),
    ("boost", "distributed under the boost software license", r"distributed under the boost software license version 1 0 see accompanying file"),
    ("wtfpl", "do what the fuck you want", r"you just do what the fuck you want to"),
    ("wtfpl", "wtfpl net", r"(?:https? )?(?:www )?wtfpl net"),
    ("beerware", "buy me a beer", r"(?:you can )?buy me a beer in return"),
    ("beerware", "the beer ware license", r"the beer ware license(?: revision 42)?"),
    ("artistic", "artistic license", r"same terms as (?:the )?perl(?: 5)?(?: itself)?(?: \S+){0,8} artistic license"),
    ("perl", "same terms as perl", r"(?:under )?the same terms as perl(?: itself| 5)?"),
    ("ofl", "scripts sil org ofl", r"(?:https? )?scripts sil org ofl"),
    ("ofl", "with reserved font", r"with reserved font names?"),
    ("openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "written by eric young", r"this product includes cryptographic software written by eric young"),
    ("apache-1.1", "developed by the apache", r"this product includes software developed by the apache software foundation"),
    ("php", "php net software", r"this product includes php software freely available from (?:https? )?(?:www )?php net software"),
    ("curl", "curl license", r"curl license"),
    ("ncsa", "deal with the software without restriction", r"to deal with the software without restriction"),
    ("ncsa", "open source license", r"(?:university of )?illinois(?: ncsa)? open source license"),
    ("w3c", "w3c software notice", r"w3c software notice and license"),
    ("w3c", "w3c document license", r"w3c document license"),
    ("x11", "of the x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("ibm-pl", "ibm public license", r"ibm public license(?: version 1 0)?"),
    ("sleepycat", "accompanying software that uses", r"how to obtain complete source code for the \S+ software and any accompanying software that uses"),
    ("unicode", "unicode data files", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("icu", "icu license", r"icu license"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("commons-clause", "commons clause", r"commons clause(?: license)?(?: condition)?(?: v(?:ersion)?)?(?: 1 0)?"),
    ("bsl-1.1", "change date", r"change date(?: \S+){1,12} change license"),
    ("sspl", "offering the program as a service", r"offering the program as a service"),
    ("elastic-2.0", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use)(?: license)?(?: 1 0 0)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: license)?"),
    ("llama", "llama", r"llama(?: 2| 3)?(?: 1| 2| 3)? community license(?: agreement)?"),
    ("gemma", "gemma terms of use", r"gemma terms of use"),
    ("rail", "responsible ai", r"responsible ai licenses?"),
)

#: Clauses of license texts.
CLAUSES = (
    ("apache-2.0", "derivative works thereof in any medium", r"you may reproduce and distribute copies of the work or derivative works thereof in any medium(?: with or without modifications)?"),
    ("apache-2.0", "modified files to carry prominent notices", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "perpetual worldwide non exclusive no charge", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent)? ?license"),
    ("apache-2.0", "notice text file as part of its distribution", r"if the work includes a notice text file as part of its distribution"),
    ("apache-2.0", "submission of contributions", r"submission of contributions unless you explicitly state otherwise"),
    ("apache-2.0", "use the trade names trademarks service marks", r"does not grant permission to use the trade names trademarks service marks or product names of the licensor"),
    ("apache-2.0", "granted to you under this license for that work shall terminate", r"any patent licenses? granted to you under this license for that work shall terminate"),
    ("apache-2.0", "patent license to make", r"patent license to make have made use offer to sell sell import and otherwise transfer the work"),
    ("apache-1.1", "end user documentation included with the redistribution", r"the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment"),
    ("apache-1.1", "may not be called apache", r"products derived from this software may not be called apache(?: nor may apache appear in their name)?"),
    ("mit", "without limitation the rights to use copy modify merge", r"including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "in no event shall the authors or copyright holders", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "to deal in the software without restriction", r"to deal in the software without restriction"),
    ("bsd", "in no event shall the copyright", r"in no event shall the copyright (?:holder|owner)s? or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "in no event shall the regents", r"in no event shall the regents or contributors be liable for any direct"),
    ("bsd", "procurement of substitute goods", r"procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("bsd-4-clause", "university of california berkeley and its contributors", r"this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-patent", "patent license", r"patent license to make have made use offer to sell sell import and otherwise transfer this software"),
    ("bsd-2-clause-views", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("isc", "copyright notice and this permission notice appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("hpnd", "not be used in advertising or publicity", r"not be used in advertising or publicity pertaining to distribution of the software without specific(?: written)? prior permission"),
    ("hpnd", "makes no representations about the suitability", r"makes no representations about the suitability of this software for any purpose"),
    ("zlib", "in no event will the authors be held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "may not be removed or altered from any source distribution", r"this notice may not be removed or altered from any source distribution"),
    ("zlib", "alter it and redistribute it freely", r"for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("libpng", "contributing authors and group", r"the contributing authors and group 42 inc disclaim all warranties"),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright (?:c )?(?:[0-9]{4} )?the freetype project"),
    ("info-zip", "info zip", r"info zip is (?:defined as|provided)|redistributions of source code(?: \S+){1,20} info zip"),
    ("bzip2", "acknowledgment in the product documentation", r"if you use this software in a product an acknowledgment in the product documentation would be appreciated"),
    ("openssl", "openssl toolkit", r"software developed by the openssl project for use in the openssl toolkit https? www openssl org"),
    ("openssl", "openssl toolkit and openssl project", r"the names openssl toolkit and openssl project must not be used to endorse"),
    ("openssl", "openssl software foundation", r"prior written permission of the openssl software foundation"),
    ("ssleay", "windows specific code", r"if you include any windows specific code or a derivative thereof from the apps directory"),
    ("boost", "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor"),
    ("boost", "any person or organization obtaining a copy", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("gpl", "freedom to share and change", r"(?:the )?licenses for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl", "when we speak of free software", r"when we speak of free software we are referring to freedom not price"),
    ("gpl", "work based on the program", r"work based on the program means either the program or any derivative work under copyright law"),
    ("gpl", "complete corresponding machine readable source code", r"accompany it with the complete corresponding machine readable source code"),
    ("gpl", "written offer valid for at least three years", r"accompany it with a written offer valid for at least three years"),
    ("gpl", "not required to accept this license", r"you are not required to accept this license since you have not signed it"),
    ("gpl", "do not accept this license", r"these actions are prohibited by law if you do not accept this license"),
    ("gpl", "no warranty for the program", r"because the program is licensed free of charge there is no warranty for the program"),
    ("gpl", "how to apply these terms to your new programs", r"how to apply these terms to your new programs"),
    ("gpl", "comes with absolutely no warranty", r"comes with absolutely no warranty for details type show w"),
    ("gpl", "free software foundation inc", r"write to the free software foundation inc (?:59 temple place|51 franklin st(?:reet)?|675 mass ave)"),
    ("gpl-3", "protecting users legal rights from anti circumvention law", r"protecting users legal rights from anti circumvention law"),
    ("gpl-3", "conveying modified source versions", r"conveying modified source versions"),
    ("gpl-3", "installation information for a user product", r"installation information for a user product means any methods procedures authorization keys"),
    ("lgpl", "derivative work of the library", r"such a work in isolation is not a derivative work of the library"),
    ("lgpl", "work that uses the library", r"a work that uses the library"),
    ("lgpl", "work based on the library", r"a work based on the library means either the library or any derivative work under copyright law"),
    ("lgpl-3", "combined work is a work produced by combining", r"a combined work is a work produced by combining or linking an application with the library"),
    ("agpl", "interacting with it remotely through a computer network", r"all users interacting with it remotely through a computer network"),
    ("agpl", "remote network interaction", r"remote network interaction use with the gnu general public license"),
    ("gpl-autoconf-exception", "generated by autoconf", r"configuration script generated by autoconf you may include it under the same distribution terms"),
    ("gpl-libtool-exception", "program or library that is built using gnu libtool", r"as part of a program or library that is built using gnu libtool"),
    ("gpl-linux-syscall", "user programs that use kernel services", r"this copyright does not cover user programs that use kernel services by normal system calls"),
    ("gfdl", "contains a notice placed by the copyright holder", r"(?:manual or other work(?: in any medium)?|other work) that contains a notice placed by the copyright holder"),
    ("gfdl", "secondary section", r"a secondary section is a named appendix or a front matter section of the document"),
    ("mpl", "covered code", r"covered code means the original code or modifications"),
    ("mpl-1.1", "rights and limitations under the license", r"see the license for the specific language governing rights and limitations under the license"),
    ("mpl-1.1", "initial developer of the original code", r"the initial developer of the original code is"),
    ("mpl-2.0", "incompatible with secondary licenses", r"(?:this source code form is )?incompatible with secondary licenses(?: as defined by the mozilla public license)?"),
    ("mpl-2.0", "larger work means a work that combines covered software", r"larger work means a work that combines covered software with other material"),
    ("epl", "each contributor hereby grants recipient", r"each contributor hereby grants recipient a non exclusive worldwide royalty free (?:copyright|patent) license"),
    ("epl", "commercial contributor", r"if a contributor includes the program in a commercial product offering such contributor (?:the )?commercial contributor|contributor commercial contributor hereby agrees to defend"),
    ("epl-2.0", "made available under the following secondary licenses", r"may also be made available under the following secondary licenses"),
    ("cpl", "common public license", r"the accompanying program is provided under the terms of this common public license"),
    ("cddl", "replace with your own identifying information", r"with the fields enclosed by brackets(?: \S+){0,3} replace with your own identifying information|replace with your own identifying information(?: \S+){0,6} portions copyright"),
    ("cddl", "usr src opensolaris license", r"usr src opensolaris license"),
    ("eupl", "licensed under the eupl", r"licensed under the eupl(?: version 1 [012])?(?: only| or later)?"),
    ("eupl", "joinup ec europa eu", r"(?:https? )?joinup ec europa eu (?:software page|collection) eupl"),
    ("cecill", "cecill", r"governed by the cecill(?: b| c)? license under french law"),
    ("cecill", "cecill info", r"(?:https? )?(?:www )?cecill info"),
    ("osl", "licensed under the open software license", r"licensed under the open software license version [123] [01]"),
    ("afl", "licensed under the academic free license", r"licensed under the academic free license version [123] [012]"),
    ("artistic", "verbatim copies of the source form of the standard version", r"you may make and give away verbatim copies of the source form of the standard version of (?:this|the) package"),
    ("artistic", "standard version refers to such a package", r"standard version refers to such a package"),
    ("artistic", "freely available", r"place your modifications in the public domain or otherwise make them freely available"),
    ("artistic-2.0", "copyright holder for use as the standard version", r"you may distribute your modified version(?: \S+){1,12} copyright holder for use as the standard version|to the copyright holder for use as the standard version"),
    ("ofl", "reserved font name", r"no modified version of the font software may use the reserved font name|reserved font name refers to any names specified as such"),
    ("ofl", "versions of the font software may be", r"original or modified versions of the font software may be (?:bundled|sold)"),
    ("ofl", "may be sold by itself", r"neither the font software nor any of its individual components(?: \S+){1,6} may be sold by itself"),
    ("ofl", "stimulate worldwide development of collaborative font projects", r"goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("bitstream-vera", "bitstream vera", r"bitstream vera is a trademark of bitstream|the font software may be modified(?: \S+){1,12} bitstream vera"),
    ("psf", "python software foundation", r"this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("psf", "psf is making python available to licensee", r"psf is making python available to licensee on an as is basis"),
    ("cnri", "corporation for national research initiatives", r"between the corporation for national research initiatives having an office at 1895 preston white drive"),
    ("php", "php", r"products derived from this software may not be called php nor may php appear in their name"),
    ("ruby", "place your modifications", r"you may modify your copy of the software in any way provided that(?: \S+){1,12} place your modifications"),
    ("vim", "vim maintainer", r"(?:the vim maintainer|a vim maintainer)"),
    ("tcl", "regents of the university of california sun microsystems", r"copyrighted by the regents of the university of california sun microsystems(?: inc)? scriptics"),
    ("postgresql", "in no event shall the university of california be liable", r"in no event shall the university of california be liable to any party for direct indirect special"),
    ("upl", "licensed works", r"covering the licensed works|the larger works and the licensed works"),
    ("blueoak", "no contributor can revoke this license", r"no contributor can revoke this license"),
    ("blueoak", "blueoakcouncil org license", r"(?:https? )?blueoakcouncil org license 1 0 0"),
    ("ms-pl", "reproduce reproduction derivative works and distribution", r"the terms reproduce reproduction derivative works and distribution have the same meaning here"),
    ("ms-limited", "reference source license", r"microsoft (?:limited )?reference source license"),
    ("apsl", "apple public source license", r"apple public source license(?: version)?(?: [12] [0-2])?"),
    ("apple-mit", "apple inc apple in consideration of your agreement", r"supplied to you by apple inc apple in consideration of your agreement"),
    ("intel", "intel open source license", r"intel open source license"),
    ("nasa", "nasa open source agreement", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("sun-bcl", "binary code license", r"sun microsystems(?: inc)? binary code license agreement"),
    ("oracle-otn", "technology network", r"oracle technology network (?:development (?:and distribution )?)?license"),
    ("adobe", "adobe systems incorporated", r"adobe systems incorporated grants to you a perpetual(?: worldwide)?"),
    ("cc-by", "creativecommons org licenses by", r"(?:https? )?(?:www )?creativecommons org licenses by (?:[1-4] [05])(?: \S{2})?"),
    ("cc-by-sa", "creativecommons org licenses by sa", r"(?:https? )?(?:www )?creativecommons org licenses by sa (?:[1-4] [05])(?: \S{2})?"),
    ("cc-by-nc", "creativecommons org licenses by nc", r"(?:https? )?(?:www )?creativecommons org licenses by nc (?:[1-4] [05])(?: \S{2})?"),
    ("cc-by-nd", "creativecommons org licenses by nd", r"(?:https? )?(?:www )?creativecommons org licenses by nd (?:[1-4] [05])(?: \S{2})?"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", r"(?:https? )?(?:www )?creativecommons org licenses by nc sa (?:[1-4] [05])(?: \S{2})?"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", r"(?:https? )?(?:www )?creativecommons org licenses by nc nd (?:[1-4] [05])(?: \S{2})?"),
    ("cc", "appropriate credit", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc", "some rights reserved", r"some rights reserved"),
    ("cc-sa", "distribute your contributions under the same license", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-nd", "may not distribute the modified material", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-nc", "may not use the material for commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc0", "to the extent possible under law", r"to the extent possible under law(?: \S+){1,12} (?:waived|waives)|to the extent possible under law the (?:author|person)s?"),
    ("unlicense", "dedicate any and all copyright interest", r"dedicate any and all copyright interest in the software to the public domain"),
    ("odbl", "opendatacommons org licenses odbl", r"(?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?"),
    ("odbl", "openstreetmap contributors", r"(?:copyright )?openstreetmap contributors"),
    ("open-government", "public sector information licensed under the open government", r"contains public sector information licensed under the open government licence"),
    ("etalab", "licence ouverte", r"licence ouverte(?: open licence)?(?: etalab)?(?: version)?(?: 2 0)?"),
    ("dl-de", "datenlizenz deutschland", r"datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?"),
    ("gutenberg", "project gutenberg", r"(?:this ebook is for the use of anyone anywhere|terms of the) (?:\S+ ){0,30}project gutenberg(?: tm)? license"),
    ("wikipedia", "text is available under the creative commons", r"text is available under the creative commons attribution share ?alike license"),
    ("stackexchange", "user contributions licensed under", r"user contributions licensed under cc by sa(?: [234] [05])?"),
    ("arxiv", "arxiv org licenses", r"(?:https? )?arxiv org licenses nonexclusive distrib 1 0"),
    ("elsevier", "published by elsevier", r"(?:[0-9]{4} )?published by elsevier(?: \S+){0,6}|copyright (?:c )?(?:[0-9]{4} )?published by elsevier"),
    ("ieee", "personal use of this material is permitted", r"personal use of this material is permitted(?: however)?(?: permission(?: from ieee)? must be obtained)?"),
    ("acm", "digital or hard copies of", r"permission to make digital or hard copies of (?:all or )?part or all of this work|permission to make digital or hard copies of all or part of this work"),
    ("prosperity", "prosperity public license", r"prosperity public license(?: 3 0 0)?"),
    ("parity", "parity public license", r"parity public license(?: [67] 0 0)?"),
    ("hippocratic", "hippocratic license", r"hippocratic license(?: version)?(?: [123] [012])?"),
    ("fsl", "functional source license", r"functional source license(?: version)?(?: 1 [01])?"),
    ("redis", "redis source available license", r"redis source available license(?: agreement)?"),
    ("confluent", "confluent community license", r"confluent community license(?: agreement)?"),
    ("timescale", "timescale license", r"timescale license agreement"),
    ("bsl-1.1", "additional use grant", r"additional use grant (?:you may|none)"),
    ("mariadb-bsl", "mariadb corporation ab", r"mariadb corporation ab(?: \S+){0,8} business source license|business source license(?: \S+){0,8} mariadb corporation ab"),
    ("dual", "dual licensed", r"(?:is |are )?dual licensed under(?: the)?"),
    ("contributor-agreement", "contributor license agreement", r"(?:individual |corporate |signed )?contributor license agreement(?: cla)?"),
    ("dco", "developer certificate of origin", r"developer certificate of origin(?: version 1 1)?"),
    ("patent-grant", "additional grant of patent rights", r"additional grant of patent rights(?: version 2)?"),
    ("export-control", "export administration regulations", r"(?:subject to )?(?:the )?(?:u s |us |united states )?export administration regulations"),
    ("restricted-rights", "restricted rights", r"u s government (?:users )?restricted rights|use duplication or disclosure(?: \S+){1,12} restricted rights"),
    ("attribution-required", "attribution is required", r"attribution is required(?: (?:for|when) \S+)?"),
    ("ai-training-opt-out", "machine learning", r"may not be used (?:to train|for (?:the )?training)(?: of)? (?:\S+ ){0,6}machine learning|not be used for machine learning"),
    ("ai-training-opt-out", "text and data mining", r"(?:rights (?:are )?reserved|not permitted|prohibited)(?: \S+){0,8} text and data mining|text and data mining(?: \S+){0,8} (?:reserved|prohibited|not permitted)"),
)

#: Statements of rights and terms of use outside the named licenses.
NOTICES = (
    ("proprietary", "all rights reserved", r"(?:proprietary|confidential)(?: \S+){0,6} all rights reserved"),
    ("proprietary", "may not be reproduced", r"may not be reproduced(?: \S+){0,8} without(?: \S+){0,4} permission"),
    ("proprietary", "no part of this", r"no part of this (?:publication|book|document|work|report) may be reproduced(?: stored in a retrieval system)? or transmitted"),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", "confidential and proprietary", r"confidential and proprietary(?: information)?"),
    ("proprietary", "unauthorized copying", r"unauthorized copying(?: \S+){0,8} (?:is )?(?:strictly )?prohibited"),
    ("proprietary", "unauthorized reproduction", r"unauthorized reproduction(?: or distribution)?(?: \S+){0,6} (?:is )?(?:strictly )?prohibited"),
    ("proprietary", "trade", r"(?:contains|constitutes) (?:valuable )?trade secrets? of"),
    ("proprietary", "end user license agreement", r"end user license agreement"),
    ("proprietary", "non transferable license", r"(?:limited )?non ?exclusive non transferable license"),
    ("proprietary", "reverse engineer", r"(?:may|shall|must) not reverse engineer decompile or disassemble"),
    ("proprietary", "license agreement", r"by (?:installing|downloading|using)(?: \S+){1,10} you (?:agree|accept)(?: \S+){0,8} license agreement"),
    ("proprietary", "commercial license", r"(?:available|licensed) under (?:a )?commercial license"),
    ("no-license", "no license", r"no license (?:is )?granted"),
    ("no-license", "rights are granted", r"no (?:other )?rights are granted"),
    ("no-derivatives", "no derivative works", r"no derivative works(?: (?:are )?(?:permitted|allowed))?"),
    ("noncommercial", "non commercial", r"(?:for )?(?:personal|educational|research|academic) (?:and|or) non commercial (?:use|purposes)(?: only)?"),
    ("noncommercial", "non commercial", r"for non commercial (?:use|purposes)(?: only)?"),
    ("noncommercial", "noncommercial", r"for noncommercial (?:use|purposes)(?: only)?"),
    ("noncommercial", "commercial use", r"commercial use (?:is )?(?:strictly )?(?:prohibited|forbidden|not (?:allowed|permitted))"),
    ("research-only", "research purposes only", r"(?:for )?research purposes only"),
    ("evaluation-only", "evaluation purposes only", r"(?:for )?evaluation purposes only"),
    ("permission", "reprinted", r"reprinted (?:here )?with (?:the )?(?:kind )?permission"),
    ("permission", "used with", r"used with (?:the )?permission(?: of)?"),
    ("permission", "used by permission", r"used by permission(?: of)?"),
    ("permission", "permission is granted", r"permission is granted to (?:reproduce|copy|reprint|distribute)"),
    ("permission", "freely", r"may be freely (?:copied and )?distributed|can be freely distributed"),
    ("permission", "verbatim", r"verbatim cop(?:y|ies)(?: \S+){0,6} (?:is|are) permitted|permission(?: \S+){0,6} make and distribute verbatim copies"),
    ("copyright", "copyright", r"copyright (?:c )?(?:[0-9]{4} ){1,6}\S+"),
    ("copyright", "copyright notice", r"(?:retain|include|reproduce)(?: \S+){0,3} copyright notice"),
    ("copyright", "copyrighted material", r"(?:this )?(?:is )?copyrighted material"),
    ("trademark", "registered", r"registered trademarks?(?: of)?"),
    ("open-government", "open government licence", r"open government licence(?: v(?:ersion)?)?(?: [123] 0)?"),
    ("crown-copyright", "crown copyright", r"crown copyright(?: (?:and )?database rights?)?"),
    ("royalty-free", "royalty free", r"royalty free(?: \S+){0,3} license"),
    ("odbl", "open data commons", r"open data commons open database license"),
    ("pddl", "public domain dedication and license", r"(?:open data commons )?public domain dedication and license"),
    ("cdla", "community data license", r"community data license agreement(?: permissive| sharing)?(?: version)?(?: [12] 0)?"),
    ("free-art", "free art license", r"free art license(?: 1 [23])?"),
    ("fair-use", "fair use", r"(?:qualifies as|constitutes|considered) fair use"),
)

#: Identifiers of the form "SPDX-License-Identifier: X", as they read in the word stream.
SPDX = (
    "mit", "mit 0", "isc", "zlib", "0bsd", "bsd 1 clause", "bsd 2 clause", "bsd 2 clause patent", "bsd 3 clause", "bsd 3 clause clear", "bsd 4 clause", "bsl 1 0", "busl 1 1", "apache 1 0", "apache 1 1", "apache 2 0", "gpl 1 0 only", "gpl 1 0 or later",
    "gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 0 only", "lgpl 2 0 or later", "lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0", "agpl 3 0 only",
    "agpl 3 0 or later", "gfdl 1 2 only", "gfdl 1 3 only", "gfdl 1 3 or later", "mpl 1 0", "mpl 1 1", "mpl 2 0", "epl 1 0", "epl 2 0", "cddl 1 0", "cddl 1 1", "cpl 1 0", "ipl 1 0", "eupl 1 1", "eupl 1 2", "artistic 1 0", "artistic 2 0", "afl 3 0", "osl 3 0", "ofl 1 1",
    "unlicense", "wtfpl", "cc0 1 0", "cc by 3 0", "cc by 4 0", "cc by sa 3 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nd 4 0", "cc by nc sa 4 0", "cc by nc nd 4 0", "odbl 1 0", "pddl 1 0", "odc by 1 0", "postgresql", "openssl", "ncsa", "curl", "x11", "hpnd", "icu",
    "python 2 0", "psf 2 0", "php 3 01", "ruby", "vim", "w3c", "zpl 2 1", "ms pl", "ms rl", "sspl 1 0", "elastic 2 0", "json", "ftl", "libpng 2 0", "tcl", "unicode dfs 2016", "upl 1 0", "blueoak 1 0 0", "ecl 2 0", "lppl 1 3c", "ngpl", "nosl", "sleepycat", "beerware",
)

#: Short names that stand for a license only after "licensed under" or "license:".
SHORT = ("mit", "isc", "zlib", "bsd", "0bsd", "gpl", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv3", "agpl", "agplv3", "mpl", "apache", "apache2", "boost", "unlicense", "cc0", "wtfpl", "ncsa", "postgresql", "eupl", "epl", "cddl", "artistic", "ofl")
