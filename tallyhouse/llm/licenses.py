"""Licence recognition by sentences, with DataFrame functions alone.

A text is cut into sentences, each normalised; those that are known get an identifier, and the sequence of
identifiers is matched against ordered licence rules. A rule takes its identifiers out of the sequence wherever it matches, as often as it does,
so what a fuller rule has used is not seen by a shorter one; known sentences that no rule takes are told, and make an unnamed licence if nothing else was found.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licence texts and notices, lower case, without punctuation but inner full stops, and their identifiers.
SENTENCES = {
    "mit license": "MitTitle",
    "the mit license": "MitTitle",
    "the mit license mit": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "released under the mit license": "MitName",
    "licensed under the mit license": "MitName",
    "this project is licensed under the mit license": "MitName",
    "this software is released under the mit license": "MitName",
    "distributed under the mit license": "MitName",
    "spdx license identifier mit": "MitName",
    "apache license": "ApacheTitle",
    "apache license version 2.0": "ApacheName",
    "licensed under the apache license version 2.0": "ApacheName",
    "licensed under the apache license version 2.0 the license": "ApacheLicensed",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheObtain",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "ApacheObtain",
    "http www.apache.org licenses license 2.0": "ApacheAddress",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheBasis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the apache license version 2.0": "ApacheName",
    "spdx license identifier apache 2.0": "ApacheName",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "1. redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "2. redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdWarranty",
    "released under the bsd 3 clause license": "Bsd3Name",
    "licensed under the bsd 3 clause license": "Bsd3Name",
    "spdx license identifier bsd 3 clause": "Bsd3Name",
    "licensed under the bsd 2 clause license": "Bsd2Name",
    "spdx license identifier bsd 2 clause": "Bsd2Name",
    "this program is free software": "GplFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "either version 2 of the license or at your option any later version": "GplVersion2Later",
    "either version 3 of the license or at your option any later version": "GplVersion3Later",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplHope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GplEven",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplReceived",
    "this work is licensed under the gnu general public license version 3": "Gpl3Name",
    "licensed under the gnu general public license version 3": "Gpl3Name",
    "released under the gnu general public license version 3": "Gpl3Name",
    "spdx license identifier gpl 3.0 only": "Gpl3Name",
    "spdx license identifier gpl 3.0 or later": "Gpl3LaterName",
    "licensed under the gnu general public license version 2": "Gpl2Name",
    "this work is licensed under the gnu general public license version 2": "Gpl2Name",
    "spdx license identifier gpl 2.0 only": "Gpl2Name",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplTerms",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Name",
    "spdx license identifier lgpl 3.0 only": "Lgpl3Name",
    "licensed under the gnu affero general public license version 3": "Agpl3Name",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "MplTerms",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0": "MplObtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "MplObtain",
    "licensed under the mozilla public license version 2.0": "MplName",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "licensed under the isc license": "IscName",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "licensed under cc by 4.0": "CcByName",
    "this work is licensed under cc by 4.0": "CcByName",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcByName",
    "licensed under cc by sa 4.0": "CcBySaName",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "CcBySaName",
    "licensed under cc by nc 4.0": "CcByNcName",
    "this work is licensed under cc by nc 4.0": "CcByNcName",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CcByNcName",
    "licensed under cc by nc sa 4.0": "CcByNcSaName",
    "licensed under cc by nd 4.0": "CcByNdName",
    "cc0 1.0 universal": "Cc0Name",
    "licensed under cc0 1.0": "Cc0Name",
    "boost software license version 1.0": "BoostName",
    "distributed under the boost software license version 1.0": "BoostName",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BsdLiability",
    "loss of use data or profits": "BsdLoss",
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdInterruption",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscWarranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "IscLiability",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "ApacheCopyright",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise transfer the work where such license applies only to those patent claims licensable by such contributor that are necessarily infringed by their contribution s alone or by combination of their contribution s with the work to which such contribution s was submitted": "ApachePatent",
    "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in source or object form provided that you meet the following conditions": "ApacheRedistribution",
    "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor except as required for reasonable and customary use in describing the origin of the work and reproducing the content of the notice file": "ApacheTrademarks",
    "gnu general public license": "GplTitle",
    "gnu lesser general public license": "LgplTitle",
    "gnu affero general public license": "AgplTitle",
    "version 2 june 1991": "GnuVersion2",
    "version 3 29 june 2007": "GnuVersion3",
    "version 3 19 november 2007": "GnuVersion3",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "GnuVerbatim",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "Gpl3Preamble",
    "the licenses for most software and other practical works are designed to take away your freedom to share and change the works": "Gpl3Freedom",
    "the licenses for most software are designed to take away your freedom to share and change it": "Gpl2Freedom",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "AgplPreamble",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "LgplBody",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3LaterTerms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2LaterTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3LaterTerms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3LaterTerms",
    "see the gnu lesser general public license for more details": "LgplSee",
    "see the gnu affero general public license for more details": "AgplSee",
    "mozilla public license version 2.0": "MplTitle",
    "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software": "MplContributor",
    "each contributor hereby grants you a world wide royalty free non exclusive license": "MplGrant",
    "eclipse public license v 1.0": "Epl1Title",
    "eclipse public license v 2.0": "Epl2Title",
    "the accompanying program is provided under the terms of this eclipse public license agreement": "EplTerms",
    "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement": "EplAcceptance",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0": "Epl2Notice",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "all rights reserved": "AllRights",
}
#: Fixed values, in order: a licence, and the identifiers that it takes one after another; ``?`` may be missing, ``|`` separates alternatives.
RULES = [
    ("MIT", "MitTitle? MitGrant MitNotice MitWarranty MitLiability?"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdEndorse BsdWarranty? BsdLiability? BsdLoss? BsdInterruption?"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary BsdWarranty? BsdLiability? BsdLoss? BsdInterruption?"),
    ("Apache-2.0", "ApacheTitle? ApacheCopyright ApachePatent? ApacheRedistribution? ApacheTrademarks?"),
    ("Apache-2.0", "ApacheLicensed|ApacheName ApacheUse ApacheObtain ApacheAddress? ApacheBasis ApacheSee?"),
    ("AGPL-3.0-only", "AgplTitle? GnuVersion3? GnuVerbatim? AgplPreamble"),
    ("LGPL-3.0-only", "LgplTitle? GnuVersion3? GnuVerbatim? LgplBody"),
    ("GPL-3.0-only", "GplTitle? GnuVersion3? GnuVerbatim? Gpl3Preamble Gpl3Freedom?"),
    ("GPL-2.0-only", "GplTitle? GnuVersion2? GnuVerbatim? Gpl2Freedom"),
    ("AGPL-3.0-or-later", "GplFree? Agpl3LaterTerms GplHope? GplEven? AgplSee?"),
    ("LGPL-3.0-or-later", "GplFree? Lgpl3LaterTerms GplHope? GplEven? LgplSee?"),
    ("GPL-3.0-or-later", "GplFree? Gpl3LaterTerms GplHope? GplEven? GplSee? GplReceived?"),
    ("GPL-2.0-or-later", "GplFree? Gpl2LaterTerms GplHope? GplEven? GplSee? GplReceived?"),
    ("LGPL-3.0-or-later", "GplFree? LgplTerms GplVersion3Later GplHope? GplEven? LgplSee?"),
    ("GPL-3.0-or-later", "GplFree? GplTerms GplVersion3Later GplHope? GplEven? GplSee? GplReceived?"),
    ("GPL-2.0-or-later", "GplFree? GplTerms GplVersion2Later GplHope? GplEven? GplSee? GplReceived?"),
    ("MPL-2.0", "MplTitle? MplContributor MplGrant?"),
    ("MPL-2.0", "MplTerms MplObtain?"),
    ("EPL-2.0", "Epl2Title EplTerms? EplAcceptance?"),
    ("EPL-1.0", "Epl1Title EplTerms? EplAcceptance?"),
    ("EPL-2.0", "Epl2Notice"),
    ("ISC", "IscGrant IscWarranty? IscLiability?"),
    ("Zlib", "ZlibAsIs? ZlibLiability? ZlibGrant"),
    ("Unlicense", "UnlicenseGrant"),
    ("MIT", "MitName"),
    ("MIT", "MitTitle"),
    ("Apache-2.0", "ApacheTitle? ApacheLicensed|ApacheName"),
    ("BSD-3-Clause", "Bsd3Name"),
    ("BSD-2-Clause", "Bsd2Name"),
    ("GPL-3.0-only", "GplTitle? Gpl3Name"),
    ("GPL-3.0-or-later", "Gpl3LaterName"),
    ("GPL-2.0-only", "GplTitle? Gpl2Name"),
    ("GPL-3.0-only", "GplTitle GnuVersion3"),
    ("GPL-2.0-only", "GplTitle GnuVersion2"),
    ("LGPL-3.0-only", "LgplTitle? Lgpl3Name"),
    ("LGPL-3.0-only", "LgplTitle GnuVersion3"),
    ("AGPL-3.0-only", "AgplTitle? Agpl3Name"),
    ("AGPL-3.0-only", "AgplTitle GnuVersion3"),
    ("MPL-2.0", "MplName|MplTitle"),
    ("ISC", "IscName"),
    ("CC-BY-NC-SA-4.0", "CcByNcSaName"),
    ("CC-BY-NC-4.0", "CcByNcName"),
    ("CC-BY-ND-4.0", "CcByNdName"),
    ("CC-BY-SA-4.0", "CcBySaName"),
    ("CC-BY-4.0", "CcByName"),
    ("CC0-1.0", "Cc0Name"),
    ("BSL-1.0", "BoostName"),
    ("LicenseRef-all-rights-reserved", "AllRights"),
]
#: How notices name a licence after "licensed under" and the like, and the identifier of the sentence.
NAMES = {
    "mit license": "MitName", "mit": "MitName", "mit x11 license": "MitName", "expat license": "MitName",
    "apache license version 2.0": "ApacheName", "apache license 2.0": "ApacheName", "apache 2.0 license": "ApacheName", "apache 2.0": "ApacheName", "apache license v2.0": "ApacheName", "apache license v2": "ApacheName", "apache license version 2.0 the license": "ApacheLicensed",
    "bsd 3 clause license": "Bsd3Name", "3 clause bsd license": "Bsd3Name", "new bsd license": "Bsd3Name", "modified bsd license": "Bsd3Name", "bsd 3 clause": "Bsd3Name",
    "bsd 2 clause license": "Bsd2Name", "2 clause bsd license": "Bsd2Name", "simplified bsd license": "Bsd2Name", "freebsd license": "Bsd2Name", "bsd 2 clause": "Bsd2Name",
    "gnu general public license version 3": "Gpl3Name", "gnu general public license v3": "Gpl3Name", "gnu general public license v3.0": "Gpl3Name", "gpl v3": "Gpl3Name", "gplv3": "Gpl3Name", "gpl version 3": "Gpl3Name", "gnu gpl v3": "Gpl3Name", "gnu gplv3": "Gpl3Name",
    "gnu general public license version 2": "Gpl2Name", "gnu general public license v2": "Gpl2Name", "gnu general public license v2.0": "Gpl2Name", "gpl v2": "Gpl2Name", "gplv2": "Gpl2Name", "gpl version 2": "Gpl2Name", "gnu gpl v2": "Gpl2Name",
    "gnu lesser general public license version 3": "Lgpl3Name", "gnu lesser general public license v3": "Lgpl3Name", "lgpl v3": "Lgpl3Name", "lgplv3": "Lgpl3Name",
    "gnu affero general public license version 3": "Agpl3Name", "gnu affero general public license v3": "Agpl3Name", "agpl v3": "Agpl3Name", "agplv3": "Agpl3Name",
    "mozilla public license version 2.0": "MplName", "mozilla public license 2.0": "MplName", "mpl 2.0": "MplName", "isc license": "IscName", "boost software license version 1.0": "BoostName", "unlicense": "UnlicenseGrant",
    "creative commons attribution 4.0 international license": "CcByName", "creative commons attribution sharealike 4.0 international license": "CcBySaName", "creative commons attribution noncommercial 4.0 international license": "CcByNcName", "cc by 4.0": "CcByName", "cc by sa 4.0": "CcBySaName",
}
SENTENCES_AND_NAMES = SENTENCES | {f"licensed under {name}": identifier for name, identifier in NAMES.items()}
#: Marks before a sentence of a list, as they are left of "1.", "(a)" or "iv)".
LIST_MARK = "^(?:[0-9]{1,2}[.]?|[a-z]|[ivx]{1,4}) "
#: Fixed values, the first that fits counting: sentences that name somebody or something, and how they stand among the known ones.
SLOTS = [
    ("^(?:neither )?the names? of .+ n?or the names of (?:its|their|the|any|any of its) contributors may (?:not )?be used to endorse or promote products derived from this software without (?:specific )?prior written permission$", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("^(?:neither )?the names? of .+ may (?:not )?be used to endorse or promote products derived from this software without (?:specific )?prior written permission$", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("^this software is provided by .+ as is and any express or implied warranties including", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including"),
    ("^in no event shall .+ be liable for any direct indirect incidental special exemplary or consequential damages", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("^in no event shall .+ be liable for any claim damages or other liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("^(?:.* )?(?:licensed|licenced|released|distributed|published|available|provided) under (?:the |a |an )?(?:terms (?:and conditions )?of )?(?:the |a |an )?(.+?)(?: (?:see|refer to) .*)?$", "licensed under \\1"),
]
#: Words that a sentence with a slot holds one of.
SLOT_WORDS = (" under ", "the name", "provided by", "in no event shall", "redistribution")
#: Identifiers of SPDX, and those that are deprecated with what they mean.
SPDX_IDS = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-only GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only
LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA OFL-1.1 OpenSSL OSL-3.0 PostgreSQL Python-2.0 Ruby Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib""".split()
DEPRECATED = {f"{name}{plus}": f"{name}-{'or-later' if plus else 'only'}" for name in ("AGPL-3.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "GFDL-1.3") for plus in ("", "+")}
#: By identifier in lower case; "or any later" of one that has no such form is left out.
SPDX = {i.lower(): i for i in SPDX_IDS} | {f"{i.lower()}+": i for i in SPDX_IDS} | {i.lower(): name for i, name in DEPRECATED.items()}
_ID = "[A-Za-z0-9][A-Za-z0-9.+-]*"
_OPERAND = rf"(?:\([ \t]*)*{_ID}(?:[ \t]*\))*"
SPDX_TAG = rf"(?i)SPDX-License-Identifier:[ \t]*({_OPERAND}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_OPERAND})*)"
SPDX_EXCEPTION = rf"(?i)[ \t]WITH[ \t]+(?:\([ \t]*)*{_ID}"
#: Known sentences that no rule took.
UNNAMED = "LicenseRef-unnamed"
#: Where a sentence ends: where lines count as sentences of their own, and where a line end is a space.
#: The colon of an SPDX tag and the full stop of "v." before a digit end none.
_INNER = r"(?<!\bspdx-license-identifier:)(?!(?<=\bv\.)[ \t\r\n*#/;-]+[0-9])"
ENDS = {"lines": rf"[.!?;:]+[ \t\r]*\n[ \t\r\n]*|[.!?;:]++{_INNER}[ \t\r]+|\n[ \t\r\n]*", "wrapped": rf"[.!?;:]++{_INNER}[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*"}


def rule_pattern(rule: str) -> str:
    """A regular expression over ``,Id,,Id,``: every identifier has both its commas, so that notices which follow each other share none."""
    out = ""
    for part in rule.split():
        ids = f",(?:{part.rstrip('?')}),"
        out += f"(?:{ids})?" if part.endswith("?") else ids
    return out


def _filled(sentence: Column) -> Column:
    """A sentence without its list mark and with the slots as the known sentences have them; a known one as it is."""
    bare = F.regexp_replace(sentence, LIST_MARK, "")
    slots = reduce(lambda rest, slot: F.when(bare.rlike(slot[0]), F.regexp_replace(bare, slot[0], slot[1].replace("\\1", "$1"))).otherwise(rest), reversed(SLOTS), bare)
    return F.when(~sentence.isin(list(SENTENCES)) & reduce(lambda a, b: a | b, [F.contains(sentence, F.lit(w)) for w in SLOT_WORDS]), slots).otherwise(sentence)


def _tagged() -> Column:
    """SPDX identifiers of the expressions in tags of column text, in order; exceptions and identifiers that are not known are left out, references to licences of one's own stay."""
    table = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    ids = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(SPDX_TAG), 1), lambda e: F.regexp_extract_all(F.regexp_replace(e, SPDX_EXCEPTION, ""), F.lit(_ID), 0)))
    bare = F.transform(ids, lambda i: F.rtrim(i, F.lit(".-")))
    named = F.transform(bare, lambda i: F.when(F.startswith(i, F.lit("LicenseRef-")), i).otherwise(F.try_element_at(table, F.lower(i))))
    return F.when(F.contains(F.lower("text"), F.lit("spdx-license-identifier:")), F.array_compact(named)).otherwise(F.array().cast("array<string>"))


def _known(kind: str) -> Column:
    """Identifiers of the known sentences of column text, in order, as ``,Id,,Id,``."""
    marked = F.regexp_replace(F.lower("text"), ENDS[kind], "\n") if kind == "lines" else F.regexp_replace(F.regexp_replace(F.lower("text"), ENDS[kind], "\u0001"), "\n", " ")
    mark = "\n" if kind == "lines" else "\u0001"
    sentences = F.split(F.regexp_replace(marked, f"[^a-z0-9.{mark}]+", " "), mark)
    known = F.filter(F.transform(F.transform(sentences, lambda s: F.trim(s, F.lit(" ."))), _filled), lambda s: s.isin(list(SENTENCES_AND_NAMES)))
    table = F.create_map(*[F.lit(x) for pair in SENTENCES_AND_NAMES.items() for x in pair])
    return F.array_join(F.transform(known, lambda s: F.concat(F.lit(","), F.element_at(table, s), F.lit(","))), "")


def _licences(sequence: Column) -> Column:
    """(found, left): the licences whose rules match, in the rules' order, and the sequence without what they took, a bar in its place."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(rule)).alias("pattern")) for name, rule in RULES])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        left = F.regexp_replace(state["left"], rule["pattern"], F.lit("|"))
        return F.struct(left.alias("left"), F.when(left != state["left"], F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    return F.when(sequence == "", start).otherwise(F.aggregate(rules, start, step))


def _ids(sequence: Column) -> Column:
    return F.filter(F.split(sequence, "[,|]+"), lambda x: x != "")


def scan(docs: DataFrame) -> DataFrame:
    """Licences of every whole text of ``docs`` (doc_id, text).

    A row per row: doc_id, sentence_ids (identifiers in order, comma-separated; lines as sentences first, then, where they differ, lines joined), licenses
    (comma-separated, ascending, empty if none; those of SPDX expressions in tags among them), n_known and unclaimed (identifiers that no rule took in either reading, comma-separated, ascending). A text with known sentences and no licence has UNNAMED. Null and empty texts have none.
    Repeated rows and null doc_ids stay, extra columns are left out, an empty table stays empty. No shuffle.
    """
    both = docs.select("doc_id", F.coalesce(_known("lines"), F.lit("")).alias("a"), F.coalesce(_known("wrapped"), F.lit("")).alias("b"), F.coalesce(_tagged(), F.array().cast("array<string>")).alias("tagged"))
    # Lines that are sentences show in either reading; each reading has its own sequence for the rules.
    found = both.withColumn("b", F.when(F.col("a") == F.col("b"), "").otherwise(F.col("b"))).withColumns({"ra": _licences(F.col("a")), "rb": _licences(F.col("b")), "ids": _ids(F.concat("a", "b"))})
    left_a, left_b = _ids(F.col("ra.left")), _ids(F.col("rb.left"))
    unclaimed = F.array_union(F.array_except(left_a, F.array_except(_ids(F.col("b")), left_b)), F.array_except(left_b, F.array_except(_ids(F.col("a")), left_a)))
    named = F.array_union(F.array_union("ra.found", "rb.found"), "tagged")
    licences = F.when((F.size(named) == 0) & (F.size("ids") > 0), F.array(F.lit(UNNAMED))).otherwise(named)
    return found.select("doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_sort(licences), ",").alias("licenses"), F.size("ids").cast("long").alias("n_known"), F.array_join(F.array_sort(unclaimed), ",").alias("unclaimed"))


def _spelled_out(rule: str) -> list[str]:
    """All sequences that a rule takes, longer ones first."""
    ways = [[()] * part.endswith("?") + [(x,) for x in part.rstrip("?").split("|")] for part in rule.split()]
    return sorted(("".join(f",{x}," for step in way for x in step) for way in product(*ways)), key=lambda w: (-w.count(","), w))


def oracle() -> str:
    """The same in SQL for DuckDB: sentences by other expressions, since RE2 cannot look around, and every sequence that a rule takes spelled out instead of its pattern."""
    quoted, whole = (", ".join(f"'{s}'" for s in known) for known in (SENTENCES, SENTENCES_AND_NAMES))
    table = "MAP {" + ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES_AND_NAMES.items()) + "}"
    bare = f"regexp_replace(s, '{LIST_MARK}', '')"
    slots = " ".join(f"WHEN regexp_matches({bare}, '{pattern}') THEN regexp_replace({bare}, '{pattern}', '{to}')" for pattern, to in SLOTS)
    holds = " OR ".join(f"contains(s, '{w}')" for w in SLOT_WORDS)
    filled = f"CASE WHEN s NOT IN ({quoted}) AND ({holds}) THEN CASE {slots} ELSE {bare} END ELSE s END"
    ids = f"flatten(list_transform(regexp_extract_all(text, '{SPDX_TAG}', 1), lambda e: regexp_extract_all(regexp_replace(e, '{SPDX_EXCEPTION}', '', 'g'), '{_ID}')))"
    spdx = "MAP {" + ", ".join(f"'{i}': '{name}'" for i, name in SPDX.items()) + "}"
    tagged = f"coalesce(list_filter(list_transform(list_transform({ids}, lambda i: rtrim(i, '.-')), lambda i: CASE WHEN starts_with(i, 'LicenseRef-') THEN i ELSE {spdx}[lower(i)] END), lambda i: i IS NOT NULL), [])"
    blank = {"lines": r"[ \t\r]", "wrapped": r"[ \t\r\n]"}
    ends = {"lines": r"[.!?;:]+[ \t\r]*\n[ \t\r\n]*|[.!?;:]+[ \t\r]+|\n[ \t\r\n]*", "wrapped": r"[.!?;:]+[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*"}

    def known(kind: str) -> str:
        mark = "chr(10)" if kind == "lines" else "chr(1)"
        # a tag's colon becomes a space, and the stop of "v." before a number chr(2), until sentences are cut
        after = blank[kind] + ("+[^ \\t\\r\\n]" if kind == "lines" else "")
        held = rf"regexp_replace(lower(text), '\bspdx-license-identifier:({after})', 'spdx-license-identifier \1', 'g')"
        between = r"[ \t*#/;-]+" if kind == "lines" else r"[ \t\r\n*#/;-]+"
        held = rf"regexp_replace({held}, '\bv\.({between}[0-9])', 'v' || chr(2) || '\1', 'g')"
        marked = f"regexp_replace({held}, '{ends[kind]}', {mark}, 'g')"
        if kind == "wrapped":
            marked = f"replace({marked}, chr(10), ' ')"
        cleaned = f"regexp_replace(replace({marked}, chr(2), '.'), '[^a-z0-9.' || {mark} || ']+', ' ', 'g')"
        return f"coalesce(list_aggregate(list_transform(list_filter(list_transform(list_transform(string_split({cleaned}, {mark}), lambda s: trim(s, ' .')), lambda s: {filled}), lambda s: s IN ({whole})), lambda s: ',' || {table}[s] || ','), 'string_agg', ''), '')"

    def taken(column: str, rule: str) -> str:
        return reduce(lambda x, way: f"replace({x}, '{way}', '|')", _spelled_out(rule), column)

    def chain(column: str) -> str:
        steps = [f"{column}0 AS (SELECT *, {column} AS {column}_0 FROM %s)"]
        steps += [f"{column}{k} AS (SELECT *, {taken(f'{column}_{k - 1}', rule)} AS {column}_{k} FROM {column}{k - 1})" for k, (_, rule) in enumerate(RULES, 1)]
        return ",\n".join(steps)

    def names(column: str) -> str:
        return ", ".join(f"CASE WHEN {column}_{k} <> {column}_{k - 1} THEN '{name}' END" for k, (name, _) in enumerate(RULES, 1))

    names_of = lambda x: f"list_filter(string_split(replace({x}, '|', ','), ','), lambda s: s <> '')"
    last = len(RULES)
    return f"""
WITH both_ AS (SELECT doc_id, {known("lines")} AS a, {known("wrapped")} AS b, {tagged} AS tagged FROM documents),
seq AS (SELECT doc_id, tagged, a, CASE WHEN a = b THEN '' ELSE b END AS b FROM both_),
{chain("a") % "seq"},
{chain("b") % f"a{last}"},
named AS (SELECT doc_id, {names_of("a")} AS ia, {names_of("b")} AS ib, {names_of(f"a_{last}")} AS la, {names_of(f"b_{last}")} AS lb, list_distinct(list_filter([{names("a")}, {names("b")}], lambda x: x IS NOT NULL) || tagged) AS found FROM b{last}),
sets AS (SELECT *, list_filter(ia, lambda x: NOT list_contains(la, x)) AS ca, list_filter(ib, lambda x: NOT list_contains(lb, x)) AS cb FROM named)
SELECT doc_id, array_to_string(ia || ib, ',') AS sentence_ids,
       CASE WHEN len(found) = 0 AND len(ia || ib) > 0 THEN '{UNNAMED}' ELSE array_to_string(list_sort(found), ',') END AS licenses,
       len(ia || ib) AS n_known,
       array_to_string(list_sort(list_distinct(list_filter(la, lambda x: NOT list_contains(cb, x)) || list_filter(lb, lambda x: NOT list_contains(ca, x)))), ',') AS unclaimed
FROM sets"""
