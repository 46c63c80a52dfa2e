"""Known licence sentences as they are written in licences and files."""

import re

import duckdb

from tallyhouse.llm import licenses
from tests.llm.helpers import documents

ORIGINALS = [
    "MIT License", "The MIT License", "The MIT License (MIT)",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "Distributed under the MIT License.",
    "// SPDX-License-Identifier: MIT",
    "Apache License", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");',
    "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "    http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "See the License for the specific language governing permissions and limitations under the License.", "Released under the Apache License, Version 2.0.",
    "# SPDX-License-Identifier: Apache-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", "/* SPDX-License-Identifier: BSD-3-Clause */", "Licensed under the BSD 2-Clause License.", "-- SPDX-License-Identifier: BSD-2-Clause",
    "This program is free software:", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,",
    "either version 2 of the License, or (at your option) any later version.", "either version 3 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier:\tGPL-3.0-or-later", "Licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier:  GPL-2.0-only",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation,",
    "Licensed under the GNU Lesser General Public License, version 3.", "<!-- SPDX-License-Identifier: LGPL-3.0-only -->", "Licensed under the GNU Affero General Public License, version 3.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Licensed under the Mozilla Public License, version 2.0.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Licensed under the ISC License.", "This is free and unencumbered software released into the public domain.",
    "Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-ND 4.0.", "CC0 1.0 Universal", "Licensed under CC0 1.0.",
    "Boost Software License - Version 1.0", "Distributed under the Boost Software License, Version 1.0.", "All rights reserved.",
]
ORIGINALS += [
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;", "LOSS OF USE, DATA, OR PROFITS;",
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work, where such license applies only to those patent claims licensable by such Contributor that are necessarily infringed by their Contribution(s) alone or by combination of their Contribution(s) with the Work to which such Contribution(s) was submitted.",
    "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
    "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.",
    "GNU GENERAL PUBLIC LICENSE", "GNU LESSER GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", "Version 2, June 1991", "Version 3, 29 June 2007", "Version 3, 19 November 2007",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works.", "The licenses for most software are designed to take away your freedom to share and change it.",
    "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    *(f"you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version." for kind, v in (("", 3), ("", 2), ("Lesser ", 3), ("Affero ", 3))),
    "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details.",
    "Mozilla Public License Version 2.0", '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.', "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license:",
    "Eclipse Public License - v 1.0", "Eclipse Public License - v 2.0", 'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").', "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "This software is provided 'as-is', without any express or implied warranty.", "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
]
BSD3 = """Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
BSD2 = BSD3[: BSD3.index("3. Neither")] + BSD3[BSD3.index("THIS SOFTWARE") :]
GPL3 = "    GNU GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007\n\n Copyright (C) 2007 Somebody\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n  The licenses for most software and other practical works are designed\nto take away your freedom to share and change the works.  By contrast,"
GPL3_NOTICE = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n"
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/."


def test_every_sentence_as_it_is_written(spark):
    keys = [re.sub(r"[^a-z0-9.]+", " ", t.lower()).strip(" .") for t in ORIGINALS]
    assert set(keys) == set(licenses.SENTENCES)
    rows = list(enumerate(ORIGINALS)) + [(1000 + k, f"Some words before.\n{t}\nand more words after it.") for k, t in enumerate(ORIGINALS)]
    got = {r["doc_id"]: r["sentence_ids"].split(",") for r in licenses.scan(documents(spark, rows)).collect()}
    for k, key in enumerate(keys):
        assert licenses.SENTENCES[key] in got[k], ORIGINALS[k]
        assert licenses.SENTENCES[key] in got[1000 + k], ORIGINALS[k]


def test_tags_and_headers(spark):
    rows = [(1, "x = 1\n// SPDX-License-Identifier: MIT\ny = 2"), (2, f"/* {MPL} */\nint x;"), (3, MPL.replace("\n *", "")), (4, MPL.replace("License, v. 2.0", "License, v.\n * 2.0")), (5, "See v. 2 of it. Released under the MIT License: all of it")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(documents(spark, rows)).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("MIT", "MPL-2.0", "MPL-2.0", "MPL-2.0", "MIT")


NOTICES = [
    (1, BSD3, "BSD-3-Clause"), (2, BSD3 + "\n" + BSD3, "BSD-3-Clause"), (3, BSD2 + BSD2, "BSD-2-Clause"), (4, BSD3 + BSD2, "BSD-2-Clause,BSD-3-Clause"), (5, BSD3 + BSD3 + BSD3 + "MIT License", "BSD-3-Clause,MIT"),
    (6, GPL3, "GPL-3.0-only"), (7, GPL3_NOTICE, "GPL-3.0-or-later"), (8, GPL3_NOTICE + GPL3_NOTICE, "GPL-3.0-or-later"), (9, f"{MPL}\n\n{MPL}", "MPL-2.0"), (10, "// SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: MIT\nall rights reserved", "LicenseRef-all-rights-reserved,MIT"),
]


def test_repeated_notices_and_full_texts(spark):
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, [(k, t) for k, t, _ in NOTICES])).collect()}
    for k, _, want in NOTICES:
        assert got[k]["licenses"] == want, k
        assert got[k]["unclaimed"] == "", k


def test_sentences_that_no_rule_takes_are_told(spark):
    rows = [(1, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nReleased under the MIT License."), (2, "LOSS OF USE, DATA, OR PROFITS;"), (3, "MIT License")]
    got = {r["doc_id"]: (r["licenses"], r["unclaimed"]) for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {1: ("MIT", "BsdGrant"), 2: (licenses.UNNAMED, "BsdLoss"), 3: ("MIT", "")}


def test_wordings_equal_sql(spark):
    rows = [(k, t) for k, t, _ in NOTICES] + [(100 + k, t) for k, t in enumerate(ORIGINALS)] + [(500, "\n".join(ORIGINALS)), (501, " ".join(ORIGINALS)), (502, MPL.replace("License, v. 2.0", "License, v.\n * 2.0")), (503, "x SPDX-License-Identifier:\nMIT"), (504, "See v. 2 of it; v. two. Released under the MIT License: all of it")]
    got = sorted(tuple(r) for r in licenses.scan(documents(spark, rows)).collect())
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [list(r) for r in rows])
    assert got == sorted(c.execute(licenses.oracle()).fetchall())
