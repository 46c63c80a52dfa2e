"""Notices as people write them: other names in the slots, list marks, SPDX expressions; what each means is written here by hand."""

import duckdb
import pytest

from tallyhouse.llm import licenses
from tests.llm.helpers import documents
from tests.llm.test_wording import BSD2, BSD3

HOLDER = "Neither the name of the copyright holder nor the names of its\n   contributors may"
HEADERS = [
    (BSD3.replace(HOLDER, "Neither the name of Example Ltd nor the names of its\n   contributors may"), "BSD-3-Clause"),
    (BSD3.replace(HOLDER, "Neither the name of the University of Somewhere\n   nor the names of any contributors may"), "BSD-3-Clause"),
    (BSD3.replace(HOLDER, "The name of the author may not").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE AUTHOR").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE AUTHOR"), "BSD-3-Clause"),
    (BSD3.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) "), "BSD-3-Clause"), (BSD2.replace("1. ", "* ").replace("2. ", "* ").replace("THE COPYRIGHT HOLDERS AND", "EXAMPLE LTD AND ITS"), "BSD-2-Clause"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\nfn main() {}", "Apache-2.0,MIT"), ("/* SPDX-License-Identifier: GPL-2.0 */", "GPL-2.0-only"), ("# SPDX-License-Identifier: GPL-2.0+", "GPL-2.0-or-later"),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "BSD-3-Clause,GPL-2.0-only"), ("<!-- SPDX-License-Identifier: (MIT AND (LGPL-2.1-or-later OR BSD-2-Clause)) -->", "BSD-2-Clause,LGPL-2.1-or-later,MIT"),
    ("-- spdx-license-identifier: apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: LicenseRef-Example-1.0", "LicenseRef-Example-1.0"), ("SPDX-License-Identifier: Nothing-9.9", ""), ("SPDX-License-Identifier: MIT.", "MIT"), ("SPDX-License-Identifier:", ""),
    ("# This file is licensed under the terms of the MIT license.", "MIT"), ("Licensed under the terms of the MIT license.", "MIT"), ("This project is distributed under the Apache 2.0 license.", "Apache-2.0"), ("This library is available under the 3-Clause BSD License.", "BSD-3-Clause"),
    ("Use of this source code is provided under a New BSD license. See the LICENSE file.", "BSD-3-Clause"), ("This package is released under the GPL v3.", "GPL-3.0-only"), ("The plugin is licensed under the GPLv2. All of it.", "GPL-2.0-only"), ("Published under the MPL-2.0.", "MPL-2.0"),
    ("The code is licensed under the MIT License see LICENSE for details", "MIT"),
    ("The streets were licensed under the council, and taxis were available under the bridge.", ""), ("Neither the name of the rose nor the names of its gardeners may be told.", ""), ("In no event shall the ball be late.", ""),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, t) for k, (t, _) in enumerate(HEADERS)]
    return rows, sorted(tuple(r) for r in licenses.scan(documents(spark, rows)).collect())


def test_what_headers_mean(found):
    names = {r[0]: r[2] for r in found[1]}
    for k, (text, want) in enumerate(HEADERS):
        assert names[k] == want, text


def test_headers_equal_sql(found):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [list(r) for r in found[0]])
    assert found[1] == sorted(c.execute(licenses.oracle()).fetchall())


def test_no_python_runs(spark):
    plan = licenses.scan(documents(spark, [(1, "MIT")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("EvalPython", "MapInArrow", "MapInPandas", "InPandas"))
