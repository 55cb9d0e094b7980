from pathlib import Path

import duckdb

from rollscan.llm import license_scan
from rollscan.llm.license_scan import KNOWN, known_digests, oracle_sql, scan_licenses

FOLDER = Path(license_scan.__file__).parent / "license_texts"
MIT = KNOWN[0][1]
TEXTS = [
    (1, MIT, "MIT", 0, "MIT"),
    (2, "Copyright (c) 2020 Some Body\n\n" + MIT.replace("sublicense", "sub-licence").upper() + "\n", "MIT", 0, "MIT"),
    (3, "prose\nReleased under the M.I.T. License!\nmore", None, 0, ""),
    (4, "prose\n  * RELEASED under the MIT Licence *\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\n", None, 3, "CC-BY-NC-4.0,MIT"),
    (5, "mit license", "MIT", 1, "MIT"),
    (6, MIT.replace("free of charge", "for a charge"), None, 0, ""),
    (7, None, None, 0, ""),
    (8, "", None, 0, ""),
    (9, "© 2020\n---\n(c) you", None, 0, ""),
    (None, "MIT License", "MIT", 1, "MIT"),
    (5, "mit license", "MIT", 1, "MIT"),
]


def test_cases(spark):
    d = spark.createDataFrame([(k, t, "clash") for k, t, *_ in TEXTS], "doc_id long, text string, license string")
    got = sorted(map(str, map(tuple, scan_licenses(d).collect())))
    assert got == sorted(str((k, w, n, a)) for k, _, w, n, a in TEXTS)
    own = known_digests(spark, (("X", "my own terms"),))
    assert scan_licenses(d.where("doc_id = 1"), own).collect()[0]["whole_license"] is None


def test_oracle(spark, sample, no_docs):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(tuple, scan_licenses(sample).collect())) == sorted(con.sql(oracle_sql()).fetchall())
    assert scan_licenses(no_docs).count() == 0


def test_spdx_lines_and_names(spark):
    lines = {
        "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: MPL-2.0": "MPL-2.0",
        "# SPDX-License-Identifier: Apache-2.0 OR MIT": "Apache-2.0 OR MIT", "/* SPDX-License-Identifier: MIT OR GPL-2.0-or-later */": "MIT OR GPL-2.0-or-later",
        "Licensed under the BSD 3-Clause License.": "BSD-3-Clause", "This project is licensed under the ISC licence": "ISC",
        "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0", "Released under the zlib License.": "Zlib",
        "SPDX-License-Identifier: Nothing-1.0": "",
    }
    d = spark.createDataFrame([(i, f"code\n{line}\nmore") for i, line in enumerate(lines)], "doc_id int, text string")
    assert [r["licenses"] for r in scan_licenses(d).orderBy("doc_id").collect()] == list(lines.values())


def test_long_texts_and_names(spark):
    text = "word " * 300_000 + "\nMIT License\n" + "x" * 500_000
    bsd = (FOLDER / "BSD-3-Clause.txt").read_text("utf-8").replace("the University", "Some Body of " + "a very long name " * 20)
    d = spark.createDataFrame([(1, text), (2, bsd)], "doc_id int, text string")
    found = {r["doc_id"]: r for r in scan_licenses(d).collect()}
    assert found[1]["licenses"] == "MIT" and found[2]["whole_license"] == "BSD-3-Clause"
