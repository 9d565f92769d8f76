"""License notices in long lines, over several lines, several to a line, full texts and SPDX lines."""

import random

from pyspark.sql import functions as F

from ratertrail.llm import license_scan

GIVEN = tuple(sorted([*license_scan.TEMPLATES.items(), *license_scan.FULL_TEXTS]))


def names(text):
    return [x[1] for x in license_scan.scan_text(text, GIVEN) if x[1]]


def test_notice_in_a_long_line():
    rnd = random.Random(1)
    for name, text in license_scan.TEMPLATES.items():
        prose = [rnd.choice("work version public general the under project river stone light many years of trade and song".split()) + rnd.choice(["", ",", "."]) for _ in range(16_000)]
        at = rnd.randrange(len(prose))
        long = " ".join(prose[:at]) + ". " + text + " " + " ".join(prose[at:])
        assert len(long) > 80_000 and names(long) == [name]


def test_wrapped_and_double_notices():
    assert [x[:2] for x in license_scan.scan_text("a\nLicensed under the Apache License,\nVersion 2.0.\nb", GIVEN)] == [(1, "Apache-2.0")]
    assert names("// Licensed under the\n//   Apache\n//\n// License, Version 2.0.") == ["Apache-2.0"]
    assert names("Released under the MIT License. Licensed under CC BY 4.0.") == ["MIT", "CC-BY-4.0"]
    assert names("Released under the MIT License.Licensed under CC BY 4.0.") == ["MIT", "CC-BY-4.0"]
    assert names("All\nrights\nreserved. Dedicated to the public\ndomain under CC0 1.0.") == ["LicenseRef-All-Rights-Reserved", "CC0-1.0"]
    assert names("Licensed under the Apache License,\nVersion 7.0.") == []
    for name, text in license_scan.TEMPLATES.items():
        assert names(text.replace(" ", "\n")) == [name]
        assert names(text + " " + text) == [name, name]


def test_full_texts_and_spdx_lines(spark):
    full = dict(license_scan.FULL_TEXTS)
    for name in ("MIT", "ISC", "BSD-2-Clause"):
        assert names(full[name]) == [name] and names("Copyright (c) 2020 X\n\n" + "\n".join(" * " + w for w in full[name].split()) + "\nend") == [name]
    clauses = " ".join(f"clause{k}" for k in range(90))
    assert names(full["BSD-2-Clause"] + " " + clauses + " " + full["BSD-3-Clause"]) == ["BSD-3-Clause"]
    assert names("# SPDX-License-Identifier: MIT") == ["MIT"] and names("SPDX-License-Identifier: GPL-3.0-or-later\nx") == ["GPL-3.0"]
    assert names("/* SPDX-License-Identifier: (MIT OR Apache-2.0) */") == ["MIT", "Apache-2.0"] and names("SPDX-License-Identifier: XYZ") == []
    texts = [full["ISC"], None, "SPDX-License-Identifier: ISC", "Released under the MIT License. Licensed under CC BY 4.0."]
    out = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id")
    assert [r[0] for r in out.select(F.col("licenses.license")).collect()] == [["ISC"], [], ["ISC"], ["MIT", "CC-BY-4.0"]]
