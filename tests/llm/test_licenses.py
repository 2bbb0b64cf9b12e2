"""License scans: whole queries against a scan of all rules without gates, and rule by rule."""

import re
import time

import pytest

from lexmill.llm import licenses, queries
from tests.llm.test_kernels import brute_base, pattern_samples


def fold(text: str) -> bytes:
    return b" " + b" ".join(text.encode().translate(licenses._FOLD).split()) + b" "


def plain_detections(folded: bytes) -> list[tuple]:
    """Every rule in order, no gates; a match inside an accepted one is dropped."""
    accepted = []
    for i, (label, _, pattern, sure) in enumerate(licenses.RULES):
        for m in pattern.finditer(folded):
            if not any(a <= m.start() and m.end() <= b for a, b, *_ in accepted):
                accepted.append((m.start(), m.end(), label, sure, i))
    return sorted(accepted)


def plain(key, text):
    n, at, own = brute_base(text or "")
    found = plain_detections(fold(text or ""))
    score = max([*(x[3] for x in found), *[0.95] * bool(at)], default=0.0)
    return key, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[2] for x in found})), score, len(found)


COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]


def check(got, rows):
    assert sorted(str(tuple(r[c] for c in COLUMNS)) for r in got) == sorted(str(plain(*r)) for r in rows)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(queries.op8_license_scan(spark, "/root/testdata/sf0.001").collect(), rows)


def test_odd_rows(spark):
    many = "Under the MIT License, or CC-BY-NC; GPL-2.0-or-later. " * 40
    rows = [(1, None), (2, ""), (3, " \n"), (4, many), (4, many), (4, "MIT Licensed"), (None, "licensed under the GPL"), (None, None), (5, "日本 é under the mit license"), (6, "x" * 300_000 + " apache license version 2.0"), (7, "license " * 2000)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, labels string, score double")
    check(licenses.license_scan(df).collect(), rows)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_a_page_of_notices_takes_linear_time():
    kinds = ["under the MIT License", "SPDX-License-Identifier: Apache-2.0", "CC BY-NC-SA 4.0", "GNU Lesser General Public License v2.1 or later", "all rights reserved"]
    folded = fold(". ".join(f"{kinds[i % 5]} in part {i}" for i in range(100_000)))
    began = time.process_time()
    assert len(licenses.detect(folded)) == 100_000
    assert time.process_time() - began < 15
    assert licenses.detect(folded[:20_000]) == plain_detections(folded[:20_000])


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("MIT Licensed", {"mit"}),
        ("the Python license", {"python-2"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2-or-later"}),
        ("SPDX-License-Identifier: LGPL-2.1-only", {"lgpl-2.1-only"}),
        ("GNU General Public License version 3 or (at your option) any later version", {"gpl-3-or-later"}),
        ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", {"gpl-2-or-later"}),
        ("licensed under the GPLv2", {"gpl-2"}),
        ("Apache 2.0 licensed", {"apache-2"}),
        ("Community Data License Agreement - Permissive, Version 2.0", {"cdla-permissive"}),
        ("PolyForm Noncommercial License 1.0.0", {"polyform-nc"}),
        ("a later version of the plan, only for readers", set()),
    ],
)
def test_rules(text, labels):
    assert {x[2] for x in licenses.detect(fold(text))} == labels


def test_every_name_is_found_in_a_notice():
    assert len(licenses.NAMES) + len(licenses.BODIES) + len(licenses.SHORT) > 280
    for label, _, pattern in licenses.NAMES:
        for sample in [x for x in pattern_samples(re._parser.parse(pattern)) if x == " ".join(x.split())][:40]:
            folded = fold(f"this file is licensed under the terms of {sample} .")
            found = licenses.detect(folded)
            assert found == plain_detections(folded) and found, (label, sample)
