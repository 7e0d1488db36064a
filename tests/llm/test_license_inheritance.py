"""Licences inherited in random trees of directories against a walk up by hand."""

import random

import pytest

from pixelspark.llm import license_scan

TEXTS = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_ancestor(spark, seed):
    draw, rows, given = random.Random(seed), [], {}
    dirs = {"/".join(draw.choice("abc") for _ in range(draw.randrange(0, 5))) for _ in range(60)}
    for k, d in enumerate(sorted(dirs)):
        if draw.random() < 0.3:
            given[d] = draw.choice(list(TEXTS))
            rows.append((f"{d}/LICENSE" if d else "LICENSE", TEXTS[given[d]]))
        rows += [(f"{d}/f{k}.{n}" if d else f"f{k}.{n}", draw.choice(("plain words", "", None))) for n in range(draw.randrange(3))]
    rows += [(None, "no path"), rows[0], ("lone/dir/x", "words")]
    table = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(rows)], "doc_id long, path string, text string").selectExpr("*", "'clash' AS license", "1 AS dir")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"], r["distance"]) for r in license_scan.scan(table).collect()}
    assert len(got) == len(rows) and len(given) > 5
    for k, (path, text) in enumerate(rows):
        own = next((name for name, t in TEXTS.items() if t == text), None)
        want = (own, own, None, None)
        if own is None and path is not None:
            parts = path.split("/")[:-1]
            for up in range(len(parts) + 1):
                d = "/".join(parts[: len(parts) - up])
                if d in given:
                    want = (None, given[d], d, up)
                    break
        assert got[k] == want, (path, text)
    assert license_scan.scan(table.limit(0)).count() == 0
