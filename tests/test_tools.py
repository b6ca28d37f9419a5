import os

import pytest

from factloom.sources.tables import table
from factloom.tools import TOOLS

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_tools_answer(spark):
    v = table(spark, DIR, "slot_values").filter("subject_id is not null and lower(trim(source)) <> 'user'").orderBy("value_id").first()
    got = {r.slot: r for r in TOOLS["facts"](spark, DIR, v.subject_id, "2030-01-01").collect()}
    assert v.slot in got and all(r.status in ("missing", "resolved", "conflict") for r in got.values())
    assert TOOLS["facts"](spark, DIR, "nobody", "2030-01-01").count() == 0
    e = TOOLS["entities"](spark, DIR, v.vault).collect()
    assert e and len({x.entity_id for x in e}) == len(e) and TOOLS["entities"](spark, DIR, "none").count() == 0
    p = table(spark, DIR, "parts").filter("source_id is not null").orderBy("segment_id").first()
    parts = TOOLS["source"](spark, DIR, p.source_id).collect()
    assert p.text in [x.text for x in parts] and [x.ordinal for x in parts] == sorted(x.ordinal for x in parts)
    hits = TOOLS["find"](spark, DIR, "vertrag", 3).collect()
    assert [h["rank"] for h in hits] == list(range(1, len(hits) + 1)) and all("ertrag" in h.excerpt for h in hits)
