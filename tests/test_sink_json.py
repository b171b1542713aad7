"""The JSON output: what it writes on its way."""

import json

from vigil.plans import q_triage
from vigil.plans.q_core import corpus_of
from vigil.plans.queries import load_all

SF = "/root/testdata/sf0.001"


def test_only_findings_that_may_have_duplicates_are_written(spark, monkeypatch):
    written = {}

    def stage(session, df, name):
        out = stage.real(session, df, name)
        written[name] = out.count()
        return out

    stage.real = q_triage.checkpoint_table
    monkeypatch.setattr(q_triage, "checkpoint_table", stage)
    lines = load_all()["sink_json"].build(spark, SF)
    findings = [json.loads(r.json) for r in lines.where("kind = 'finding'").collect()]
    want = {r.id: (r.is_duplicate, r.duplicate_of, r.auto_ignored, r.auto_ignore_reason, r.contextual_severity)
            for r in q_triage._tri(spark, SF).collect()}
    assert {f["id"]: (f["is_duplicate"], f["duplicate_of"], f["auto_ignored"], f["auto_ignore_reason"], f["contextual_severity"])
            for f in findings} == want
    in_groups = {f["id"] for f in findings if f["is_duplicate"]} | {f["duplicate_of"] for f in findings if f["is_duplicate"]}
    assert 0 < len(in_groups) <= written["triaged"] < corpus_of(spark, SF).findings.count() / 2
