"""All signals of the ablation from one pass over the windows, against one pass for each."""

import pytest

from auditweave.operators import evaluate, ordered
from auditweave.plans import evaluation


@pytest.mark.parametrize("mode", ["isolated", "graph"])
def test_signals_together_equal_each_alone(spark, sf_dir, mode):
    events, earlier = evaluation._halves(spark, sf_dir)
    clouds = None
    if mode == "graph":
        events, clouds = evaluate.stitch_for_evaluation(events, earlier.where("is_attack = 0"), mode)
    together = evaluate.run_signals(events, clouds, mode, ["iforest", "classifier"])
    got = {r["event_id"]: tuple(r)[1:] for r in together.select("event_id", "scaled_score_if_score", "scaled_score_clf_score").collect()}
    alone = [
        {r["event_id"]: r["scaled_score"] for r in evaluate.run_mode(events, clouds, mode, s).select("event_id", "scaled_score").collect()}
        for s in ("iforest", "classifier")
    ]
    assert len(got) == events.count() and got == {e: (alone[0][e], alone[1][e]) for e in alone[0]}


def test_ablation_reads_the_windows_of_a_table_once(spark, sf_dir, monkeypatch):
    calls = []
    recent = ordered.recent
    monkeypatch.setattr(ordered, "recent", lambda *a, **kw: calls.append(1) or recent(*a, **kw))
    events, earlier = evaluation._halves(spark, sf_dir)
    table = evaluate.ablation(events, earlier, modes=("isolated", "graph")).select("mode", "signal", "tp", "fp", "tn", "fn")
    found = {(r["mode"], r["signal"]): r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in table.collect()}
    assert len(calls) == 2 and len(found) == 4 and set(found.values()) == {events.count()}
