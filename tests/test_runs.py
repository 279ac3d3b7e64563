"""Settings, seeds, groups of samples, preflight and cycle summaries."""

import json

import pytest

from sievemill.functions import envelope
from sievemill.operators import groups
from sievemill.plans import cycle, inspect
from sievemill.sources import preflight, seeds, settings

QUESTIONS = [
    ("algebra", "decision", "Does the equation x^2 + 5x + 40 = 0 have a real solution? Answer Yes or No.", "No"), ("geometry", "search", "Find all positive integers x for which 5, 12 and x are sides of a right triangle.", "\\{13\\}"),
    ("number_theory", "counting", "How many primes lie below thirty?", "10"), ("discrete_mathematics", "counting", "How many subsets does a set of five elements have?", "32"),
    ("applied_mathematics", "optimization", "Find the maximum of 6x - x^2 over the real numbers.", "9"), ("calculus", "function", "Compute the value of the integral of 2x from 0 to 3.", "9"), ("precalculus", "function", "Compute the value of the sine of thirty degrees.", "1/2"),
]


def seed_rows():
    modes = {"decision": "boolean", "search": "set"}
    return [
        {"problem_id": f"s{i}", "question": q, "proposed_answer": a, "pseudo_gold": a, "verifier": {"mode": modes.get(t, "expression")} | ({"elements": ["13"]} if t == "search" else {}), "domain": d, "problem_type": t, "lineage_root_ids": [] if i % 2 else [f"s{i}"]}
        for i, (d, t, q, a) in enumerate(QUESTIONS)
    ]


def put(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_seeds(spark, tmp_path):
    rows = seeds.read_seeds(spark, put(tmp_path / "seeds.jsonl", seed_rows())).collect()
    assert {r["problem_id"]: r["lineage_root_ids"] for r in rows} == {f"s{i}": [f"s{i}"] for i in range(7)}
    for change, fault in (({"domain": "botany"}, "cell"), ({"problem_type": "counting"}, "type"), ({"pseudo_gold": "1, 2"}, "gold_answer"), ({"proposed_answer": ""}, "proposed_answer"), ({"verifier": {"mode": "set"}}, "verifier"), ({"colour": 1}, "unknown_field"), ({"problem_id": "s0"}, "ids")):
        bad = seed_rows()
        bad[5] |= change
        with pytest.raises(ValueError, match=fault):
            seeds.read_seeds(spark, put(tmp_path / "bad.jsonl", bad))
    with pytest.raises(ValueError, match="rows"):
        seeds.read_seeds(spark, put(tmp_path / "few.jsonl", seed_rows()[:6]))
    with pytest.raises(FileNotFoundError):
        seeds.read_seeds(spark, str(tmp_path / "none.jsonl"))


def test_settings():
    files = {"a/base.json": json.dumps({"run": {"name": "x"}, "novelty": {"sibling_similarity_ceiling": 0.8}, "domain": {"old": 1}}), "a/top.json": json.dumps({"extends": "base.json", "run": {"master_seed": 7}}), "loop.json": '{"extends": "loop.json"}'}
    full = settings.settle(settings.load("a/top.json", files.__getitem__))
    assert full["run"] == settings.DEFAULTS["run"] | {"name": "x", "master_seed": 7}
    made = settings.config(full)
    assert made.seed == 7 and made.novelty.sibling == 0.8 and made.waves.most == 128
    with pytest.raises(ValueError, match="extend each other"):
        settings.load("loop.json", files.__getitem__)
    for values, what in (
        ({"colour": {}}, "unknown settings"), ({"run": {"colour": 1}}, "run.colour"), ({"labeling": {"num_rollouts": 8}}, "num_rollouts must be 9"), ({"scoring": {"top_p": 0}}, "scoring.top_p"), ({"scoring": {"frontier_s_hat_low": 0.9}}, "band"), ({"frontier": {"selection_lag": True}}, "selection_lag"),
        ({"frontier": {"max_per_cell_per_batch": 0}}, "cannot fill"), ({"run": {"max_iterations": 256}}, "warm-up"), ({"novelty": {"near_duplicate_threshold": True}}, "near_duplicate"), ({"novelty": {"parent_containment_min_shared_shingles": 1.5}}, "whole number"), ({"backend": {"kind": "other"}}, "backend.kind"),
        ({"verl_config": {"data": {"train_batch_size": 31}}}, "batch size"), ({"verl_config": {"ray_init": {"num_cpus": None}}}, "num_cpus"), ({"verl_config": {"ray_init": {"num_cpus": 16, "object_store_memory": 1}}}, "1 GiB"), ({"training": {"replay_score_rollouts": False}}, "replay"), ({"novelty": {"min_question_chars": 9999}}, "bounds"),
    ):
        with pytest.raises(ValueError, match=what):
            settings.settle(values)


def test_yaml_settings():
    pytest.importorskip("yaml")
    files = {"c/base.yaml": "run:\n  name: base\ngeneration:\n  temperature: 0.5\n", "c/top.yaml": "extends: base.yaml\nbackend:\n  n_gpus: 4\n"}
    full = settings.settle(settings.load("c/top.yaml", files.__getitem__))
    assert (full["run"]["name"], full["generation"]["temperature"], full["backend"]["n_gpus"]) == ("base", 0.5, 4)


def test_groups(spark):
    rows = spark.createDataFrame([("r", a, i, f"{a}{i}", p, h) for a, i, p, h in ((0, 0, 10, "h"), (0, 2, 12, "h"), (1, 0, 20, ""))] + [("q", 0, 0, "x", 5, "h"), ("q", 1, 0, "y", None, "g")], "request_id string, attempt int, sample_index int, text string, payload_row int, prompt_hash string")
    got = {(r["request_id"], r["sample_index"]): r["text"] for r in groups.together(rows).collect()}
    assert got == {("r", 0): "00", ("r", 1): "02", ("r", 2): "10", ("q", 0): "x", ("q", 1): "y"}
    assert {tuple(r) for r in groups.fragment_faults(rows).collect()} == {("q", "one_prompt"), ("q", "one_kind")}
    whole = groups.together(rows)
    ask = lambda *w: spark.createDataFrame([("r", i, k) for k, i in enumerate(w)], "request_id string, sample_index int, seat int")
    assert [(r["sample_index"], r["payload_row"]) for r in groups.picked(whole, ask(2, 0, 2)).orderBy("sample_index").collect()] == [(0, 20), (1, 10), (2, 20)]
    with pytest.raises(Exception, match="no sample 3"):
        groups.picked(whole, ask(3)).collect()


def test_authorised_batches_and_retries(spark):
    batch = lambda b, ids: spark.createDataFrame([(b, i) for i in ids], "batch_id string, observation_id string")
    none, two = batch("b", []), batch("b", ["o1", "o2"])
    faults = lambda *a: {r["fault"] for r in groups.authorisation_faults(*a, size=2).collect()}
    assert faults(two, none) == set() and faults(two, two) == set() and faults(batch(" ", ["o1", "o2"]), none) == {"empty_id"}
    assert faults(batch("b", ["o1", "o1"]), none) == faults(batch("b", ["o1"]), none) == {"group_count"} and faults(batch("c", ["o1", "o2"]), two) == faults(batch("b", ["o1", "o3"]), two) == {"other_batch"}
    samples = spark.createDataFrame([("a", "accepted")] * 3 + [("b", "accepted"), ("b", "rejected")], "g string, status string")
    told = lambda n: {tuple(r) for r in groups.label_statuses(samples, "g", n, 2, 3).collect()}
    assert told(1) == {("a", 3, "complete", None), ("b", 1, "retrying", "incomplete_label_group")} and told(2) == {("a", 3, "complete", None), ("b", 1, "rejected", "incomplete_label_group")}


def test_cycle_summary_and_order(spark):
    state = lambda v: spark.createDataFrame([(v,)], "policy_version int")
    problems = spark.createDataFrame([(-1,), (0,), (1,), (1,), (2,)], "created_iteration int")
    events = spark.createDataFrame([(1, "c1", "archive", "accepted", 0), (1, "c2", "parse", "rejected", 0), (1, "c3", "archive", "accepted", 1), (0, "c0", "archive", "accepted", 0)], "iteration int, candidate_id string, phase string, status string, wave int")
    updates = spark.createDataFrame([(1, "applied", None, "b", None), (1, "checkpointed", None, "b", "step_1"), (0, "skipped", "short", None, None)], "iteration int, status string, reason string, batch_id string, checkpoint string")
    row = inspect.cycle_summary(1, state(3), state(4), problems, events, state(1), state(1).limit(0), updates).collect()
    assert len(row) == 1 and row[0].asDict() | {"waves": None} == {
        "iteration": 1, "policy_version_before": 3, "policy_version_after": 4, "accepted_before": 2, "accepted_after": 4, "archived_children": 2, "attempted_candidates": 3, "current_frontier_count": 1, "lagged_frontier_count": 0, "update_applied": True,
        "update_skip_reason": None, "replay_batch_id": "b", "checkpoint": "step_1", "waves": None,
    }
    assert [tuple(w) for w in row[0]["waves"]] == [(0, 2, 1), (1, 1, 1)]
    for first in (True, False):
        state_now = cycle.State(phase="scoring")
        for phase in cycle.phase_order(first, True):
            state_now = cycle.advance(state_now, phase)
    assert cycle.phase_order(True, False) == ("discovery", "ready")


def test_preflight(spark, tmp_path):
    put(tmp_path / "seeds.jsonl", seed_rows())
    (tmp_path / "p.txt").write_text("Say $x")
    full = settings.settle({"training": {"resume_mode": "auto"}})
    run = lambda: preflight.preflight(spark, full, str(tmp_path), ("p.txt",))
    assert run()["seed_count"] == 7 and run()["map_cells"] == 35
    out, saved = tmp_path / "output", tmp_path / "checkpoints"
    out.mkdir()
    (out / "run_manifest.json").write_text("{}")
    steps = [
        ("without its state", lambda: (out / "pipeline_state.json").write_text('{"checkpoint_step": 2}')), ("no latest marker", lambda: (saved.mkdir(), (saved / preflight.LATEST).write_text("x"))), ("no number", lambda: (saved / preflight.LATEST).write_text("1")),
        ("at step 2", lambda: (saved / preflight.LATEST).write_text("2")), ("checkpoint 2 is missing", lambda: (saved / "global_step_2").mkdir()),
    ]
    for what, mend in steps:
        with pytest.raises(ValueError, match=what):
            run()
        mend()
    assert run()["resume_mode"] == "auto"
    assert preflight.resume_fault(spark, str(out), str(saved), "disable") and preflight.resume_fault(spark, str(saved), str(tmp_path / "no"), "auto") == "output without a run manifest"


@pytest.mark.parametrize(
    ("text", "items"),
    [
        ("{1, 2}", ["1", "2"]), ("\\{(1,2); [3,4]\\}", ["(1,2)", "[3,4]"]), ("\\left\\{ a_{1,2}, b \\right\\}", ["a_{1,2}", "b"]), ("[]", []), ("\\varnothing", []), ("{ }", []), ("{1,,2}", None), ("{1,2", None), ("{(1,2]}", None), ("3", ["3"]), ("", []),
        (",".join(map(str, range(32))), list(map(str, range(32)))), (",".join(map(str, range(33))), None), (None, []), ("{{1},{2}}", ["{1}", "{2}"]), ("{1},{2}", None),
    ],
)
def test_finite_sets(text, items):
    assert envelope.finite_set(text) == items
