"""Operators on small tables, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sievemill.operators import audit, grid, labeling, pairing, replay, selection, tables
from sievemill.plans import cycle, inspect
from sievemill.plans.cases import _cut
from sievemill.sources import artifacts, config, logs, prompts, schemas
from sievemill.streaming import ingest


def test_round_robin_equals_a_loop(spark):
    rng = random.Random(3)
    for case in range(4):
        rows = [(c, f"p{i:03}", rng.randrange(20)) for i, c in enumerate(rng.choices("abcd", k=40))]
        offset, cap, size = case, 3 + case, 9
        queues = {c: sorted([r for r in rows if r[0] == c], key=lambda r: (-r[2], r[1]))[:cap] for c in sorted({r[0] for r in rows})}
        cells = list(queues)
        cells = cells[offset % len(cells) :] + cells[: offset % len(cells)]
        want = []
        while len(want) < size and any(queues.values()):
            for c in cells:
                if queues[c] and len(want) < size:
                    want.append(queues[c].pop(0)[1])
        df = selection.ranked(spark.createDataFrame(rows, "cell string, id string, s int"), "cell", [F.desc("s"), F.asc("id")], cap)
        got = selection.round_robin(df, "cell", selection.turns_by_name(df, "cell", offset), size, whole=True)
        assert [r["id"] for r in got.orderBy("seat").collect()] == want
    assert selection.round_robin(df, "cell", selection.turns_by_name(df, "cell"), 1000, whole=True).count() == 0


def test_rotation_draws_as_the_loop_would(spark):
    rows = [("b", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5)]
    rng = random.Random(9)
    for n in (2, 2, 1):
        rng.shuffle(list(range(n)))
    assert selection.rotation(spark.createDataFrame(rows, "cell string, seen int"), "cell", "seen", 9) == rng.randrange(3)


def test_appends_are_idempotent(spark):
    old = spark.createDataFrame([("a", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 1), ("", 4)], "id string, v int")
    assert [tuple(r) for r in tables.append_new(old, new, "id", [F.col("v")]).collect()] == [("b", 2)]
    kept = tables.keep_last(new.where("id = 'b'"), ["id"], [F.col("v")])
    assert [tuple(r) for r in kept.collect()] == [("b", 3)]
    assert {tuple(r) for r in tables.same_keys(old, new, "id").collect()} == {("b", "right"), (None, "right"), ("", "right")} | {("b", "right")}


def test_typed_vote_needs_cliques(monkeypatch):
    near = lambda a, b, mode: abs(ord(a) - ord(b)) <= 1
    monkeypatch.setattr(labeling.grading, "equivalent", near)
    assert labeling.typed_vote(["a", "b", "c"], None, 3) == (None, [3], 0.0, "non_transitive_answer_equivalence")
    assert labeling.typed_vote(["x", "a", "y", None], None, 4) == ("x", [2, 1], 0.5, None)


def test_pairs_are_seeded_and_apart():
    catalog = [("a", "c1", frozenset()), ("b", "c1", frozenset({"r"})), ("c", "c2", frozenset({"r"})), ("d", "c3", frozenset())]
    one = pairing.plan_pairs(catalog, ["c1", "c2", "c3", "c4"], 20, 123)
    assert one == pairing.plan_pairs(catalog, ["c1", "c2", "c3", "c4"], 20, 123) != pairing.plan_pairs(catalog, ["c1", "c2", "c3", "c4"], 20, 124)
    assert all({a, b} != {"b", "c"} and a != b and 0 <= s < 2**31 for a, b, s in one)
    with pytest.raises(ValueError):
        pairing.plan_pairs(catalog[:1], ["c1"], 1, 1)


def test_index_is_rebuilt_from_logs(spark):
    problems = spark.createDataFrame([("p1", "q", "algebra/search", 0), ("p1", "q2", "algebra/search", 1), ("p2", "r", "algebra/search", 0), ("p3", "s", "calculus/decision", 2)], "problem_id string, question string, cell string, created_iteration int")
    scores = spark.createDataFrame([("p1", 1, 1, 1, 0.1), ("p1", 1, 1, 2, 0.4), ("p2", 1, 1, 3, 0.3), ("p2", 2, 2, 4, 0.2)], "problem_id string, iteration int, policy_version int, seq int, rq_score double")
    index = inspect.rebuild_index(problems, scores)
    rows = index.collect()
    assert len(rows) == 35 and rows[0]["cell"] == "algebra/decision"
    assert {(r["cell"], r["n"], r["representative"]) for r in rows if r["n"]} == {("algebra/search", 2, "p1"), ("calculus/decision", 1, "p3")}
    events = spark.createDataFrame([("rejected",), ("passed",)], "status string")
    assert tuple(inspect.summary(index, events).first()) == (3, 2, 2, 1)
    with pytest.raises(KeyError):
        inspect.rebuild_index(problems, scores.withColumn("problem_id", F.lit("stray")))


def test_logs(spark, tmp_path):
    path, schema = str(tmp_path / "log.jsonl"), "a long, b string"
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(schema)
    read = lambda: sorted(tuple(r) for r in logs.read_log(spark, path, schema).collect())
    assert read() == [] and logs.repair_log(spark, path) is False
    (tmp_path / "log.jsonl").write_bytes(b'{"a":1,"b":"x"}\n\n{"a":2,"b":"\xc3\xa9"}\n{"a":3,')
    assert read() == [(1, "x"), (2, "\u00e9")]
    assert logs.repair_log(spark, path) and read() == [(1, "x"), (2, "\u00e9")]
    (tmp_path / "log.jsonl").write_bytes(b'{"a":1,"b":"x"}\n{"a":2,"b":"y"}')
    assert read() == [(1, "x"), (2, "y")]
    logs.append_log(spark, path, [{"b": "z", "a": 3}])
    assert (tmp_path / "log.jsonl").read_bytes() == b'{"a":1,"b":"x"}\n{"a":2,"b":"y"}\n{"a":3,"b":"z"}\n'
    for bad in (b'{"a":1\n{"a":2}\n', b'[1]\n', b'{"a":1}\n{"a":\n'):
        (tmp_path / "log.jsonl").write_bytes(bad)
        with pytest.raises(Exception, match="not a JSON object"):
            read()


def test_broken_tails_are_told_by_their_place(spark, tmp_path):
    from pyspark.sql.types import StructType

    file, path, schema = tmp_path / "log.jsonl", str(tmp_path / "log.jsonl"), StructType.fromDDL("a string")
    read = lambda: [r["a"] for r in logs.read_log(spark, path, schema).collect()]
    whole = '{"a":"\u00e9\u00fc"}\n'.encode()
    file.write_bytes(whole + b'{"a":"\xc3')  # cut within a character
    assert read() == ["\u00e9\u00fc"] and logs.repair_log(spark, path) and file.read_bytes() == whole and not logs.repair_log(spark, path)
    file.write_bytes(whole + b'{"a":\n' + whole + b'{"a":')  # the same text within is no tail
    with pytest.raises(Exception, match="not a JSON object"):
        read()
    file.write_bytes(b'{"a":')
    assert read() == []
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = [f"row {i}" for i in range(2000)]
        file.write_bytes("".join(logs.stable_json({"a": r}) + "\n" for r in rows).encode() + b'{"a":"row 7')
        assert sorted(read()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_all_logs_are_repaired(spark, tmp_path):
    (tmp_path / "score_observations.jsonl").write_bytes(b'{"a":1}')
    (tmp_path / "candidate_events.jsonl").write_bytes(b'{"a":1}\n{"b"')
    (tmp_path / "training_events.jsonl").write_bytes(b'{"a":1}\n')
    assert logs.repair_logs(spark, str(tmp_path)) == ["candidate_events", "score_observations"]
    assert (tmp_path / "candidate_events.jsonl").read_bytes() == (tmp_path / "score_observations.jsonl").read_bytes() == b'{"a":1}\n'
    assert logs.repair_logs(spark, str(tmp_path)) == [] and len(list(tmp_path.iterdir())) == 3


def test_prefix_and_documents(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "events.jsonl")
    first = b'{"a":1}\n'
    (tmp_path / "events.jsonl").write_bytes(first + b'{"a":2}\n')
    digest = hashlib.sha256(first).hexdigest()
    faults = lambda *a: [r["fault"] for r in logs.prefix_faults(spark, path, *a).collect()]
    assert faults(0, "") == [] and faults(len(first), digest) == [] and faults(99, digest) == ["shorter_than_checkpoint"] and faults(len(first), "0") == ["prefix_changed"]
    assert faults(3, hashlib.sha256(first[:3]).hexdigest()) == ["not_at_row_end"]
    logs.write_document(spark, str(tmp_path / "d.json"), {"b": 1, "a": ["\u00e9"]})
    assert logs.read_document(spark, str(tmp_path / "d.json")) == {"a": ["\u00e9"], "b": 1}
    assert logs.file_hash(spark, path).first()["sha256"] == hashlib.sha256(first + b'{"a":2}\n').hexdigest()


def test_stream_appends_once(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "id string, v int").coalesce(1)
    for _ in range(2):
        one.write.mode("append").parquet(str(source))
        rows = spark.readStream.schema("id string, v int").parquet(str(source))
        ingest.append_stream(rows, table, "id", ["v"], str(tmp_path / "check")).awaitTermination()
        one = spark.createDataFrame([("b", 7), ("c", 7)], "id string, v int").coalesce(1)
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [("a", 1), ("b", 1), ("c", 7)]


def test_cycle_phases_and_recovery():
    state = cycle.advance(cycle.State(), "policy_frozen", cycle_id="c")
    with pytest.raises(ValueError):
        cycle.advance(state, "update_applied")
    assert cycle.recover(state) == (cycle.State(iteration=1), "aborted")
    assert cycle.recover(cycle.State(2, "checkpointed", 1, "c", "b")) == (cycle.State(iteration=3, global_step=1), None)
    with pytest.raises(ValueError):
        cycle.recover(cycle.State(2, "update_applied", 1, "c", "b"))
    assert list(cycle.wave_sizes(config.Waves(), lambda: 0, 32)) == [64, 32, 32]
    assert list(cycle.wave_sizes(config.Waves(), lambda: 40, 32)) == [64]
    assert cycle.more_cycles(cycle.State(iteration=319), config.Config()) and not cycle.more_cycles(cycle.State(iteration=320), config.Config())


def test_config_extends_and_checks():
    files = {"d/base.json": '{"seed": 1, "waves": {"first": 8}}', "d/run.json": '{"extends": "base.json", "waves": {"refill": 4}}', "d/a.json": '{"extends": "b.json"}', "d/b.json": '{"extends": "a.json"}'}
    found = config.build(config.load("d/run.json", files.__getitem__))
    assert (found.seed, found.waves.first, found.waves.refill) == (1, 8, 4)
    with pytest.raises(ValueError, match="each other"):
        config.load("d/a.json", files.__getitem__)
    for bad in ({"speed": 1}, {"waves": {"size": 1}}, {"scores": {"low": 0.9}}, {"selection": {"lag": 2}}):
        with pytest.raises(ValueError):
            config.build(bad)


def test_prompts(spark):
    df = spark.createDataFrame([("a $right b", None)], "l string, r string")
    got = df.select(prompts.messages(("user", prompts.render("1: $left 2: $right.", left=F.col("l"), right=F.col("r")))).alias("m")).first()["m"]
    assert [tuple(x) for x in got] == [("user", "1: a $right b 2: .")]
    with pytest.raises(KeyError):
        prompts.render("$other", left=F.col("l"))


def test_audits(spark):
    groups = spark.createDataFrame([("o1", "p1", "score", 8, [("user", "q")], "7", ("expression", None), 1, 4), ("o2", "", "label", 7, [("user", "q")], "7", ("expression", None), 1, 4)], "observation_id string, problem_id string, purpose string, payload_rows int, messages array<struct<role:string,content:string>>, answer string, verifier struct<mode:string,elements:array<string>>, policy int, iteration int")
    good = groups.withColumns({"prompt_hash": replay.prompt_hash(F.col("messages")), "answer_hash": replay.answer_hash(F.col("answer")), "verifier_hash": replay.verifier_hash(F.col("verifier.mode"), F.col("verifier.elements"))})
    row = good.first()
    sha = lambda v: hashlib.sha256(logs.stable_json(v).encode()).hexdigest()
    assert (row["prompt_hash"], row["answer_hash"], row["verifier_hash"]) == (sha([{"role": "user", "content": "q"}]), sha({"answer": "7"}), sha({"verifier": {"mode": "expression"}}))
    one = spark.createDataFrame([("set", ["a", "b"], ("u", 1, 2, 3, "c"))], "m string, e array<string>, p struct<run_uuid:string,policy_version:int,adapter_version:int,global_step:int,source_checkpoint:string>")
    got = one.select(replay.verifier_hash(F.col("m"), F.col("e")).alias("v"), replay.policy_hash(F.col("p")).alias("p")).first()
    assert (got["v"], got["p"]) == (sha({"verifier": {"mode": "set", "elements": ["a", "b"]}}), sha({"run_uuid": "u", "policy_version": 1, "adapter_version": 2, "global_step": 3, "source_checkpoint": "c"}))
    assert {tuple(r) for r in audit.replay_checks(good).collect()} == {("o2", "purpose"), ("o2", "ids"), ("o2", "payload_rows")}
    assert {tuple(r) for r in audit.buffer_checks(good).collect()} == {("*", "group_size")}
    assert audit.buffer_checks(good.limit(0)).count() == 0
    rows = spark.createDataFrame([("o1", "h", True)] * 8 + [("o2", "h", True)] * 7 + [("o2", "k", False)], "observation_id string, payload_hash string, marked boolean")
    assert {tuple(r) for r in audit.served_checks(rows, groups=2).collect()} == {("o2", "one_payload"), ("o2", "marked")}
    a = spark.createDataFrame([("o1", 0, 1.0), ("o1", 1, 0.2)], "o string, i int, reward double")
    b = spark.createDataFrame([("o1", 0, True), ("o1", 1, True), ("o1", 2, False)], "o string, i int, correct boolean")
    assert {tuple(r) for r in audit.flags_agree(a, b, ["o", "i"]).collect()} == {("o1/1", "reward"), ("o1/2", "reward")}
    candidates = spark.createDataFrame([("o1", "p", 0.5, 0.4, 1, 2), ("o2", "p", 1.5, None, 2, 2)], "observation_id string, problem_id string, current_s double, selection_s double, selection_iteration int, score_iteration int")
    assert {tuple(r) for r in audit.candidate_checks(candidates, 1).collect()} == {("o2", "current_s"), ("o2", "lag")}
    parts = spark.createDataFrame([("g", 0, 0, "x"), ("g", 1, 0, "x"), ("h", 0, 0, "x"), ("h", 0, 0, "y")], "g string, attempt int, sample_index int, prompt_hash string")
    assert {tuple(r) for r in audit.fragments(parts, "g").collect()} == {("h", "one_prompt"), ("h", "indices")}
    with pytest.raises(ValueError, match="purpose"):
        audit.require(audit.replay_checks(good), "replay")


def test_first_needed_spans_attempts(spark):
    rows = spark.createDataFrame([("g", a, i, not (a == 0 and i < 2)) for a in range(3) for i in range(4)], "g string, attempt int, i int, ok boolean")
    got = tables.first_needed(rows, "g", [F.col("attempt"), F.col("i")], F.col("ok"), 5).orderBy("sample_seq").collect()
    assert [(r["attempt"], r["i"]) for r in got] == [(0, 2), (0, 3), (1, 0), (1, 1), (1, 2)]


def test_lineage_and_schemas(spark):
    parents = spark.createDataFrame([("a", ["x"], 2), ("b", [], 0)], "id string, roots array<string>, generation int")
    child = spark.createDataFrame([("c", "a", "b")], "id string, left_id string, right_id string")
    row = grid.lineage(child, parents).first()
    assert (row["roots"], row["generation"]) == (["b", "x"], 3)
    assert all(schemas.schema(t).names for t in schemas.TABLES)


def test_greedy_keeps_what_a_loop_keeps(spark):
    from sievemill.operators import novelty

    rng = random.Random(8)
    ranks = list(range(1, 25))
    edges = {(b, a) for a in ranks for b in ranks if b > a and rng.random() < 0.15}
    kept: list[int] = []
    for r in ranks:
        if not any((r, k) in edges for k in kept):
            kept.append(r)
    rows = spark.createDataFrame([(1, r) for r in ranks], "wave int, rank int")
    table = spark.createDataFrame([(1, a, b) for a, b in edges], "wave int, rank int, better int")
    out = novelty.greedy_keep(rows, table, "wave", "rank", _cut(spark)).where("kept").orderBy("rank").collect()
    assert [r["rank"] for r in out] == kept


def test_wave_evidence_is_the_most_over_its_threshold(spark):
    from sievemill.operators import novelty

    edges = spark.createDataFrame([(1, 4, 1, 0.95, 0.9, "wave"), (1, 4, 2, 0.8, 0.7, "sibling"), (1, 4, 3, 1.0, 0.7, "sibling"), (1, 5, 3, 1.0, 0.9, "wave")], "wave int, rank int, better int, maximum double, threshold double, reason string")
    kept = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, False), (1, 5, True)], "wave int, rank int, kept boolean")
    assert [tuple(r) for r in novelty.wave_evidence(edges, kept, "wave", "rank").collect()] == [(1, 4, "sibling", 2, 0.8)]


def test_artifacts_are_made_once(spark, tmp_path):
    root, made = str(tmp_path), []

    def make():
        made.append(1)
        return spark.createDataFrame([("p", 1), ("q", 2)], "id string, v int")

    for _ in range(2):
        assert artifacts.cached(spark, root, "pairs", 3, 2, make).count() == 2
    assert made == [1]
    with pytest.raises(ValueError, match="planned"):
        artifacts.cached(spark, root, "pairs", 3, 5, make)
    artifacts.write(make(), root, "pairs", 4)
    assert artifacts.read(spark, root, "pairs", (4,)).select("iteration").distinct().collect()[0][0] == 4 and artifacts.read(spark, root, "pairs").count() == 4


def test_manifests():
    one = artifacts.manifest({"seed": 1, "training": {"resume_mode": "auto", "steps": 2}}, {"seeds": "ab"}, "u", "x")
    two = artifacts.manifest({"seed": 1, "training": {"resume_mode": "off", "steps": 2}}, {"seeds": "ab"}, "u", "y")
    assert artifacts.manifest_changes(one, two) == []
    assert artifacts.manifest_changes(one, artifacts.manifest({"seed": 2}, {"seeds": "ac"}, "u")) == ["config", "sha256"]
