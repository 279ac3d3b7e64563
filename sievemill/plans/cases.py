"""Authored cases for rules on questions and answers, as queries; the SQL lists what each must give."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import envelope, grading
from sievemill.functions import text as T
from sievemill.functions import typing_rules as R
from sievemill.operators import audit, labeling, novelty, scoring, selection
from sievemill.plans import cycle
from sievemill.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def expects(columns: str, rows: list[tuple]) -> Callable:
    """Registers a query whose result is rows. columns: name type, ..."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [c.split()[1] for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT {', '.join(f'CAST({n} AS {k}) AS {n}' for n, k in zip(names, kinds, strict=True))} FROM (VALUES {values}) t({', '.join(names)})"
        return f

    return add


def rows_of(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


Q = "<question>How many primes lie below {}?</question>"
D = "<domain>number_theory</domain>"
RESPONSES = [
    (1, f"{Q.format(30)}{D}\\boxed{{10}}", "How many primes lie below 30?", "number_theory", "10", None),
    (2, f"<think>first \\boxed{{x}}</think>\n{Q.format(20)}\n{D}\n\\boxed{{ 8 }}", "How many primes lie below 20?", "number_theory", "8", None),
    (3, f"{Q.format(12)}\\boxed{{5}} {D}", "How many primes lie below 12?", "number_theory", "5", None),
    (4, f"{Q.format(10)}<geometry>\\boxed{{\\frac{{1}}{{2}}}}</geometry>", "How many primes lie below 10?", "geometry", "\\frac{1}{2}", None),
    (5, f"{Q.format(10)}{D}\\boxed{{4}} as was to be counted", "How many primes lie below 10?", "number_theory", "4", None),
    (6, None, None, None, None, "response_not_string"),
    (7, f"Here it is: {Q.format(10)}", None, None, None, "missing_question_open"),
    (8, "<question>How many?", None, None, None, "missing_question_close"),
    (9, f"{Q.format(10)}{Q.format(11)}{D}\\boxed{{4}}", None, None, None, "multiple_question_blocks"),
    (10, f"{Q.format(10)}{D}{D}\\boxed{{4}}", None, None, None, "multiple_domain_blocks"),
    (11, f"{Q.format(10)}so \\boxed{{4}}", None, None, None, "missing_domain_open"),
    (12, f"{Q.format(10)}<domain>calculus \\boxed{{4}}", None, None, None, "missing_domain_close"),
    (13, f"{Q.format(10)}<domain>Algebra</domain>\\boxed{{4}}", None, None, None, "invalid_domain"),
    (14, f"{Q.format(10)}{D}4", None, None, None, "missing_boxed_answer"),
    (15, f"{Q.format(10)}{D}\\boxed{{4", None, None, None, "unclosed_boxed_answer"),
    (16, f"{Q.format(10)}{D}\\boxed{{4}} or \\boxed{{5}}", None, None, None, "trailing_output"),
    (17, f"<question> \n </question>{D}\\boxed{{4}}", None, None, None, "empty_question"),
    (18, f"{Q.format(10)}{D}\\boxed{{  }}", None, None, None, "empty_answer"),
    (19, f"{Q.format(10)}\\boxed{{4}}", None, None, None, "missing_domain_open"),
    (20, "", None, None, None, "missing_question_open"),
]


@expects("case_id BIGINT, question VARCHAR, domain VARCHAR, answer VARCHAR, reason VARCHAR", [(r[0], *r[2:]) for r in RESPONSES])
def parse_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "case_id long, text string", [r[:2] for r in RESPONSES])
    return rows.select("case_id", envelope.envelope(F.col("text")).alias("e")).select("case_id", "e.*")


BOXES = [(1, "so \\boxed{3} or rather \\boxed{4}", "4"), (2, "\\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), (3, "\\boxed{7} and \\boxed{8", "7"), (4, "nothing", None), (5, "\\boxed{1} then \\boxed{ }", None), (6, "\\boxed{a\\boxed{b}c}", "b"), (7, None, None), (8, "\\boxed{{{2}}}", "{{2}}")]


@expects("case_id BIGINT, answer VARCHAR", [(a, c) for a, _, c in BOXES])
def box_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "case_id long, text string", [r[:2] for r in BOXES]).select("case_id", envelope.boxed(F.col("text")).alias("answer"))


STATEMENTS = [
    (1, "Determine whether 91 is prime.", "decision", None), (2, "Is 91 a prime number?", "decision", None), (3, "Find the largest area of a rectangle of perimeter 12.", "optimization", None),
    (4, "How many ways are there to seat five guests?", "counting", None), (5, "Find all integers n with n^2 = 49.", "search", None), (6, "Compute the sum of the first ten squares.", "function", None),
    (7, "What is the remainder of 2^10 modulo 7?", "function", None), (8, "Prove that 7 is prime.", None, "proof_or_justification"), (9, "Let a be real. Construct a triangle with side a.", None, "unsupported_witness_request"),
    (10, "Compute the area and find the perimeter of the square.", None, "multiple_output_requests"), (11, "How many primes lie below 30, and what is the largest one?", None, "mixed_output_contract"), (12, "Find x.", None, "generic_find_or_determine"),
    (13, "A square has side three.", None, "no_output_contract_cue"), (14, "  \n ", None, "empty_statement"), (15, "Solve the equation x^2 = 9.", "search", None), (16, "Maximize xy for x + y = 4.", "optimization", None), (17, None, None, "empty_statement"),
]


@expects("case_id BIGINT, problem_type VARCHAR, reason VARCHAR", [(a, c, d) for a, _, c, d in STATEMENTS])
def type_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "case_id long, text string", [r[:2] for r in STATEMENTS])
    return rows.select("case_id", R.problem_type(F.col("text")).alias("t")).select("case_id", "t.*")


ANSWERS = [
    (1, "decision", "Yes", None), (2, "decision", "\\text{no}", None), (3, "decision", "perhaps", "decision_answer_not_boolean"), (4, "search", "{-7, 7}", None), (5, "search", "\\{(1,2), (3,4)\\}", None), (6, "search", "{7, 7}", "search_answer_contains_duplicates"),
    (7, "search", "(1, 2", "search_answer_not_finite_set"), (8, "counting", "1,234", None), (9, "counting", "-3", "counting_answer_not_nonnegative_integer"), (10, "function", "12,345", None), (11, "function", "3, 4", "compound_scalar_answer"),
    (12, "function", "(3, 4)", None), (13, "optimization", "{5}", "scalar_answer_has_wrong_shape"), (14, "optimization", "true", "scalar_answer_has_wrong_shape"), (15, "function", "(3", "malformed_scalar_answer"), (16, "function", "2 and 3", "compound_scalar_answer"),
    (17, "function", " ", "empty_answer"), (18, "poem", "5", "unknown_problem_type"), (19, "search", "\\emptyset", None), (20, "function", "\\frac{1}{2}", None), (21, "decision", "1", None), (22, "search", "{1,,2}", "search_answer_not_finite_set"),
]


@expects("case_id BIGINT, fault VARCHAR", [(a, d) for a, _, _, d in ANSWERS])
def contract_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "case_id long, kind string, answer string", [r[:3] for r in ANSWERS]).select("case_id", R.contract_error(F.col("kind"), F.col("answer")).alias("fault"))


SETS = [(1, "{1, 2; 3}", "1|2|3"), (2, "[ ]", ""), (3, "\\left\\{ (1,2), x \\right\\}", "(1,2)|x"), (4, "1, 2", "1|2"), (5, "{1, (2}", None), (6, "{,1}", None), (7, ",".join(map(str, range(33))), None), (8, "∅", ""), (9, "{a} , {b}", None), (10, "5", "5")]


@expects("case_id BIGINT, items VARCHAR", [(a, c) for a, _, c in SETS])
def set_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "case_id long, text string", [r[:2] for r in SETS]).select("case_id", F.array_join(envelope.set_items(F.col("text")), "|").alias("items"))


VERIFIERS = [(1, "decision", "yes", "boolean", None, None), (2, "search", "{1, 2}", "set", "1|2", None), (3, "function", "7", "expression", None, None), (4, "search", "{1, 1}", "set", "1|1", "set_answer_not_unique_finite_set"), (5, "decision", "7", "boolean", None, "boolean_answer_not_yes_no"), (6, "counting", " ", "expression", None, "empty_answer"), (7, "poem", "x", None, None, "unknown_problem_type")]


@expects("case_id BIGINT, mode VARCHAR, items VARCHAR, error VARCHAR", [(r[0], *r[3:]) for r in VERIFIERS])
def verifier_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "case_id long, kind string, answer string", [r[:3] for r in VERIFIERS])
    return rows.select("case_id", R.verifier(F.col("kind"), F.col("answer")).alias("v")).select("case_id", "v.mode", F.array_join("v.elements", "|").alias("items"), "v.error")


GRADES = [
    (1, "0.5", "\\frac{1}{2}", "expression", True), (2, "\\frac12", "1/2", "expression", True), (3, "1,000", "1000", None, True), (4, "2^{10}", "1024", "expression", True), (5, "\\sqrt{49}", "7", "expression", True), (6, "3", "4", "expression", False),
    (7, "x + 1", "x+1", "expression", True), (8, "x + 1", "1 + x", "expression", False), (9, "true", "Yes", "boolean", True), (10, "no", "Yes", "boolean", False), (11, "7", "maybe", "boolean", False), (12, "{2, 1}", "{1, 2}", "set", True),
    (13, "{1, 2, 2}", "{1, 2}", "set", False), (14, "{0.5, 3}", "{3, 1/2}", "set", True), (15, None, "3", "expression", False), (16, "3", None, "expression", False), (17, "50\\%", "0.5", "expression", True), (18, "-(2-5)", "3", "expression", True), (19, "1/0", "1/0", "expression", True), (20, "2(3)", "6", "expression", True),
]


@expects("case_id BIGINT, hit BOOLEAN", [(r[0], r[4]) for r in GRADES])
def grader_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "case_id long, a string, g string, m string", [r[:4] for r in GRADES]).select("case_id", grading.graded(F.col("a"), F.col("g"), F.col("m")).alias("hit"))


#: Answers of nine rollouts in index order, by group.
VOTES = {
    "clear": ["1/2", "0.5", "\\frac{1}{2}", "0.50", "2/4", None, None, None, None], "tie": ["1", "1", "1", "1", "2", "2", "2", "2", "3"], "plurality": ["7", "8", "8.0", "9", "10", None, None, None, None],
    "none": [None] * 9, "short": ["1"] * 8, "first": ["0.25", "1/4", "1/4", "5", "5", "6", None, None, None],
}


@expects("group_id VARCHAR, label VARCHAR, sizes VARCHAR, agreement DOUBLE, reason VARCHAR", [
    ("clear", "1/2", "5", 0.555556, None), ("tie", None, "4,4,1", 0.444444, "label_tie"), ("plurality", "8", "2,1,1,1", 0.222222, None), ("none", None, "", 0.0, "no_valid_label_answers"), ("short", None, "", 0.0, "incomplete_label_group"), ("first", "0.25", "3,2,1", 0.333333, None),
])
def typed_vote_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "group_id string, i int, a string, m string", [(g, i, a, "expression") for g, v in VOTES.items() for i, a in enumerate(v)])
    out = labeling.typed_labels(rows, "group_id", "a", "i", "m", F.lit(True))
    return out.select("group_id", "label", F.array_join(F.col("cluster_sizes").cast("array<string>"), ",").alias("sizes"), F.round("agreement", 6).alias("agreement"), "reason")


@expects("group_id VARCHAR, s_hat DOUBLE, learnability DOUBLE, rq_score DOUBLE, reason VARCHAR", [
    ("good", 0.5, 0.285714, 0.228571, None), ("few", None, None, None, "incomplete_score_group"), ("cut", None, None, None, "score_group_contains_rejected_sample"), ("blank", None, None, None, "missing_score_entropy"), ("wild", None, None, None, "invalid_normalized_entropy"),
])
def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda g, n=8, **odd: [(g, i, i < 4 if i < 7 else None, odd.get("entropy", 0.8) if i == 3 else 0.8, odd.get("status", "accepted") if i == 3 else "accepted") for i in range(n)]
    rows = rows_of(spark, "group_id string, i int, correct boolean, entropy double, status string", one("good") + one("few", 7) + one("cut", status="rejected") + one("blank", entropy=None) + one("wild", entropy=1.5))
    out = scoring.score_groups(rows, ["group_id"], F.col("correct"), F.col("entropy"), F.col("status") == "accepted")
    return out.select("group_id", *(F.round(c, 6).alias(c) for c in ("s_hat", "learnability", "rq_score")), "reason")


@expects("case_id BIGINT, entropy DOUBLE", [(1, 0.5), (2, None), (3, 1.0), (4, None)])
def entropy_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    u = math.log(1000)
    rows = rows_of(spark, "case_id long, v array<double>, m array<int>", [(1, [0.25 * u, 9.0, 0.75 * u], [1, 0, 1]), (2, [3.0 * u], [1]), (3, [u * 1.0000005], [1]), (4, [1.0], [0])])
    return rows.select("case_id", F.round(scoring.mean_entropy(F.col("v"), F.col("m"), 1000), 6).alias("entropy"))


LONG = "A farmer has 17 sheep and 23 goats on two fields and sells a third of the goats at the market every spring until none are left"
CATALOG = [("p1", "How many sheep graze on the hill in June?"), ("p2", f"{LONG}. How many springs pass?"), ("p3", "Compute the sum of the first ten odd squares.")]
ASKED = [
    ("exact", "how many  sheep graze on the hill in June?", None), ("template", LONG.replace("17", "19").replace("23", "29") + ". How many springs pass?", None), ("parent", f"Once upon a time in spring: {LONG}. What is left?", f"{LONG}."),
    ("copy", "Compute the area of the blue circle of radius two.", "Compute the area of the blue circle of radius ten."), ("novel", "Determine whether every bounded sequence converges.", "What is the value of f(3)?"),
]


@expects("key VARCHAR, reason VARCHAR, nearest_id VARCHAR", [("exact", "exact_duplicate", "p1"), ("template", "near_duplicate", "p2"), ("parent", "parent_containment", None), ("copy", "parent_copy", None), ("novel", None, None)])
def novelty_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = novelty.indexed(rows_of(spark, "key string, q string", CATALOG), "key", "q")
    own = novelty.indexed(rows_of(spark, "key string, q string", [r[:2] for r in ASKED]), "key", "q")
    return novelty.decide(own, index, _parents(spark, [(k, p) for k, _, p in ASKED if p], "key"), "key").select("key", "reason", "nearest_id")


def _parents(spark: SparkSession, rows: list[tuple[str, str]], key: str) -> DataFrame:
    found = novelty.indexed(rows_of(spark, "n int, k string, q string", [(i, k, q) for i, (k, q) in enumerate(rows)]), "n", "q")
    keys = rows_of(spark, f"n int, {key} string", [(i, k) for i, (k, _) in enumerate(rows)])
    return found.join(keys, "n").select(key, F.col("text").alias("parent_text"), F.col("shingles").alias("parent_shingles"))


def _cut(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; where that is unset, as in tests, in a new one."""
    import tempfile

    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "") or "file://" + tempfile.mkdtemp(prefix="sievemill-"))
    return lambda df: df.checkpoint()


#: (rank, pair, question): the second is too near the first and goes; the fifth is too near the second alone, so it stays.
WAVE = [(1, "a", "Compute the sum of all odd numbers below one hundred."), (2, "b", "Compute the sum of all odd numbers below one thousand."), (3, "a", "Find a product of odd numbers below one hundred."), (4, "c", "How many lattice points lie inside the circle?"), (5, "d", "Compute the sum of all odd squares below one thousand.")]


@expects("rank BIGINT, kept BOOLEAN", [(1, True), (2, False), (3, True), (4, True), (5, True)])
def greedy_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = novelty.indexed(rows_of(spark, "rank long, q string", [(r, q) for r, _, q in WAVE]), "rank", "q").join(rows_of(spark, "rank long, pair string", [r[:2] for r in WAVE]), "rank").withColumn("wave", F.lit(1))
    edges = novelty.conflicts(rows, "wave", "rank", "pair", near=0.9)
    return novelty.greedy_keep(rows, edges, "wave", "rank", _cut(spark)).select("rank", "kept")


@expects("case_id VARCHAR, fault VARCHAR", [("batch", "cycle"), ("behind", "checkpoint_behind"), ("high", "high_water"), ("idle", "cycle"), ("phase", "batch"), ("phase", "phase")])
def state_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "case_id string, phase string, iteration int, policy_version int, global_step int, checkpoint_step int, checkpoint_event_offset long, checkpoint_event_hash string, active_cycle_id string, active_training_batch_id string"
    rows = [
        ("fine", "ready", 3, 2, 2, 2, 90, "ab", None, None), ("working", "batch_ready", 3, 2, 2, 2, 90, "ab", "c", "b"), ("ahead", "update_applied", 3, 3, 3, 2, 90, "ab", "c", "b"), ("batch", "ready", 3, 2, 2, 2, 90, "ab", None, "b"),
        ("behind", "scoring", 3, 3, 3, 2, 90, "ab", "c", None), ("high", "scoring", 0, 0, 0, 0, 90, "ab", "c", None), ("idle", "scoring", 0, 0, 0, 0, 0, "", None, None), ("phase", "dreaming", 0, 0, 0, 0, 0, "", "c", "b"),
    ]
    return audit.violations(rows_of(spark, schema, rows), "case_id", audit.state_checks()).withColumnRenamed("key", "case_id")


@expects("key VARCHAR, fault VARCHAR", [("s2", "type"), ("s3", "gold_answer"), ("*", "domains"), ("*", "cells"), ("*", "types")])
def seed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievemill.functions.vocab import DOMAINS

    kinds = ["decision", "search", "counting", "optimization", "counting", "decision", "decision"]
    rows = [(f"s{i}", "algebra" if i in (0, 5) else d, k, "search" if i == 2 else k, None, "compound_scalar_answer" if i == 3 else None) for i, (d, k) in enumerate(zip(DOMAINS, kinds, strict=True))]
    return audit.seed_checks(rows_of(spark, "problem_id string, domain string, problem_type string, annotated_type string, proposed_fault string, gold_fault string", rows))


@expects("rotation BIGINT, first_cell VARCHAR", [(2, "c")])
def rotation_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "cell string, id int", [(c, i) for i, c in enumerate("aaabbc")])
    offset = selection.rotation(rows, "cell", "id", 11)
    turns = selection.turns_by_name(rows, "cell", offset).where("turn = 0")
    return turns.select(F.lit(offset).cast("long").alias("rotation"), F.col("cell").alias("first_cell"))


@expects("request_id BIGINT, rows BIGINT, texts BIGINT, in_range BOOLEAN", [(1, 9, 2, True), (2, 9, 2, True)])
def fixture_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fixtures.samples(rows_of(spark, "r long", [(1,), (2,)]), "r", "label", ["\\boxed{1}", "\\boxed{2}"], 9)
    return made.groupBy("request_id").agg(F.count("*").alias("rows"), F.count_distinct("text").alias("texts"), F.bool_and((F.col("entropy") >= 0.1) & (F.col("entropy") < 0.9)).alias("in_range"))


def _response(question: str, answer: str, domain: str = "algebra") -> str:
    return f"<question>{question}</question><domain>{domain}</domain>\\boxed{{{answer}}}"


CANDIDATES = [
    ("c1", "accepted", _response("Compute the sum of the roots of x^2 - 5x + 6.", "5")), ("c2", "accepted", _response("Compute the sum of the roots of x^2 - 9x + 6.", "9")), ("c3", "accepted", _response("How many integers lie between 3 and 11 inclusive?", "9", "number_theory")),
    ("c4", "accepted", _response("Prove that the sum of two even integers is even.", "yes")), ("c5", "rejected", ""), ("c6", "accepted", _response("Compute the product of 3 and 4 and 5 and 6.", "1, 2")), ("c7", "accepted", "no envelope"), ("c8", "accepted", _response("Is it 7?", "yes")),
    ("c9", "accepted", _response("Compute the sum of the first ten odd squares.", "1330")), ("c10", "accepted", _response("Find all integers n such that n^2 = 49 holds.", "{-7, 7}")),
]


@expects("candidate_id VARCHAR, phase VARCHAR, reason VARCHAR", [("c1", None, None), ("c2", None, None), ("c3", None, None), ("c4", "problem_type", "proof_or_justification"), ("c5", "generation", "generation_rejected"), ("c6", "answer_contract", "compound_scalar_answer"), ("c7", "parse", "missing_question_open"), ("c8", "parse", "question_length_out_of_bounds"), ("c9", None, None), ("c10", None, None)])
def candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = cycle.read_candidates(_samples(spark))
    return read.select("candidate_id", F.col("failure.phase").alias("phase"), F.col("failure.reason").alias("reason"))


def _samples(spark: SparkSession) -> DataFrame:
    return rows_of(spark, "candidate_id string, status string, text string", CANDIDATES).withColumn("reject_reason", F.lit(None).cast("string"))


def _flow(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Candidates through all gates: what was read of them, and what became of those that could be read."""
    cut = _cut(spark)
    read = cut(cycle.read_candidates(_samples(spark)).withColumn("wave", F.lit(1)).withColumn("pair_id", F.lit("p")))
    votes = {"c1": ["5"] * 9, "c2": ["9"] * 9, "c3": ["9"] * 4 + ["8"] * 4 + ["7"], "c9": ["1330"] * 9, "c10": ["{7, -7}"] * 5 + ["{-7, 7}"] * 4}
    modes = {"c10": "set"}
    said = rows_of(spark, "candidate_id string, i int, a string, m string", [(c, i, a, modes.get(c, "expression")) for c, v in votes.items() for i, a in enumerate(v)])
    labels = labeling.typed_labels(said, "candidate_id", "a", "i", "m", F.lit(True))
    catalog = rows_of(spark, "problem_id string, question string", CATALOG)
    parents = _parents(spark, [("c1", CATALOG[0][1]), ("c2", CATALOG[0][1])], "candidate_id")
    return read, cycle.accept(read, labels, catalog, parents, cut, F.col("candidate_id"))


#: c1 and c2 are of one pair, so the second is a sibling's near duplicate.
@expects("candidate_id VARCHAR, phase VARCHAR, reason VARCHAR, wave_nearest VARCHAR", [("c1", None, None, None), ("c2", "wave_novelty", "sibling_near_duplicate", "c1"), ("c3", "pseudo_label", "label_tie", None), ("c9", "preliminary_novelty", "exact_duplicate", None), ("c10", None, None, None)])
def discovery_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates through all gates: the flagship flow."""
    return _flow(spark)[1].select("candidate_id", "phase", "reason", "wave_nearest")


PASSED = [(1, "parse", "passed"), (5, "preflight", "passed"), (6, "domain", "passed"), (7, "wave_novelty", "passed"), (8, "pseudo_label", "accepted"), (12, "archive", "accepted")]


@expects(
    "candidate_id VARCHAR, step INTEGER, phase VARCHAR, status VARCHAR, reason VARCHAR",
    [(c, *x, None) for c, n in (("c1", 6), ("c2", 3), ("c3", 4), ("c4", 1), ("c6", 1), ("c8", 1), ("c9", 1), ("c10", 6)) for x in PASSED[:n]]
    + [
        ("c2", 7, "wave_novelty", "rejected", "sibling_near_duplicate"), ("c3", 8, "pseudo_label", "rejected", "label_tie"), ("c4", 2, "problem_type", "rejected", "proof_or_justification"), ("c5", 0, "generation", "rejected", "generation_rejected"),
        ("c6", 3, "answer_contract", "rejected", "compound_scalar_answer"), ("c7", 1, "parse", "rejected", "missing_question_open"), ("c8", 1, "parse", "rejected", "question_length_out_of_bounds"), ("c9", 4, "preliminary_novelty", "rejected", "exact_duplicate"),
    ],
)
def discovery_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.events(*_flow(spark))


@expects("request_id VARCHAR, pair_id VARCHAR, reason VARCHAR, received BIGINT", [("r2", "p2", "incomplete_generation_group", 1), ("r3", "p3", "missing_generation_group", 0)])
def generation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = rows_of(spark, "request_id string, pair_id string", [("r1", "p1"), ("r2", "p2"), ("r3", "p3")])
    return cycle.group_events(requests, rows_of(spark, "request_id string, text string", [("r1", "a"), ("r1", "b"), ("r2", "a")]), 2)


#: Found new against the catalog, and too near each other: b equals a, d is near c, which is archived before it.
LATE = [("a", "Compute the sum of all odd numbers below one hundred and ten."), ("b", "compute the sum of all  odd numbers below one hundred and ten."), ("c", "How many lattice points lie strictly inside the circle of radius 9?"), ("d", "How many lattice points lie strictly inside the circle of radius 8?"), ("e", "Is the integer 91 a prime number?")]


@expects("candidate_id VARCHAR, reason VARCHAR", [("b", "exact_duplicate"), ("d", "near_duplicate")])
def final_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "candidate_id string, question string", LATE)
    own = novelty.indexed(rows, "candidate_id", "question")
    return cycle.final_novelty(rows, own, own.limit(0), _cut(spark)).withColumnRenamed("_final", "reason")


CUE_CASES = [
    (1, "Find the sum of 1 and 2. Compute the product, and also find the ratio.", ["Find the sum of 1 and 2", "Compute the product, and also", "find the ratio"]), (2, "Let n be odd. Please determine whether n is prime", ["determine whether n is prime"]),
    (3, "Is 7 prime? How many divisors has 12?", ["Is 7 prime? How many divisors has 12?"]), (4, "The sum is known", []), (5, None, []), (6, "\U0001d465 = 1; find \U0001d465, and count the \u00e9s", ["find \U0001d465, and", "count the \u00e9s"]),
]


@expects("case_id BIGINT, cues VARCHAR[]", [(i, c) for i, _, c in CUE_CASES])
def cue_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "case_id long, t string", [c[:2] for c in CUE_CASES]).select("case_id", R.request_cues(F.col("t")).alias("cues"))


@expects("case_id BIGINT, template VARCHAR", [(1, "a # b x2# #"), (2, "#, # and y #"), (3, "")])
def template_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "case_id long, t string", [(1, "A 12.5 b X23  -3/4"), (2, "١٢, +7 and y 8"), (3, None)]).select("case_id", T.template(F.col("t")).alias("template"))
