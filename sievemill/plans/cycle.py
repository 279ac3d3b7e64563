"""A run's cycle: legal phases, recovery, waves, and the flow from candidates to accepted problems."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import envelope, ids
from sievemill.functions import typing_rules as R
from sievemill.functions.vocab import QUESTION_CHARS
from sievemill.operators import gates, novelty
from sievemill.sources.config import Config, Waves

#: The phases that may follow each phase.
NEXT = {
    "ready": ("policy_frozen",),
    "policy_frozen": ("scoring",),
    "scoring": ("discovery", "batch_ready"),
    "discovery": ("ready", "batch_ready"),
    "batch_ready": ("update_applied",),
    "update_applied": ("discovery", "ready", "checkpointed"),
    "checkpointed": ("ready", "discovery"),
}


@dataclass(frozen=True)
class State:
    iteration: int = 0
    phase: str = "ready"
    global_step: int = 0
    cycle_id: str | None = None
    batch_id: str | None = None


def advance(state: State, phase: str, **changes) -> State:
    if phase not in NEXT[state.phase]:
        raise ValueError(f"{phase} cannot follow {state.phase}")
    return replace(state, phase=phase, **changes)


def recover(state: State) -> tuple[State, str | None]:
    """(state to go on from, event to log) after a stop. A cycle that stopped before its update is given up, and its number with it, for its ids would be made again from other text; one that stopped after the update is done if it was saved, and cannot be told apart from a lost update if not."""
    if state.phase == "ready":
        return state, None
    if state.phase == "update_applied":
        raise ValueError("stopped between update and checkpoint: the trained state is uncertain")
    fresh = State(iteration=state.iteration + 1, global_step=state.global_step)
    return fresh, None if state.phase == "checkpointed" else "aborted"


def wave_sizes(waves: Waves, capacity: Callable[[], int], needed: int) -> Iterator[int]:
    """Candidates to ask for, wave after wave, until the frontier's capacity or the limit is reached."""
    made = 0
    while made < waves.most and (made == 0 or capacity() < needed):
        size = min(waves.first if made == 0 else waves.refill, waves.most - made)
        made += size
        yield size


def more_cycles(state: State, config: Config) -> bool:
    return state.iteration < config.max_cycles and state.global_step < config.max_updates


def phase_order(update_first: bool, ready: bool) -> tuple[str, ...]:
    """Phases of a cycle after scoring: the update, if a batch is ready, comes before or after discovery, which then has the new policy's or the old one's names."""
    update = ("batch_ready", "update_applied") if ready else ()
    return (*update, "discovery", "ready") if update_first else ("discovery", *update, "ready")


GATES = ["generation", "parse", "problem_type", "answer_contract"]


def read_candidates(samples: DataFrame, key: str = "candidate_id", text: str = "text") -> DataFrame:
    """Per sample: question, domain, answer, problem_type, problem_id, and failure (phase, reason) of the first gate that it fails. samples have status and reject_reason. The cheap gates come first; each UDF has its own projection."""
    read = samples.withColumn("_e", envelope.envelope(F.when(F.col("status") == "accepted", F.col(text))))
    read = read.withColumn("_t", R.problem_type(F.col("_e.question")))
    read = read.withColumn("_c", R.contract_error(F.col("_t.problem_type"), F.col("_e.answer")))
    chars = F.length("_e.question")
    length = F.when(~chars.between(*QUESTION_CHARS), "question_length_out_of_bounds")
    failure = gates.first_failure([
        ("generation", F.when(F.col("status") != "accepted", F.coalesce("reject_reason", F.lit("generation_rejected")))),
        ("parse", F.coalesce(F.col("_e.reason"), length)), ("problem_type", F.col("_t.reason")), ("answer_contract", F.col("_c")),
    ])
    return read.select(key, F.col("_e.question").alias("question"), F.col("_e.domain").alias("domain"), F.col("_e.answer").alias("answer"), F.col("_t.problem_type").alias("problem_type"), ids.problem_id(F.col("_e.question")).alias("problem_id"), failure.alias("failure"))


def accept(candidates: DataFrame, labels: DataFrame, catalog: DataFrame, parents: DataFrame, cut: Callable[[DataFrame], DataFrame], rank: Column) -> DataFrame:
    """Candidates through the gates: (candidate_id, problem_id, question, domain, problem_type, answer, label, phase, reason, wave_nearest, wave_maximum); reason is null for accepted ones, phase is the gate that told it.

    candidates come from read_candidates with wave and pair_id; catalog has problem_id and question; parents has
    (candidate_id, parent_text, parent_shingles); labels has (candidate_id, label, reason). The order of the gates is
    read, novelty against the catalog, the greedy choice within the wave, the label, the label's shape, the verifier,
    novelty against the live index (the catalog and what this wave has accepted before, in order of candidate_id), and
    an id that is new.
    """
    from pyspark.sql import Window

    good = candidates.where("failure is null")
    own = cut(novelty.indexed(good, "candidate_id", "question"))
    index = cut(novelty.indexed(catalog.select(F.col("problem_id").alias("candidate_id"), "question"), "candidate_id", "question"))
    told = cut(novelty.decide(own, index, parents, "candidate_id"))
    novel = told.where("reason is null").join(good.select("candidate_id", "wave", "pair_id"), "candidate_id").join(own, "candidate_id")
    novel = novel.withColumn("rank", F.row_number().over(Window.partitionBy("wave").orderBy("parent_containment", "parent_similarity", rank, "candidate_id")))
    novel = cut(novel.select("candidate_id", "wave", "pair_id", "rank", "text", "shingles"))
    edges = cut(novelty.conflicts(novel, "wave", "rank", "pair_id"))
    kept = novelty.greedy_keep(novel, edges, "wave", "rank", cut)
    why = novelty.wave_evidence(edges, kept, "wave", "rank").join(novel.select("wave", F.col("rank").alias("wave_nearest"), F.col("candidate_id").alias("_nearest")), ["wave", "wave_nearest"]).drop("wave_nearest").withColumnRenamed("_nearest", "wave_nearest")
    wave = novel.join(kept, ["wave", "rank"]).join(why, ["wave", "rank"], "left").select("candidate_id", "kept", "wave_reason", "wave_nearest", "wave_maximum")
    rows = good.join(told.select("candidate_id", F.col("reason").alias("_novel")), "candidate_id").join(wave, "candidate_id", "left").join(labels.select("candidate_id", "label", F.col("reason").alias("_label")), "candidate_id", "left")
    rows = rows.join(catalog.select("problem_id", F.lit(True).alias("_known")).distinct(), "problem_id", "left")
    shape = R.contract_error(F.col("problem_type"), F.col("label"))
    verifier = R.verifier(F.col("problem_type"), F.col("label"))
    rows = rows.withColumn("_shape", F.concat(F.lit("pseudo_gold_"), shape)).withColumn("_verifier", F.when(verifier["error"].isNotNull(), "invalid_final_verifier"))
    first = gates.first_failure([
        ("preliminary_novelty", F.col("_novel")), ("wave_novelty", F.when(~F.coalesce("kept", F.lit(False)), F.col("wave_reason"))),
        ("pseudo_label", F.when(F.col("label").isNull(), F.coalesce("_label", F.lit("incomplete_label_group")))), ("answer_contract", F.col("_shape")), ("verifier", F.col("_verifier")),
    ])
    rows = cut(rows.withColumn("_f", first))
    late = final_novelty(rows.where("_f is null"), own, index, cut)
    rows = rows.join(late, "candidate_id", "left")
    again = F.row_number().over(Window.partitionBy("problem_id").orderBy((F.col("_f").isNull() & F.col("_final").isNull()).desc(), "candidate_id")) > 1
    archive = F.when(F.coalesce("_known", F.lit(False)) | again, "duplicate_problem_id")
    failure = F.coalesce("_f", gates.first_failure([("final_novelty", F.col("_final")), ("archive", archive)]))
    return rows.select("candidate_id", "problem_id", "question", "domain", "problem_type", "answer", "label", failure["phase"].alias("phase"), failure["reason"].alias("reason"), "wave_nearest", "wave_maximum")


def final_novelty(rows: DataFrame, own: DataFrame, index: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(candidate_id, _final: the reason) of rows that the live index no longer finds new: what was accepted before in the same run is in it.

    rows passed all earlier gates, against the index too, so only each other can be near: a wave is at most some hundred
    rows. A row is archived unless one archived before it, by candidate_id, is equal or too near.
    """
    from pyspark.sql import Window

    live = own.join(rows.select("candidate_id"), "candidate_id").withColumn("_one", F.lit(1))
    live = cut(live.withColumn("_rank", F.row_number().over(Window.partitionBy("_one").orderBy("candidate_id"))))
    pairs = novelty.shortlist(live, live, "candidate_id", "_other")
    near = novelty.near_pairs(pairs, live, live, "candidate_id", "_other").where(F.col("similarity") >= novelty.NEAR)
    equal = live.select("candidate_id", "text").join(live.select(F.col("candidate_id").alias("_other"), "text"), "text").select("candidate_id", "_other")
    edges = near.select("candidate_id", "_other", F.lit("near_duplicate").alias("why")).unionByName(equal.select("candidate_id", "_other", F.lit("exact_duplicate").alias("why"))).where("candidate_id > _other")
    ranked = edges.join(live.select("candidate_id", "_one", "_rank"), "candidate_id").join(live.select(F.col("candidate_id").alias("_other"), F.col("_rank").alias("better")), "_other")
    ranked = cut(ranked.select("candidate_id", "_one", "_rank", "better", "why"))
    kept = novelty.greedy_keep(live, ranked, "_one", "_rank", cut)
    held = kept.where("kept").select("_one", F.col("_rank").alias("better"))
    return ranked.join(held, ["_one", "better"]).groupBy("candidate_id").agg(F.min("why").alias("_final"))  # exact before near


def group_events(requests: DataFrame, samples: DataFrame, needed: int) -> DataFrame:
    """(request_id, pair_id, reason, received) of asked-for generation groups that did not come, or not whole. Samples of an incomplete group go on."""
    got = samples.groupBy("request_id").agg(F.count("*").alias("received"))
    both = requests.select("request_id", "pair_id").join(got, "request_id", "left").withColumn("received", F.coalesce("received", F.lit(0)).cast("long"))
    reason = F.when(F.col("received") == 0, "missing_generation_group").when(F.col("received") != needed, "incomplete_generation_group")
    return both.withColumn("reason", reason).where("reason is not null").select("request_id", "pair_id", "reason", "received")


#: The gates in their order, with those that only log a pass.
PHASES = ("generation", "parse", "problem_type", "answer_contract", "preliminary_novelty", "preflight", "domain", "wave_novelty", "pseudo_label", "answer_contract", "verifier", "final_novelty", "archive")
#: Places in PHASES of the gates that log a pass as well as a rejection.
PASSES = {"parse": 1, "preflight": 5, "domain": 6, "wave_novelty": 7, "pseudo_label": 8, "archive": 12}


def events(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """(candidate_id, step, phase, status, reason): the log of every candidate's way: a pass for each gate that logs passes, and the rejection that ended it. candidates come from read_candidates, judged from accept.

    A question of bad length has passed parsing before it is rejected there.
    """
    said = candidates.select("candidate_id", F.col("failure.phase").alias("p"), F.col("failure.reason").alias("r"), F.lit(0).alias("late"))
    said = said.where("r is not null").unionByName(judged.select("candidate_id", F.col("phase").alias("p"), F.col("reason").alias("r"), F.lit(1).alias("late")))
    at = lambda phases: F.array_position(F.array(*map(F.lit, phases)), F.col("p")).cast("int") - 1
    place = F.when(F.col("late") == 0, at(PHASES[:4])).when(F.col("p").isNotNull(), at(PHASES[4:]) + 4).otherwise(len(PHASES))
    said = said.withColumn("end", place)
    passes = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(p).alias("phase"), F.lit("accepted" if p in ("pseudo_label", "archive") else "passed").alias("status")) for p, i in PASSES.items()))
    length = F.col("r") == "question_length_out_of_bounds"
    done = said.select("candidate_id", "end", length.alias("odd"), F.explode(passes).alias("x")).where("x.step < end or (x.step = 1 and odd)").select("candidate_id", "x.step", "x.phase", "x.status", F.lit(None).cast("string").alias("reason"))
    failed = said.where("r is not null").select("candidate_id", F.col("end").alias("step"), F.col("p").alias("phase"), F.lit("rejected").alias("status"), F.col("r").alias("reason"))
    return done.unionByName(failed)
