"""Run settings: YAML or JSON documents that extend others, over the defaults, with every rule that a run's settings must keep."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from sievemill.functions import vocab as V
from sievemill.sources.config import Config, Labels, Novelty, Scores, Selection, Waves, merged

#: Sections, their fields and defaults.
DEFAULTS: dict[str, dict[str, Any]] = {
    "run": {"name": "run", "master_seed": 0, "max_iterations": V.MAX_CYCLES, "schema_version": "concrete-problem-map-v1"},
    "generation": {"pairs_per_cycle": 32, "children_per_pair": 2, "initial_candidates": V.FIRST_WAVE, "refill_candidates": V.REFILL, "max_candidates": V.MOST_CANDIDATES, "temperature": 0.45, "top_p": 0.85, "max_tokens": 4096, "require_distinct_lineages": True},
    "labeling": {"num_rollouts": V.LABEL_ROLLOUTS, "temperature": 1.0, "top_p": 1.0, "top_k": 40, "max_tokens": 4096, "count_invalid_in_denominator": True, "max_infrastructure_retries": V.RETRIES},
    "scoring": {"num_rollouts": V.SCORE_ROLLOUTS, "temperature": 1.0, "top_p": 0.95, "max_tokens": 5000, "frontier_s_hat_low": V.BAND[0], "frontier_s_hat_high": V.BAND[1], "reject_overlong": True, "reject_invalid_answer": False, "reject_duplicates": False, "require_entropy": True, "max_infrastructure_retries": V.RETRIES},
    "novelty": {"exact": True, "near_duplicate_threshold": V.NEAR, "parent_similarity_ceiling": V.PARENT_CEILING, "parent_shingle_containment_ceiling": V.CONTAINMENT, "parent_containment_min_shared_shingles": V.SHARED, "sibling_similarity_ceiling": V.SIBLING, "min_question_chars": V.QUESTION_CHARS[0], "max_question_chars": V.QUESTION_CHARS[1]},
    "archive": {"output_dir": "./output", "seed_file": "seeds.jsonl", "selection_strategy": "uniform_cell", "fsync_jsonl": True, "store_rollout_text": True},
    "frontier": {"training_batch_size": V.BATCH, "selection_lag": V.LAG, "warmup_use_current_score": False, "skip_update_when_short": True, "update_before_discovery": False, "remeasure_budget": V.REMEASURE, "max_per_cell_per_batch": V.PER_CELL},
    "training": {"enabled": True, "replay_score_rollouts": True, "total_training_steps": V.MAX_UPDATES, "save_freq": 0, "resume_mode": "disable"},
    "backend": {"kind": "verl", "model_path": "", "n_gpus": 8, "gpu_memory_utilization": 0.42, "request_chunk_size": 8},
}
#: The section that is handed on as it is, and one that is allowed and ignored.
FREE, IGNORED = "verl_config", "domain"

#: Settings that have one legal value.
PINNED = {
    "generation.pairs_per_cycle": 32, "generation.children_per_pair": 2, "generation.initial_candidates": 64, "generation.refill_candidates": 32, "generation.max_candidates": 128, "labeling.num_rollouts": 9, "labeling.count_invalid_in_denominator": True,
    "scoring.num_rollouts": 8, "scoring.reject_overlong": True, "scoring.reject_invalid_answer": False, "scoring.reject_duplicates": False, "scoring.require_entropy": True, "frontier.training_batch_size": 32, "frontier.selection_lag": 1, "frontier.warmup_use_current_score": False,
    "frontier.skip_update_when_short": True, "training.save_freq": 0, "archive.selection_strategy": "uniform_cell", "novelty.exact": True, "run.schema_version": "concrete-problem-map-v1",
}
AT_LEAST = {
    0: ("generation.temperature", "labeling.temperature", "scoring.temperature", "labeling.max_infrastructure_retries", "scoring.max_infrastructure_retries"),
    1: ("generation.max_tokens", "labeling.max_tokens", "scoring.max_tokens", "frontier.max_per_cell_per_batch", "backend.n_gpus", "backend.request_chunk_size", "run.max_iterations", "training.total_training_steps", "novelty.min_question_chars", "novelty.parent_containment_min_shared_shingles"),
}
#: Over 0 and up to 1.
SHARES = ("generation.top_p", "labeling.top_p", "scoring.top_p", "novelty.near_duplicate_threshold", "novelty.parent_similarity_ceiling", "novelty.parent_shingle_containment_ceiling", "novelty.sibling_similarity_ceiling")
CHOICES = {"backend.kind": ("verl", "mock"), "training.resume_mode": ("disable", "auto")}
GIB = 1 << 30


def get(settings: Mapping, path: str, default: Any = None) -> Any:
    for name in path.split("."):
        if not isinstance(settings, Mapping) or name not in settings:
            return default
        settings = settings[name]
    return settings


def _number(x: Any, whole: bool = False) -> bool:
    return isinstance(x, int if whole else (int, float)) and not isinstance(x, bool)


#: What must hold between settings, by what is wrong if it does not.
RELATIONS: dict[str, Callable[[Callable], bool]] = {
    "scoring band is not 0 <= low < high <= 1": lambda s: 0 <= s("scoring.frontier_s_hat_low") < s("scoring.frontier_s_hat_high") <= 1,
    "frontier.max_per_cell_per_batch cannot fill a batch": lambda s: s("frontier.max_per_cell_per_batch") * len(V.CELLS) >= s("frontier.training_batch_size"),
    "generation.refill_candidates is not a multiple of children_per_pair": lambda s: s("generation.refill_candidates") % s("generation.children_per_pair") == 0,
    "generation.max_candidates is not a multiple of children_per_pair": lambda s: s("generation.max_candidates") % s("generation.children_per_pair") == 0,
    "training.replay_score_rollouts is off": lambda s: not s("training.enabled") or s("training.replay_score_rollouts"),
    "backend.gpu_memory_utilization is not between 0 and 1": lambda s: 0 < s("backend.gpu_memory_utilization") < 1,
    "run.max_iterations leaves no warm-up cycle": lambda s: s("run.max_iterations") > s("training.total_training_steps"),
    "novelty question length bounds": lambda s: s("novelty.min_question_chars") <= s("novelty.max_question_chars"),
    "the trainer's batch size is another": lambda s: not s("training.replay_score_rollouts") or int(s(f"{FREE}.data.train_batch_size", s("frontier.training_batch_size"))) == s("frontier.training_batch_size"),
    "the trainer's rollouts are others": lambda s: not s("training.replay_score_rollouts") or int(s(f"{FREE}.actor_rollout_ref.rollout.n", s("scoring.num_rollouts"))) == s("scoring.num_rollouts"),
    "the trainer saves on its own": lambda s: not s("training.replay_score_rollouts") or int(s(f"{FREE}.trainer.save_freq", 0)) == 0,
    "ray_init.num_cpus is not a number of at least n_gpus": lambda s: not _distributed(s) or (_number(s(f"{FREE}.ray_init.num_cpus"), True) and s(f"{FREE}.ray_init.num_cpus") >= s("backend.n_gpus")),
    "ray_init.object_store_memory is not a number of at least 1 GiB": lambda s: not _distributed(s) or (_number(s(f"{FREE}.ray_init.object_store_memory"), True) and s(f"{FREE}.ray_init.object_store_memory") >= GIB),
}


def _distributed(s: Callable) -> bool:
    return s("backend.kind") == "verl" and bool(s(FREE))


def faults(settings: Mapping) -> list[str]:
    """Every rule that full settings break; a value of a wrong type breaks the rules it is in."""
    s = lambda path, default=None: get(settings, path, default)
    found = [f"{p} must be {v!r}" for p, v in PINNED.items() if s(p) != v or isinstance(s(p), bool) != isinstance(v, bool)]
    found += [f"{p} must be at least {least}" for least, paths in AT_LEAST.items() for p in paths if not _number(s(p)) or s(p) < least]
    found += [f"{p} must be over 0 and up to 1" for p in SHARES if not _number(s(p)) or not 0 < s(p) <= 1]
    found += [f"{p} must be one of {v}" for p, v in CHOICES.items() if s(p) not in v]
    if not _number(s("novelty.parent_containment_min_shared_shingles"), True):
        found.append("novelty.parent_containment_min_shared_shingles must be a whole number")
    for what, holds in RELATIONS.items():
        try:
            ok = holds(s)
        except (TypeError, ValueError, ZeroDivisionError):
            ok = False
        if not ok:
            found.append(what)
    return found


def parse(text: str, path: str = "") -> dict:
    """A JSON document, or a YAML one where its library is there."""
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise ValueError(f"{path}: reading YAML needs PyYAML; write it as JSON") from error
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is not an object")
    return found


def load(path: str, read: Callable[[str], str], _on_way: tuple[str, ...] = ()) -> dict:
    """The document at a path over the one it names under "extends", which is relative to it; a circle raises."""
    if path in _on_way:
        raise ValueError("settings extend each other: " + " -> ".join((*_on_way, path)))
    values = parse(read(path), path)
    if base := values.pop("extends", None):
        values = merged(load(path.rpartition("/")[0] + "/" + base if "/" in path else base, read, (*_on_way, path)), values)
    return values


def settle(values: Mapping) -> dict:
    """The defaults with these values; unknown sections and fields, and broken rules, raise."""
    unknown = [k for k in values if k not in DEFAULTS and k not in (FREE, IGNORED)]
    unknown += [f"{k}.{f}" for k, v in values.items() if k in DEFAULTS for f in (v or {}) if f not in DEFAULTS[k]]
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    full = {k: {**v, **(values.get(k) or {})} for k, v in DEFAULTS.items()} | {FREE: dict(values.get(FREE) or {})}
    if found := faults(full):
        raise ValueError("; ".join(found))
    return full


def config(full: Mapping) -> Config:
    """What the engine's operators take of full settings."""
    s = lambda path: get(full, path)
    return Config(
        seed=s("run.master_seed"), max_cycles=s("run.max_iterations"), max_updates=s("training.total_training_steps"),
        waves=Waves(s("generation.initial_candidates"), s("generation.refill_candidates"), s("generation.max_candidates")),
        labels=Labels(s("labeling.num_rollouts"), s("labeling.max_infrastructure_retries")),
        scores=Scores(s("scoring.num_rollouts"), s("scoring.max_infrastructure_retries"), s("scoring.frontier_s_hat_low"), s("scoring.frontier_s_hat_high")),
        novelty=Novelty(s("novelty.near_duplicate_threshold"), s("novelty.parent_similarity_ceiling"), s("novelty.parent_shingle_containment_ceiling"), s("novelty.parent_containment_min_shared_shingles"), s("novelty.sibling_similarity_ceiling"), s("novelty.min_question_chars"), s("novelty.max_question_chars")),
        selection=Selection(s("frontier.training_batch_size"), s("frontier.selection_lag"), s("frontier.remeasure_budget"), s("frontier.max_per_cell_per_batch")),
    )
