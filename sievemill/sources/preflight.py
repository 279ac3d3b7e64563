"""What must be in place before a run starts or goes on."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from sievemill.functions.vocab import CELLS
from sievemill.sources import logs, prompts, seeds
from sievemill.sources.settings import get

#: Names of a run's files.
STATE, MANIFEST, LATEST = "pipeline_state.json", "run_manifest.json", "latest_checkpointed_iteration.txt"


def _filled(spark: SparkSession, folder: str) -> bool:
    fs, p = logs._fs(spark, folder)
    return fs.exists(p) and fs.listStatus(p) is not None and len(fs.listStatus(p)) > 0


def resume_fault(spark: SparkSession, output: str, checkpoints: str, mode: str) -> str | None:
    """Why a run in these folders may not start (mode disable) or go on (auto); null if it may."""
    if mode == "disable":
        return "resume is disabled and there are checkpoints" if _filled(spark, checkpoints) else None
    if not logs.exists(spark, f"{output}/{MANIFEST}"):
        if _filled(spark, output):
            return "output without a run manifest"
        return "checkpoints of no run" if _filled(spark, checkpoints) else None
    if not logs.exists(spark, f"{output}/{STATE}"):
        return "a run manifest without its state"
    step = int(logs.read_document(spark, f"{output}/{STATE}").get("checkpoint_step", 0))
    if not step:
        return "checkpoints, and a state before the first" if _filled(spark, checkpoints) else None
    if not logs.exists(spark, f"{checkpoints}/{LATEST}"):
        return "a state with a checkpoint, and no latest marker"
    fs, p = logs._fs(spark, f"{checkpoints}/{LATEST}")
    said = logs._bytes(spark, f"{checkpoints}/{LATEST}", 0, fs.getFileStatus(p).getLen()).decode("utf-8", "replace").strip()
    if not said.isdigit():
        return "the latest marker is no number"
    if int(said) != step:
        return f"the state is at step {step}, the latest checkpoint at {int(said)}"
    return None if logs.exists(spark, f"{checkpoints}/global_step_{step}") else f"checkpoint {step} is missing"


def preflight(spark: SparkSession, settings: Mapping, root: str, templates: tuple[str, ...]) -> dict[str, Any]:
    """A report of what a run will do; missing or empty templates, bad seeds and a run that may not go on raise."""
    at = lambda path: path if "://" in path or path.startswith("/") else f"{root}/{path}"
    for name in templates:
        prompts.load_template(spark, at(name))
    found = {
        "backend": get(settings, "backend.kind"), "model_path": get(settings, "backend.model_path"), "n_gpus": get(settings, "backend.n_gpus"), "seed_count": seeds.read_seeds(spark, at(get(settings, "archive.seed_file"))).count(), "map_cells": len(CELLS),
        "generation_per_initial_wave": get(settings, "generation.initial_candidates"), "label_rollouts": get(settings, "labeling.num_rollouts"), "score_rollouts": get(settings, "scoring.num_rollouts"), "training_groups": get(settings, "frontier.training_batch_size"), "output_dir": at(get(settings, "archive.output_dir")),
    }
    if found["backend"] == "verl":
        mode = get(settings, "training.resume_mode")
        folder = at(get(settings, "verl_config.trainer.default_local_dir", "checkpoints"))
        if fault := resume_fault(spark, found["output_dir"], folder, mode):
            raise ValueError(fault)
        found |= {"checkpoint_dir": folder, "resume_mode": mode}
    return found
