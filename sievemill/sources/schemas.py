"""Schemas of the catalog's tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

ROLLOUT = "struct<response:string,predicted_answer:string,correct:boolean,entropy:double,status:string,reject_reason:string,policy_version:int,adapter_version:int,global_step:int,source_checkpoint:string,sample_index:int>"
CONTRACT = "struct<n:int,temperature:double,top_p:double,max_tokens:int>"
SCORE = f"struct<iteration:int,policy_version:int,s_hat:double,learnability:double,u_score:double,rq_score:double,num_rollouts:int,num_correct:int,policy_run_uuid:string,adapter_version:int,global_step:int,source_checkpoint:string,sampling_contract:{CONTRACT},rollouts:array<{ROLLOUT}>,observation_id:string,request_id:string>"
EVIDENCE = f"struct<pseudo_gold:string,cluster_sizes:array<int>,agreement:double,proposed_matches:boolean,accepted:boolean,reason:string,rollouts:array<{ROLLOUT}>,request_id:string,policy_run_uuid:string,policy_version:int,adapter_version:int,global_step:int,source_checkpoint:string>"

#: Column lists by table name; details that differ from row to row are JSON text.
TABLES = {
    "parent_pairs": "pair_id string, left_id string, right_id string, prompt_seed int",
    "candidates": "candidate_id string, question string, domain string, proposed_answer string, parent_ids array<string>, pair_id string, iteration int, child_index int, raw_response string",
    "generation_samples": "request_id string, purpose string, attempt int, sample_index int, text string, entropy double, status string, reject_reason string",
    "accepted_problems": f"problem_id string, question string, proposed_answer string, pseudo_gold string, verifier struct<mode:string,elements:array<string>>, domain string, problem_type string, parent_ids array<string>, lineage_root_ids array<string>, generation int, created_iteration int, created_policy_version int, label_evidence string, domain_evidence string, score_history array<{SCORE}>, novelty string, source string, cell string",
    "candidate_events": "event_id string, iteration int, candidate_id string, phase string, status string, reason string, details string",
    "label_observations": f"label_observation_id string, candidate_id string, iteration int, evidence {EVIDENCE}",
    "score_observations": f"score_id string, problem_id string, score {SCORE}",
    "training_events": "event_id string, iteration int, status string, payload string",
    "pipeline_state": "schema_version string, iteration int, phase string, active_cycle_id string, active_training_batch_id string, policy_version int, global_step int, checkpoint_step int, checkpoint_event_offset long, checkpoint_event_hash string",
    "map_index": "cell string, ids array<string>, representative string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
