"""The closed vocabularies of the problem grid and the operating defaults."""

DOMAINS = ("algebra", "geometry", "number_theory", "discrete_mathematics", "applied_mathematics", "calculus", "precalculus")
PROBLEM_TYPES = ("decision", "search", "counting", "optimization", "function")
CELLS = tuple(f"{d}/{t}" for d in DOMAINS for t in PROBLEM_TYPES)
VERIFIER_MODES = ("expression", "boolean", "set")
SET_ITEMS = 32

NEAR, PARENT_CEILING, CONTAINMENT, SHARED, SIBLING = 0.92, 0.94, 0.85, 8, 0.82
QUESTION_CHARS = (20, 4000)
SCORE_ROLLOUTS, LABEL_ROLLOUTS, RETRIES = 8, 9, 2
BAND = (0.3, 0.8)
BATCH, LAG, REMEASURE, PER_CELL = 32, 1, 64, 8
FIRST_WAVE, REFILL, MOST_CANDIDATES = 64, 32, 128
MAX_CYCLES, MAX_UPDATES = 320, 256

PHASES = ("ready", "policy_frozen", "scoring", "discovery", "batch_ready", "update_applied", "checkpointed")
