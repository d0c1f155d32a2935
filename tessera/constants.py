"""Fixed values that define the results of queries."""

from __future__ import annotations

# Retrieval.
BM25_K1, BM25_B, MIN_TOKEN = 1.5, 0.75, 2
TOP_K, CANDIDATES, W_DENSE, W_LEXICAL, RRF_K = 10, 50, 0.4, 1.0, 60
# Graph expansion.
MAX_HOPS, DECAY, GRAPH_WEIGHT, BEAM, MAX_EXPANDED = 2, 0.5, 0.5, 24, 60
EDGE_WEIGHTS = {"prerequisite": 1.0, "explains": 0.9, "depends_on": 0.85, "appears_in": 0.7, "related_to": 0.6, "example_of": 0.55, "references": 0.5, "extends": 0.5, "mentioned_in": 0.4, "contains": 0.3}
OTHER_EDGE = 0.3
# Chunking.
PARENT_TOKENS, CHILD_TOKENS, OVERLAP_TOKENS, LEAST_TOKENS, TOKENS_A_WORD = 512, 180, 40, 8, 1.3
# Context and answers.
CONTEXT_ITEMS, CONTEXT_TOKENS, CHUNK_TOKENS = 5, 1800, 320
# Learner model.
MASTERY_START, MASTERY_K, WEAK, STRONG, EXPOSURE_GAIN = 0.3, 0.25, 0.4, 0.7, 0.05
MINUTES = {"quiz": 3, "exam": 45, "lesson": 15, "video": 10, "reading": 8, "interaction": 2}
OTHER_MINUTES = 5
# Planner.
PLAN_MINUTES = {"read": 15, "watch": 12, "practice": 20, "quiz": 5, "revision": 10}
# Bandit.
BANDIT_ALPHA, DIFFICULTIES = 2.5, (0.2, 0.35, 0.5, 0.65, 0.8)
# Video.
SEGMENT_WORDS, SEGMENT_GAP, BUCKET_SECONDS = 160, 8.0, 180
