"""Declared record types."""

from __future__ import annotations

# Record fields and their types.
RAW_TEST = "id bigint, nums array<bigint>, numbers array<bigint>, target bigint"
BUCKET = "struct<num_count:bigint,expr_depth:bigint,expr_len:bigint,has_division:boolean,has_subtraction:boolean,score:bigint,complexity:string,bucket_key:string>"
VALIDATION = "struct<ok:boolean,value:string,used_numbers:array<bigint>,expression:string,error:string>"
SOURCE = f"id string, source_index bigint, numbers array<bigint>, target bigint, gold_expr string, prompt string, bucket {BUCKET}"
UNSOLVED = "id string, source_index bigint, numbers array<bigint>, target bigint, reason string"
SFT = f"{SOURCE}, response string, validation {VALIDATION}, provenance string"
CANDIDATE = f"source_id string, candidate_id string, generation_route string, rejected string, rejected_category string, validation {VALIDATION}, rollout_index bigint"
PAIR = "prompt string, chosen string, rejected string, rejected_category string, generation_route string, provenance string"
GENERATION = "position bigint, text string, finish_reason string, token_count bigint, stop_reason string, truncated boolean"
EVAL_SAMPLE = "id string, prompt string, raw_generation string, extracted_expr string, format_ok boolean, valid_expression boolean, correct boolean, error string, value string, generated_tokens bigint, truncated boolean"
ROLLOUT = "position bigint, reward double, response_length bigint, truncated boolean, answer_correct boolean, format_ok boolean, bucket string"
LEDGER = "step bigint, metrics struct<accuracy:double,format_rate:double>, samples string, metrics_file string"
