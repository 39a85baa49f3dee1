"""Declared schemas and fixed values of the data model."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the analysed system's for equal results.
# Experiment arms, in their fixed order.
ARMS = ["baseline", "raw_text", "raw_text_contract", "contract"]
# Block types that may continue on the next block when flagged as split.
SPLITTABLE_TYPES = ["paragraph", "caption", "equation", "reference_entry"]
# Block types left out of the semantic-stage input.
EXCLUDED_TYPES = ["unknown", "reference_entry"]
# Bucket thresholds (Low < 0.33 <= Med < 0.66 <= High).
BUCKET_THRESHOLDS = (0.33, 0.66)
BUCKETS = ["Low", "Med", "High"]
# Absolute-error tolerance of the binary correctness proxy.
CORRECT_TOL = 0.15
# Candidate names of the prediction column, first present wins.
PRED_CANDIDATES = ["pred_answer", "model_answer", "model_pred", "prediction", "answer"]
# Bootstrap settings: replicates, seeds.
N_BOOT = 2000
SEED_PER_DOMAIN = 7
SEED_CROSS_DOMAIN = 42
N_CAL_BINS = 10
N_HIST_BINS = 30
# Context flags of the answer stage.
FLAG_CONTRACT = "CC"
FLAG_RAW_TEXT = "RAW_TEXT"
# Field names of the question, answer, ledger, state and design tables below.
# ---------------------------------------------------------------------------

BLOCK = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("ref", T.StringType()),
])

QUESTION = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("question_type", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("gold_answer", T.StringType()),
    T.StructField("gold_trace", T.StringType()),
    T.StructField("notes", T.StringType()),
])

ANSWER = T.StructType(QUESTION.fields[:] + [
    T.StructField("experiment_id", T.StringType()),
    T.StructField("config_name", T.StringType()),
    T.StructField("pred_answer", T.StringType()),
    T.StructField("pred_trace", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("latency", T.LongType()),
    T.StructField("eval_score", T.DoubleType()),
])

# A scored-answer file as the analysis reads it: the model decides the JSON
# type of answers and scores, so they are read as text and cast on purpose.
SCORED_ANSWER_JSON = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("gold_answer", T.StringType()),
    T.StructField("pred_answer", T.StringType()),
    T.StructField("eval_score", T.StringType()),
    T.StructField("trace_sim", T.StringType()),
    T.StructField("experiment_id", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("timestamp_utc", T.StringType()),
    T.StructField("experiment_id", T.StringType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("agent_name", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("success", T.IntegerType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("total_tokens", T.LongType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("model_name", T.StringType()),
])

URL_STATE = T.StructType([
    T.StructField("paper_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.StringType()),
])

DESIGN_CSV = T.StructType([
    T.StructField("candidate_name", T.StringType()),
    T.StructField("justification", T.StringType()),
    T.StructField("feasibility_score", T.StringType()),
    T.StructField("contract_parts", T.StringType()),
])
