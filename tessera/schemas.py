"""Record layouts read from and written to files."""

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
          "double": T.DoubleType()}


def struct(fields: str) -> T.StructType:
    """A flat schema from 'name type, name type'; needs no running session."""
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SFT_INPUT = struct("text string, qid bigint, trainable_round int")
GENERATION = struct(
    "qid bigint, i bigint, text string, label string, data_source string, prompt string, "
    "reference string, finish_reason string, response string, response_token_len int, "
    "prompt_token_len int, model_name string, policy_name string")
SCORE = struct("qid bigint, i bigint, score double")
CODE_REFERENCE = struct("diag string, diag_code string")
