"""Result columns, codes and messages."""

from __future__ import annotations

# Codes and domains that results carry.
ERRORS = {0: "ok", 1: "decode", 2: "encode", 3: "metric", 4: "too_small", 5: "unreachable", 6: "no_smaller", 7: "null_input", 8: "too_large", 9: "panic"}
MODES = ("fast", "quality", "strip")
MIN_DIM, SCORE_CEILING, MAX_PIXELS = 113, 91.0, 250_000_000
LOWEST, HIGHEST, STEP, PROBES = 20, 98, 8, 6
JOB_BYTES, RAM_SHARE = 3.0e9, 0.75

# What a user is told about a code.
MESSAGES = {
    0: "ok",
    1: "the image could not be decoded",
    2: "the image could not be encoded",
    3: "the perceptual metric failed",
    4: "too small to judge perceptually; use fast mode",
    5: "the quality target cannot be reached for this image",
    6: "already optimal; a smaller file is not possible",
    7: "no input was provided",
    8: "this image is too large to open safely; the file was not changed",
    9: "the engine failed unexpectedly; the file was not changed",
}
TARGET, QUALITY = 80.0, 75.0

#: The columns of a result row, whatever the mode.
RESULT = {
    "path": "string", "mode": "string", "target": "double", "format": "string", "state": "string", "data": "binary", "bytes": "long", "original_bytes": "long",
    "quality": "double", "score": "double", "best_score": "double", "quantized": "boolean", "hdr": "string", "error_code": "int",
    "target_met": "boolean", "metadata_removed": "boolean", "modificationTime": "timestamp",
    "error_detail": "struct<reason:string,shorter_side:int,best_score:double,best_bytes:bigint,width:bigint,height:bigint>", "probes": "array<struct<quality:float,score:double,bytes:bigint>>",
}
