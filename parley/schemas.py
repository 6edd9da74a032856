"""Row types shared by readers and operators."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


S, D, I, B = StringType(), DoubleType(), IntegerType(), BooleanType()

TURN = _struct(speaker=S, text=S, start_time=D, end_time=D)
SEGMENT = _struct(speaker_id=S, transcript=S, start_time=D, end_time=D)

#: metadata.json rows; unknown fields are ignored on read.
SAMPLE = _struct(
    sample_id=S, recording_id=S, language=S, dataset_type=S, duration_bucket=S, duration_seconds=D, num_speakers=I, num_segments=I,
    overlap_duration=D, overlap_ratio=D, turn_switches=I, audio_path=S, audio_file=S, speaker_labels=ArrayType(S),
    ground_truth_turns=ArrayType(TURN), annotated_transcript=ArrayType(SEGMENT), reference_dialogue_raw=S, reference_dialogue_indic_clean=S,
)

METRICS = _struct(wer=D, cer=D, speaker_attribution_accuracy=D, cpwer=D, diarization_gap=D, speaker_mapping=MapType(S, S), format_valid=B)

#: The superset of all result files; a file leaves out what it does not know.
PREDICTION = _struct(
    sample_id=S, model_id=S, approach=S, source=S, strategy=S, duration_seconds=D, duration_bucket=S, num_speakers=I, overlap_ratio=D,
    conflict_tier=S, latency_seconds=D, num_turns_predicted=I, num_turns_ground_truth=I, stage2_triggered=B, metrics=METRICS,
    predicted_turns=ArrayType(TURN), raw_response=S,
)

CORRECTION = "array<struct<turn_id: string, speaker: string>>"
