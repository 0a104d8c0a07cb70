"""Record types as Spark schemas, and the closed domains of their fields."""

from __future__ import annotations

# Bounds and domains of decisions.
PAN_MIN, PAN_MAX = -90, 90
TILT_MIN, TILT_MAX = -30, 30
DECISIONS = ("ACT", "WAIT", "OBSERVE")
GESTURES = ("none", "nod", "shake", "turn_to_speaker", "scan")
EMOTIONS = ("neutral", "happy", "sad", "angry", "surprise", "fear", "disgust", "unknown")

MESSAGES = "array<struct<role:string,content:string>>"
PERSON = "struct<id:string,name:string,known:boolean,last_seen:string>"
VISUAL = "struct<faces:int,distance:string,looking_at_robot:boolean,emotion:string>"
AUDIO = "struct<speech:string,lang:string,addressed_to_robot:boolean>"
SITUATION = f"struct<time:string,silence_sec:double,person:{PERSON},visual:{VISUAL},audio:{AUDIO},observations:array<string>,memory:array<string>,last_robot_action:string>"
SPEECH = "struct<text:string,lang:string>"
MOTION = "struct<pan:int,tilt:int,gesture:string>"
DECISION = f"struct<decision:string,confidence:double,speech:{SPEECH},motion:{MOTION},memory_write:string>"
REACTION = (
    "struct<emotion_before:string,emotion_after:string,continued_dialogue:boolean,turned_away:boolean,left_frame:boolean,"
    "interrupted_robot:boolean,repeated_question:boolean,engagement_seconds:double>"
)
INTERACTION = f"situation_key string, messages {MESSAGES}, decision_json string, reaction {REACTION}"
PREDICTION = "gold string, predicted string, addressed_to_robot boolean, duration_sec double"
PROACTIVE = "obs array<struct<time:string,event:string>>, pred_task string, valid boolean, help_needed boolean, annotation array<boolean>, category string"
SWEEP_RESULT = (
    "label string, adapter string, base_only boolean, examples long, gold map<string,long>, predicted map<string,long>, invalid_json long, degenerate boolean, "
    "metrics struct<timeliness:double,false_intervention_rate:double,precision_act:double,f1_act:double,decision_accuracy:double>"
)
SPEECH_RESULT = "title string, model string, examples long, wer double, cer double, wer_detail struct<substitutions:long,deletions:long,insertions:long,reference_length:long>"


def decision_json_schema() -> dict:
    """The JSON Schema of a decision, from the bounds and domains above."""
    number = lambda low, high: {"type": "integer", "minimum": low, "maximum": high, "default": 0}
    return {
        "title": "RobotDecision",
        "type": "object",
        "required": ["decision", "confidence"],
        "properties": {
            "decision": {"enum": list(DECISIONS)},
            "confidence": {"type": "number", "minimum": 0.0, "maximum": 1.0},
            "speech": {"anyOf": [{"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "lang": {"type": "string", "default": "ru"}}}, {"type": "null"}], "default": None},
            "motion": {"anyOf": [{"type": "object", "properties": {"pan": number(PAN_MIN, PAN_MAX), "tilt": number(TILT_MIN, TILT_MAX), "gesture": {"enum": list(GESTURES), "default": "none"}}}, {"type": "null"}], "default": None},
            "memory_write": {"anyOf": [{"type": "string"}, {"type": "null"}], "default": None},
        },
    }
