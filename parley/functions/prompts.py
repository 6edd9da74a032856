"""Prompt and schema builders, as columns where they depend on a row."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = {
    "labelled": "Write each turn as 'Speaker N: words'.",
    "text_first": "Write each turn as '[Utterance] words | [Speaker] Speaker N'.",
    "tri_field": "Write each turn as '[Utterance] words | [Transition] TAG | [Speaker] Speaker N'.",
    "json": "Answer with one JSON object whose list 'dialogue' holds the turns.",
}


def speaker_names(n: Column) -> Column:
    """'Speaker 0, Speaker 1, ..' for n speakers; empty for none."""
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit("Speaker "), i.cast("string"))), ", ")


def instructions(n: Column, grammar: str) -> Column:
    """What to do with a recording of n speakers: pairs are told apart, more are listed."""
    who = F.when(n == 2, F.lit("Two people talk: Speaker 0 speaks first, Speaker 1 answers.")).otherwise(F.concat(n.cast("string"), F.lit(" people talk: "), speaker_names(n), F.lit(".")))
    return F.concat_ws(" ", F.lit("Transcribe the conversation word by word."), who, F.lit(FORMATS[grammar]))


#: What each strategy adds to the instructions.
ADVICE = {
    "single_step": "Start a new line whenever the speaker changes.",
    "anchor_prompt": "Settle first who has which voice, from pitch, pace and manner, and hold on to that for the whole recording.",
    "two_step": "Leave the speakers out for now and write the words only.",
    "text_first": "Write what is said before you decide who said it.",
    "two_pass": "This is the first of two passes: number the turns and leave the speakers out.",
    "advanced_text_first": "Write what is said before you decide who said it; an answer belongs to another speaker than its question.",
    "structured_json": "Fill utterance, transition_type and speaker of every turn, in this order.",
    "tri_field": "Begin with a block [Speaker Profiles] of one line for each voice. Name the transition before the speaker.",
    "multi_stage": "Begin with a block [Speaker Profiles] of one line for each voice. Name the transition before the speaker.",
    "adaptive": "Begin with a block [Speaker Profiles] of one line for each voice. Name the transition before the speaker, and mark a return after an interruption.",
}
SECOND_PASS = {
    "two_step": "Give each line of this transcript a speaker. Change no word.",
    "two_pass": "Here is the first pass. Listen again and give each numbered turn its speaker.",
}


def strategy_prompt(n: Column, name: str, grammar: str) -> Column:
    """The first request of a strategy for a recording of n speakers."""
    return F.concat_ws(" ", instructions(n, grammar), F.lit(ADVICE[name]))


def second_prompt(n: Column, name: str, reply: Column) -> Column:
    """The second request of a strategy that asks for speakers apart: the first reply goes along as it is."""
    return F.concat(F.lit(SECOND_PASS[name] + " The speakers are: "), speaker_names(n), F.lit(".\n\n"), reply)


def schema_json(n: Column, most: int = 12) -> Column:
    """``response_schema`` as JSON text for each row's n; counts above ``most`` leave the labels free."""
    made = F.create_map(*[F.lit(x) for k in range(1, most + 1) for x in (k, json.dumps(response_schema(k)))])
    return F.coalesce(F.try_element_at(made, n), F.lit(json.dumps(response_schema(0))))


def mutation(prompt: Column, finding: Column) -> Column:
    """The request for a better prompt, given the present one and what went wrong with it."""
    return F.concat(F.lit("This prompt is in use:\n"), prompt, F.lit("\n\nIts replies fall short here:\n"), finding, F.lit("\n\nWrite an improved prompt, whole, and nothing else."))


def response_schema(n: int) -> dict:
    """The JSON schema of a dialogue; labels are free where n is not positive."""
    label = {"type": "STRING"} | ({"enum": [f"Speaker {i}" for i in range(n)]} if n > 0 else {})
    turn = {"utterance": {"type": "STRING"}, "transition_type": {"type": "STRING"}, "speaker": label}
    item = {"type": "OBJECT", "properties": turn, "required": list(turn)}
    return {"type": "OBJECT", "properties": {"dialogue": {"type": "ARRAY", "items": item}}, "required": ["dialogue"]}


def first_lines(turns: Column, n: int = 15) -> Column:
    """The first n of an array of (speaker, text) as lines."""
    return F.array_join(F.transform(F.slice(turns, 1, n), lambda t: F.concat(t.speaker, F.lit(": "), t.text)), "\n")


def critique(ref: Column, hyp: Column, n: int = 15) -> Column:
    return F.concat(F.lit("Reference:\n"), first_lines(ref, n), F.lit("\n\nCandidate:\n"), first_lines(hyp, n), F.lit("\n\nScore the candidate as JSON."))


def unfenced(text: Column) -> Column:
    """The inside of a code fence around the whole text."""
    t = F.trim(text)
    return F.when(t.rlike(r"(?s)^```[^\n]*\n.*\n```$"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"\n```$", ""))).otherwise(t)


def accepted(candidate: Column, current: Column, least: int = 100) -> Column:
    """The unfenced candidate if longer than ``least`` characters, else what there was."""
    t = unfenced(candidate)
    return F.when(F.length(t) > least, t).otherwise(current)
