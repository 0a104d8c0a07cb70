"""Situations and decisions as JSON, their validity, and the gate from probability to decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.jsontext import json_object, number_text, spaced
from millrace.schemas import DECISIONS, GESTURES, PAN_MAX, PAN_MIN, TILT_MAX, TILT_MIN

# Fixed value: the system message of every example; rows are told by it, so it must be the same to the letter.
SYSTEM_PROMPT = f"""Ты — управляющий контур социального робота.

На вход ты получаешь JSON с описанием текущей ситуации: кто в кадре, что слышно,
сколько длится тишина, что ты помнишь об этом человеке и что делал сам.

Ты решаешь, что робот делает прямо сейчас:
- "ACT"     — вмешаться: сказать что-то и/или подвигаться
- "WAIT"    — не вмешиваться, ситуация тебя не касается
- "OBSERVE" — не вмешиваться, но продолжать следить за происходящим

Вмешиваться нужно уместно. Если люди разговаривают между собой, человек проходит
мимо или занят своим делом — правильное решение "WAIT". Навязчивость хуже, чем
пропущенная возможность помочь.

Отвечай строго одним JSON-объектом:
- decision: "ACT" | "WAIT" | "OBSERVE"
- confidence: число от 0 до 1 — насколько ты уверен в решении
- speech: {{"text": ..., "lang": ...}} — только при ACT
- motion: {{"pan": {PAN_MIN}..{PAN_MAX}, "tilt": {TILT_MIN}..{TILT_MAX}, "gesture": ...}} — только при ACT
- memory_write: что записать в память об этом человеке, или null

При WAIT и OBSERVE поля speech и motion должны быть null."""


def situation_json(observations: Column, silence: Column, memory: Column | None = None) -> Column:
    """A situation of observations only: members in order, nulls left out, the silent audio an empty object."""
    none = F.array().cast("array<string>")
    lists = {"memory": F.coalesce(memory, none) if memory is not None else none, "observations": F.coalesce(observations, none)}
    return json_object({"audio": F.lit("{}"), **{k: spaced(F.to_json(v)) for k, v in lists.items()}, "silence_sec": number_text(silence)})


def full_situation_json(situation: Column) -> Column:
    """Any situation struct (schemas.SITUATION): members in the order of their names at every depth, missing flags, counts
    and lists by their defaults, other nulls left out; a member struct without anything is an empty object."""
    s, none = situation, F.array().cast("array<string>")
    flag = lambda c: F.coalesce(c, F.lit(False))

    def part(parent: Column, **members: Column) -> Column:
        return F.when(parent.isNotNull(), spaced(F.to_json(F.struct(*[c.alias(k) for k, c in sorted(members.items())]))))

    audio, person, visual = s["audio"], s["person"], s["visual"]
    text = lambda c: F.when(c.isNotNull(), spaced(_quoted(c)))
    return json_object({
        "audio": part(audio, speech=audio["speech"], lang=audio["lang"], addressed_to_robot=audio["addressed_to_robot"]),
        "last_robot_action": text(s["last_robot_action"]),
        "memory": spaced(F.to_json(F.coalesce(s["memory"], none))),
        "observations": spaced(F.to_json(F.coalesce(s["observations"], none))),
        "person": part(person, id=person["id"], name=person["name"], known=flag(person["known"]), last_seen=person["last_seen"]),
        "silence_sec": number_text(F.coalesce(s["silence_sec"], F.lit(0.0))),
        "time": text(s["time"]),
        "visual": part(visual, faces=F.coalesce(visual["faces"], F.lit(0)), distance=visual["distance"], looking_at_robot=flag(visual["looking_at_robot"]), emotion=F.coalesce(visual["emotion"], F.lit("unknown"))),
    })


def decision_json(decision: Column, confidence: Column, text: Column | None = None, lang: str = "ru") -> Column:
    """A decision whose speech is there only if it is to act; a rejected action's text thus never leaks."""
    members = {"confidence": number_text(confidence), "decision": F.concat(F.lit('"'), decision, F.lit('"'))}
    if text is not None:
        speech = F.struct(F.lit(lang).alias("lang"), text.alias("text"))
        members["speech"] = F.when((decision == "ACT") & text.isNotNull(), spaced(F.to_json(speech)))
    return json_object(members)


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def example_messages(user: Column, assistant: Column | None = None) -> Column:
    """System, user and (when training) assistant message."""
    said = [("system", F.lit(SYSTEM_PROMPT)), ("user", user)] + ([("assistant", assistant)] if assistant is not None else [])
    return F.array(*[F.struct(F.lit(who).alias("role"), text.alias("content")) for who, text in said])


_NUMBER = r"^[\x20\t\n\r]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?[\x20\t\n\r]*$"
_WHOLE = r"^[\x20\t\n\r]*[+-]?[0-9]+(\.0+)?[\x20\t\n\r]*$"


def decision_valid(text: Column) -> Column:
    """Whether a JSON text is a decision: known names, ranges, whole servo steps, no speech or motion without acting, one of
    them when acting. Numbers may be written as strings or as true and false; texts and names must be strings; a member
    that isn't null by its kind, as a gesture or a step, must not be null. Broken JSON, text behind the object and missing
    fields are invalid; extra fields are ignored."""
    # Text behind the object makes the list longer, or no JSON. The lambda's variable holds what was parsed, once.
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.get(F.transform(F.array(parsed), _valid_alone), F.lit(0)), F.lit(False))


def _valid_alone(parsed: Column) -> Column:
    """Whether a parsed list holds one valid decision and nothing else."""
    get = lambda path, kind: F.try_variant_get(parsed, f"$[0]{path}", kind)
    kind = lambda path: F.coalesce(F.schema_of_variant(get(path, "variant")), F.lit("MISSING"))
    there = lambda path: ~kind(path).isin("MISSING", "VOID")

    def number(path: str, form: str) -> Column:
        said, own = get(path, "string"), kind(path)
        return F.when(own == "STRING", F.when(said.rlike(form), F.btrim(said, F.lit(" \t\n\r")).try_cast("double"))).when(own == "BOOLEAN", get(path, "boolean").cast("double")).when(own.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), get(path, "double"))

    def step(path: str, low: int, high: int) -> Column:
        x = number(path, _WHOLE)
        return (kind(path) == "MISSING") | F.coalesce(x.between(low, high) & (x == F.floor(x)), F.lit(False))

    name = lambda path, names: (kind(path) == "STRING") & get(path, "string").isin(*names)
    string_or = lambda path, *others: kind(path).isin("STRING", *others)
    is_object = lambda path: kind(path).startswith("OBJECT")
    speech, motion = there(".speech"), there(".motion")
    return (
        F.try_variant_get(parsed, "$[1]", "variant").isNull() & is_object("") & name(".decision", DECISIONS)
        & F.coalesce(number(".confidence", _NUMBER).between(0.0, 1.0), F.lit(False))
        & (~speech | (is_object(".speech") & string_or(".speech.text") & string_or(".speech.lang", "MISSING")))
        & (~motion | (is_object(".motion") & step(".motion.pan", PAN_MIN, PAN_MAX) & step(".motion.tilt", TILT_MIN, TILT_MAX) & ((kind(".motion.gesture") == "MISSING") | name(".motion.gesture", GESTURES))))
        & string_or(".memory_write", "VOID", "MISSING")
        & ((speech | motion) == (get(".decision", "string") == "ACT"))
    )


def apply_temperature(probability: Column, temperature: float) -> Column:
    """The logistic of a probability's log-odds divided by the temperature; probabilities are kept off 0 and 1 by 1e-6."""
    if temperature == 0:
        raise ZeroDivisionError("temperature must not be 0")
    p = F.least(F.greatest(probability, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1.0 / (1.0 + F.exp(-(F.ln(p / (1.0 - p)) / temperature)))


def act_probability(entries: Column, chosen: Column) -> Column:
    """P(ACT) from the first position's (token, logprob) entries: the last entry that begins with ACT over the sum of all;
    without entries or such a token, 1 or 0 by the choice itself."""
    act = F.try_element_at(F.filter(entries, lambda e: F.upper(F.trim(F.coalesce(e["token"], F.lit("")))).startswith("ACT")), F.lit(-1))
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + F.exp(e["logprob"]))
    mass = F.exp(act["logprob"])
    return F.coalesce(F.when(total > 0, mass / total).otherwise(mass), F.when(chosen == "ACT", F.lit(1.0)).otherwise(F.lit(0.0)))


def gated_decision(probability: Column, chosen: Column, threshold: float) -> Column:
    """ACT only if chosen and its probability reaches the threshold; an ACT short of it, or an unknown name, is WAIT."""
    return F.when((chosen == "ACT") & (probability >= threshold), F.lit("ACT")).when(chosen.isin("WAIT", "OBSERVE"), chosen).otherwise(F.lit("WAIT"))
