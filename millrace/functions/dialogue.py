"""Dialogues of several layouts as one array of messages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.jsontext import respelt
from millrace.functions.labels import role, strip

# The transcript format's markers, their roles and its end token.
MARKERS = {"USER": "user", "ASSISTANT": "assistant", "FUNCTION RESPONSE": "tool"}
END_TOKEN = "<|endoftext|>"
# Columns that hold a prompt and a response, in the order in which they are tried.
PROMPT_KEYS = ("prompt", "instruction", "question", "query", "input")
RESPONSE_KEYS = ("response", "answer", "answers", "output", "completion", "target")

MESSAGES = "array<struct<role:string,content:string>>"


def message(who: Column, content: Column) -> Column:
    return F.struct(who.alias("role"), content.alias("content"))


def clean(text: Column) -> Column:
    return strip(F.replace(text, F.lit(END_TOKEN), F.lit("")))


def content_text(raw: Column) -> Column:
    """A message's content, given as JSON text of any type: strings as they are, everything else (null too) as JSON, members
    in their order. A missing content is null's text."""
    value = F.coalesce(raw, F.lit("null"))
    is_string = F.ltrim(value).startswith('"')
    string = F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(is_string, string).otherwise(respelt(F.when(~is_string, value)))


def parse_transcript(chat: Column) -> Column:
    """Turns of a transcript whose lines begin with USER:, ASSISTANT: or FUNCTION RESPONSE:. What precedes the first marker
    and empty turns are dropped."""
    names = "|".join(MARKERS)
    pattern = rf"(?dms)^({names}):\s*(.*?)(?=^(?:{names}):|\z)"
    said = lambda group: F.regexp_extract_all(chat, F.lit(pattern), F.lit(group))
    who = F.transform(said(1), lambda m: F.element_at(F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair]), m))
    turns = F.zip_with(who, F.transform(said(2), clean), message)
    return F.filter(turns, lambda t: t["content"] != "")


def from_messages(items: Column) -> Column:
    """messages: (role, content) structs with foreign role names."""
    return F.transform(items, lambda m: message(role(m["role"]), F.coalesce(m["content"], F.lit("null"))))


def from_conversations(items: Column) -> Column:
    """conversations: from or role, value or content; an empty value falls through to the next."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.transform(items, lambda m: message(role(F.coalesce(some(m["from"]), m["role"])), F.coalesce(some(m["value"]), m["content"], F.lit("null"))))


def from_chat(chat: Column, system: Column) -> Column:
    """A transcript with its system text, if there is one, in front. Null if nothing can be parsed."""
    turns = parse_transcript(chat)
    head = F.coalesce(strip(system), F.lit(""))
    whole = F.when(head != "", F.concat(F.array(message(F.lit("system"), head)), turns)).otherwise(turns)
    return F.when(F.size(turns) > 0, whole)


def from_prompt(prompts: list[Column], responses: list[Column], tools: Column) -> Column:
    """The first non-empty prompt and response, behind the tools as a system message."""
    pick = lambda cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(None).cast("string"))
    prompt, response = pick(prompts), pick(responses)
    pair = F.array(message(F.lit("user"), prompt), message(F.lit("assistant"), response))
    known = F.nullif(tools, F.lit(""))
    return F.when(prompt.isNotNull() & response.isNotNull(), F.when(known.isNotNull(), F.concat(F.array(message(F.lit("system"), known)), pair)).otherwise(pair))


def to_messages(columns: dict[str, str]) -> Column:
    """Messages of a row with the given columns (name: type), by the first layout that fits; null if none does."""
    have = lambda name: F.col(name) if name in columns else F.lit(None).cast("string")
    ways = []
    if columns.get("messages", "").startswith("array"):
        ways.append(F.when(F.size("messages") > 0, from_messages(F.col("messages"))))
    if columns.get("conversations", "").startswith("array"):
        ways.append(F.when(F.size("conversations") > 0, from_conversations(F.col("conversations"))))
    if "chat" in columns:
        ways.append(F.when(strip(F.col("chat")) != "", from_chat(F.col("chat"), have("system"))))
    prompts, responses = [F.col(k) for k in PROMPT_KEYS if k in columns], [F.col(k) for k in RESPONSE_KEYS if k in columns]
    if prompts and responses:
        ways.append(from_prompt(prompts, responses, F.coalesce(F.nullif(have("tools"), F.lit("")), have("functions"))))
    return F.coalesce(*ways) if ways else F.lit(None).cast(MESSAGES)


@dataclass(frozen=True)
class Template:
    """A chat template: what stands around a turn's role and content, and the head of an answer to come."""

    before: str = "<|im_start|>"
    between: str = "\n"
    after: str = "<|im_end|>\n"
    answer: str = "<|im_start|>assistant\n"


def render(messages: Column, open_turn: bool = False, template: Template = Template()) -> Column:
    """Messages in a template; open_turn adds the head of an answer to come."""
    t = template
    turns = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(t.before), m["role"], F.lit(t.between), m["content"], F.lit(t.after))), "")
    return F.concat(turns, F.lit(t.answer)) if open_turn else turns


def answer_in_window(messages: Column, window: int, template: Template = Template(), size: Callable[[Column], Column] = F.length) -> Column:
    """Whether an answer begins before the window ends: what precedes the first one, rendered, is shorter, by characters or another
    measure. Training cuts texts at the window, so other dialogues have nothing to learn from. False without an answer."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "assistant").cast("int")
    before = render(F.slice(messages, F.lit(1), F.greatest(first - 1, F.lit(0))), True, template)
    return F.coalesce((first > 0) & (size(before) < window), F.lit(False))


def prompt_of(messages: Column) -> Column:
    """The messages that aren't the assistant's; a message without a role stays."""
    return F.filter(messages, lambda m: ~m["role"].eqNullSafe(F.lit("assistant")))
