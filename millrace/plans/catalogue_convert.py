"""Registered queries: foreign labels and layouts, observations, situations and decisions, dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import decisions, dialogue, labels, text
from millrace.operators import convert, evaluate
from millrace.plans.catalogue import register, table
from millrace.sources import interactions

# --- categories and proactive rows -------------------------------------------------------------------------------------

_CATEGORIES = {"1-URGENT": "Correct-Detection (CD)", "2-HIGH": "Correct-Rejection (CR)", "3-MEDIUM": "False-Alarm (FA)", "4-NOT SPECIFIED": "Missed-Need (MN)"}
_CASE = "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in _CATEGORIES.items()) + " else 'other' end"
_CODE = "case o_orderpriority when '1-URGENT' then 'CD' when '2-HIGH' then 'CR' when '3-MEDIUM' then 'FA' when '4-NOT SPECIFIED' then 'MN' end"
_TARGET = "case o_orderpriority when '1-URGENT' then 'ACT' when '2-HIGH' then 'WAIT' when '3-MEDIUM' then 'WAIT' when '4-NOT SPECIFIED' then null else case when o_totalprice > 100000 then 'ACT' else 'WAIT' end end"


def _categorised(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in _CATEGORIES.items() for x in pair])
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.coalesce(F.element_at(names, F.col("o_orderpriority")), F.lit("other")).alias("category"), (F.col("o_totalprice") > 100000).alias("help_needed"))


@register("category_code", f"select o_orderkey, {_CASE} as category, {_CODE} as code from orders")
def category_code(spark: SparkSession, sf: str) -> DataFrame:
    return _categorised(spark, sf).select("o_orderkey", "category", labels.category_code(F.col("category")).alias("code"))


@register("target_decision", f"select o_orderkey, {_TARGET} as decision from orders")
def target_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _categorised(spark, sf).select("o_orderkey", labels.target_decision(F.col("category"), F.col("help_needed")).alias("decision"))


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events in time order as (time, event) structs; sign-ups as blank events."""
    one = F.struct("ts", "event_id", F.date_format("ts", "HH:mm").alias("time"), F.when(F.col("event_type") == "signup", F.lit(" ")).otherwise(F.col("event_type")).alias("event"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["time"].alias("time"), x["event"].alias("event"))).alias("obs"))


_OBSERVED = "(select user_id, list('[' || strftime(ts, '%H:%M') || '] ' || event_type order by ts, event_id) as seen from events where event_type <> 'signup' group by user_id)"


@register("observation_tail", f"select user_id, array_to_string(seen[-12:], '|') as tail, array_to_string(seen[-3:], '|') as short_tail, len(seen)::bigint as everything from {_OBSERVED}")
def observation_tail(spark: SparkSession, sf: str) -> DataFrame:
    rows = _observed(spark, sf)
    lines = lambda n: F.array_join(text.timed_observations(F.col("obs"), n), "|")
    return rows.select("user_id", lines(12).alias("tail"), lines(3).alias("short_tail"), F.size(text.timed_observations(F.col("obs"), 0)).cast("long").alias("everything"))


def _proactive(spark: SparkSession, sf: str) -> DataFrame:
    rows = _categorised(spark, sf).join(_observed(spark, sf), F.col("o_custkey") == F.col("user_id"), "left")
    task = F.when(F.col("o_orderkey") % 10 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Offer \"help\" "), F.col("o_orderkey").cast("string")))
    return convert.proactive(rows.withColumn("pred_task", task))


_CONVERTED = f"""(select o_orderkey, seen, target, case when seen is null then 'no_observations' when target is null then 'no_label' when target = 'ACT' and o_orderkey % 10 = 0 then 'no_text' else 'kept' end as status
  from (select o_orderkey, o_custkey, {_TARGET} as target from orders) o left join {_OBSERVED} e on o.o_custkey = e.user_id)"""


@register("proactive_convert", f"""select o_orderkey, status, case when status = 'kept' then target end as decision,
  case when status = 'kept' then '{{"audio": {{}}, "memory": [], "observations": [' || array_to_string(list_transform(seen[-12:], lambda x: '"' || x || '"'), ', ') || '], "silence_sec": 0.0}}' end as situation,
  case when status = 'kept' then '{{"confidence": 0.85, "decision": "' || target || '"' || case when target = 'ACT' then ', "speech": {{"lang": "ru", "text": "Offer \\"help\\" ' || o_orderkey || '"}}' else '' end || '}}' end as answer from {_CONVERTED}""")
def proactive_convert(spark: SparkSession, sf: str) -> DataFrame:
    said = lambda k: F.get("messages", F.lit(k))["content"]
    return _proactive(spark, sf).select("o_orderkey", "status", "decision", said(1).alias("situation"), said(2).alias("answer"))


@register("convert_stats", f"select status, count(*) as n from {_CONVERTED} group by status")
def convert_stats(spark: SparkSession, sf: str) -> DataFrame:
    return convert.stats(_proactive(spark, sf))


@register("label_balance", f"select decision, n, n / sum(n) over () as share from (select target as decision, count(*) as n from {_CONVERTED} where status = 'kept' group by 1)")
def label_balance(spark: SparkSession, sf: str) -> DataFrame:
    kept = _proactive(spark, sf).filter("status = 'kept'")
    return evaluate.label_balance(kept, labels.decision_of(F.col("messages")))


@register("act_share", f"select a / (a + w)::double as act_share, not (a / (a + w)::double between 0.35 and 0.65) as skewed from (select count(*) filter (target = 'ACT') as a, count(*) filter (target = 'WAIT') as w from {_CONVERTED} where status = 'kept')")
def act_share(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.act_share_warning(label_balance(spark, sf))


# --- labels and generic rows -------------------------------------------------------------------------------------------

_TOKENS = ("accepted", " Rejected ", "YES", "no", "1", "0", "maybe", "", "true", "False", "call", "none")


@register("label_norm", "select doc_id, t as token, case when lower(trim(t)) in ('accept', 'accepted', 'yes', 'true', '1', 'positive', 'good', 'act', 'call') then true when lower(trim(t)) in ('reject', 'rejected', 'no', 'false', '0', 'negative', 'bad', 'wait', 'none') then false end as by_token, quality = 1 as by_number from (select doc_id, quality, [" + ", ".join(f"'{t}'" for t in _TOKENS) + f"][doc_id % {len(_TOKENS)} + 1] as t from labels)")
def label_norm(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select("doc_id", "quality", F.get(F.array(*map(F.lit, _TOKENS)), (F.col("doc_id") % len(_TOKENS)).cast("int")).alias("token"))
    return rows.select("doc_id", "token", labels.label_from_variant(F.parse_json(F.concat(F.lit('"'), "token", F.lit('"')))).alias("by_token"), labels.label_from_variant(F.parse_json(F.col("quality").cast("string"))).alias("by_number"))


@register("generic_convert", r"""select doc_id, status, case when status = 'kept' then case when quality = 1 then 'ACT' else 'WAIT' end end as decision, case when status = 'kept' then lines end as observations from (
  select doc_id, quality, lines, case when lines = 0 then 'no_observations' when quality = 1 and lang = 'fr' then 'no_text' else 'kept' end as status from (
    select doc_id, quality, lang, least(12, len(list_filter(regexp_split_to_array(text, '[\n\r]'), lambda x: regexp_matches(x, '[^\s\p{Z}]'))))::bigint as lines from labels join documents using (doc_id)))""")
def generic_convert(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("user_activity"), F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.lit("help")).alias("proposed_task"))
    rows = convert.generic(docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("verdict")), "doc_id"))
    seen = F.from_json(F.get("messages", F.lit(1))["content"], "observations array<string>")["observations"]
    return rows.select("doc_id", "status", "decision", F.size(seen).cast("long").alias("observations")).withColumn("observations", F.when(F.col("status") == "kept", F.col("observations")))


@register("generic_lists", """select o_orderkey, status, case when status = 'kept' then case when accepted then 'ACT' else 'WAIT' end end as decision, case when status = 'kept' then array_to_string(string_split(seen, '|')[-12:], '|') end as observations, case when status = 'kept' and accepted then said end as said from (
  select *, case when accepted is null then 'no_label' when seen is null then 'no_observations' else 'kept' end as status from (
    select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end as accepted, 'offer: ' || o_orderpriority || chr(10) || 'parts: ' || n as said, seen
    from orders join (select l_orderkey, count(*) as n, array_to_string((list('p' || l_partkey || case when l_returnflag = 'R' then '|back' else '' end order by l_linenumber, l_partkey, l_suppkey, l_returnflag) filter (l_linestatus = 'F' or l_returnflag = 'N')), '|') as seen from lineitem where l_linenumber > 1 group by l_orderkey) on l_orderkey = o_orderkey))""")
def generic_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Observations as lists with nulls and lines inside items, actions as structs, labels as words."""
    part = F.concat(F.lit(" p"), F.col("l_partkey").cast("string"), F.lit(" "))
    mode = F.when(F.col("l_returnflag") == "R", F.concat(part, F.lit("\r\n\n back  "))).otherwise(part)
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.when((F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "N"), mode).alias("mode"))
    seen = table(spark, sf, "lineitem").filter("l_linenumber > 1").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["mode"]).alias("events"), F.count("*").alias("n"))
    action = F.struct(F.concat("o_orderpriority", F.lit("  ")).alias("offer"), F.lit(None).cast("string").alias("why"), F.col("n").alias("parts"))
    label = F.when(F.col("o_orderstatus") == "F", F.lit("Accepted ")).when(F.col("o_orderstatus") == "O", F.lit("no")).otherwise(F.lit("perhaps"))
    orders = table(spark, sf, "orders").join(seen, F.col("l_orderkey") == F.col("o_orderkey"))
    made = convert.generic(orders.select("o_orderkey", "events", action.alias("task"), label.alias("verdict")))
    seen = F.array_join(F.from_json(F.get("messages", F.lit(1))["content"], "observations array<string>")["observations"], "|")
    return made.select("o_orderkey", "status", "decision", seen.alias("observations"), F.get_json_object(F.get("messages", F.lit(2))["content"], "$.speech.text").alias("said"))


@register("observation_spaced", """select user_id, array_to_string(list(case when event_id % 3 = 0 then event_type else '[' || strftime(ts, '%H:%M') || '] ' || event_type end order by ts, event_id)[-12:], '|') as tail from events where event_type <> 'signup' group by user_id
  union all select user_id, '' from events group by user_id having count(*) filter (event_type <> 'signup') = 0""")
def observation_spaced(spark: SparkSession, sf: str) -> DataFrame:
    """Times with white space around them, and blank ones."""
    time = F.when(F.col("event_id") % 3 == 0, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.date_format("ts", "HH:mm"), F.lit(" \n")))
    one = F.struct("ts", "event_id", time.alias("time"), F.when(F.col("event_type") == "signup", F.lit(" ")).otherwise(F.concat("event_type", F.lit(" "))).alias("event"))
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["time"].alias("time"), x["event"].alias("event"))).alias("obs"))
    return rows.select("user_id", F.array_join(text.timed_observations(F.col("obs"), 12), "|").alias("tail"))


# --- dialogues ---------------------------------------------------------------------------------------------------------

_ROLES = ("human", "GPT ", "chatgpt", "bot", "System", "function", "observation", "narrator")


@register("role_norm", "select conv_id, turn, r as given, case when r is null then 'user' else ['user', 'assistant', 'assistant', 'assistant', 'system', 'tool', 'tool', 'user'][k] end as role from (select conv_id, turn, (conv_id + turn) % 9 + 1 as k, ['human', 'GPT ', 'chatgpt', 'bot', 'System', 'function', 'observation', 'narrator'][(conv_id + turn) % 9 + 1] as r from conversations)")
def role_norm(spark: SparkSession, sf: str) -> DataFrame:
    given = F.get(F.array(*map(F.lit, _ROLES)), ((F.col("conv_id") + F.col("turn")) % 9).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", given.alias("given")).withColumn("role", labels.role(F.col("given")))


@register("content_text", """select event_id, case event_id % 4 when 0 then event_type when 1 then props when 2 then '{"z": [1, "a,b: c"], "a": ' || props || ', "x": null, "n": 1.50}' else 'null' end as content from (select event_id, event_type, props from events)""".replace("1.50", "1.5"))
def content_text(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(kind == 1, F.regexp_replace("props", " ", "")).when(kind == 2, F.concat(F.lit('{"z":[1,"a,b: c"],  "a":'), "props", F.lit(',"x":null,"n":1.50}'))).otherwise(F.lit("null"))
    return table(spark, sf, "events").select("event_id", dialogue.content_text(raw).alias("content"))


@register("as_text", """select event_id, event_type || chr(10) || 'k: ' || (props->>'k') as nested, 'k: ' || (props->>'k') as flat from events""")
def as_text(spark: SparkSession, sf: str) -> DataFrame:
    nested = F.concat(F.lit('["  '), "event_type", F.lit('  ",null,'), "props", F.lit("]"))
    return table(spark, sf, "events").select("event_id", text.as_text(nested).alias("nested"), text.plain_text(F.from_json("props", "map<string,string>"), T.MapType(T.StringType(), T.StringType())).alias("flat"))


def _flat(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n--\n")


def _dialogues(spark: SparkSession, sf: str) -> DataFrame:
    """conversations in the four layouts by turns: messages, conversations, transcript, prompt and response."""
    base = convert.assembled(table(spark, sf, "conversations"), "conv_id", "turn")
    m, kind = F.col("messages"), F.col("conv_id") % 4
    shout = F.create_map(*[F.lit(x) for pair in (("user", "USER: "), ("assistant", "ASSISTANT: "), ("tool", "FUNCTION RESPONSE: "), ("system", "USER: ")) for x in pair])
    chat = F.array_join(F.transform(m, lambda x: F.concat(F.element_at(shout, x["role"]), x["content"], F.lit(" <|endoftext|>\n\n"))), "")
    return base.select(
        "conv_id",
        F.when(kind == 0, m).alias("messages"),
        F.when(kind == 1, F.transform(m, lambda x: F.struct(F.when(x["role"] == "user", F.lit("human")).when(x["role"] == "assistant", F.lit("gpt")).otherwise(x["role"]).alias("from"), F.lit("").alias("value"), x["role"].alias("role"), x["content"].alias("content")))).alias("conversations"),
        F.when(kind == 2, chat).alias("chat"),
        F.lit(" Be kind. ").alias("system"),
        F.when(kind == 3, F.get(m, F.lit(0))["content"]).alias("query"),
        F.when(kind == 3, F.get(m, F.lit(1))["content"]).alias("answers"),
        F.lit("[tool]").alias("tools"),
    )


_TURNS = "(select conv_id, turn, role, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as bare from conversations)"
_PLAIN = f"(select conv_id, count(*) as n, string_agg(role || ': ' || text, chr(10) || '--' || chr(10) order by turn) as plain, string_agg(case when role = 'system' then 'user' else role end || ': ' || bare, chr(10) || '--' || chr(10) order by turn) filter (bare <> '') as said, min_by(text, turn) as first, arg_min(text, turn) filter (turn > (select 0)) as second from {_TURNS} group by conv_id)"


@register("dialogue_convert", f"""select conv_id, case when n < 2 and conv_id % 4 <> 2 then case when conv_id % 4 = 3 then 'unparsed' else 'short' end else 'kept' end as status,
  case when n < 2 and conv_id % 4 <> 2 then null when conv_id % 4 in (0, 1) then plain when conv_id % 4 = 2 then 'system: Be kind.' || chr(10) || '--' || chr(10) || said else 'system: [tool]' || chr(10) || '--' || chr(10) || 'user: ' || first || chr(10) || '--' || chr(10) || 'assistant: ' || second end as dialogue from {_PLAIN}""")
def dialogue_convert(spark: SparkSession, sf: str) -> DataFrame:
    return convert.dialogues(_dialogues(spark, sf)).select("conv_id", "status", _flat(F.col("messages")).alias("dialogue"))


@register("glaive_convert", f"select conv_id, case when acts = 0 then 'no_assistant' else 'kept' end as status, case when acts > 0 then 'system: Be kind.' || chr(10) || '--' || chr(10) || said end as dialogue from (select conv_id, count(*) filter (role = 'assistant' and bare <> '') as acts, string_agg(case when role = 'system' then 'user' else role end || ': ' || bare, chr(10) || '--' || chr(10) order by turn) filter (bare <> '') as said from {_TURNS} group by conv_id)")
def glaive_convert(spark: SparkSession, sf: str) -> DataFrame:
    base = convert.assembled(table(spark, sf, "conversations"), "conv_id", "turn")
    head = lambda r: F.when(r == "assistant", F.lit("ASSISTANT: ")).when(r == "tool", F.lit("FUNCTION RESPONSE: ")).otherwise(F.lit("USER: "))
    chat = F.array_join(F.transform("messages", lambda x: F.concat(head(x["role"]), x["content"], F.lit(" <|endoftext|>\n"))), "")
    rows = base.select("conv_id", F.lit("Be kind.<|endoftext|>").alias("system"), F.concat(F.lit("lost head\n"), chat).alias("chat"))
    return convert.transcripts(rows).select("conv_id", "status", _flat(F.col("messages")).alias("dialogue"))


@register("chat_render", "select conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) || '<|im_start|>assistant' || chr(10) as rendered from conversations group by conv_id")
def chat_render(spark: SparkSession, sf: str) -> DataFrame:
    base = convert.assembled(table(spark, sf, "conversations"), "conv_id", "turn")
    return base.select("conv_id", dialogue.render(F.col("messages"), open_turn=True).alias("rendered"))


@register("answer_window", """select conv_id from (select conv_id, role, turn, text, min(case when role = 'assistant' then turn end) over (partition by conv_id) as first from conversations)
  where first is not null group by conv_id having coalesce(sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))) filter (turn < first), 0) + 22 < 300""")
def answer_window(spark: SparkSession, sf: str) -> DataFrame:
    """The dialogues whose first answer begins within 300 characters."""
    base = convert.assembled(table(spark, sf, "conversations"), "conv_id", "turn")
    return base.filter(dialogue.answer_in_window(F.col("messages"), 300)).select("conv_id")


# --- situations and decisions ------------------------------------------------------------------------------------------

_SITUATION = """'{"audio": {}, "memory": [], "observations": ["' || event_type || '", "a,b: \\"c\\""], "silence_sec": ' || value || '}'"""


@register("situation_json", f"select event_id, {_SITUATION} as situation from events")
def situation_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", decisions.situation_json(F.array(F.col("event_type"), F.lit('a,b: "c"')), F.col("value")).alias("situation"))


@register("full_situation", """select user_id, '{"audio": ' || case when errors > 0 then '{"addressed_to_robot": true, "speech": "help"}' else '{}' end || ', "memory": [], "observations": ["' || latest || '"], "person": {"id": "' || user_id || '", "known": false}, "silence_sec": '
  || case when errors > 0 then '0.00025' else '3.0' end || case when errors > 2 then ', "time": "noon"' else '' end || ', "visual": {"emotion": "unknown", "faces": ' || errors || ', "looking_at_robot": false}}' as situation
  from (select user_id, count(*) filter (event_type = 'error') as errors, max_by(event_type, event_id) as latest from events group by user_id)""")
def full_situation(spark: SparkSession, sf: str) -> DataFrame:
    """Situations with a person, a view and maybe a voice: defaults stay, nulls go, members in order."""
    own = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").cast("int").alias("errors"), F.max_by("event_type", "event_id").alias("latest"))
    none = F.lit(None).cast("string")
    loud = F.col("errors") > 0
    s = F.struct(
        F.when(F.col("errors") > 2, F.lit("noon")).alias("time"), F.when(loud, F.lit(0.00025)).otherwise(F.lit(3.0)).alias("silence_sec"),
        F.struct(F.col("user_id").cast("string").alias("id"), none.alias("name"), F.lit(None).cast("boolean").alias("known"), none.alias("last_seen")).alias("person"),
        F.struct(F.col("errors").alias("faces"), none.alias("distance"), F.lit(None).cast("boolean").alias("looking_at_robot"), none.alias("emotion")).alias("visual"),
        F.struct(F.when(loud, F.lit("help")).alias("speech"), none.alias("lang"), F.when(loud, F.lit(True)).alias("addressed_to_robot")).alias("audio"),
        F.array("latest").alias("observations"), F.lit(None).cast("array<string>").alias("memory"), none.alias("last_robot_action"),
    )
    return own.select("user_id", decisions.full_situation_json(s).alias("situation"))


_ANSWER = """'{"confidence": 0.85, "decision": "' || case when quality = 1 then 'ACT", "speech": {"lang": "ru", "text": "doc ' || doc_id || '"}}' else 'WAIT"}' end"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").withColumn("d", F.when(F.col("quality") == 1, "ACT").otherwise("WAIT"))
    return rows.select("doc_id", "d", decisions.decision_json(F.col("d"), F.lit(0.85), F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("answer"))


@register("decision_json", f"select doc_id, {_ANSWER} as answer from labels")
def decision_json(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("doc_id", "answer")


@register("build_example", f"""select doc_id, 3 as messages, '{{"audio": {{}}, "memory": [], "observations": ["seen"], "silence_sec": 1.5}}' as situation, {_ANSWER} as answer from labels""")
def build_example(spark: SparkSession, sf: str) -> DataFrame:
    m = decisions.example_messages(decisions.situation_json(F.array(F.lit("seen")), F.lit(1.5)), F.col("answer"))
    rows = _answers(spark, sf).select("doc_id", m.alias("m"))
    return rows.select("doc_id", F.size("m").alias("messages"), F.get("m", F.lit(1))["content"].alias("situation"), F.get("m", F.lit(2))["content"].alias("answer"))


@register("decision_of", "select doc_id, case when doc_id % 5 = 0 then 'UNKNOWN' when quality = 1 then 'ACT' else 'WAIT' end as decision from labels")
def decision_of(spark: SparkSession, sf: str) -> DataFrame:
    said = F.array(F.struct(F.lit("assistant").alias("role"), F.when(F.col("doc_id") % 5 == 0, F.lit("WAIT")).otherwise(F.col("answer")).alias("content")))
    return _answers(spark, sf).select("doc_id", labels.decision_of(said).alias("decision"))


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions, some of them out of range: by event."""
    v, k = F.col("value"), F.col("event_id") % 7
    name = F.element_at(F.array(*map(F.lit, ("ACT", "ACT", "WAIT", "OBSERVE", "ACT", "RUN", "WAIT"))), (k + 1).cast("int"))
    motion = F.concat(F.lit('"motion":{"pan":'), F.floor(v).cast("string"), F.lit(',"tilt":0,"gesture":"nod"}'))
    body = F.concat(F.lit('{"decision":"'), name, F.lit('","confidence":'), F.round(v / 100, 4).cast("decimal(10,4)").cast("string"), F.when(k.isin(0, 6), F.concat(F.lit(","), motion)).when(k == 1, F.lit(',"speech":{"text":"hi"}')).otherwise(F.lit("")), F.lit("}"))
    return table(spark, sf, "events").select("event_id", body.alias("answer"))


_VALID = "(select event_id, round(value / 100, 4) between 0 and 1 and case event_id % 7 when 0 then floor(value) between -90 and 90 when 1 then true when 2 then true when 3 then true else false end as valid from events)"


@register("decision_validity", f"select event_id, valid from {_VALID}")
def decision_validity(spark: SparkSession, sf: str) -> DataFrame:
    return _generated(spark, sf).select("event_id", decisions.decision_valid(F.col("answer")).alias("valid"))


# (decision text, whether it is one)
_CASES = (
    ('{"decision":"ACT","confidence":0.5,"speech":{"text":"hi"}}', True),
    ('{"decision":"ACT","confidence":"0.5","speech":{"text":"hi"}}', True),
    ('{"decision":"ACT","confidence":" 1e-1 ","speech":{"text":"hi"}}', True),
    ('{"decision":"ACT","confidence":true,"speech":{"text":"hi"}}', True),
    ('{"decision":"WAIT","confidence":0,"speech":null,"motion":null,"memory_write":null,"more":[1]}', True),
    ('{"decision":"ACT","confidence":1,"motion":{}}', True),
    ('{"decision":"ACT","confidence":1,"motion":{"pan":"10","tilt":-30.0,"gesture":"scan"}}', True),
    ('{"decision":"ACT","confidence":1,"motion":{"pan":true}}', True),
    (' {"decision":"OBSERVE","confidence":0.25,"memory_write":"x"} ', True),
    ('{"decision":"ACT","confidence":0.5,"speech":{"text":5}}', False),
    ('{"decision":"ACT","confidence":0.5,"speech":{"text":"hi","lang":null}}', False),
    ('{"decision":"ACT","confidence":0.5,"speech":{}}', False),
    ('{"decision":"ACT","confidence":0.5,"speech":"hi"}', False),
    ('{"decision":"ACT","confidence":0.5,"speech":{"text":"hi"},"memory_write":7}', False),
    ('{"decision":"ACT","confidence":0.5,"motion":{"gesture":null}}', False),
    ('{"decision":"ACT","confidence":0.5,"motion":{"pan":null}}', False),
    ('{"decision":"ACT","confidence":0.5,"motion":{"pan":10.5}}', False),
    ('{"decision":"ACT","confidence":0.5,"motion":{"pan":91}}', False),
    ('{"decision":"ACT","confidence":0.5,"motion":[]}', False),
    ('{"decision":"ACT","confidence":"high","speech":{"text":"hi"}}', False),
    ('{"decision":"ACT","confidence":null,"speech":{"text":"hi"}}', False),
    ('{"decision":"act","confidence":0.5,"speech":{"text":"hi"}}', False),
    ('{"decision":"WAIT","confidence":0.5,"speech":{"text":"hi"}}', False),
    ('{"decision":"ACT","confidence":0.5}', False),
    ('{"decision":"WAIT","confidence":0.5} and more', False),
    ('{"decision":"WAIT","confidence":0.5},{"decision":"WAIT","confidence":0.5}', False),
    ('{"decision":"WAIT","confidence":0.5', False),
    ('["WAIT"]', False),
    ("", False),
)


@register("decision_cases", "select event_id, answer, valid from events join (values " + ", ".join(f"({k}, '{t}', {v})" for k, (t, v) in enumerate(_CASES)) + f") t(k, answer, valid) on event_id % {len(_CASES)} = k")
def decision_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every event answered by one of the hard cases."""
    cases = F.array(*[F.lit(t) for t, _ in _CASES])
    rows = table(spark, sf, "events").select("event_id", F.get(cases, (F.col("event_id") % len(_CASES)).cast("int")).alias("answer"))
    return rows.select("event_id", "answer", decisions.decision_valid(F.col("answer")).alias("valid"))


@register("decision_rows", f"select event_id from {_VALID} where valid and event_id % 2 = 0")
def decision_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _generated(spark, sf)
    other = F.array(*[F.struct(F.lit(r).alias("role"), F.lit("-").alias("content")) for r in ("system", "user")], F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    m = F.when(F.col("event_id") % 2 == 0, decisions.example_messages(F.lit("{}"), F.col("answer"))).otherwise(other)
    return interactions.decision_rows(rows.withColumn("messages", m)).select("event_id")
