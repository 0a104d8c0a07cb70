"""Facts about labels, texts, dialogues, decisions and sizes, on literal rows."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import decisions, dialogue, labels, sizes, text
from millrace.operators import fields
from millrace.schemas import decision_json_schema


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in rows.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_label_tokens(spark):
    got = column(spark, ["accepted", "Rejected", "1", "0", " true ", "maybe", "", None], labels.label_from_text)
    assert got == [True, False, True, False, True, None, None, None]


def test_label_of_any_json_type(spark):
    got = column(spark, ["true", "0", "1.0", "2", '"Accepted"', "[1]", '{"a":1}', "null", None], lambda v: labels.label_from_variant(F.parse_json(v)))
    assert got == [True, False, True, None, True, None, None, None, None]


def test_category_and_target(spark):
    rows = spark.createDataFrame([("Correct-Detection (CD)", None), ("False-Alarm (FA)", True), ("Missed-Need (MN)", True), ("other", True), ("other", False), (None, None)], "c string, h boolean")
    assert [r[0] for r in rows.select(labels.target_decision(F.col("c"), F.col("h"))).collect()] == ["ACT", "WAIT", None, "ACT", "WAIT", None]


def test_roles(spark):
    assert column(spark, [" Human", "GPT", "function", "narrator", None], labels.role) == ["user", "assistant", "tool", "user", "user"]


def test_tail_keeps_the_last_lines_and_all_for_zero(spark):
    lines = "\n".join(f"event {k}" for k in range(40))
    assert column(spark, [lines], lambda v: text.observation_lines(v, 5)) == [[f"event {k}" for k in range(35, 40)]]
    assert len(column(spark, [lines], lambda v: text.observation_lines(v, 0))[0]) == 40
    assert column(spark, ["one", None, " \n "], lambda v: text.observation_lines(v, 5)) == [["one"], [], []]


def test_as_text(spark):
    got = column(spark, ['{"b":" x ","a":null,"c":[1,null,true]}', '"  hi "', None, "2.0"], text.as_text)
    assert got == ["b: x\nc: 1\nTrue", "hi", "", "2.0"]


def test_as_text_strips_what_it_joins(spark):
    got = column(spark, ['[" ", "a"]', '["b", "  "]', '{"a": " "}', '[[" x", {"k": [1.5, false]}], null, " y "]', "[]", '" "', "null"], text.as_text)
    assert got == ["a", "b", "a:", "x\nk: 1.5\nFalse\ny", "", "", ""]


def test_plain_text_of_columns_equals_that_of_their_json(spark):
    rows = spark.sql("""select * from values
      (array(' a ', null, '', 'b\n'), named_struct('x', ' p ', 'y', cast(null as string), 'z', array(1, null, 3)), map('k', 2.5D, 'l', 1e20D), true, 12L),
      (array(), named_struct('x', '', 'y', 'q ', 'z', array()), map(), false, null),
      (null, null, null, null, -1L) as t(l, s, m, b, n)""")
    kinds = {f.name: f.dataType for f in rows.schema}
    for name, kind in kinds.items():
        got = rows.select(text.plain_text(F.col(name), kind).alias("typed"), text.as_text(F.to_json(F.struct(name), {"ignoreNullFields": "false"})).alias("spelt")).collect()
        assert [f"{name}: {r['typed']}".strip() if r["spelt"] else "" for r in got] == [r["spelt"] for r in got]


def test_times_are_stripped(spark):
    rows = spark.sql("select array(named_struct('time', ' 5 ', 'event', ' e '), named_struct('time', '  ', 'event', 'f'), named_struct('time', 'x', 'event', ' '), null, named_struct('time', null, 'event', 'g')) as o union all select null")
    assert [r[0] for r in rows.select(text.timed_observations(F.col("o"))).collect()] == [["[5] e", "f", "g"], []]


def test_composition(spark):
    rng = random.Random(4)
    letters = "еЕиИуіaAoñçкΩ\u212b가ᄀ" + "\u0306\u0308\u0301\u0323\u1161\u11a8" * 2 + "\u0344 .,—«»қәё漢\U0001d15e\u0958"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(7))) for _ in range(1500)] + [None, "", "Её\u0306и\u0306\u0301"]
    assert column(spark, texts, text.nfc) == [t if t is None else unicodedata.normalize("NFC", t) for t in texts]


def test_settled_characters_never_change():
    own = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.match(f"[{text.SETTLED}]", chr(c))]
    assert all(unicodedata.is_normalized("NFC", c) and not unicodedata.combining(c) for c in own)
    second = {chr(int(d.split()[1], 16)) for c in range(0x110000) if " " in (d := unicodedata.decomposition(chr(c))) and d[0] != "<"}
    assert not second & set(own)


def test_long_alignments_keep_few_columns(monkeypatch):
    rng = random.Random(8)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(25))], [rng.choice("abc") for _ in range(rng.randrange(25))]) for _ in range(300)]
    monkeypatch.setattr(text, "_BITS", 50)
    assert [text.alignment(*p) for p in pairs] == [plain_alignment(*p) for p in pairs]
    assert text.alignment(["a"] * 1_100_000 + ["b"], ["a"] * 1_100_000 + ["c", "d"]) == (1, 0, 1)
    assert text.alignment(["a"] * 2_000_000, []) == (0, 2_000_000, 0)


@pytest.mark.parametrize("given, expected", [("ҚАЗА-ҚАЗАН!", "қаза-қазан"), ("a - b", "а b"), ("", ""), (None, ""), ("й", "й"), ("  x,y;  z ", "х у z"), ("5-6", "5-6")])
def test_normalize(spark, given, expected):
    assert column(spark, [given], text.normalize) == [expected]


def plain_alignment(ref, hyp):
    above = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for token in ref:
        c, s, d, i = above[0]
        row = [(c + 1, s, d + 1, i)]
        for j, other in enumerate(hyp):
            if token == other:
                row.append(above[j])
                continue
            ways = [(above[j], 1, 0, 0), (above[j + 1], 0, 1, 0), (row[j], 0, 0, 1)]
            x, s, d, i = min(ways, key=lambda w: w[0][0])
            row.append((x[0] + 1, x[1] + s, x[2] + d, x[3] + i))
        above = row
    return above[-1][1:]


def test_alignment_equals_a_plain_table(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]) for _ in range(200)] + [("бір екі үш төрт".split(), "бір өзге үш төрт бес".split())]
    expected = [plain_alignment(*p) for p in pairs]
    assert expected[-1] == (1, 0, 1)
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, r array<string>, h array<string>")
    for way in (text.align("r", "h"), text.align_expression(F.col("r"), F.col("h"))):
        assert [tuple(r["x"]) for r in rows.select("k", way.alias("x")).orderBy("k").collect()] == expected


def test_transcript(spark):
    chat = "lost\nUSER: hi <|endoftext|>\n\nASSISTANT: <functioncall> x\nFUNCTION RESPONSE: {}\nASSISTANT:   \nASSISTANT: done"
    got = column(spark, [chat, "nothing"], dialogue.parse_transcript)
    assert [(m["role"], m["content"]) for m in got[0]] == [("user", "hi"), ("assistant", "<functioncall> x"), ("tool", "{}"), ("assistant", "done")]
    assert got[1] == []


def test_empty_value_falls_through(spark):
    rows = spark.createDataFrame([([("human", "", "ignored", "told")],)], "conversations array<struct<from:string,value:string,role:string,content:string>>")
    assert tuple(rows.select(dialogue.to_messages(dict(rows.dtypes))).first()[0][0]) == ("user", "told")


def test_decision_json_never_leaks_a_rejected_text(spark):
    rows = spark.createDataFrame([("ACT", "say"), ("WAIT", "say")], "d string, t string")
    acted, waited = [r[0] for r in rows.select(decisions.decision_json(F.col("d"), F.lit(0.85), F.col("t"))).collect()]
    assert acted == '{"confidence": 0.85, "decision": "ACT", "speech": {"lang": "ru", "text": "say"}}' and waited == '{"confidence": 0.85, "decision": "WAIT"}'


def test_situation_without_sight(spark):
    assert column(spark, ["x"], lambda v: decisions.situation_json(F.array(v), F.lit(0.0))) == ['{"audio": {}, "memory": [], "observations": ["x"], "silence_sec": 0.0}']


def test_decision_validity(spark):
    good = ['{"decision":"WAIT","confidence":0}', '{"decision":"ACT","confidence":1,"speech":{"text":"a"}}', '{"decision":"ACT","confidence":0.5,"motion":{"pan":-90,"tilt":30}}', '{"decision":"WAIT","confidence":0.5,"speech":null,"extra":1}']
    bad = ['{"decision":"ACT","confidence":0.5}', '{"decision":"WAIT","confidence":0.5,"speech":{"text":"a"}}', '{"decision":"ACT","confidence":1.1,"speech":{"text":"a"}}', '{"decision":"ACT","confidence":0.5,"motion":{"pan":91}}', '{"decision":"ACT","confidence":0.5,"motion":{"pan":10.5}}', '{"decision":"ACT","confidence":0.5,"motion":{"gesture":"dance"}}', '{"decision":"RUN","confidence":0.5}', "{broken", None, "{}"]
    assert column(spark, good + bad, decisions.decision_valid) == [True] * len(good) + [False] * len(bad)


def test_act_probability(spark):
    rows = spark.createDataFrame([([("ACT", 0.0), (" act", -1.0), ("WAIT", -1.0)], "WAIT"), ([("WAIT", 0.0)], "ACT"), (None, "WAIT")], "e array<struct<token:string,logprob:double>>, c string")
    got = [r[0] for r in rows.select(decisions.act_probability(F.col("e"), F.col("c"))).collect()]
    assert got == pytest.approx([0.36787944 / 1.73575888, 1.0, 0.0])


def test_gate_and_temperature(spark):
    rows = spark.createDataFrame([(0.9, "ACT"), (0.1, "ACT"), (0.9, "OBSERVE"), (0.9, "RUN")], "p double, c string")
    assert [r[0] for r in rows.select(decisions.gated_decision(F.col("p"), F.col("c"), 0.5)).collect()] == ["ACT", "WAIT", "OBSERVE", "WAIT"]
    assert column(spark, [0.5, 1.0, 0.0], lambda v: decisions.apply_temperature(v, 1.0), "double") == pytest.approx([0.5, 1 - 1e-6, 1e-6])
    with pytest.raises(ZeroDivisionError):
        decisions.apply_temperature(F.lit(0.5), 0)


def test_sizes(spark):
    assert column(spark, ["org/Qwen-8B", "x-1.5B-y", "phi-4b", "none"], sizes.billions) == [8.0, 1.5, 4.0, 8.0]
    names = ["openai/whisper-large-v3-turbo", "me/kazakh-whisper-large-v3-turbo", "openai/whisper-large-v3", "other"]
    assert column(spark, names, sizes.speech_millions) == [809, 809, 1550, None]
    assert column(spark, names[:1], lambda v: sizes.trainable_millions(v, True)) == [170]


def test_schema_holds_the_servo_bounds():
    motion = decision_json_schema()["properties"]["motion"]["anyOf"][0]["properties"]
    assert (motion["pan"]["minimum"], motion["pan"]["maximum"], motion["tilt"]["maximum"]) == (-90, 90, 30)


def test_fields():
    assert fields.find_field(["Context", "my_label"], fields.OBSERVATION, "observation") == "Context"
    assert fields.find_field(["ctx", "my_label"], fields.LABEL, "label") == "my_label"
    assert fields.find_field(["a"], fields.LABEL, "label", required=False) is None
    with pytest.raises(fields.FieldNotFound):
        fields.find_field(["a"], fields.LABEL, "label")
    with pytest.raises(fields.FieldNotFound):
        fields.find_field(["a"], fields.LABEL, "label", override="b")
    assert fields.text_column(["text", "sentence"]) == "sentence" and fields.text_column(["a", "b"], "b") == "b"
    assert fields.corpus_format(["obs", "help_needed", "x"]) == "proactive" and fields.corpus_format(["x"]) == "generic"


def test_alignment_of_texts_and_of_large_batches(spark):
    import tracemalloc

    import pyarrow as pa

    random.seed(5)
    pairs = [("".join(random.choices("abü😀", k=random.randrange(9))), "".join(random.choices("abü😀", k=random.randrange(9)))) for _ in range(60)] + [("", "a"), ("ab", ""), (None, "ab"), ("abc", None), (None, None)]
    rows = spark.createDataFrame(pairs, "r string, h string").coalesce(1)
    lists = [text.characters(F.coalesce(c, F.lit(""))).alias(c) for c in ("r", "h")]
    told = rows.select(text.align("r", "h").alias("a")).collect()
    assert told == rows.select(*lists).select(text.align("r", "h").alias("a")).collect()
    # A batch is worked on part by part, and a part's lists go; the parts' results come in order.
    same = pa.array([[str(k % 7) for k in range(400)]] * 4000, pa.list_(pa.string()))
    odd = pa.concat_arrays([same.slice(0, 3999), pa.array([["x", "1"]], same.type)])
    joined = [pa.array(["".join(x) for x in a.to_pylist()]) for a in (same, odd)]
    for reference, hypothesis in ((same, odd), joined):
        tracemalloc.start()
        found = text.align.func(reference, hypothesis).to_pylist()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 12e6 and all(sum(x.values()) == 0 for x in found[:-1])
        assert found[-1] == {"substitutions": 1, "deletions": 398, "insertions": 0}
