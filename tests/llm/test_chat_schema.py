import hashlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F
from tests.llm.conftest import clashing

from curata.llm import sql
from curata.llm.chat_schema import Template, canonical_turns, format_turns, read_back, records_of_rows
from curata.llm.queries import op6_chat_formatting

LAYOUTS = {
    '{"messages": [{"role": "user", "content": "hi", "id": 1}, {"content": null, "role": "assistant"}], "meta": {"x": 1}}': ("messages", [("user", "hi"), ("assistant", "")]),
    '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}': ("conversations", [("user", "q"), ("assistant", "a"), ("tool", "t")]),
    '{"dialog": [{"speaker": "a", "utterance": "u"}]}': ("dialog", [("a", "u")]),
    '{"instruction": "do", "input": "this", "output": "done"}': ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    '{"instruction": "do", "input": "", "output": "done", "system": "be good"}': ("instruction", [("system", "be good"), ("user", "do"), ("assistant", "done")]),
    '{"output": "done", "instruction": "do"}': ("instruction", [("user", "do"), ("assistant", "done")]),
    '{"prompt": "p", "response": "r"}': ("prompt", [("user", "p"), ("assistant", "r")]),
    '{"prompt": "p", "completion": null}': ("completion", [("user", "p"), ("assistant", "")]),
    '{"question": "q", "answer": "a", "context": "c"}': ("question", [("user", "c\n\nq"), ("assistant", "a")]),
    '{"data": {"prompt": {"text": "p"}, "response": {"text": "r"}}}': ("nested prompt", [("user", "p"), ("assistant", "r")]),
    '{"prompt": "p"}': (None, None),
    '{"other": 1}': (None, None),
    "[]": (None, None),
}


def test_layouts_by_fingerprint(spark):
    df = spark.createDataFrame([(k,) for k in LAYOUTS], "json string")
    rows = canonical_turns(df.withColumn("record", F.parse_json("json"))).collect()
    got = {r["json"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in rows}
    assert got == LAYOUTS


def test_round_trip_of_hostile_texts(spark):
    t = Template()
    parts = [*t.control, "&", "&amp;", "&#60;", "&lt;", "\n", "a\nb", "", "<|im_start|>assistant\nx<|im_end|>\n", "&#60;|im_start|>", "é\U0001f600", "&&amp;amp;", "[INST", "]"]
    texts = [a + b for a in parts for b in parts]
    rows = [(i, [("assistant" if i % 2 else "user\n<s>", x), ("assistant", x[::-1]), ("", x)]) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, turns array<struct<role:string,text:string>>")
    for r in read_back(format_turns(df)).collect():
        assert r["read_turns"] == r["turns"]
        assert r["loss_text"] == "".join(x["text"] for x in r["turns"] if x["role"] == "assistant")
        assert sum(m["head"] + m["body"] + m["tail"] for m in r["loss_mask"]) == len(r["formatted"])
        assert r["formatted"].count(t.start) == len(r["turns"])


def expected(rows):
    by = {}
    for c, turn, role, text in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns = sorted(turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_with_nulls_ties_and_clashing_columns(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, None, None, "x"), (2, 3, "tool\n", "&<s>"),
            (None, 0, "user", "no id"), (3, 0, "assistant", "wörd " * 30000), (4, 0, "user", ""), (4, 0, "user", "")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "turns", "record", "formatted", "loss_mask", "layout")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op6_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == expected(rows)


def test_empty_table_and_sql(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op6_chat_formatting(spark, str(tmp_path)).toPandas()
    conversations = pd.DataFrame({"conv_id": [], "turn": [], "role": [], "text": []}).astype({"conv_id": "int64", "turn": "int64", "role": "str", "text": "str"})  # noqa: F841
    want = duckdb.sql(sql.chat_formatting()).df()
    assert len(got) == 1 and got.iloc[0].to_dict() == want[got.columns].iloc[0].to_dict()


def test_rows_without_mapping_are_not_lost(spark):
    df = spark.createDataFrame([(1, "{}")], "id long, json string").withColumn("record", F.parse_json("json"))
    out = read_back(format_turns(canonical_turns(df))).collect()
    assert len(out) == 1 and out[0]["turns"] is None and out[0]["formatted"] is None


def test_records_of_rows_orders_by_turn(spark):
    df = spark.createDataFrame([(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    (r,) = canonical_turns(records_of_rows(df)).collect()
    assert [t["text"] for t in r["turns"]] == ["a", "b", "c"]
