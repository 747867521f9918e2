import json
import time

from pyspark.sql import functions as F

from turnloom.operators import convert
from turnloom.plans.chat import Engine
from turnloom.streaming import turns as st


def test_stateless_requests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"conv_id": i, "request": json.dumps({"messages": [{"role": "user", "content": f"q{i}"}]})}))
    stream = spark.readStream.schema("conv_id long, request string").json(str(tmp_path / "in"))
    out = Engine.of(7).tokens(convert.from_json(stream)).select("conv_id", "prompt")
    q = out.writeStream.format("memory").queryName("prompts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.conv_id: r.prompt for r in spark.table("prompts").collect()} == {i: f"<s>[INST]q{i}[/INST]" for i in range(3)}


def test_turns_are_gathered(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def put(name, rows):
        (tmp_path / name).write_text("\n".join(json.dumps(dict(zip(("conv_id", "turn", "role", "text", "ts"), r, strict=True))) for r in rows))
        (tmp_path / name).rename(tmp_path / "in" / name)
        time.sleep(1.1)  # files are taken in order of their time

    put("a", [(1, 1, "assistant", "b", "2024-01-01T00:00:01"), (2, 0, "user", "x", "2024-01-01T00:00:02")])
    put("b", [(1, 0, "user", "a", "2024-01-01T00:00:03")])
    put("c", [(9, 0, "user", "late", "2024-01-01T02:00:00")])
    put("d", [(9, 1, "user", "later", "2024-01-01T02:00:01")])
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = st.messages(st.gathered(stream, quiet_ms=60_000))
    q = out.writeStream.format("memory").queryName("gathered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.conv_id: [(m.role, m.chunks[0].text) for m in r.messages] for r in spark.table("gathered").collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "x")]}
    assert spark.table("gathered").select(F.size("messages")).count() == 2
