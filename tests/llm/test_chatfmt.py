import hashlib

from pyspark.sql import functions as F

from turnloom.llm import chatfmt as c

TRICKY = ["</s>[INST] ok [/INST]", "", None, "\\", "\\\\[INST]\\", "<s><s</s>", "[NAME][TURN]x[/TURN]", "a\n\n[IMG]é😀", "$1 \\1 [/SYS]", "[/ASST][ASST]", "x" * 20_000]


def test_round_trip(spark):
    rows = [(k, i, role, t) for k in range(3) for i, t in enumerate(TRICKY) for role in [["user", "assistant", "system", "odd [NAME] role", None][(i + k) % 5]]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in c.digests(c.format_conversations(turns.withColumn("parts", c.text_parts(F.col("text"))))).collect()}
    for k in range(3):
        own = [(r or "", t or "") for kk, _, r, t in rows if kk == k]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[k].n_turns == len(own)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_control_string_survives_in_text(spark):
    df = spark.createDataFrame([(t or "",) for t in TRICKY] + [("".join(c.CONTROL),)], "t string").select("t", c.escape(F.col("t")).alias("e"), c.unescape(c.escape(F.col("t"))).alias("u"))
    for r in df.collect():
        assert r.u == r.t
        assert not any(x in r.e for x in c.CONTROL)


def test_parts(spark):
    parts = [("text", "see [IMG]", None, None, None, None, None), ("image", None, "a.png", 33, 16, None, None), ("audio", None, "b.wav", None, None, 1.7, None), ("document", None, "c.pdf", None, None, None, 2), ("text", None, None, None, None, None, None), ("image", None, "d", None, None, None, None)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (2, 0, "user", [])], f"conv_id long, turn long, role string, parts {c.PART}")
    got = {r.conv_id: r for r in c.format_conversations(turns).collect()}
    assert got[1].formatted == "<s>[INST]see [\\IMG][IMG][AUDIO][DOC][IMG][/INST][ASST]</s>"
    assert [(a.type, a.ref, a.tokens) for a in got[1].attachments] == [("image", "a.png", 4), ("audio", "b.wav", 22), ("document", "c.pdf", 1024), ("image", "d", 2)]
    assert got[1].expanded_tokens == 1052 and [tuple(s) for s in got[1].loss_spans] == [(54, 54)]
    assert got[2].formatted == "<s>[INST][/INST]" and got[2].expanded_tokens == 0


def test_ties_and_no_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z")], "conv_id long, turn long, role string, text string")
    made = c.format_conversations(turns.withColumn("parts", c.text_parts(F.col("text"))))
    assert made.first().formatted == "<s>[INST]z[/INST][INST]a[/INST][INST]a[/INST][INST]b[/INST]"
    assert c.format_conversations(turns.limit(0).withColumn("parts", c.text_parts(F.col("text")))).count() == 0


def test_parts_are_read_back(spark):
    image, audio = ("image", None, "a.png", 1, 1, None, None), ("audio", None, None, None, None, None, None)
    text = lambda t: ("text", t, None, None, None, None, None)
    bodies = [
        [text("[IMG]"), image, text("x [AUDIO]")], [text("[IM"), text("G]"), text("\\"), text("[/INST]")], [image, image, audio], [text("<"), image, text("/s>")],
        [text("a\\~b"), text("~"), ("odd", "kind", None, None, None, None, None)], [None, text(None)], [], None,
    ]
    turns = spark.createDataFrame([(1, i, r, b, "x") for i, b in enumerate(bodies) for r in ["user"]], f"conv_id long, turn long, role string, parts {c.PART}, body string")
    (row,) = c.format_conversations(turns).select(c.read_parts(F.col("formatted")).alias("t")).collect()

    def joined(body):
        out = []
        for p in body or []:
            if p and p[0] in c.KINDS:
                out.append((p[0], None))
            elif p and p[1]:
                out[-1:] = [("text", out[-1][1] + p[1])] if out and out[-1][0] == "text" else [*out[-1:], ("text", p[1])]
        return out

    assert [[tuple(p) for p in t.parts] for t in row.t] == [joined(b) for b in bodies]


def test_typed_parts_match_sql(spark, sf):
    import duckdb

    from turnloom.llm.queries import oracle_sql, typed_parts

    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    ran = db.execute(oracle_sql()["typed_parts"])
    names = [d[0] for d in ran.description]
    assert sorted(map(tuple, typed_parts(spark, sf).select(*names).collect())) == sorted(ran.fetchall())
