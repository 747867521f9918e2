import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnloom.llm import pii

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    digits = re.sub("[^0-9]", "", v)
    return {"ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}.get(kind, lambda: True)()


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


TEXTS = [
    None, "", "no data", "a@b.c", "x@y.z_foo@bar.com", "a@b@c.de", "@a.b", "a.b@c.d.e. f", "é me@ex-a.org, ☃ you@ex.org", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 1.2.3", "001.2.03.255",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "1 2 3 4 5 6 7 8 9 " * 3000, "+1 (555) 123-4567 +12 +123456789", "+1+1+1+123 456 7890",
    "9" * 50_000, "a" * 50_000, "a@" * 2000, "1." * 20_000, "+1 (" * 3000, "😀a@b.cd 😀 10.0.0.1 +49 30 1234567",
]


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", pii.spans_text(pii.identifiers(F.coalesce("t", F.lit("")))).alias("s")).collect()}
    return [[x for x in got[i].split(",") if x] for i in range(len(texts))]


def test_identifiers_match_brute_force(spark):
    for text, got in zip(TEXTS, spans(spark, TEXTS), strict=True):
        assert got == brute(text), (text or "")[:60]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+- ()_9é", max_size=40), min_size=150, max_size=150))
def test_identifiers_match_on_random_texts(spark, texts):
    assert spans(spark, texts) == [brute(t) for t in texts]


def docs_with_names(docs):
    shared = [f"the report of w{i} and others" for i in range(30)]
    named = ["call Zylinder at john.doe@example.com today", "ask Zylinder or john.doe@example.com about the report", "the mail john.doe@example.com of Zylinder"]
    return docs(named + shared + ["the report without data", None, ""])


def test_telling_terms(docs):
    df = docs_with_names(docs)
    rows = {r.doc_id: r for r in pii.digests(pii.found_in(df)).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    for i, r in rows.items():
        base = brute(texts[i])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans.startswith(",".join(base))
        terms = [x.split(":") for x in r.spans.split(",") if x.startswith("term")]
        words = [texts[i][int(a) : int(z)] for _, a, z in terms]
        assert words == (["Zylinder"] if i < 3 else [])  # 'the' and 'report' stand near too, but tell nothing


def test_sanitised(docs):
    df = docs_with_names(docs)
    clean = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert clean[0].text == "call [REMOVED] at [EMAIL] today"
    assert all(clean[r.doc_id].text == r.text for r in df.collect() if r.doc_id >= 3)
    assert pii.sanitised(df).columns == df.columns
    assert pii.sanitised(df.limit(0)).count() == 0
    again = df.limit(1).union(df.limit(1))
    assert pii.sanitised(again).count() == 2


def test_overlaps(docs):
    assert pii.sanitised(docs(["x 4111111111111111 y 10.0.0.1@a.bc"])).first().text == "x [CARD] y [EMAIL]"


def test_terms_far_off_and_repeated(docs):
    far = "w0 w1 of others and " * 60
    named = [f"Zylinder is here. {far} {a} john.doe@example.com {b} {far} and Zylinder again, zylinder" for a, b in (("mail", "now"), ("ask", "soon"), ("see", "later"))]
    df = docs(named + [f"the mail of w{i} and others is here, ask again, see now or soon or later" for i in range(30)])
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    for i, t in enumerate(named):
        assert clean[i] == t.replace("john.doe@example.com", "[EMAIL]").replace("Zylinder", "[REMOVED]").replace("zylinder", "[REMOVED]")


def test_unique_identifiers_get_a_verdict(docs):
    plain = [f"the report of w{i} and others, call today" for i in range(30)]
    df = docs(["call Zylinder at john.doe@example.com today"] * 5 + plain)
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert all(clean[i] == "call [REMOVED] at [EMAIL] today" for i in range(5))
    assert all(clean[5 + i] == t for i, t in enumerate(plain))


def test_copies_are_no_evidence(docs):
    shared = [f"the report of w{i} and others" for i in range(30)]
    named = ["call Zylinder at john.doe@example.com"] * 3 + ["ask john.doe@example.com about the report"]
    assert all(r.terms == [] for r in pii.found_in(docs(named + shared)).collect())


def test_running_folds_match_plain_ones(spark):
    from turnloom.llm.common import running

    df = spark.createDataFrame([(n, [(i * 7919) % 101 for i in range(n)]) for n in (0, 1, 2, 5, 6, 7, 40, 41, 500)], "n int, v array<bigint>")
    got = df.select("n", "v", running(F.col("v"), lambda a, x: a + x, "bigint", block=6).alias("s"), running(F.col("v"), F.greatest, "bigint", block=6).alias("m")).collect()
    for r in got:
        assert r.s == [sum(r.v[: i + 1]) for i in range(r.n)] and r.m == [max(r.v[: i + 1]) for i in range(r.n)]


def test_a_very_long_text_of_identifiers(docs):
    text = "".join(f"Name{i % 5000} mail{i}@host{i % 90}.org 10.0.{i % 256}.{i // 256 % 256}\n" for i in range(60_000))  # over 2 MB
    df = docs([text, "the report of others", "the report", "Name1 of the report"])
    rows = {r.doc_id: r for r in pii.found_in(df).collect()}
    base = brute(text)
    assert len(rows[0].base) == len(base) == 120_000
    assert [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in rows[0].base[:: 997]] == base[::997]
    assert len(rows[0].terms) == 60_000 - 12  # Name1 stands in another text, too
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[0] == "".join(f"{'Name1' if i % 5000 == 1 else '[REMOVED]'} [EMAIL] [IP]\n" for i in range(60_000))
    assert clean[3] == "Name1 of the report"


def test_one_id_on_two_texts(spark, docs):
    df = docs(["ask a@b.cd now", "nothing here", "ask a@b.cd now", None], ids=[1, 1, 1, None])
    rows = sorted((r.doc_id or 0, r.text or "", r.fp, r.n) for r in pii.sanitised(df).collect())
    assert rows == [(0, "", "x", 1), (1, "[REMOVED] [EMAIL] [REMOVED]", "x", 1), (1, "[REMOVED] [EMAIL] [REMOVED]", "x", 1), (1, "nothing here", "x", 1)]


def test_many_places_are_no_broadcast(docs, monkeypatch):
    """Few texts with many telling terms each, some rows alike: their places go by bytes, not by rows."""
    monkeypatch.setattr(pii, "BROADCAST_BYTES", 1000, raising=False)
    texts = [f"a{i}@example.com " + " ".join(f"own{i}x{j}" for j in range(40)) for i in range(4)]
    found = pii.found_in(docs([*texts, texts[0], "no identifier", None]))
    assert "strategy=broadcast" not in found._jdf.queryExecution().analyzed().toString()
    told = {r.doc_id: len(r.terms) for r in found.collect()}
    assert told == {**dict.fromkeys(range(5), 40), 5: 0, 6: 0}
