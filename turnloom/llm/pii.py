"""Personal data: patterns for identifiers, and information-theoretic sanitisation of the terms that reveal them.

An entity is a distinct identifier. For a term t in a text that holds an entity e, corpus counts give p(e | t) =
n(e, t) / n(t), both over distinct whole texts: n(t) counts those with t outside identifiers, n(e, t) those of them that
hold e. The pointwise mutual information log(p(e | t) / p(e)), as a share of the entity's own information
log(1 / p(e)), tells how much of e the term gives away: 1 if t never occurs without e, 0 if t says nothing. Terms at or
above one threshold are generalised to their kind of word, at or above a higher one removed, wherever they stand, but
only in documents that hold the entity. Entities of exactly the same texts are counted as one. Column expressions only,
of work in proportion to a text's length: places come from running sums, substrings from pieces of bounded length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import BROADCAST_BYTES, BROADCAST_NUMBERS, joined_by_hot_key, let, looked_up, running, written

_LOCAL = "A-Za-z0-9._%+-"
#: Patterns by kind, in the order of the result. Loops are possessive: nothing follows that could need them shorter,
#: and Java then runs them without recursion. A match begins where its run of characters begins or the last match ended,
#: which leftmost matching implies, so long runs are tried once.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
_SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
_NONE = "array<struct<kind:int,start:bigint,end:bigint,value:string>>"
#: Terms: runs of at least three letters or digits, in lower case.
_TERM = r"[A-Za-z0-9\u0080-￿]{3,}+"
_NO_TERM = r"[^a-z0-9\u0080-￿]+"
_TERM_KIND = len(KINDS)
_PLACES = "array<struct<start:bigint,end:bigint,share:double>>"
#: Code points of a piece that substrings are taken from.
_PIECE = 1024


def matches(text: Column, pattern: str) -> Column:
    """array<struct(start, end, value)> of the pattern's matches, in code points, end exclusive.

    The text between matches gives their places: the pieces of a split on the pattern alternate with the matches.
    """

    def placed(m: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        ends = running(F.zip_with(between, m, lambda b, v: (F.length(b) + F.length(v)).cast("long")), lambda a, x: a + x, "bigint")
        return F.zip_with(m, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(F.array().cast(_SPAN)))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _cut(pieces: Column, at: Column, n: Column) -> Column:
    """n code points from `at` of the text that has these pieces, at a cost of those and a piece; none for n below 1."""
    first, last = (F.floor(x / _PIECE).cast("int") for x in (at, at + n - 1))
    taken = F.substr(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), (at % _PIECE + 1).cast("int"), n.cast("int"))
    return F.when(n > 0, taken).otherwise(F.lit(""))


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    one = lambda i: F.substr(digits, n - i + 1, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, F.when(one(i) > 4, one(i) * 2 - 9).otherwise(one(i) * 2)).otherwise(one(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(F.translate(value, " -", ""), lambda d: F.length(d).between(13, 19) & luhn(F.substring(d, 1, 19)))
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _present(kind: str, text: Column) -> Column:
    """A cheap test that no text with a match fails."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.lit(True))


def identifiers(text: Column) -> Column:
    """array<struct(kind, start, end, value)> of all identifiers by kind (as in KINDS), then start."""
    return F.concat(*(_identifiers_of(text, i, kind) for i, kind in enumerate(KINDS)))


def _identifiers_of(text: Column, i: int, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    named = F.transform(found, lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.when(_present(kind, text), named).otherwise(F.array().cast(_NONE))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs in its order."""
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _entity(s: Column) -> Column:
    """Email in lower case, numbers by their digits, so that one identifier in two spellings is one entity."""
    plain = F.when(s["kind"] == 0, F.lower(s["value"])).when(s["kind"] == 1, s["value"]).otherwise(F.translate(s["value"], "+ ().-", ""))
    return F.concat_ws(":", s["kind"].cast("string"), plain)


def _replaced(text: Column, every: Callable[[Column], Column], overlapped: Callable[[Column, Column], Column]) -> Column:
    """The text with marks in place of spans. every(pieces of the text) gives them, a sorted array<struct(start, minus_end,
    mark)>; a span that begins before the end of an earlier one gives overlapped(span, that end) instead of its mark."""

    def built(pieces: Column, spans: Column, ends: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            return let(F.coalesce(F.get(ends, i - 1), F.lit(0).cast("long")), lambda at: F.when(
                x["start"] >= at, F.concat(_cut(pieces, at, x["start"] - at), x["mark"])).otherwise(overlapped(x, at)))

        last = F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0).cast("long"))
        return F.concat(F.array_join(F.transform(spans, one), ""), let(last, lambda at: _cut(pieces, at, F.length(text) - at)))

    ends = lambda spans: running(F.transform(spans, lambda x: -x["minus_end"]), F.greatest, "bigint")
    return let(_pieces(text), lambda pieces: let(every(pieces), lambda spans: let(ends(spans), lambda e: built(pieces, spans, e))))


def _marked(base: Column, mark: Callable[[Column], Column]) -> Column:
    return F.transform(base, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), mark(s).alias("mark")))


def _blanked(text: Column, base: Column) -> Column:
    """The text with blanks in place of identifiers, so that all else stays where it is."""
    blanks = lambda n: F.repeat(F.lit(" "), F.greatest(n, F.lit(0)).cast("int"))
    marks = F.sort_array(_marked(base, lambda s: blanks(s["end"] - s["start"])))
    return _replaced(text, lambda _: marks, lambda x, at: blanks(-x["minus_end"] - at))


def _terms_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), _NO_TERM)), lambda x: F.length(x) >= 3)


def found_in(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, generalise: float = 0.9, carry: bool = False
) -> DataFrame:
    """Per row: doc_id, h (hash of its text), base (array of identifiers), terms (array of struct(start, end, share): the terms
    that disclose one of its identifiers, share at least `generalise`) and, if asked for, row, a struct of all its columns.

    least: distinct texts that must show a term with an entity before it counts as evidence; all of the entity's texts
    if it stands in fewer. Null text counts as empty; repeated rows and texts count once and are told each; very long
    texts cost in proportion to their length; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = [F.struct(*docs.columns).alias("row")] if carry else []
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"), *more)
    first = slim.withColumn("base", identifiers(F.col("t"))).withColumn("t", F.when(F.size("base") > 0, F.col("t")))
    base = written(first, "identifiers")
    copies = written(base.groupBy("h").agg(F.count("*").alias("copies")), "copies")
    n_texts = float(max(copies.count(), 1))
    held = base.filter("t is not null")
    occ = F.transform(matches(_blanked(F.col("t"), F.col("base")), _TERM), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("term")))
    texts = held.select("h", "t", "base").dropDuplicates(["h"]).select("h", F.array_distinct(F.transform("base", _entity)).alias("entities"), occ.alias("occ"))
    texts = written(texts, "held")
    in_text = texts.select("h", F.explode("entities").alias("entity"))
    of_entity = in_text.groupBy("entity").agg(F.count("*").alias("n_e"), F.bit_xor(F.xxhash64("h")).alias("e"))
    alike = written(in_text.join(of_entity, "entity").select("h", "n_e", "e").distinct(), "entities")
    said = texts.select("h", F.explode(F.array_distinct(F.transform("occ", lambda x: x["term"]))).alias("term"))
    pairs = alike.join(said, "h")
    counts = pairs.groupBy("n_e", "e", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= F.least(F.lit(least), "n_e"))
    # texts without identifiers as they are, a text with copies as one; those with some by the rows above
    repeated = copies.filter("copies > 1")
    plain = slim.filter(F.size(identifiers(F.col("t"))) == 0).select("h", "t")
    plain = looked_up(plain, repeated, "h", repeated.count(), most=BROADCAST_NUMBERS)
    seen = plain.select(F.explode(_terms_of(F.col("t"))).alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("w"))
    seen = seen.union(said.select("term", F.lit(1.0)))
    df = seen.groupBy("term").agg(F.round(F.sum("w")).alias("n_t"))
    own = F.log(F.lit(n_texts) / F.col("n_e"))
    share = F.when(own > 0, F.log(F.col("n_et") * n_texts / (F.col("n_e") * F.col("n_t"))) / own)
    telling = written(counts.join(df, "term").withColumn("share", share).filter(F.col("share") >= generalise).select("n_e", "e", "term", "share"), "telling")
    told = pairs.join(telling, ["n_e", "e", "term"]).groupBy("h", "term").agg(F.max("share").alias("share"))
    placed = texts.select("h", F.explode("occ").alias("o")).select("h", "o.*").join(told, ["h", "term"])
    placed = placed.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    none = F.array().cast(_PLACES)
    kept = ["doc_id", "h", "base", *(["row"] if carry else [])]
    spotted = _with_places(held.select(*kept), written(placed, "places"), texts.select("h"), copies)
    return base.filter("t is null").select(*kept, none.alias("terms")).unionByName(spotted.withColumn("terms", F.coalesce("terms", none)))


def _with_places(held: DataFrame, placed: DataFrame, texts: DataFrame, copies: DataFrame) -> DataFrame:
    """held, rows of some of the texts h, with their terms if they have any. A text can have thousands of places, so bytes
    decide whether they are broadcast, not rows; beyond BROADCAST_BYTES held is shuffled, but for texts of very many rows."""
    size = placed.agg(F.coalesce(F.sum(64 + 40 * F.size("terms")), F.lit(0)).alias("b")).first()["b"]
    if size <= BROADCAST_BYTES:
        return held.join(F.broadcast(placed), "h", "left")
    every = texts.join(copies, "h").join(placed, "h", "left")
    return joined_by_hot_key(held, written(every, "places"), "h", "copies")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def digests(found: DataFrame) -> DataFrame:
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    more = F.transform("terms", lambda t: F.struct(F.lit(_TERM_KIND).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    every = F.concat(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))), more)
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(every).alias("spans"))


def redacted(text: Column, base: Column, terms: Column, remove: float = 0.98) -> Column:
    """The text with identifiers replaced by their kind and telling terms by their kind of word, or by a gap mark where their
    share is at least `remove`.

    Where spans overlap, the one that begins first, then the longest, is replaced, and what others have beyond it goes too.
    """
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def every(pieces: Column) -> Column:
        def word(t: Column) -> Column:
            kind = let(_cut(pieces, t["start"], t["end"] - t["start"]), lambda w: F.when(w.rlike("[0-9]"), F.lit("[NUMBER]")).when(
                F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)), F.lit("[NAME]")).otherwise(F.lit("[WORD]")))
            return F.when(t["share"] >= remove, F.lit("[REMOVED]")).otherwise(kind)

        return F.sort_array(F.concat(_marked(base, lambda s: F.get(kinds, s["kind"])), _marked(terms, word)))

    return F.when(F.size(base) > 0, _replaced(text, every, lambda x, at: F.lit(""))).otherwise(text)


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with identifiers and telling terms replaced in text_col; other columns and texts without any as they were. Each
    row's verdict stays beside it, so rows alike or of one id are sanitised each."""
    found = found_in(docs, id_col, text_col, carry=True)
    clean = redacted(F.col(f"row.{text_col}"), F.col("base"), F.col("terms")).alias(text_col)
    return found.select(*(clean if c == text_col else F.col(f"row.{c}").alias(c) for c in docs.columns))
