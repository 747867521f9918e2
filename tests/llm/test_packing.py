import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from turnloom.llm import packing
from turnloom.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = [None, "", "Hello, World!!", "it's THE cat's", "a b\x1cc\x0bd", "é É ½ ΑΣ ας", "<|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y.", "word word word. word, 3.14% #tag *", "☃ 日本語 zażółć", "long words " * 3000]


def test_ids_match_the_tokenizer():
    t, e = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    rng = random.Random(3)
    more = ["".join(rng.choice("aAéß .,!%<|>'s\t́") for _ in range(30)) for _ in range(300)]
    for text in TEXTS + more:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(e.packed((text or "").encode()), dtype="<u4").tolist() == want, text


def test_marks_behind_every_character():
    t, e = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    codes = [*range(33, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)]
    words = [f"a{chr(c)}{',.!'[c % 3]}" for c in codes] + ["[İ:", "&-A{Bİ!"]
    for w, x in zip(words, t.encode_batch_fast(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.packed(w.encode()), dtype="<u4").tolist() == x.ids, hex(ord(w[1]))


def test_long_words_are_not_remembered():
    t, e = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    long = "日本" * 5000 + "x"
    text = f"{long} short {long}, short {long},, end."
    for _ in range(2):
        assert np.frombuffer(e.packed(text.encode()), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert max(map(len, e.young)) <= 64 and b"short" in e.young


def test_rows_alike_fill_many_shards(docs):
    rows = packing.pack(docs(["one two three"] * 600, ids=[7] * 600), PATH, capacity=64, shard_pieces=50).collect()
    assert len(rows) == 600 and {r.doc_id for r in rows} == {7}
    assert len({r.sequence_id >> 32 for r in rows}) > 6


def check(rows, texts, capacity):
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            part = ids[r.start : r.start + capacity]
            assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_pack(docs):
    rows = packing.pack(docs(TEXTS), PATH).collect()
    check(rows, TEXTS, 4096)
    small = packing.pack(docs(TEXTS), PATH, capacity=16, shard_pieces=40).collect()
    check(small, TEXTS, 16)
    assert packing.pack(docs([]), PATH).count() == 0


def test_sum_of_squares_places_by_its_rule():
    rng = np.random.default_rng(6)
    capacity, lengths = 20, rng.integers(1, 20, size=300)
    sequence, offset = packing.sum_of_squares(lengths, capacity)
    room = {}
    for s, b, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        counts = np.bincount([g for g in room.values() if g], minlength=capacity + 1)

        def cost(g, new=False, s=s, counts=counts):
            c = counts.copy()
            c[g] -= 0 if new else 1
            if g > s:
                c[g - s] += 1
            return int((c**2).sum())

        choices = [cost(g) for g in {g for g in room.values() if g >= s}] + [cost(capacity, new=True)]
        gap = room.get(b, capacity)
        assert at == capacity - gap
        assert cost(gap, new=b not in room) == min(choices)
        room[b] = gap - s


def test_few_sequences_are_made(docs):
    rng = np.random.default_rng(7)
    lengths = np.sort(np.minimum(rng.lognormal(6.3, 0.9, size=8000).astype(int) + 1, 4095))[::-1]
    sequence, _ = packing.sum_of_squares(lengths, 4096)
    assert sequence.max() + 1 <= 1.005 * np.ceil(lengths.sum() / 4096)
