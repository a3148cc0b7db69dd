"""Byte-level BPE and packing, against the public libraries."""

import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sluice.llm import byte_bpe, packing
from sluice.llm.common import tokenizer_file

random.seed(5)
HARD = ["", "a" * 3000, "ab" * 2000, " \n\n  x ", "it's I'VE don't''s", "\x00\x00a\x00", "\x1c \x85 q", "ÀÉß ŸÿÇ é", "".join(random.choice("abthe é1'.") for _ in range(8000)), "".join(chr(random.randrange(1, 0x2FFF)) for _ in range(2000)), "<|endoftext|>a<|ENDOFTEXT|> b", "ΑΣ ſ K İ"]


def test_rank_queue_pops_in_order():
    q = byte_bpe.RankQueue(70_000)
    pushed = [(random.randrange(70_000), random.randrange(100)) for _ in range(2000)]
    for r, p in pushed:
        q.push(r, p)
    out = []
    while (found := q.pop()) is not None:
        out += [(found[0], p) for p in found[1]]
    assert out == sorted(pushed) and not q.buckets


def test_bpe_is_the_library_s():
    import public_tokenizers
    import tiktoken

    path = tokenizer_file(byte_bpe.VOCABULARY)
    coder = byte_bpe.ByteBPE(path, public_tokenizers.PATTERN)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    for text, ids in zip(HARD, coder.encode(HARD), strict=True):
        assert ids.tolist() == want.encode_ordinary(text)
        assert coder.decode(ids).tobytes() == text.encode()


def test_a_lower_rank_may_come_late(tmp_path):
    # merging bc makes the pair a, bc, whose rank is lower than that of bc
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc"]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    coder = byte_bpe.ByteBPE(str(tmp_path / "v"), ".+")
    assert coder.merge([b"abcbc", b"bcabc"]) == [[256, 257], [257, 256]]


def test_generations_of_kept_words(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(byte_bpe, "KEEP", 5)
    coder = byte_bpe.ByteBPE(tokenizer_file(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    fresh = byte_bpe.ByteBPE(tokenizer_file(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    for text in HARD + HARD:
        assert coder.encode([text])[0].tolist() == fresh.encode([text])[0].tolist()


def test_odd_rows_encode(odd, empty):
    rows = byte_bpe.encode_bpe(odd).collect()
    texts = {(r["doc_id"]): r["text"] or "" for r in odd.collect()}
    assert len(rows) == 12 and all(bytes(r["decoded"]).decode() == texts[r["doc_id"]] for r in rows)
    assert byte_bpe.encode_bpe(empty).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode_bpe(odd, keep=("doc_id", "ids"))


def test_words_are_the_tokenizer_s():
    words = packing.WordIds(tokenizer_file(packing.VOCABULARY))
    marks = "".join(map(chr, range(1, 256)))
    texts = [*HARD, "a\x01b \x01 c", "foo,'s bar's b,'ll a'b .x,y 's,t 'll,a a<|b|>c x>y don't,", marks, " ".join(f"a{m}b {m}a{m} é{m}'s" for m in marks), "naïve***&&& \u0130, \u00e9\u0301. e\u0301! \u01c5."]
    for _ in range(2):
        ids, counts = words.encode(texts)
        for own, e in zip(np.split(ids, np.cumsum(counts)[:-1]), words.encoder.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.tolist() == e.ids


def test_generations_of_packed_words(monkeypatch):
    monkeypatch.setattr(packing, "KEEP", 5)
    words = packing.WordIds(tokenizer_file(packing.VOCABULARY))
    for text in HARD + HARD:
        assert words.encode([text])[0].tolist() == words.encoder.encode(text, add_special_tokens=False).ids


def test_kept_words_take_little_memory():
    import gc
    import tracemalloc

    import pyarrow as pa

    words = packing.WordIds(tokenizer_file(packing.VOCABULARY))
    texts = [" ".join("".join(chr(97 + (i // 26**k + 7 * k) % 26) for k in range(8)) for i in range(1000 * n, 1000 * n + 1000)) for n in range(50)]
    gc.collect()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for text in texts:
        words.encode([text])
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    # 50,000 words of 8 letters, with their ids
    assert held < 80 * 50_000
    ids, counts = words.encode(texts)
    assert ids.tolist() == [i for e in words.encoder.encode_batch(texts, add_special_tokens=False) for i in e.ids] and counts.sum() == len(ids)


def test_query_packs_the_whole_table(spark):
    from sluice.llm.common import load

    words = packing.WordIds(tokenizer_file(packing.VOCABULARY))
    docs = {r["doc_id"]: [*words.encoder.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in load(spark, "/root/testdata/sf0.001", "documents").collect()}
    got, used = defaultdict(list), defaultdict(int)
    for r in packing.op2_packing(spark, "/root/testdata/sf0.001").collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        used[r["sequence_id"]] += r["length"]
    assert got.keys() == docs.keys() and max(used.values()) <= 2048
    assert 2048 * len(used) - sum(used.values()) < 2048 * 2
    for doc, ids in docs.items():
        at = 0
        for start, n, crc, tokens in sorted(got[doc]):
            assert start == at and tokens == len(ids) and crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            at += n
        assert at == len(ids)


def test_assignment_is_balanced():
    lengths = np.array([900, 800, 700, 600, 500, 400, 300, 200, 100, 2048, 7, 0])
    pieces = packing.assign(lengths)
    used, places = defaultdict(int), defaultdict(list)
    for item, start, n, at, offset in pieces:
        used[at] += n
        places[at].append((offset, n))
        assert start + n <= lengths[item]
    assert sum(used.values()) == lengths.sum() and max(used.values()) <= 2048 and len(used) == -(-lengths.sum() // 2048)
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()]
    # descending, to the lowest cost with room: the first three long ones go to sequences of their own
    assert len({at for item, _, _, at, _ in pieces if item in (9, 0, 1)}) == 3


def test_packing_of_odd_rows(odd, empty):
    words = packing.WordIds(tokenizer_file(packing.VOCABULARY))
    rows = packing.pack_documents(odd).collect()
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc in odd.collect():
        ids = np.append(words.encode([doc["text"] or ""])[0], 1)
        copies = 2 if doc["doc_id"] == 5 else 1
        assert sum(r["length"] for r in of[doc["doc_id"]]) == copies * len(ids)
        for r in of[doc["doc_id"]]:
            assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) and r["doc_tokens"] == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack_documents(empty).count() == 0
