import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqtally.llm.packing import encode, inner_cuts, pack_documents, read_vocabulary, sequences, shortest_pack_first, token_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(PATH)


def whole(text, tokenizer=Tokenizer.from_file(PATH)):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_distinct_runs_encode_like_whole_texts(vocabulary):
    rnd = random.Random(2)
    bits = ["the", "IT'S", "can't,", " ", "  ", "\n", "\t\x0b", " ", " ", "\x85", "é", "é", "́", "ΣΑΣ", "ß", "<|endoftext|>", "a<|startoftext|>b", "12 34", "\U0001f600", "日本語", "--", "\x00", "a≠b", "x<|y", "(it's)", "''s", "-'t", "w.d.", "9th'd8", "\x1c", "İ", "'", "s"]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(0, 30))) for _ in range(500)] + ["", None, " "]
    cuts = inner_cuts(vocabulary)
    assert cuts is not None and inner_cuts("{}") is None
    known = {}
    for c, k in ((cuts, None), (None, None), (cuts, known), (cuts, known)):
        ids, ends = encode(pa.array(texts), Tokenizer.from_str(vocabulary), cuts=c, known=k)
        begins = [0, *ends[:-1]]
        assert [ids[a:b].tolist() for a, b in zip(begins, ends)] == [whole(t) for t in texts]
    sliced = pa.array(["xx", *texts]).slice(1)
    assert (encode(sliced, Tokenizer.from_str(vocabulary))[0] == ids).all()
    assert len(encode(pa.array([], pa.string()), Tokenizer.from_str(vocabulary))[0]) == 0


def plain_shortest_first(counts, length):
    """One piece at a time into the emptiest open pack that has room."""
    packs = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [p for p in packs if length - sum(p) >= size]
            if fits:
                min(fits, key=sum).append(size)
            else:
                packs.append([size])
    return Counter(sum(p) for p in packs)


def test_histogram_plan_equals_one_piece_at_a_time():
    rnd = random.Random(7)
    for _ in range(60):
        length = rnd.choice([1, 7, 16, 50])
        counts = Counter(rnd.randint(1, length) for _ in range(rnd.randint(0, 80)))
        plan = shortest_pack_first(counts, length)
        used = Counter()
        for lengths, n in plan:
            assert sum(lengths) <= length and n > 0
            for size in lengths:
                used[size] += n
        assert used == counts
        assert Counter({k: v for k, v in plain_shortest_first(counts, length).items()}) == sum((Counter({sum(p): n}) for p, n in plan), Counter())
        assert len(plan) <= 2 * length
    # the plan does not grow with the counts
    many = shortest_pack_first({s: 10**12 + s for s in range(1, 2049)}, 2048)
    assert len(many) <= 4096 and sum(n for _, n in many) * 2048 < 1.001 * sum(s * (10**12 + s) for s in range(1, 2049))


@pytest.mark.parametrize("length", [2048, 64])
def test_every_id_lies_in_one_place(spark, docs_of, odd_rows, vocabulary, length):
    rnd = random.Random(3)
    words = ["the", "of", "running", "Zebra,", "x1"]
    rows = odd_rows + [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 300)))) for i in range(150)]
    docs = docs_of(rows).withColumns({c: F.lit("x") for c in ("start", "length", "ids", "sequence_id", "offset", "_number")})
    packed = pack_documents(docs, vocabulary, length=length)
    found = packed.collect()
    texts = Counter((r[0], zlib.crc32(np.array(whole(r[1]), "<u4").tobytes()), len(whole(r[1]))) for r in rows)
    by_doc = defaultdict(list)
    for r in found:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[r.doc_id].append(r)
    for doc_id, own in by_doc.items():
        want = [whole(t[1]) for t in rows if t[0] == doc_id]
        pieces = Counter((a, tuple(w[a : a + length]), len(w)) for w in want for a in range(0, len(w), length))
        assert Counter((r.start, tuple(r.ids), r.doc_tokens) for r in own) == pieces
    assert sum(texts.values()) == len(rows)
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s in sequences(packed, length).collect():
        n = sum(x for _, x in by_sequence[s.sequence_id])
        assert s.n_ids == n and len(s.ids) == (n if n & (n - 1) == 0 else length)
    again = pack_documents(docs, vocabulary, length=length, keep_ids=False)
    assert sorted(map(str, again.select("doc_id", "start", "ids_crc32", "sequence_id", "offset").collect())) == sorted(map(str, packed.select("doc_id", "start", "ids_crc32", "sequence_id", "offset").collect()))


def test_empty_table(spark, docs_of, odd_rows, vocabulary):
    docs = docs_of(odd_rows).where("false")
    assert pack_documents(docs, vocabulary).count() == 0
    assert token_pieces(docs, vocabulary).count() == 0
