import random

import pytest

from seqtally.llm.queries import VOCABULARY
from seqtally.llm.token_counts import Tokenizer, apply_edits, build, edit_aware_counts, edited, ordered, read_ranks, redactions


@pytest.fixture(scope="module")
def ranks(spark):
    return read_ranks(spark, VOCABULARY)


def test_edits_equal_counting_again(ranks):
    tok = Tokenizer(ranks)
    rnd = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "'", "'l", "l", "re", "1", "2", "!", "é", "Z", "\t", " the"]
    for _ in range(400):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 300)))
        tree = build(text, tok, rnd.choice([1, 2, 8, 32]))
        for _ in range(3):
            edits = []
            for _ in range(rnd.randint(0, 4)):
                a = rnd.randint(0, len(text))
                edits.append((a, min(len(text), a + rnd.choice([0, 1, 3, 20])), "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 4])))))
            want = edited(text, ordered(edits, len(text)))
            text, _ = apply_edits(text, tree, edits, tok)
            assert text == want
            assert tree.total == len(tok.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)


def test_only_touched_regions_are_encoded(ranks):
    tok = Tokenizer(ranks)
    text = "some plain words in a row, " * 4000
    tree = build(text, tok)
    new, encoded = apply_edits(text, tree, [(50_000, 50_004, "other")], tok)
    assert encoded < 1000 and tree.total == len(tok.encoding.encode_ordinary(new))


def test_table(spark, docs_of, odd_rows, ranks):
    rows = odd_rows + [(30, "mail me.x@example.com or 10.20.30.40, key " + "ab12" * 10 + " tel +1 (456) 555-2186")]
    got = edit_aware_counts(docs_of(rows), ranks).collect()
    assert len(got) == len(rows)
    tok = Tokenizer(ranks)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        new = edited(texts[r.doc_id], list(redactions(texts[r.doc_id])))
        assert r.n_before == len(tok.encoding.encode_ordinary(texts[r.doc_id]))
        assert (r.n_after, r.chars_after) == (len(tok.encoding.encode_ordinary(new)), len(new))
    assert {r.doc_id: r.n_edits for r in got}[30] == 4
    assert edit_aware_counts(docs_of(rows).where("false"), ranks).count() == 0


def test_vocabularies_that_begin_alike_are_told_apart(spark):
    ranks = {bytes([i]): i for i in range(256)}
    other = ranks | {b"ab": 256}
    longer = ranks | {b"cd": 256}
    docs = spark.createDataFrame([(1, "ababab cdcd")], "doc_id long, text string")
    assert [edit_aware_counts(docs, r).first()["n_before"] for r in (other, longer, other)] == [8, 9, 8]
