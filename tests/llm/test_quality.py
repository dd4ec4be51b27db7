import random
import re
from collections import Counter

from pyspark.sql import functions as F

from seqtally.llm.quality import Rules, quality


def brute(text):
    text = text or ""
    words = re.findall("[^ \\t-\\r]+", text)
    lines = [x for x in text.split("\n") if re.search("[^ \\t-\\r]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(wins)
    covered = {k for i, w in enumerate(wins) if seen[w] > 1 for k in range(i, i + 8)}
    n, rep = len(words), len(covered)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def test_base_counts_equal_brute_force(spark, docs_of, odd_rows):
    loop = " ".join(f"w{i % 11}" for i in range(400))
    once = " ".join(f"u{i}" for i in range(60))
    texts = [loop, once, f"{once}\n{once}\n\n{once}", "a\n a\na\n\n \na # <> $$", "x " * 7, "x " * 8, "x " * 9, f"{once} {once[:40]}", "  é ß \U0001f600"]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts)]
    want = sorted(map(str, ((r[0], *brute(r[1])) for r in rows)))
    got = quality(docs_of(rows))
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(str(tuple(r)[:7]) for r in got.collect()) == want
    assert got.where("base_failed and kept").count() == 0
    assert "Python" not in got._jdf.queryExecution().toString()


def _prose(k, n=160):
    rnd = random.Random(k)
    letters = "abcdefghijklmnop"
    own = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8)))
    return " ".join(rnd.choice(["the", "of", "and", "to", "in", "is"]) if rnd.random() < 0.5 else own() for _ in range(n))


def test_far_documents_are_not_kept_and_short_ones_spared(spark, docs_of):
    clean = [(k, _prose(k)) for k in range(1, 60)]
    shout = " ".join(f"{w.upper()}!!" for w in _prose(3).split())
    other = " ".join(f"zq{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}{'uvwxyz'[i % 5]}" for i in range(90))
    rows = clean + [(100, shout), (101, other), (102, " ".join(shout.split()[:30])), (103, other, "xx", "s"), (104, other, None, "s")]
    got = {r.doc_id: r for r in quality(docs_of(rows), Rules(language_share=0.05)).collect()}
    judged = {k: r for k, r in got.items() if not r.base_failed}
    assert all(judged[k].kept for k in range(1, 60) if k in judged) and len(judged) > 20
    for bad in (100, 101):
        assert got[bad].base_failed or not got[bad].kept
    assert got[100].class_distance > 0.24 and got[101].word_distance > 0.315
    assert got[102].class_distance is None and got[103].word_distance is None and got[104].word_distance is None


def test_empty(spark, docs_of, odd_rows):
    assert quality(docs_of(odd_rows).where("false")).count() == 0
    got = quality(docs_of(odd_rows).withColumn("lang", F.lit(None).cast("string")))
    assert got.where("word_distance is not null").count() == 0
