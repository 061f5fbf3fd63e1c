import random
from collections import Counter

import pytest
import regex

from mergeloom.functions import patterns as P
from mergeloom.operators import inventory as I
from mergeloom.operators.counters import BigramCounter, WordCounter, batches
from mergeloom.operators.pretokenizer import PreTokenizer
from mergeloom.sources import texts

EDGE = ["", " ", "a", "it's I'd've 's", "x y　　z", "a  b\n\nc \n", "1 2３", "don''t !?", "\u0085 .", "é 你好 x"]


def _pieces(df):
    return [(r.piece, r.is_special) for r in df.orderBy("doc_id", "pos").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Hello, world! It's 2024.", ["Hello", ",", " world", "!", " It", "'s", " 2024", "."]),
        ("你好，世界！Now是2024年。", ["你好", "，", "世界", "！", "Now是", "2024", "年", "。"]),
    ],
)
def test_default_pattern(spark, text, want):
    assert PreTokenizer().tokens(text) == want
    assert _pieces(PreTokenizer().pieces(texts.in_memory(spark, [text]))) == [(w, False) for w in want]


def test_table_and_single_text_agree(spark):
    rng = random.Random(1)
    rows = EDGE + ["".join(rng.choice("ab '1 \n!é你") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    pre = PreTokenizer(["ab", "'1"])
    got = _pieces(pre.pieces(texts.in_memory(spark, rows)))
    assert got == [p for t in rows for p in pre.pieces_of(t)]
    counted = {r.word: r.freq for r in pre.words(texts.in_memory(spark, [*rows, None])).collect()}
    assert counted == dict(Counter(p for t in rows for p, s in pre.pieces_of(t) if not s))


def test_default_pattern_keeps_all_text():
    for t in EDGE:
        assert "".join(PreTokenizer().tokens(t)) == t


def test_custom_pattern(spark):
    assert PreTokenizer(pat_str=r"[^\s]").get_words("ab a") == {"a": 2, "b": 1}
    assert P.java_pattern(r"a$|[$]|\$") == r"(?Ud)a\z|[$]|\$"
    got = PreTokenizer(pat_str=r"\s++$|\S+").words(texts.in_memory(spark, ["ab a  "])).collect()
    assert {r.word: r.freq for r in got} == {"ab": 1, "a": 1, "  ": 1}


def test_specials_in_list_order(spark):
    pre = PreTokenizer(["<a", "<a>"])
    assert list(pre.pieces_of("x<a>y")) == [("x", False), ("<a", True), (">", False), ("y", False)]
    assert _pieces(pre.pieces(texts.in_memory(spark, ["x<a>y"]))) == list(pre.pieces_of("x<a>y"))


@pytest.mark.parametrize("mixed, text, want", [("keep", "Hello 世界你好 world", ["Hello", " 世界", "你", "好", " world"]), ("keep", "er世界", ["er世界"]), ("split", "er世界", ["er", "世界"])])
def test_segmentation(spark, mixed, text, want):
    pre = PreTokenizer(unicode_bigrams=["世界"], unicode_bigram_mixed_boundary=mixed)
    assert pre.tokens(text) == want
    assert [p for p, _ in _pieces(pre.pieces(texts.in_memory(spark, [text])))] == want
    assert {r.word: r.freq for r in pre.words(texts.in_memory(spark, [text])).collect()} == dict(Counter(want))


def test_bigrams_stop_at_specials(spark):
    pre = PreTokenizer(["<|endoftext|>"])
    text = "ab你<|endoftext|>bc你好한글かな"
    want = {"你好": 1, "好한": 1, "한글": 1, "글か": 1, "かな": 1}
    assert dict(pre.bigrams_of(text)) == want
    assert {r.left + r.right: r.freq for r in pre.bigram_counts(texts.in_memory(spark, [text, None, ""])).collect()} == want
    with pytest.raises(ValueError):
        PreTokenizer(unicode_bigrams=["abc"])


@pytest.mark.parametrize("top, least, kept, cut, out", [(2, 1, 3, 5, 4), (10, 5, 3, 5, 4), (10, 11, 0, None, 10), (0, 1, 0, None, 10), (9, 1, 4, 4, None)])
def test_selection_keeps_ties(spark, top, least, kept, cut, out):
    counts = {"你好": 10, "世界": 5, "한글": 5, "かな": 4}
    table = spark.createDataFrame([(b[0], b[1], n) for b, n in counts.items()], "left string, right string, freq long")
    counter = BigramCounter(PreTokenizer())
    counter.counts.update(counts)
    for s in (I.select_bigrams(table, top, least), counter.select(top, least)):
        assert (len(s.bigrams), s.cutoff_freq, s.max_excluded_freq) == (kept, cut, out)
    assert I.top_bigrams(table, top, least).count() == kept


def test_counters():
    pre = PreTokenizer(pat_str=r"[^\s]")
    a, b = WordCounter(pre), WordCounter(pre)
    a.add_text("ab")
    b.add_batch(["a", "c"])
    a.merge(b)
    assert a.words() == {"a": 2, "b": 1, "c": 1} and a.len == 3
    assert a.take_counts() and a.is_empty()
    for bad in ({"max_records": 0}, {"max_bytes": 0}, {"prefetch": 2}):
        with pytest.raises(ValueError):
            a.add_source(iter(["x"]), **bad)

    def broken():
        yield "p"
        yield "q"
        raise ValueError("source failed")

    with pytest.raises(ValueError, match="source failed"):
        a.add_source(broken(), max_records=1)
    assert a.words() == {"p": 1, "q": 1}
    assert list(batches(iter(["aa", "b", "cccccc", "d"]), 10, 3)) == [["aa", "b"], ["cccccc"], ["d"]]
    a.counts["z"] = (1 << 63) - 1
    with pytest.raises(OverflowError):
        a.add_text("z")


def test_two_passes():
    source = ["你好世界", "你好"]
    bigrams = BigramCounter(PreTokenizer())
    bigrams.add_source(source, max_records=1, max_bytes=8)
    s = bigrams.select(1, 1)
    assert (s.bigrams, s.cutoff_freq, s.max_excluded_freq) == (["你好"], 2, 1)
    words = WordCounter(PreTokenizer().with_unicode_bigrams(s.bigrams))
    words.add_source(source)
    assert words.words() == {"你好": 2, "世": 1, "界": 1}


def test_inventory_operators(spark):
    words = spark.createDataFrame([("a", 5), ("bb", 5), ("ccc", 1)], "word string, freq long")
    assert [r.word for r in I.sorted_words(words).collect()] == ["bb", "a", "ccc"]
    assert {r.word: r.freq for r in I.merged(words, words).collect()} == {"a": 10, "bb": 10, "ccc": 2}
    s = I.summary(words).first()
    assert (s.unique_words, s.occurrences, s.singletons, s.max_length) == (3, 11, 1, 3)
    assert {r.word: r.freq for r in I.scaled(words, 4).collect()} == {"a": 2, "bb": 2}
    assert sum(r.freq for r in I.scaled(words, 101).collect()) == 101
    assert {r.word: r.freq for r in I.scaled(words, 1).collect()} == {"a": 1}
    assert I.words_fingerprint(words) == I.words_fingerprint(words.repartition(3))
    assert I.fingerprint(["ab", "c"]) != I.fingerprint(["a", "bc"])
    assert regex.match(P.any_of([]), "x") is None
