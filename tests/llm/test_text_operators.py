"""Counts, ids, quality and language against plain Python and the libraries."""

import itertools
import random
import time
import zlib

import numpy as np
import plain_versions as plain
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadlake.llm import language, quality, textgrid, token_counts, token_ids

SCHEMA = "doc_id long, text string, lang string, source string, size long"
WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
BYTE_PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " \t\n", "one", "The <|endoftext|> End", "naïve ÉCLAIR Σς", "a b\x85c \x1c d", "1234 'll don't", "😀😀 🇩🇪", "x" * 30_000, "word " * 5000, "Ɤ new letter"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(ODD)] + [(3, "one", None, None, None), (None, "no id", "en", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def word_encoder():
    return token_ids.WordEncoder(WORD_PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(BYTE_PATH)


pieces = st.lists(st.one_of(st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "'ll", "The", "é", "é", "1", "\x1c", "\x85", "!", "don't,"]), st.text(max_size=3)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(text=pieces.filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)))
def test_libraries_agree(text, word_encoder, counter):
    got = np.frombuffer(word_encoder.packed([text.encode()])[0], dtype=word_encoder.width).tolist()
    assert got == word_encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_every_code_point_counts_alike(counter):
    """The split by pattern is the library's for every assigned code point."""
    for low in range(0, 0x110000, 4096):
        points = [c for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000 and not counter.unassigned.search(chr(c))]
        text = "".join(f"a{chr(c)}1 {chr(c)}!{chr(c)} " for c in points)
        ends, at = [], 0
        for piece in counter.split(text):
            at += len(piece)
            ends.append(at)
        assert ends == [e for _, (_, e) in counter.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_spaces_part_texts_as_the_library_does(counter):
    for n in range(1, 6):
        for some in itertools.product(["a", " ", "\n", "'s", "\u3000", "<|endoftext|>"], repeat=n):
            text = "".join(some)
            assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids), text


def test_a_word_seen_is_not_split_again(counter, monkeypatch):
    text = "Wörter that ereatshly, 'll be 12 seen\nagain " * 3 + "end"
    want, seen, split = counter.count(text), [], counter.split
    monkeypatch.setattr(counter, "split", lambda part: seen.append(part) or split(part))
    assert counter.count(text) == want
    assert seen == ["Wörter"]


def test_unassigned_are_found_fast(counter):
    spent = time.process_time()
    assert not counter.unassigned.search("é" * 2_000_000)
    assert time.process_time() - spent < 0.5
    for at in (0, 1, 65_535, 65_536, 70_000):
        assert counter.unassigned.search("é" * at + "\u0378" + "é")
        assert counter.unassigned.search("é" * at + "\U000e0fff" + "é")
    assert not counter.unassigned.search("")


def test_memory_holds_short_words_alone(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 5)
    counter = token_counts.PieceCounter(BYTE_PATH)
    for text in ["q" * 30_000 + " " + "z" * 30_000, " ".join(f"w{k}é" for k in range(50))]:
        assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)
    assert len(counter.words) <= 5
    assert all(len(w) <= 64 for w in [*counter.words, *counter.merged])


@given(st.lists(st.integers(0, (1 << 32) - 1)))
def test_values_round_trip(values):
    array = np.array(values, dtype=np.uint32)
    control, data = token_ids.encode_values(array)
    assert token_ids.decode_values(control, data, len(array)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def test_binary_corpus(spark, odd):
    t = Tokenizer.from_file(WORD_PATH)
    rows = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for key, ids in rows:
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_ids.binary_corpus(odd, WORD_PATH).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = token_ids.encode(odd, WORD_PATH)
    from threadlake.session import shared_path

    folder = shared_path(spark, "test")
    many = token_ids.write_shards(small, folder, shard_tokens=3000, block_tokens=500)
    assert many.count() > 1
    assert sorted((tuple(r) for r in token_ids.read_digests(many, folder).collect()), key=str) == sorted(want, key=str)


def test_token_counts(odd):
    t = Tokenizer.from_file(BYTE_PATH)
    for r in token_counts.count_tokens(odd, BYTE_PATH).collect():
        if r.doc_id is not None:
            text = ODD[r.doc_id] or ""
            n = len(t.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def test_empty_tables(spark, odd):
    none = odd.filter("doc_id < 0")
    assert token_ids.binary_corpus(none, WORD_PATH).count() == 0
    assert token_counts.count_tokens(none, BYTE_PATH).count() == 0
    assert quality.ledger(none).count() == 0 and quality.filter_documents(none).count() == 0
    assert language.identify(none).count() == 0


lines = st.lists(st.sampled_from(["a b c d e", "a b c d e f", "", " ", "é # x", "one\ttwo\r", "\x1c"]), max_size=9).map("\n".join)


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), lines), max_size=5))
def test_measures(texts):
    import pyarrow as pa

    got = quality._measure(pa.array(texts, pa.string()))
    assert [list(map(int, m)) for m in zip(*got)] == [plain.measures(t) for t in texts]


def test_ledger_policies_and_ablation(odd):
    rows = quality.ledger(odd)
    assert {r.doc_id for r in rows.filter(quality.passes("base")).collect()} == set()
    kept = quality.filter_documents(odd.selectExpr("doc_id", "concat_ws(' ', transform(sequence(1, 20), x -> concat('w', x * (coalesce(doc_id, 0) + 1)))) as text", "size as quality"))
    assert kept.columns == ["doc_id", "text", "quality"] and kept.count() == len(ODD) + 2
    found = {r.rule: (r.n_failed, r.n_alone) for r in quality.ablation(rows, "base").collect()}
    assert found["few_words"][0] >= found["few_words"][1] > 0


def test_long_texts_span_slices():
    import pyarrow as pa

    texts = ["w%d " % k * 40 for k in range(50)]
    whole = [g.n_words.tolist() for _, g in textgrid.grids(pa.array(texts))]
    cut = [n for _, g in textgrid.grids(pa.array(texts), slice_bytes=300) for n in g.n_words.tolist()]
    assert sum(whole, []) == cut == [40] * 50


def test_suffix_automaton():
    table = language.suffix_automaton([1, 2, 1, 1, 2], 3)

    def holds(word):
        at = 0
        for c in word:
            at = table[at][c]
            if at < 0:
                return False
        return True

    assert holds([2, 1, 1]) and holds([1, 2, 1, 1, 2]) and not holds([2, 2]) and not holds([1, 1, 1])


def test_language_parse_counts_phrases():
    parser = language.CrossParser((("aa", "abab"), ("bb", "bbbb")))
    count, letters = parser.phrases(["abab", "bbb", "123", "ba!ab"])
    assert letters.tolist() == [4, 3, 0, 4]
    assert count[0, 0] == 1 and count[1, 1] == 1 and count[1, 0] > 1


def _plain_phrases(sample, text):
    """Longest matches from left to right; a letter the sample has not is one."""
    count = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        count, at = count + 1, end
    return count


def test_language_phrases_cross_stretches():
    """Phrases longer than a stretch, and none cut by one."""
    rng = random.Random(5)
    sample = "".join(rng.choice("abcde ") for _ in range(1500))
    sample = " ".join(sample.split())
    parser = language.CrossParser((("a", sample), ("b", "xyz abc")))
    texts = [sample * 3, "x" * 700, sample[5:900] + "q" + sample, "".join(rng.choice("abcdexyz") for _ in range(3000))]
    count, _ = parser.phrases(texts)
    assert count.tolist() == [[_plain_phrases(s, t) for t in texts] for s in (sample, "xyz abc")]


def test_language_sample_is_spread_and_bounded(spark):
    """One long text is one passage of the sample; rows equal in id and text count once."""
    rows = [(k, f"word{k} " * 50, "aa") for k in range(30)] + [(100, "zz " * 40_000, "aa")] + [(7, "same text", "bb")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = dict(language.training_sample(docs))
    assert max(map(len, sample["aa"])) <= language.PASSAGE and len(sample["aa"]) > 15 and len(sample.get("bb", [""])) == 1


@pytest.mark.parametrize("dense_bytes", [1 << 27, 0])
def test_language_keeps_every_letter(monkeypatch, dense_bytes):
    """Scripts of many letters share no table: each is told by its own letters."""
    monkeypatch.setattr(language, "DENSE_BYTES", dense_bytes, raising=False)
    rng = random.Random(4)
    alphabets = {"aa": range(0x61, 0x7B), "cjk": range(0x4E00, 0x4E00 + 900), "kor": range(0xAC00, 0xAC00 + 600)}
    known = {name: ["".join(chr(rng.choice(letters)) for _ in range(rng.randint(2, 6))) for _ in range(150)] for name, letters in alphabets.items()}
    draw = lambda name, n: " ".join(rng.choice(known[name]) for _ in range(n))
    samples = tuple((name, draw(name, 1000)[:3000]) for name in alphabets)
    parser = language.CrossParser(samples)
    texts = [draw(name, 30)[:200] for name in alphabets] + [f"{draw('aa', 5)} {draw('cjk', 5)} {draw('kor', 5)}"]
    count, _ = parser.phrases(texts)
    assert count.tolist() == [[_plain_phrases(sample, t) for t in texts] for _, sample in samples]
    assert count.argmin(axis=0)[:3].tolist() == [0, 1, 2]


def test_language_many_labels(spark, monkeypatch):
    """More labels than 500 are told apart as fewer are."""
    monkeypatch.setattr(language, "SAMPLE_DOCS", 1)
    rows = [(k * 10 + j, chr(0x4E00 + k) * 12, f"l{k:03}") for k in range(540) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sampled = language.training_sample(docs)
    assert len(sampled) > 500


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, odd):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[1].score == 0.0


def test_quality_beside_columns_named_alike(spark):
    """Names that differ in case only are the same to Spark."""
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, 5, 6), (2, "short", 5, 6)], "doc_id long, text string, Quality int, QUALITY_ int")
    kept = quality.filter_documents(docs, "base")
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, text, 5, 6)]
