import random
import zlib

import numpy as np
import pytest

from siteweave.llm import encode, token_counts, token_files

SCHEMA = "doc_id long, text string, start long, part string"
TEXTS = [
    "The quick brown fox.", "", None, "naïve café — déjà vu, l'été!", "it's we'll you're don't 'sneak", "a1b2c3 4,5;6", "<|endoftext|> stays <|startoftext|>x",
    "<|ENDOFTEXT|> upper", "İstanbul ΣΑΣ ǅ ﬁ", "中文 字符、标点。", "x" * 3000, "tab\tnew\nline\rfeed\x0bvt\x0cff", "non breaking space\u0085next", "é ́x",
    "hash# dollar$ & <b> *", "😀😃 ok", "word " * 4000, "a=\u0338b é.é é—, ×.a ÷!a a.ΑΣ,ΑΣ (don't) x.'s .'ll. µ.µ ª.º ÿ<>Þ ß...ñ", "a\u0301.a\u0301 ,\u0301a e.\u0301",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encode.tokenizer_path())


def plain_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def plain_result(tokenizer, rows):
    out, start = {}, 0
    for doc_id, text in rows:
        ids = [*plain_ids(tokenizer, text), 1]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_ids_by_word_are_the_ids_of_the_text(tokenizer, monkeypatch):
    rng = random.Random(4)
    alphabet = "aàbcd'.,!<|>#1 2\t\n éÉßŒ́ñ中×÷sΣ—\u0338=tµ"
    texts = [*TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400))]
    own = encode.Encoder(encode.tokenizer_path())
    for kept in (encode.KEPT_WORDS, 50):
        monkeypatch.setattr(encode, "KEPT_WORDS", kept)
        for s in range(0, len(texts), 30):
            some = texts[s:s + 30]
            data = [(t or "").encode() for t in some]
            want = [plain_ids(tokenizer, t) for t in some]
            assert [x.tolist() for x in own.ids(data)] == want
            assert own.lengths(data).tolist() == [len(x) for x in want]


def test_round_trip(spark, tokenizer):
    rows = [(50 - i, t) for i, t in enumerate(TEXTS)]
    df = token_files.report(spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(3))
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()} == plain_result(tokenizer, sorted(rows))


def test_given_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.report(docs).collect()} == plain_result(tokenizer, rows)


def test_files(spark, tokenizer, tmp_path):
    """Sequences of equal length, in order, masked behind the last id; batches of a mapped file are not copied."""
    rows = [(i, f"document number {i} has some words " * (i % 7)) for i in range(40)]
    manifest = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path), length=16)
    got = []
    for part in sorted(manifest.collect(), key=lambda r: r.part):
        for ids, mask in token_files.sequences(str(tmp_path), part.tokens):
            assert ids.shape[1] == 16 and ids.dtype == np.uint16 and not ids.flags.owndata
            got.extend(ids[mask].tolist())
    assert got == [i for _, t in rows for i in [*plain_ids(tokenizer, t), 1]]


def test_any_sequence_by_its_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 4)
    for n in (64, 100):  # the last batch full, and not
        path = str(tmp_path / f"{n}.arrows")
        with open(path, "wb") as sink:
            writer = token_files.SequenceWriter(sink, 8, False)
            for at in range(0, n, 7):
                writer.add(np.arange(at, min(n, at + 7)))
            writer.close()
        many = -(-n // 8)
        for k in reversed(range(many)):
            ids, mask = token_files.sequence(str(tmp_path), path, k)
            want = list(range(8 * k, min(n, 8 * k + 8)))
            assert ids[:len(want)].tolist() == want and mask.as_py() == [True] * len(want) + [False] * (8 - len(want))
            assert not ids.flags.owndata and ids.dtype == np.uint16
        for wrong in (-1, many, many + 1, many + 100):
            with pytest.raises(IndexError):
                token_files.sequence(str(tmp_path), path, wrong)


def test_long_regular_words(spark, tokenizer):
    """Thue-Morse words, whose polynomial hashes modulo 2**64 are equal."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(0, word), (1, word.translate(str.maketrans("ab", "ba"))), (2, word[:1024]), (3, word[1024:])]
    df = token_files.report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in df.collect()} == plain_result(tokenizer, rows)


def test_repeats_nulls_and_empty(spark):
    df = token_files.report(spark.createDataFrame([(None, "b", 0, ""), (1, "a", 0, ""), (1, "a", 0, "")], SCHEMA))
    assert sorted((r.start, str(r.doc_id)) for r in df.collect()) == [(0, "1"), (2, "1"), (4, "None")]
    assert token_files.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_length_histogram(spark, tokenizer):
    rows = [(i, t, 0, "") for i, t in enumerate([*TEXTS, *TEXTS[:4]])]
    sizes = [len(plain_ids(tokenizer, r[1])) for r in rows]
    sums = token_counts.report(spark.createDataFrame(rows, SCHEMA).repartition(3))
    table = {r.n_tokens: r for r in sums.collect()}
    assert sorted(table) == sorted(set(sizes))
    for n, r in table.items():
        assert (r.n_docs, r.docs_at_least) == (sizes.count(n), sum(s >= n for s in sizes))
        assert (r.ids_at_least, r.ids_within) == (sum(s for s in sizes if s >= n), sum(min(s, n) for s in sizes))
    for limit in (0, 1, 7, 100, 5000, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(s, limit) for s in sizes)
    for share in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(sums, share) == next(n for n in sorted(sizes) if sum(s <= n for s in sizes) >= share * len(sizes))
    empty = token_counts.report(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and token_counts.quantile(empty, 0.5) is None and token_counts.truncated_total(empty, 5) == 0
