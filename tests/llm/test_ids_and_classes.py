"""Ids above 2^53 beside nulls, texts without a letter, and characters newer than the regex module's tables."""

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from relscope.llm import bpe, lang_id, quality_mil, simhash

BIG = 2 ** 60
TEXT = "one two three four five six seven eight nine ten"
IDS = [(BIG + 1, TEXT), (None, "another text that says something else here"), (3, "a third one with its own few words"), (BIG + 2, TEXT)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(IDS, "doc_id long, text string").coalesce(1)


def test_language_keeps_ids_beside_a_null(spark, docs):
    model = lang_id.train(spark.createDataFrame([(i, TEXT, "en") for i in range(30)], "doc_id long, text string, lang string"))
    assert {r.doc_id for r in lang_id.identify(docs, model).collect()} == {BIG + 1, None, 3, BIG + 2}
    odd = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ ⅓ 12_3"), (3, "a½"), (4, "四"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(odd, model).collect()}
    assert got[1] == got[2] == got[5] == ("und", 0.0) and got[3][0] == got[4][0] == "en"


def test_simhash_keeps_ids_beside_a_null(docs):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[BIG + 1] == got[BIG + 2] == BIG + 1 and got[3] == 3 and len(got) == 4
    kept = simhash.keep_first(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "n_chars": F.lit(1)}), words=4, bits=4)
    assert {r.doc_id for r in kept.collect()} == {BIG + 1, None, 3}


def test_quality_keeps_ids_beside_a_null(spark, docs):
    assert {r.doc_id for r in quality_mil.score(docs, 0.5).collect()} == {BIG + 1, None, 3, BIG + 2}


def test_all_code_points_have_the_library_s_class_or_are_left_to_it():
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for pattern in (r"\p{L}", r"\p{N}", r"\s"):
        outside = bytearray(len(text))
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), behavior="removed").pre_tokenize_str(text):
            outside[a:b] = b"\1" * (b - a)
        mine = regex.compile(pattern)
        wrong = [c for c, out in zip(text, outside) if (mine.match(c) is None) != bool(out) and not bpe.NEWER.match(c)]
        assert wrong == []


def test_characters_of_other_unicode_versions_get_the_library_s_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    ends = [[int(x, 16) for x in r.split("-")] for r in bpe.DIFFERENT.split()]
    points = sorted({c for e in ends for c in (e[0], e[-1], (e[0] + e[-1]) // 2)})
    texts = [f.replace("{}", chr(c)) for c in points for f in ("{}'s", "a{}b 1{}", " {} {}\n{}")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.transcode(d, path).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want, hex(ord(texts[r.doc_id][0]))
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_the_lexicon_s_words_are_bounded_by_a_histogram(spark):
    counts = spark.createDataFrame([(f"w{i}", 1000 // (i + 1)) for i in range(900)], "word string, n long")
    for size in (0, 5, 100, 10_000):
        got = bpe.frequent_words(counts, size)
        assert len(got) <= size and set(got) <= {f"w{i}" for i in range(500)}
        least = min((int(w[1:]) for w in {f"w{i}" for i in range(500)} - set(got)), default=500)
        assert set(got) == {f"w{i}" for i in range(least)}
    assert len(bpe.frequent_words(counts, 10_000)) == 500


def test_many_secrets_in_one_text_are_found_in_time_that_grows_with_them(spark):
    import time

    from relscope.llm import secrets
    run, n = "0123456789abcdef" * 2, 30_000
    text = " ".join([run] * n)
    began = time.time()
    r = secrets.digest(secrets.scan_documents(spark.createDataFrame([(1, text), (2, run), (3, "x " + " ".join([run] * 129))], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert time.time() - began < 60
    assert [x.n_hex for x in r] == [n, 1, 129]
    assert r[0].spans == ",".join(f"hex:{33 * i}:{33 * i + 32}" for i in range(n))
    assert r[2].spans == ",".join(f"hex:{2 + 33 * i}:{34 + 33 * i}" for i in range(129))
