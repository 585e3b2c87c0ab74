import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlight.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  ", "a  b\n\n c", "<|endoftext|>x<|endoftext|>", "x" * 300, "é" * 100, "　a b\x1c c", "日本語 \U0001f642\U0001f642", "I'm we'll they've 'S 12345 ⅷ²", "\r\n\r\n a", "don't\tstop  ", " \n ", "a \n b"]


def texts(seed, n):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice(" \n\tab'sé1!<|>\U0001f642\x00") for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_ids_and_texts_are_the_library_s():
    library, own = Tokenizer.from_file(PATH), bpe.Bpe(PATH)
    for t, ids in zip(texts(1, 1500), own.encode_batch(texts(1, 1500)), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False) == t
    assert own.count_batch(texts(1, 1500)) == [len(x) for x in own.encode_batch(texts(1, 1500))] == bpe.Bpe(PATH).count_batch(texts(1, 1500))


def test_matrix_lists_and_heap_agree():
    own, rnd = bpe.Bpe(PATH), random.Random(5)
    words = ["".join(rnd.choice("theandiong") for _ in range(rnd.randrange(1, 40))).encode() for _ in range(400)]
    matrix = own.merge_short(words)
    assert matrix == [own.merge_one(w) for w in words] == [own.merge_long(w).tobytes() for w in words]


def test_operators_on_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Hello there"), (2, None), (2, None), (None, "x"), (3, "")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("q"))
    tokens = bpe.encoded(df, PATH)
    assert sorted((str(r.doc_id), r.n_tokens) for r in tokens.collect()) == [("1", 2), ("2", 0), ("2", 0), ("3", 0), ("None", 1)]
    assert sorted(r.text for r in bpe.decoded(tokens, PATH).collect()) == ["", "", "", "Hello there", "x"]
    sums = {str(r.doc_id): r for r in bpe.round_trip_digests(df, PATH).collect()}
    assert sums["1"].ids_sha256 == hashlib.sha256(b"15496,612").hexdigest()
    assert sums["2"].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0


def test_bytes_that_are_no_text_decode_to_replacement_marks():
    own = bpe.loaded(PATH)
    library = Tokenizer.from_file(PATH)
    ids = [i for i in range(94, 256)]
    for i in ids:
        assert own.decode(__import__("numpy").array([i])) == library.decode([i], skip_special_tokens=False)


def test_empty_tables_and_a_column_named_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encoded(none, PATH).count() == bpe.round_trip_digests(none, PATH).count() == bpe.decoded(bpe.encoded(none, PATH), PATH).count() == 0
    both = bpe.decoded(bpe.encoded(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), PATH).withColumn("text", F.lit("own")), PATH).first()
    assert (both["text"], both["text_"]) == ("a b", "own")
