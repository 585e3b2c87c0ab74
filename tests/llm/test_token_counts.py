import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rosterlight.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tree_of(leaves, own):
    _, chars, tokens = token_counts.sums(list(map(len, leaves)), own.count_batch(leaves))
    return token_counts.Tree(leaves, chars, tokens)


def edit(tree, at, remove, insert, own):
    cut = tree.cut(at, remove, insert)
    tree.put(*cut, own.count_batch(cut[3]))


def test_random_edits_match_a_full_count():
    library, own = Tokenizer.from_file(PATH), bpe.loaded(PATH)
    rnd = random.Random(6)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    bits = ["a", "the", " ", "  ", "\n", "it's", "!!", "123", "é", "\U0001f642", "<|endoftext|>", "word", ".", "\t", "x" * 70]
    for size in (0, 3, 60, 900):
        text = "".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(size))
        leaves = token_counts.leaves_of(text)
        tree = tree_of(leaves, own)
        assert tree.total == count(text)
        for _ in range(80):
            at, remove = rnd.randrange(len(text) + 5), rnd.choice([0, 0, 1, 5, 300])
            insert = "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 4, 200])))
            edit(tree, at, remove, insert, own)
            at = min(at, len(text))
            text = text[:at] + insert + text[at + remove :]
            assert "".join(tree.leaves) == text
            assert tree.total == count(text) == sum(tree.tokens[tree.width :])
            assert tree.chars[1] == len(text) and (tree.width, tree.chars, tree.tokens) == token_counts.sums(tree.chars[tree.width :], tree.tokens[tree.width :])


def test_an_edit_touches_few_leaves():
    own = bpe.loaded(PATH)
    leaves = token_counts.leaves_of("some words of a long text " * 5000)
    tree = tree_of(leaves, own)
    edit(tree, 60_000, 3, "new", own)
    assert len(leaves) > 300 and tree.encoded <= 4


def test_edits_by_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "kept as it is"), (None, "x"), (3, "again")], "doc_id long, text string").withColumn("tokens", F.lit("t"))
    edits = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 4, 4, None), (2, 1, 99, 0, "hello"), (9, 1, 0, 0, "lost"), (3, 1, None, None, None)], "doc_id long, seq int, place long, remove long, insert string")
    state = token_counts.trees(docs, PATH)
    got = sorted((str(r.doc_id), "".join(r.leaves), r.n_before, r.n_tokens) for r in token_counts.edited(token_counts.with_edits(state, edits), PATH).collect())
    count = lambda t: len(Tokenizer.from_file(PATH).encode(t).ids)
    want = [("1", "1 three", count("one two three"), count("1 three")), ("2", "hello", 0, 1), ("3", "again", 1, 1), ("3", "kept as it is", 4, 4), ("None", "x", 1, 1)]
    assert got == sorted(want)
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "place", "remove", "insert"))).alias("edits"))
    at_once = token_counts.edited_texts(docs.join(own, "doc_id", "left"), PATH)
    assert sorted((str(r.doc_id), r.n_before, r.n_tokens) for r in at_once.collect()) == sorted((i, n, m) for i, _, n, m in want)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.trees(none, PATH).count() == 0
    assert token_counts.edited_texts(none.selectExpr("*", "array(named_struct('place', 1L, 'remove', 0L, 'insert', 'x')) AS edits"), PATH).count() == 0


def test_every_leaf_that_is_encoded_counts():
    own, sent = bpe.loaded(PATH), []

    class Counting:
        def count_batch(self, texts):
            sent.extend(texts)
            return own.count_batch(texts)

    leaves = token_counts.leaves_of("some words of a long text " * 200)
    tree = tree_of(leaves, own)
    edit(tree, 60, 3, "many more words " * 3000, Counting())
    assert tree.encoded == len(sent)
    assert tree.total == sum(len(x) for x in own.encode_batch(tree.leaves))


def test_kept_sums_go_on_where_the_last_call_ended(spark):
    """Edits in two calls give what they give in one, and the second call builds no sums."""
    docs = spark.createDataFrame([(1, "a long text of many words " * 60)], "doc_id long, text string")
    ask = lambda state, at: token_counts.edited(state.withColumn("edits", F.expr(f"array(named_struct('place', {at}L, 'remove', 4L, 'insert', 'xyz'))")), PATH)
    state = token_counts.trees(docs, PATH)
    twice = ask(ask(state, 100).select("doc_id", "leaves", "chars", "tokens"), 700).first()
    text = docs.first().text
    for at in (100, 700):
        text = text[:at] + "xyz" + text[at + 4 :]
    assert "".join(twice.leaves) == text and twice.n_tokens == twice.tokens[1] == len(Tokenizer.from_file(PATH).encode(text).ids) and twice.chars[1] == len(text)
