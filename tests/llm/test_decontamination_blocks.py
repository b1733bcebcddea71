"""Decontamination gives the same rows whether the benchmark fits into one block or takes several."""

import pytest

from tierwise.llm import decontaminate as D

ITEMS = [(10, "alpha beta gamma delta"), (11, "delta epsilon zeta"), (12, "one two three four five"), (13, "theta iota"), (10, "kappa lambda"), (None, "alpha"), (14, None)]
DOCS = [
    (None, "alpha beta gamma delta epsilon zeta eta"),
    (None, "clean words of the same length here"),
    (None, "clean words of the same length here"),
    (None, "alpha beta gamma delta epsilon zeta eta"),
    (1, "x one two three four five"),
    (1, "x none of them is here"),
    (1, "kappa lambda theta iota x y"),
    (1, "kappa lambda theta iota x y"),
    (2, None),
    (2, ""),
    (3, "theta iota " * 3 + "x " + "alpha beta gamma delta"),
]


@pytest.mark.parametrize("words", [1, 6])
def test_blocks_do_not_change_rows(spark, monkeypatch, words):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = lambda: sorted((tuple(r) for r in D.decontaminate(docs, items).collect()), key=str)
    whole = rows()
    assert len(whole) == len(DOCS) and sorted(r[2] for r in whole if r[0] is None) == [0, 0, 6, 6]
    monkeypatch.setattr(D, "BLOCK_WORDS", words)
    assert rows() == whole


@pytest.mark.parametrize("limits", [(15, 1 << 20), (8_000_000, 7)])
def test_shards_of_tiny_texts_keep_their_rows_apart(spark, monkeypatch, limits):
    """Empty texts add no bytes, so a shard has a bound of rows too, and rows are numbered on from shard to shard."""
    monkeypatch.setattr(D, "SHARD_BYTES", limits[0])
    monkeypatch.setattr(D, "SHARD_ROWS", limits[1])
    made = [(i, "") for i in range(40)] + [(100 + i, "a") for i in range(60)] + [(300, "kappa lambda")]
    docs, items = spark.createDataFrame(made, "doc_id long, text string").coalesce(1), spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(tuple(r) for r in D.decontaminate(docs, items).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 1)
    cut = sorted(tuple(r) for r in D.decontaminate(docs, items).collect())
    assert cut == whole and [r[0] for r in cut] == [i for i, _ in made] and cut[-1][2] == 2
