from __future__ import annotations

import corpus_pipeline as P
from framewright.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, sizes, columns = Scratch(spark, "test"), [docs.count()], docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert docs.where("n_chars <> length(coalesce(text, ''))").isEmpty()
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    out = P.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == sizes[4] and all(len(r.ids) == r.n_tokens for r in out)


def test_mixing_stage_writes_what_the_mix_takes(spark, docs, prose):
    rows = docs([(i, " " + prose(10 + i, i) + "\n", "en", "ab"[i % 4 > 0]) for i in range(40)])
    mixed = {r.doc_id: r for r in P.op4_mixing.mix(rows).collect()}
    got: dict[int, int] = {}
    for r in P.mixing(spark, rows, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {i: r.taken for i, r in mixed.items() if r.taken}


def test_rows_without_a_key_of_their_own_stay_in_every_stage(spark, docs, prose):
    texts = {k: prose(64, 100 + k) for k in range(5)}
    rows = docs([(None, texts[0], "en", "s"), (None, texts[1], "en", "s"), (7, texts[2], "en", "s"), (7, texts[3], "en", "s"), (8, texts[4], "en", "s"), (8, texts[4], "en", "s"), (None, texts[4], "en", "s"), (None, None, "en", "s")])
    kept = P.near_duplicates(spark, rows, SF)
    want = [(None, None), (None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    cut = P.substrings(spark, kept, SF)
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted(want, key=str)
    mixed = P.mixing(spark, cut, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in mixed), key=str) == sorted(want[1:], key=str)


def test_every_stage_takes_odd_rows_and_an_empty_table(spark, docs, prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns; then no rows at all."""
    long = prose(20000, 9)
    odd = [(None, None, None, None), (None, "", "en", "s"), (1, prose(50, 1), None, "s"), (1, prose(50, 1), None, "s"), (1, prose(50, 2), "de", None), (2, long, "en", "t"), (3, "one", "en", "t"), (4, None, "en", "t")]
    rows = docs(odd, extra=True).withColumn("row_", P.F.lit(1)).withColumn("taken", P.F.lit(2))
    key = lambda r: (r.doc_id, r.text)
    kept = [key(r) for r in P.quality(spark, rows, SF).collect()]
    assert set(kept) <= {x[:2] for x in odd}
    near = P.near_duplicates(spark, rows, SF)
    assert near.columns == P.COLUMNS
    assert sorted(map(key, near.collect()), key=str) == sorted((x[:2] for k, x in enumerate(odd) if k != 3), key=str)
    cut = {key(r): r.n_chars for r in P.substrings(spark, rows, SF).collect()}
    assert set(cut) == {x[:2] for x in odd} and all(n == (len(t) if t is not None else n) for (_, t), n in cut.items())
    mixed = [key(r) for r in P.mixing(spark, rows, SF).collect()]
    assert set(mixed) <= {(i, t) for i, t, *_ in odd if t} | {(i, t) for i, t in mixed if any(x[0] == i and x[1] and x[1].startswith(t) for x in odd)}
    tokens = P.tokens(spark, rows, SF).collect()
    assert len(tokens) == len(odd) and all((r.n_tokens == 0) == (not r.ids) for r in tokens)
    none = docs([])
    assert all(stage(spark, none, SF).count() == 0 for _, stage in P.STAGES)
