"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import collections
import random

import pytest

import corpus_pipeline
from tests.llm.samples import documents, prose, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(160):
        text = "\n".join(prose(rng, rng.randint(10, 40)).replace("\n", " ") for _ in range(3))
        if i % 8 == 1:
            text = "".join(w + "!! " for w in text.upper().split())
        elif i % 8 == 2:
            text += " wretched scoundrel vile"
        elif i % 4 == 3:
            text += "\nPrinted with kind permission of the owner"
        rows.append((i, text, f"src{i % 3}"))
        labels.append((i, int(i % 8 != 1), int(i % 8 == 2)))
    rows += [(300 + i, rows[4][1], "src0") for i in range(30)]
    rows += [(400 + i, rows[8][1] + f" tail{i}", None) for i in range(5)]
    rows += [(500, None, "src0"), (501, "", None), (None, prose(rng, 30), "src1"), (4, rows[4][1], "src0")]
    folder = str(tmp_path_factory.mktemp("tables"))
    documents(spark, rows, clashing=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.stored(stage(spark, out[-1], tables), name))
    return out


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_stage_drops_bad_documents_only(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    bad = {i for i in range(160) if i % 8 in (1, 2)}
    assert not kept & bad
    assert {r.doc_id for r in stages[0].collect()} - bad == kept


def test_line_stage_drops_the_shared_line(stages):
    before = collections.Counter(r.doc_id for r in stages[1].collect())
    after = stages[2].collect()
    assert collections.Counter(r.doc_id for r in after) == before
    assert not any("permission" in (r.text or "") for r in after)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in after)


def test_near_duplicate_stage_keeps_one_of_each_group(stages):
    def shingles(t):
        w = words(t, lower=True)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = {r.doc_id: shingles(r.text) for r in stages[2].collect() if r.doc_id is not None}
    comp = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for x in rows:
            for y in rows:
                if rows[x] and comp[x] != comp[y] and 100 * len(rows[x] & rows[y]) >= 80 * len(rows[x] | rows[y]):
                    comp[x] = comp[y] = min(comp[x], comp[y])
                    changed = True
    kept = collections.Counter(r.doc_id for r in stages[3].collect())
    assert kept == collections.Counter([i for i in rows if comp[i] == i] + [None])


def test_mix_stage_takes_each_document_at_most_twice(stages):
    before = collections.Counter(r.doc_id for r in stages[3].collect())
    after = collections.Counter(r.doc_id for r in stages[4].collect())
    assert all(n <= 2 * before[i] for i, n in after.items())
    size = {r.doc_id: len(words(r.text)) for r in stages[3].collect()}
    assert sum(size[i] * n for i, n in after.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)


def test_last_stage_packs_every_taken_document(stages):
    taken = collections.Counter(r.doc_id for r in stages[4].collect())
    assert collections.Counter(r.doc_id for r in stages[5].collect() if r.piece == 0) == taken


def test_run_gives_the_stages_result(spark, tables, stages):
    def pieces(df):
        return collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())

    assert pieces(corpus_pipeline.run(spark, tables)) == pieces(stages[-1])


def test_unlike_texts_that_share_an_id_stay(spark):
    rng = random.Random(21)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(1, one, "a"), (1, two, "a"), (1, two, "a"), (2, two + " tail", "b"), (3, one, "b"), (4, three, "c"), (None, one, "c"), (5, None, "c")]
    docs = documents(spark, rows, clashing=True)
    got = corpus_pipeline.near_duplicate_filter(spark, docs, "")
    assert got.dtypes == docs.dtypes
    want = collections.Counter([(1, one), (1, two), (4, three), (None, one), (5, None)])
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want
