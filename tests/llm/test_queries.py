"""The registered queries on the smallest tables, against SQL or a plain version."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from llm import brute
from oracle import connected, same_rows
from quirework.llm import licenses, quality, queries
from quirework.llm.common import table


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


@pytest.mark.parametrize("name", queries.SQL)
def test_sql(spark, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), connected(sf_dir), queries.SQL[name])


def test_quality_held_out(spark, sf_dir="/root/testdata/sf0.01"):
    truth = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    rows = queries.op1_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "documents").count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_language_held_out(spark, sf_dir="/root/testdata/sf0.01"):
    truth = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").select("doc_id", "lang").collect()}
    rows = queries.op3_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_against_plain_bayes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").collect()
    train = [(r.lang, r.text) for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    plain = dict(zip([r.doc_id for r in rows], brute.naive_bayes(train, [r.text for r in rows]), strict=True))
    for r in queries.op3_language_id(spark, sf_dir).collect():
        lang, score = plain[r.doc_id]
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3)


def test_features_against_plain_definitions(docs):
    import pyarrow as pa

    texts = [*docs.values(), None, "", " \n", "a\nA\n\na b a b a b", "é́ ΑΣ \x1c İ 漢字 🙂", "(x) $5 A-1\x7f"]
    for row, text in zip(quality.features(pa.array(texts)), texts, strict=True):
        assert row.tolist() == pytest.approx(brute.surface(text), abs=1e-9), text


def test_quality_against_plain_boosting(spark, sf_dir, docs):
    """Main effects alone: what pairs add is told by test_edges.test_quality_tables_add_up."""
    truth = {r.doc_id: float(r.quality) for r in table(spark, sf_dir, "labels").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = sorted(set(truth) & set(docs))
    x = [brute.surface(docs[i]) for i in ids]
    model = quality.fit(np.array(x), np.array([truth[i] for i in ids]), rounds=20, pair_rounds=0)
    plain = brute.boosted(x, [truth[i] for i in ids], rounds=20)
    every = [brute.surface(t) for t in docs.values()]
    assert model.score(np.array(every)).tolist() == pytest.approx([plain(row) for row in every], abs=1e-6)


def test_licenses(spark, sf_dir, docs):
    for r in queries.op5_license_scan(spark, sf_dir).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_words(docs[r.doc_id], licenses.BASE)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_decontamination(spark, sf_dir, docs):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    some = [(i, t) for i, t in docs.items() if len(t or "") < 3000]
    ids = {i for i, _ in some}
    found = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, sf_dir).collect()}
    assert {x for x in found if x[0] in ids} == brute.overlaps(some, items)


def test_sharding_keeps_all_rows(spark, sf_dir, docs):
    rows = queries.op7_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and all(r.level >= 1 and r.version > 8 for r in rows) and len({r.shard for r in rows}) < 8
    for shard in {r.shard for r in rows}:
        assert {r.shard_rows for r in rows if r.shard == shard} == {sum(r.shard == shard for r in rows)}


def test_packing(spark, sf_dir, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs.items()}
    rows = queries.op8_best_fit_packing(spark, sf_dir).collect()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.start == 2048 * r.piece and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= 1.02 * sum(bins.values()) / 2048 + 1


def test_chats(spark, sf_dir):
    turns = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    turns += [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    by = {}
    for c, t, role, text in sorted(turns):
        by.setdefault(c, []).append((role, text or ""))
    rows = queries.op9_chat_format(spark, sf_dir).collect()
    assert {r.conv_id for r in rows} == set(by)
    for r in rows:
        own, loss = by[r.conv_id], "".join(t for role, t in by[r.conv_id] if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest() and r.n_turns == len(own)
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r.formatted_chars > 0


def test_pii(spark, sf_dir, docs):
    import re

    entity = re.compile(r"[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])|(?<!\d)\d{16}(?!\d)|(?<=token = \")\w{40}")
    for r in queries.op10_pii_surrogates(spark, sf_dir).collect():
        old = docs[r.doc_id] or ""
        found = {m for m in entity.findall(old) if not (m.isdigit() and not brute.luhn(m))}
        assert all(m not in r.text for m in found)
        if not found and not r.n_entities:
            assert r.text == old


def test_pipeline(spark, sf_dir, docs):
    """Each stage against the plain version on its own input."""
    stages = dict(corpus_pipeline.STAGES)
    rows = table(spark, sf_dir, "documents")
    assert list(stages) == ["quality", "near_dedup", "decontam", "pii", "packing"]
    kept = stages["quality"](spark, rows, sf_dir)
    assert kept.columns == rows.columns and 0 < kept.count() < rows.count()
    kept = corpus_pipeline.written(kept, "quality")
    before = [(r.doc_id, r.text) for r in kept.collect()]
    kept = corpus_pipeline.written(stages["near_dedup"](spark, kept, sf_dir), "near")
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute.near_duplicates(before).values()}
    clean = corpus_pipeline.written(stages["decontam"](spark, kept, sf_dir), "decontam")
    assert clean.columns == rows.columns and clean.count() <= kept.count()
    private = stages["pii"](spark, clean, sf_dir)
    assert private.columns == rows.columns and private.count() == clean.count()
    packed = stages["packing"](spark, corpus_pipeline.written(private, "pii"), sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()
