"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import brute
from quirework.llm import chat, components, decontam, embdedup, langid, licenses, neardup, packing, pii, quality, shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, salt int, hash long, label int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module", autouse=True)
def key(spark):
    spark.conf.set("quirework.pii.key", "surrogates")
    yield
    spark.conf.unset("quirework.pii.key")


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(0, 40_000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, long), (7, long + " end"), (None, prose(1, 50)), (8, prose(1, 50)), (9, prose(2, 50)), (10, prose(2, 49) + " other"), (11, "é́ ΑΣ \x1c İ 漢字 🙂"), (12, "...")]
    return spark.createDataFrame([(i, t, "en", "s", None, 1.0, "w", 3, 4, 5) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in (6, 7, 8, 9, 10, 11)] + [(4, None, None), (6, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(odd, none, labels):
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # a pure interaction
    model = quality.fit(x, y, n_pairs=2)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.97 and (0, 1) in [tuple(sorted(p)) for p in model.pairs]


def test_near_duplicates(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == 14 and {r.n_shingles for r in by[1] + by[2] + by[3]} == {0} and by[2][0].component_id == 2
    assert {r.component_id for r in by[4] + by[5]} == {4} and by[7][0].component_id == 6 and by[10][0].component_id == 9
    assert by[None][0].component_id == 8 and by[8][0].kept
    assert neardup.near_duplicates(none).count() == 0
    assert sorted(neardup.near_duplicates(odd, broadcast_ids=0).collect(), key=str) == sorted(rows, key=str)


def test_near_duplicates_in_large_groups(spark):
    """Copies with few and with many edits, in blocks far smaller than the group, against all pairs."""
    rng = np.random.default_rng(5)
    base = prose(9, 150).split()
    texts = []
    for i in range(120):
        words = list(base)
        for k in rng.choice(150, rng.integers(0, 9), replace=False):
            words[k] = f"w{rng.integers(10**6)}"
        texts.append((i, " ".join(words)))
    want = brute.near_duplicates(texts)
    rows = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), block_rows=16).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert len({c for _, c in want.values()}) > 1


def test_large_groups_are_sent_in_proportion(spark):
    """Rows sent for the second comparison of one group of many blocks with a few open classes, and all pairs of an open class with another."""
    sent = {}
    for n in (400, 800, 1600):
        large = spark.range(n).select(F.lit(0).cast("long").alias("hub"), F.col("id").alias("rep"), F.col("id").alias("print_a"), F.lit(10).cast("long").alias("n_shingles"), F.lit(-(-n // 16)).alias("n_blocks"), (F.col("id") % (n // 5) == 0).alias("open"), F.lit(1).alias("n_open"))
        rows = neardup._across(large).collect()
        sent[n] = len(rows)
        sides = {}
        for r in rows:
            sides.setdefault(r.block, ({r.rep} if r.side == 0 else set(), {r.rep} if r.side else set()))[r.side].add(r.rep)
        met = {(a, b) for left, right in sides.values() for a in left for b in right}
        assert met == {(k * (n // 5), b) for k in range(5) for b in range(n)} and max(len(x) for pair in sides.values() for x in pair) <= 40
    assert sent[800] <= 2.2 * sent[400] and sent[1600] <= 2.2 * sent[800]


def test_superminhash_estimates_and_varies_less():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        x = rng.integers(0, 2**63, 90).astype(np.uint64)
        y = np.concatenate([x[:60], rng.integers(0, 2**63, 30).astype(np.uint64)])
        s = neardup.superminhash(np.concatenate([x, y]), np.array([0, 90, 180]), 64)
        errors.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < (0.25 / 64) ** 0.5
    assert np.isinf(neardup.superminhash(np.zeros(0, np.uint64), np.array([0, 0]), 8)).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(odd, none):
    rows = langid.identified(odd).collect()
    assert len(rows) == 14 and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 12)} == {"und"} and {r.lang_pred for r in rows if r.doc_id == 4} == {"en"}
    assert langid.identified(none).count() == 0 and {r.lang_pred for r in langid.identified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, rng.standard_normal(16))), int(i % 3)) for i in range(300)]
    near = [(1000 + i, [v + 0.02 * float(e) for v, e in zip(rows[i % 20][1], rng.standard_normal(16), strict=True)], rows[i % 20][2]) for i in range(400)]
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, rows[0][1], None), (2005, rows[0][1], 0), (2005, rows[0][1], 0), (2006, [], 1), (2007, rows[0][1][:8], 0), (2008, [float("inf")] + [1.0] * 15, 0), (2009, [1e-320] * 16, 2), (2010, [float(v) for v in rng.standard_normal(16)], 0), (2010, [float(v) for v in rng.standard_normal(16)], 0)]
    every = rows + near + odd
    vectors = spark.createDataFrame([(i, e, lab, "x", 1.0) for i, e, lab in every], "vec_id long, embedding array<double>, label int, unit string, proj double")
    got = embdedup.near_duplicates(vectors, leaf_size=24).collect()
    assert sorted(embdedup.near_duplicates(vectors, leaf_size=8, sample_rows=40).collect()) == sorted(got)  # a small sample: leaves are split further
    usable = [(i, np.array(e), lab) for i, e, lab in every if e and lab is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    links = [(k, m) for k, (_, x, a) in enumerate(usable) for m, (_, y, b) in enumerate(usable[:k]) if a == b and len(x) == len(y) and (x / np.abs(x).max()) @ (y / np.abs(y).max()) >= 0.93 * np.linalg.norm(x / np.abs(x).max()) * np.linalg.norm(y / np.abs(y).max())]
    number = np.zeros(len(usable), int)
    for k, m in links:
        number[k] += 1
        number[m] += 1
    top = brute.components({i for i, _, _ in every}, [(usable[k][0], usable[m][0]) for k, m in links])
    want = sorted([(u[0], int(n), top[u[0]]) for u, n in zip(usable, number, strict=True)] + [(i, 0, i) for i, _, _ in odd[:5] + odd[7:8] + odd[9:10]])  # a repeated id with other components is a vector of its own
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert embdedup.near_duplicates(vectors.limit(0)).count() == 0


def test_language_columns_that_clash(spark):
    rows = spark.createDataFrame([(1, "hello there", "en", "old", 9.0, "mine"), (2, None, "en", "old", 9.0, "mine")], "doc_id long, text string, lang string, lang_pred string, score double, _language string")
    out = langid.identify(rows, langid.train(rows))
    assert out.columns == ["doc_id", "text", "lang", "_language", "lang_pred", "score"] and [r._language for r in out.collect()] == ["mine", "mine"]
    assert {r.doc_id: r.lang_pred for r in out.collect()} == {1: "en", 2: "und"}


def test_licenses(odd, none, spark):
    for r in licenses.digest(odd).collect():
        assert r.n_base == 0 and r.labels == "" and r.score == 0 and r.first_word is None
    assert licenses.digest(none).count() == 0 and len(licenses.rules()) > 300
    texts = {
        "Released under the MIT License. under the MIT license": "mit", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3-or-later",
        "GNU General Public License, version 2 or (at your option) any later version": "gpl-2-or-later", "licensed under CC BY-NC-SA 4.0": "cc-by-nc-sa,cc-by-nc", "Apache License 2.0, BSD 3-Clause License": "apache-2,bsd-3",
    }
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: set(v.split(",")) for i, v in enumerate(texts.values())}
    assert not got[1] & {"gpl-3", "gpl"}  # contained detections are suppressed


def test_licenses_named_by_few_words(spark):
    texts = {
        "MPL-2.0": "mpl-2", "EPL-2.0": "epl-2", "EUPL 1.2": "eupl-1.2", "CDDL 1.1": "cddl-1.1", "SIL OFL 1.1": "ofl-1.1", "OSL 3.0": "osl-3", "AFL 3.0": "afl-3", "ECL 2.0": "ecl-2", "UPL 1.0": "upl-1", "SSPL v1": "sspl-1",
        "BUSL 1.1": "busl-1.1", "Mulan PSL v2": "mulan-2", "ODC-BY 1.0": "odc-by-1", "CreativeML Open-RAIL": "openrail", "CreativeML OpenRAIL-M": "openrail", "0BSD license": "bsd-0", "SPDX-License-Identifier: 0BSD": "bsd-0",
        "General Public License version 3": "gpl-3", "the expat license": "mit", "SPDX-License-Identifier: GFDL-1.3-only": "gfdl", "SPDX-License-Identifier: CPL-1.0": "cpl-1", "an upload of samples for Oslo": "",
    }
    got = [r.labels for r in licenses.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == list(texts.values())


def test_licenses_of_metadata_and_choices(spark):
    texts = {
        "License: MIT": "mit", 'license = "Apache-2.0"': "apache-2", '"license": "ISC",': "isc", "Licensed under Apache 2.0": "apache-2", "MIT/Apache-2.0": "mit-or-apache-2", "Apache-2.0/MIT": "mit-or-apache-2", "BSL 1.1": "busl-1.1", "public-domain": "public-domain",
        "License :: OSI Approved :: MIT License": "mit", "license='BSD-3-Clause'": "bsd-3", "licence: GPL-2.0-only": "gpl-2", "Licensed under the MIT": "mit", "LICENSE = Unlicense": "unlicense", "license: MIT OR GPL-2.0": "mit-or-gpl", "license_file: CC-BY-4.0": "cc-by-4", "BSD 2-Clause": "bsd-2",
        "the license fee": "", "her driver license": "", "licensed under duress": "", "Apache helicopters": "", "mit der Lizenz": "", "a public house, domain of one": "", "license to drive 2.0": "",
    }
    got = {r.doc_id: r.labels for r in licenses.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert dict(zip(texts, (got[i] for i in range(len(texts))), strict=True)) == texts


def test_licenses_against_plain_rules(spark):
    """A text for each rule, and texts of several: labels are those of all rules tried everywhere without any gate, suppressed by plain loops."""
    import re
    from re import _parser

    from llm.test_properties import spelled

    rules = [(label, order, sure, re.compile(pattern)) for label, order, sure, _, pattern in licenses.rules()]
    texts = [spelled(_parser.parse(pattern.removesuffix("(?= )")))[-1].strip() for *_, pattern in licenses.rules()]
    assert len(texts) > 380
    rng = np.random.default_rng(8)
    texts = [f"see, {t.upper() if k % 3 == 0 else t}." for k, t in enumerate(texts)] + [". ".join(rng.choice(texts, 3)) for _ in range(20)] + [" ".join(rng.choice(texts, 2)) for _ in range(20)]
    texts += [prose(7, 30_000) + " mit or apache-2.0 " + prose(8, 30_000) + " GNU GPL v3"]
    for row in licenses.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        line = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(texts[row.doc_id]))) + " "
        found = sorted((m.start(), -m.end(), -order, k, label, sure) for k, (label, order, sure, p) in enumerate(rules) for m in p.finditer(line))
        stand = []
        for d in found:
            if not stand or d[0] >= -stand[-1][1]:
                stand.append(d)
            elif d[1] < stand[-1][1] and d[2] < stand[-1][2]:
                stand[-1] = d
        _, _, _, _, base = brute.license_words(texts[row.doc_id], licenses.BASE)
        assert row.labels == ",".join(sorted({d[4] for d in stand} | set(filter(None, base.split(","))))), texts[row.doc_id]
        assert row.score == max([d[5] for d in stand] + [0.9] * bool(base), default=0) and (row.doc_id >= len(rules) or row.labels)


def test_decontamination(odd, none, spark):
    passage = prose(20, 30)
    swapped = passage.split()
    for k in (3, 11, 19, 27):
        swapped[k] = "swapped"
    items = spark.createDataFrame([(1, passage, "x"), (2, passage, "x"), (3, "too short to tell", "x"), (4, None, "x"), (5, "", "x")], "item_id long, text string, words string")
    docs = spark.createDataFrame([(1, prose(30, 100) + " " + passage + " " + prose(31, 100)), (2, prose(32, 200)), (3, prose(33, 50) + " " + " ".join(swapped)), (4, None), (5, "too short to tell"), (6, passage.upper() + "!"), (6, passage)], "doc_id long, text string")
    for most in (2_000_000, 0):
        got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items, broadcast_rows=most).collect()}
        assert got == {(1, 1), (3, 1), (6, 1)} == brute.overlaps([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert decontam.overlaps(odd, items.limit(0)).count() == 0 and decontam.overlaps(none, items).count() == 0
    assert {r.doc_id for r in decontam.decontaminate(docs, items).collect()} == {2, 4, 5}
    assert decontam.decontaminate(odd, items).count() == 14


def test_decontamination_misses_no_overlap(spark):
    """Every choice of substituted words that the rule allows, at even and odd places, in items of 8 to 14 words; rows without an id."""
    from itertools import combinations

    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in range(8, 15)]
    docs = []
    for n, item in items:
        size = min(n, 13)
        for gone in combinations(range(size), size - -(-size * 4 // 5)):
            for before in (2, 3):
                docs.append((len(docs), " ".join(["x"] * before + ["swapped" if k in gone else w for k, w in enumerate(item)] + ["y"] * 2), n))
    docs += [(None, "x " + " ".join(items[0][1]), 8), (-1, " ".join(items[-1][1][:11]), 14), (-2, " ".join(items[-1][1][4:] + ["z"]), None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, item long")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    for most in (2_000_000, 0):
        got = [(r.doc_id, r.item_id) for r in decontam.overlaps(rows, bench, broadcast_rows=most).collect()]
        assert sorted(got, key=str) == sorted([(i, n) for i, _, n in docs if n], key=str)
    for size in range(1, 60):
        assert all(decontam.covers(decontam.masks_for(size, k), size, k) for k in (size, size - 1) if k)


def test_shards(odd, none, tmp_path, spark):
    store = shards.Store(spark, str(tmp_path / "s"))
    for _ in range(3):
        store.append(odd)
    store.append(none)
    assert store.latest().number == 4 and store.read().count() == 42
    before = store.latest()
    after = store.compact(1 << 20, least=3)
    assert len(after.shards) < len(before.shards) and store.read().count() == 42 and store.read(before.shards).count() == 42
    assert store.vacuum() > 0 and store.read().count() == 42 and store.read().columns == odd.columns
    stale = shards.Version(after.number - 1, ())
    assert not store._commit(stale, ())  # another writer was first
    with pytest.raises(RuntimeError):
        store.commit([], {"shards/gone"})
    assert shards.sharded(none).count() == 0
    root = str(tmp_path / "t")
    rows = shards.sharded(odd.coalesce(1), arrivals=8, root=root).collect()  # one file, yet several arrivals
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    even = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 9).alias("text")).coalesce(1)
    merged = shards.sharded(even).collect()
    assert len(merged) == 4000 and {(r.level, r.shard_rows, r.version) for r in merged} == {(1, 4000, 9)}
    back = shards.Store(spark, root).read()
    assert back.columns == odd.columns and sorted(back.collect(), key=str) == sorted(odd.collect(), key=str)


def test_shards_of_many_writers(tmp_path, spark):
    """Commits at the same time all take place, one after another."""
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "w")
    add = lambda k: shards.Store(spark, root).commit([shards.Shard(f"shards/{k}", k, 1, 0)], most_tries=100)
    with ThreadPoolExecutor(4) as pool:
        numbers = sorted(v.number for v in pool.map(add, range(12)))
    assert numbers == list(range(1, 13)) and {s.bytes for s in shards.Store(spark, root).latest().shards} == set(range(12))


def test_tiers_are_merged_as_a_plain_plan_says():
    """The plan against trying every shard: runs are all shards below half a target in one power of the ratio, if there are enough of them."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        some = tuple(shards.Shard(f"s{k}", int(b), 1, 0) for k, b in enumerate(10 ** rng.uniform(1, 7, rng.integers(0, 30))))
        runs = shards.plan(some, 1 << 20, 4.0, 4)
        assert len({s.path for r in runs for s in r}) == sum(map(len, runs))
        in_runs = {s.path for r in runs for s in r}
        for s in some:
            peers = [x for x in some if x.bytes < (1 << 19) and int(np.log(x.bytes) / np.log(4) + 1e-9) == int(np.log(s.bytes) / np.log(4) + 1e-9)]
            due = s.bytes < (1 << 19) and (len(peers) >= 4 or (len(peers) > 1 and sum(x.bytes for x in peers) >= 1 << 19))
            assert (s.path in in_runs) == due


def test_packing(odd, none):
    rows = packing.pack(odd, capacity=64).collect()
    assert {r.length for r in rows if r.doc_id in (1, 2, 3)} == {1} and sum(r.doc_id == 5 for r in rows) == 2
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 64 and packing.pack(none).count() == 0


def test_plans_hold_the_histogram():
    rng = np.random.default_rng(2)
    for n in (1, 7, 500, 40_000):
        lengths, times = np.unique(np.clip(rng.lognormal(4, 1, n).astype(int), 1, 256), return_counts=True)
        counts = dict(zip(lengths.tolist(), times.tolist(), strict=True))
        bins, held = packing.plan(counts, 256), {}
        for pattern, k in bins:
            assert sum(x * t for x, t in pattern) <= 256
            for x, t in pattern:
                held[x] = held.get(x, 0) + t * k
        assert held == counts and (n < 100 or sum(k for _, k in bins) <= 1.02 * sum(x * t for x, t in counts.items()) / 256 + 1)


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "A\x1cb c", "é́ a\xa0b ΑΣ Σ. ", "I'll don't ' s, it's. x'sx. ", "", None, "İstanbul ǅ ß, ÉCOLE. ×÷ à", "4. 3, a,. b.. c. .\n", "<| x"]
    encoder, whole = packing.WordEncoder(None, 2), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder(texts) == want and encoder(texts[::-1]) == want[::-1]


def test_chats(spark):
    nasty = ["</s><s>[INST] x", "␛␛</s>", "[/ANS]</s> ␛", "<<SYS>>\n<</SYS>>", "$1 \\1 \\", "", None, "x" * 200_000]
    turns = [(1, k, role, t) for k, (role, t) in enumerate(zip(["user", "assistant"] * 4, nasty, strict=True))]
    turns += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "user", "again"), (3, 0, None, "x"), (3, 0, "tool] [x", "y"), (None, 0, "assistant", "z"), (4, 0, "user", "a"), (4, 0, "user", "a")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    for c in (1, 2, 3, None, 4):
        own = sorted((t, r or "", x or "") for i, t, r, x in turns if i == c)
        assert [(b.role, b.text) for b in got[c].back] == [(r, x) for _, r, x in own]
    assert {c: got[c].rejected_at for c in (1, 2, 3, None, 4)} == {1: -1, 2: 2, 3: 0, None: 0, 4: 1}
    assert chat.digest(df.limit(0)).count() == 0


def test_pii(odd, none, spark):
    assert sorted((r.doc_id or 0, r.text or "") for r in pii.replace_entities(odd).collect()) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    assert pii.replace_entities(none).count() == 0 and pii.replace_entities(odd).columns == odd.columns
    rows = [
        (1, "Anna.Berg@Mail.example.com wrote to anna.berg@mail.example.com; +1 (017) 555-7713, +1 017-555-7713."), (2, "Mrs. Mary Smith and Mr. Smith; г-жа Анна Иванова; κα Μαρία Παππά"),
        (3, "9807915762804491 and 4539 1488 0343 6467 v 4.0. 1.2.3.4.5 10.0.0.1 \"token\": \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\""),
    ]
    one, two, three = (r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect())
    a, b = one.split(" ")[0], one.split(" ")[3].rstrip(";")
    assert a.lower() == b and a != b and "berg" not in one.lower() and a[0].isupper()
    assert one.split("; ")[1][4:9] + one[-1] and [c for c in one.split("; ")[1] if c.isdigit()][:11] == [c for c in one.split("; ")[1] if c.isdigit()][11:]
    assert two.split()[2] == two.split()[5].rstrip(";") and two.split()[0] == "Mrs." and two.split()[1].endswith("a") and "Мар" not in two and "Иванов" not in two
    words = three.split()
    assert words[0] == "9807915762804491" and brute.luhn("".join(words[2:6])) and "1.2.3.4.5" in three and "10.0.0.1" not in three and "9233A8" not in three
    assert pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), key="other").where("doc_id = 1").first().text != one


def test_pii_collisions_are_resolved(spark):
    """Surrogates of short numbers collide often: all stay distinct and none is a real number."""
    real = [f"{i:03d}-{i % 89 + 10:02d}-{i * 7 % 9000 + 1000:04d}" for i in range(900)]
    df = spark.createDataFrame([(i, f"no {x} here and {real[0]}") for i, x in enumerate(real)], "doc_id long, text string")
    forced = pii.surrogate
    try:
        pii.surrogate = lambda kind, canon, attempt, key: F.lpad(F.pmod(F.xxhash64(canon, attempt), F.lit(3000)).cast("string"), 9, "1")
        out = [r.text for r in pii.replace_entities(df).orderBy("doc_id").collect()]
    finally:
        pii.surrogate = forced
    new = [t.split()[1] for t in out]
    assert len(set(new)) == 900 and len({t.split()[-1] for t in out}) == 1 and not set(new) & set(real) and new[0] == out[5].split()[-1]


def test_pii_types_come_from_the_rule_that_matched(spark):
    numbers = ["+33 1 23 45 67 89", "020 7946 0958", "01 23 45 67 89", "030 1234567", "+49 30 123456", "+1 22 33"]
    texts = ["api_key=4827164920174625", "token: 1234-5678-1234-5678", *[f"call {x}, or" for x in numbers], "on 01-02-2024 or 01.02.2024 10:30 at 0.123 and +1 2 3", "card 4827164920174625"]
    out = pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), count_into="n").orderBy("doc_id").collect()
    shape = lambda t: "".join("9" if c.isdigit() else c for c in t)
    assert [r.n for r in out] == [1] * (2 + len(numbers)) + [0, 0]
    assert all((r.text != t) == (r.n > 0) and shape(r.text) == shape(t) for r, t in zip(out, texts, strict=True))
    assert out[3].text.startswith("call 0") and out[4].text.startswith("call 0")


def test_pii_settles_dense_and_shapeless_values(spark):
    """Rules without a letter are no secrets; one-letter mailboxes, nearly shapeless secrets and numbers without luck all settle."""
    rules = ["Password: ____________________", "secret = --------------------"]
    real = [f"{c}@dense.example.com" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"_______________{d}" for d in range(10)]
    texts = rules + [x if "@" in x else f"token = {x}" for x in real]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [r.text for r in pii.replace_entities(df).orderBy("doc_id").collect()]
    new = [t.removeprefix("token = ") for t in out[2:]]
    assert out[:2] == rules and len(set(new)) == len(real) and not set(new) & set(real)

    for kind, real in (("ssn", [f"{i:03d}-10-{1000 + i}" for i in range(30)]), ("card", ["4539148803436467", "4111111111111111", "5500000000000004"]), ("ip", ["10.0.0.1", "10.0.0.2", "1.1.1.1"]), ("phone", ["+1 555-123-4567", "+1 555-123-4568"])):
        df = spark.createDataFrame(list(enumerate(real)), "doc_id long, text string")
        forced = pii.surrogate
        try:
            pii.surrogate = lambda k, canon, attempt, key: F.lit("1" * 9)  # noqa: B023  no attempt helps: all but one are ranked
            got = pii.moved(pii.detected(df), "k", most_rounds=1).collect()
        finally:
            pii.surrogate = forced
        canon = {"".join(c for c in x if c.isdigit()) if kind != "ip" else x for x in real}
        assert {r.kind for r in got} == {kind} and len({r.stand_in for r in got}) == len(got) >= len(real) - 1 and not {r.stand_in for r in got} & canon
        ranked = [r for r in got if r.stand_in != "1" * 9]
        assert all(kind == "ip" or len(r.stand_in) == len(r.canon) for r in ranked) and (kind != "card" or all(brute.luhn(r.stand_in) for r in ranked))


def test_pipeline_stages_on_odd_rows(odd, none, spark, tmp_path):
    """Columns pass through every stage but the last whatever they are called; empty tables pass."""
    import corpus_pipeline

    sf_dir = str(tmp_path)
    spark.createDataFrame([(6, 1, 0), (8, 1, 0), (9, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 50)), (2, None)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    clash = odd.withColumns({"_score": F.lit("mine"), "_found": F.lit("mine"), "_text": F.lit("mine"), "component_id": F.lit("mine"), "hash": F.lit("mine")})
    for rows, counts in ((clash, (14, 10, 9, 9)), (none, (0, 0, 0, 0))):
        for (name, stage), n in zip(corpus_pipeline.STAGES[:-1], counts, strict=True):
            columns = rows.columns
            rows = corpus_pipeline.written(stage(spark, rows, sf_dir), name)
            assert rows.columns == columns and rows.count() == n, name
            assert "_score" not in columns or rows.where("_score <> 'mine' OR _found <> 'mine' OR _text <> 'mine' OR hash <> 'mine'").isEmpty()
        ids = {r.doc_id for r in rows.collect()}
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()} == ids


def test_pii_key_is_required(spark, odd):
    spark.conf.unset("quirework.pii.key")
    try:
        with pytest.raises(ValueError):
            pii.replace_entities(odd)
    finally:
        spark.conf.set("quirework.pii.key", "surrogates")


def test_pii_against_plain_checks(spark):
    """Every type in many contexts, repeated across documents and in a very long text: found, replaced by another of its type, script
    and form, one to one over the corpus; what is no entity stays."""
    import re
    from hashlib import sha256

    rng = np.random.default_rng(11)
    def account(country, body):
        number = "".join(str(int(c, 36)) for c in body + country + "00")
        return f"{country}{98 - int(number) % 97:02d}{body}"
    def card():
        body = "4" + "".join(map(str, rng.integers(0, 10, 14)))
        return next(body + str(d) for d in range(10) if brute.luhn(body + str(d)))
    ok_iban = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    values = {
        "email": [f"Ann{i}.o{digit(2)}@Host{i % 4}.example.org" for i in range(12)], "ip": [f"10.{i}.{i + 7}.9" for i in range(12)],
        "ip6": [f"fe80::{i + 1:x}:2a" for i in range(6)] + [f"2001:0DB8:85a3:0:0:8a2e:370:{7000 + i}" for i in range(6)],
        "card": [card() for _ in range(12)], "ssn": [f"{100 + i}-45-{digit(4)}" for i in range(12)], "iban": [account("DE", digit(18)) for _ in range(12)],
        "phone": [f"+1 ({200 + i}) 555-{digit(4)}" for i in range(6)] + [f"+49 30 {digit(6)}" for _ in range(6)], "key": ["AKIA" + sha256(bytes([i])).hexdigest()[:16].upper() for i in range(12)],
        "secret": [sha256(bytes([i])).hexdigest() for i in range(11)] + ["hunter2hunter2"],
        "male": [f"Mr. Karl{chr(97 + i)} Weber{chr(97 + i)}" for i in range(6)] + [f"г-н Иван{'абвгде'[i]} Петров{'абвгде'[i]}" for i in range(6)],
    }
    lead = {"secret": "password: "}
    docs = [(i, kind, v, f"x {lead.get(kind, '')}{v} y, again {lead.get(kind, '')}{v} z") for i, (kind, v) in enumerate((k, v) for k, vs in values.items() for v in vs)]
    docs += [(10_000 + i, kind, v, f"elsewhere {lead.get(kind, '')}{v}!" if kind != "male" else f"elsewhere {v}, too") for i, kind, v, _ in docs[::3]]
    long = prose(4, 60_000) + " " + " ".join(f"{lead.get(kind, '')}{vs[0]} and" for kind, vs in values.items())
    plain = ["version 1.2.3.4.5 at 10:20:30 on 2024-01-02", "ns::f2 std::x 4111111111111112", "DE00123456789012345678", "password: required", "tel 5551234 or room 555-1234", "Mr. and Mrs.", "a@b", "AKIAXX"]
    rows = [(i, t) for i, _, _, t in docs] + [(-1, long)] + [(-2 - i, t) for i, t in enumerate(plain)]
    got = {r.doc_id: (r.text, r.n) for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), count_into="n").collect()}
    assert [got[-2 - i] for i in range(len(plain))] == [(t, 0) for t in plain]
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", t)))
    to = {}
    for i, kind, v, text in docs:
        new, n = got[i]
        assert v not in new and n == (2 if i < 10_000 else 1), text
        around = re.fullmatch(re.escape(text).replace(re.escape(v), "(.+)", 1).replace(re.escape(v), r"\1"), new)
        assert around, (text, new)
        assert to.setdefault(v, around[1]) == around[1]  # the same everywhere
    assert len(set(to.values())) == len(to) and not set(to.values()) & set(to)
    for kind, vs in values.items():
        for v in vs:
            new = to[v]
            if kind in ("ip", "male", "ip6"):
                same = {"ip": lambda: re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", new), "ip6": lambda: re.fullmatch(r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}", new), "male": lambda: new.split()[0] == v.split()[0] and len(new.split()) == 3 and ("а" <= new.split()[1][0].lower() <= "я") == ("а" <= v.split()[1][0].lower() <= "я")}[kind]()
                assert same, (v, new)
            elif kind == "secret" and re.fullmatch("[0-9a-f]+", v):
                assert re.fullmatch("[0-9a-f]+", new) and len(new) == len(v)
            else:
                assert shape(new) == shape(v), (v, new)
            assert kind != "card" or brute.luhn(new)
            assert kind != "iban" or ok_iban(new)
    assert all(vs[0] not in got[-1][0] and to[vs[0]] in got[-1][0] for vs in values.values()) and got[-1][1] == len(values)


def test_words_of_groups_that_are_not_letters_throughout():
    """Groups of words are looked at as one for letters; whatever stands among them, ids are those of whole texts. One word and none are texts too."""
    from quirework.llm.packing import WordEncoder

    encode = WordEncoder(None, 1000)
    texts = [" ".join(f"wort{'abcdefgh'[i % 8] * (i % 5)}{'é' if i % 7 == 0 else ''}{i if i % 50 == 49 else ''}" for i in range(400)), "alone", "", None, "a-b it's 3.5 x!"]
    assert encode(texts) == [np.array(encode.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
