"""Properties on arbitrary texts, without Spark."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm import brute
from quirework.llm import licenses, neardup, packing, quality
from quirework.llm.common import LOWER, text_bytes, word_hashes, word_spans

ALPHABET = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \t\n.,'’!?<|>endoftx019aAéÉΣİß́—")))
TEXTS = st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=60)), max_size=8)


@pytest.fixture(scope="module")
def encoders():
    return packing.WordEncoder(None, 50), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(texts=TEXTS)
def test_words_encode_as_texts(encoders, texts):
    own, whole = encoders
    want = [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert own(texts) == want


@settings(max_examples=200, deadline=None)
@given(texts=TEXTS)
def test_shingles_are_those_of_the_text(texts):
    sets, offsets = neardup.shingle_sets(pa.array(texts, pa.string()), 5)
    want = [brute.shingles(t) for t in texts]
    assert np.diff(offsets).tolist() == [len(s) for s in want]
    got = [set(sets[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    for x, gx in zip(want, got, strict=True):
        for y, gy in zip(want, got, strict=True):
            assert len(x & y) == len(gx & gy)


@settings(max_examples=200, deadline=None)
@given(texts=TEXTS, most=st.integers(1, 40))
def test_word_hashes_do_not_depend_on_place(texts, most):
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    s, e, at = word_spans(LOWER[raw], offsets)
    h = word_hashes(LOWER[raw], s, e)
    assert (h == word_hashes(LOWER[raw], s, e, most)).all() and at[-1:].tolist() == [len(s)]
    words = [bytes(LOWER[raw][a:b]) for a, b in zip(s, e, strict=True)]
    assert len(set(words)) == len(set(h.tolist()))


@settings(max_examples=100, deadline=None)
@given(texts=TEXTS)
def test_features_are_finite(texts):
    x = quality.features(pa.array(texts, pa.string()))
    assert x.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(x).all()


@settings(max_examples=60, deadline=None)
@given(lengths=st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plans_place_every_piece(lengths):
    held, used = {}, 0
    for pattern, k in packing.plan(dict(lengths), 64):
        assert k > 0 and sum(x * t for x, t in pattern) <= 64
        used += k
        for x, t in pattern:
            held[x] = held.get(x, 0) + t * k
    assert held == lengths
    slots = packing.slots(packing.plan(dict(lengths), 64))
    assert len(slots) == 0 or (slots[:, 4] < 64).all()


def spelled(tree):
    """All strings of a parsed pattern; of a class its first member, of a repeat its fewest and, up to one more, its most."""
    out = [""]
    for kind, arg in tree:
        name = str(kind)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
        elif name == "NOT_LITERAL":
            more = ["x"]
        elif name == "BRANCH":
            more = [s for part in arg[1] for s in spelled(part)]
        elif name == "SUBPATTERN":
            more = spelled(arg[3])
        elif name == "MAX_REPEAT":
            more = [s * n for s in spelled(arg[2]) for n in {arg[0], min(arg[1], arg[0] + 1)}]
        else:
            raise NotImplementedError(name)
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def at_gate(stem, text):
    """Both halves of the gate: plain words or short names, then the expression."""
    import re

    return (any(w in text.lower() for w in licenses.WORDS) or re.search(licenses.SHORT, text)) and stem.search(text)


def test_no_license_rule_is_lost_at_a_gate():
    """Every spelling of every name and identifier, written with blanks and with hyphens and capitals."""
    import re
    from re import _parser

    stem, n = re.compile(licenses.STEM), 0
    for line in licenses.NAMES.strip().splitlines():
        label, keyword, name, spdx = licenses._fields(line)
        keyword = re.compile(f" (?:{keyword})")
        for text, spdx_line in [(s, False) for s in spelled(_parser.parse(name))] + [(s, True) for s in spelled(_parser.parse(spdx))]:
            n += 1
            assert keyword.search(f" {text} "), (label, text)
            for raw in (text, text.upper().replace(" ", "-"), f"é {text}."):
                assert at_gate(stem, "SPDX-License-Identifier: " + raw if spdx_line else raw), (label, raw)
    assert n > 1000


def test_no_notice_is_lost_at_a_gate():
    """Every spelling of every notice, with other gaps and capitals, passes its keyword and the first gate."""
    import re
    from re import _parser

    stem, n = re.compile(licenses.STEM), 0
    for label, keyword, pattern in licenses._notices():
        for text in spelled(_parser.parse(pattern)):
            n += 1
            assert re.search(f" (?:{keyword})", f" {text} "), (label, text)
            assert at_gate(stem, text.upper().replace(" ", "  - ")) and at_gate(stem, f"({text})"), (label, text)
    assert n > 100
