"""Operators against plain versions of what they compute, and column names that clash with their own."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitelode.llm import jaccard_join, language_id, line_dedup, packing, pii, quality_rules, sentencepiece_codec
from sitelode.llm.common import words
from sitelode.llm.queries import tokenizer_path

RNG = random.Random(21)
ODD = ["", " ", "a", "Straße ÉTÉ x² y³", "日本語 テスト mixed", "𝔘𝔫𝔦 code 𝔘", "don't stop_now 3rd", "İstanbul ıı", "a" * 50, "one\ntwo  three\t\tfour", "ends.\nNext, word&& *odd* ", " lead", "x\n y", "tail \n", "<|endoftext|> a", "word,word. word!\nÜber"]


def prose(n):
    return " ".join("".join(RNG.choice("abcdeéß") for _ in range(RNG.randint(1, 6))) for _ in range(n))


TEXTS = [*ODD, *(prose(n) for n in (3, 40, 400))]


@pytest.mark.parametrize("piece", [language_id.SLICE, 7])
def test_language_counts_are_plain_counts(piece, monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", piece)
    for t in TEXTS:
        t = t.lower()
        plain = Counter()
        for word in "".join(c if c.isalpha() else " " for c in t).split():
            padded = f" {word} "
            plain.update(padded[i : i + n] for n in range(1, 5) for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
        assert language_id.plainly(t) == plain
        if (found := language_id.counted(t)) is not None:
            assert dict(zip(map(language_id.gram_of, found[0].tolist()), found[1].tolist(), strict=True)) == plain
        else:
            assert any(ord(c) > 0xFFFF for c in t)


def test_language_distance_is_the_plain_one():
    """Out-of-place distance with ties by n-gram and languages by name."""
    depth, learned = 30, {"b": prose(300), "a": prose(300), "c": "zz top zz"}
    ranked = lambda t: [g for g, _ in sorted(language_id.plainly(t.lower()).items(), key=lambda x: (-x[1], x[0]))][:depth]
    model = language_id.Profiles([(lang, g, i) for lang, t in learned.items() for i, g in enumerate(ranked(t))], 4, depth)
    for t in TEXTS:
        own = ranked(t)
        if not own:
            assert model.predict(t) == ("und", 0.0)
            continue
        far = {lang: sum(abs(ranked(x).index(g) - i) if g in ranked(x) else depth for i, g in enumerate(own)) for lang, x in learned.items()}
        best = min(sorted(far), key=far.get)
        assert model.predict(t) == (best, pytest.approx(1 - far[best] / (depth * len(own))))
    assert model.predict(None) == ("und", 0.0)


def test_languages_of_several_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, lang string")
    learned = language_id.profiles(spark.createDataFrame([("zz top zz", "c"), (prose(300), "a"), ("éé ßß éß", "b")], "text string, lang string"))
    want = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, learned).collect()}
    kept = {r.doc_id for r in language_id.accepted(docs, learned, 0.01).collect()}
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, learned).collect()} == want
    assert {r.doc_id for r in language_id.accepted(docs, learned, 0.01).collect()} == kept


def test_packing_encodes_like_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.ByteTokens(open(path, "rb").read())
    rng = random.Random(3)
    texts = [*TEXTS, *("".join(rng.choice("ab ,.\n\té'9<|") for _ in range(rng.randint(1, 60))) for _ in range(500))]
    for batch in (texts, texts[::-1]):  # the second time from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(batch)] == [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]


def test_sentencepiece_counts_differences_and_takes_the_library():
    path = tokenizer_path("piece_bpe_32k.model")
    own = sentencepiece_codec.AgendaEncoder(open(path, "rb").read())
    texts = [t for t in TEXTS]
    assert [np.frombuffer(b, "<i4").tolist() for b in own.encode(texts)] == own.library.encode(texts) and own.differed == 0
    broken = sentencepiece_codec.AgendaEncoder(open(path, "rb").read())
    broken.merge = lambda symbols: [0]
    assert [np.frombuffer(b, "<i4").tolist() for b in broken.encode(["some words"])] == broken.library.encode(["some words"]) and broken.differed == 2


def test_quality_base_columns_are_plain_counts():
    blank = "[\x20\x09-\x0d]"
    for t in [*TEXTS, None, "a # b $$\na # b $$\n\n \na # b $$ |", "x y z x y z q"]:
        s = t or ""
        split = re.findall("[^\x20\x09-\x0d]+", s)
        lines = [x for x in s.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        windows = [tuple(split[i : i + 3]) for i in range(len(split) - 2)]
        reached = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)} if len(windows) < 200 else None
        got = quality_rules.base_counts(t, words(t))
        assert got[:4] == (len(split), sum(map(len, split)), sum(c in "#*$%&|<>" for c in s), dup) and len(re.sub(blank, "", s)) == got[1]
        assert reached is None or got[4] == len(reached)


CLASH = "doc_id long, text string, _row long, row long, hit string, keys string, _hit string, _keys string, _text string, _spans string, _all string, _terms string, doc string, gone long, twice long"


def test_columns_with_the_names_of_internal_ones_stay_as_they_are(spark):
    text = "mail me at a.b@example.org now"
    rows = [(i, t, 99, 98, "h", "k", "h2", "k2", "t", "s", "a", "m", "d", 5, 6) for i, t in enumerate([text, None, "", "line\nline"])]
    docs = spark.createDataFrame(rows, CLASH)
    for out in (pii.sanitise(docs), line_dedup.dedup_corpus(docs, min_docs=1, shape="rows", broadcast_bytes=0), line_dedup.dedup_corpus(docs, min_docs=1, shape="rows"), jaccard_join.one_of_each(docs)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert tuple(r)[2:] == rows[r.doc_id][2:]
    assert "[EMAIL]" in {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[0]


def test_jaccard_join_with_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    near = a + " end"
    for rows in ([(1, a), (1, b), (2, near)], [(1, b), (1, a), (2, near)]):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert sorted(got) == [(1, 56, 1), (1, 56, 1), (2, 57, 1)]
    rows = [(3, a), (3, a), (3, a), (4, None), (None, near), (5, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in jaccard_join.join(docs).collect()) == [("3", 3), ("3", 3), ("3", 3), ("4", 4), ("5", 5), ("None", 3)]
    assert sorted(str(r.doc_id) for r in jaccard_join.one_of_each(docs).collect()) == ["3", "4", "5", "None"]


def test_line_keys_are_plain():
    assert [line_dedup.line_key(x) for x in (" A\tb\x0c", "É", "\x0b", "Straße ")] == ["a\tb", "É", "", "straße"]
    assert hashlib.sha256(line_dedup.digest("x")).hexdigest() != hashlib.sha256(line_dedup.digest("y")).hexdigest()
