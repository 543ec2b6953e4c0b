"""The ten operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sitelode.llm import fingerprints, jaccard_join, language_id, line_dedup, packing, pii, quality_rules, sentencepiece_codec, token_counts, toxicity
from sitelode.llm.components import components
from sitelode.llm.queries import tokenizer_path

DDL = "doc_id long, text string, lang string, key string, row long, ids string, class string, score string"
PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


def docs_of(spark, texts, lang=None):
    """A table with columns whose names clash with those that operators make."""
    rows = [(i, t, lang[i] if lang else "en", "k", 7, "x", "c", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DDL)


def prose(rng, n, vocabulary=("stone", "river", "walks", "under", "bright", "moon", "with", "seven", "lanterns", "and", "a", "quiet", "song", "of", "iron")):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


RNG = random.Random(5)
ODD = [None, "", " ", "\n", "a", "one two", "x" * 5000, "é ö\x85 k\xa0 z ​", "日本語 テスト\x00\t▁▁ <s> <0x0A> <|endoftext|> end", "line\n\nline\nline \n LINE", "1 2  3", "0 " * 400, prose(RNG, 30), prose(RNG, 30)]
TEXTS = [*ODD, *ODD[-2:], prose(RNG, 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def test_sentencepiece_matches_the_library(spark, docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in sentencepiece_codec.encode(docs, PIECES).collect()}
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        assert got[i].ids == ids and got[i].decoded == sp.decode(ids)
    digest = {r.doc_id: r for r in sentencepiece_codec.digests(docs, PIECES).collect()}
    assert all(digest[i].ids_sha256 == hashlib.sha256(",".join(map(str, got[i].ids)).encode()).hexdigest() and digest[i].n_tokens == len(got[i].ids) for i in got)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, PIECES), PIECES).collect()}
    assert back == {i: r.decoded for i, r in got.items()}
    assert sentencepiece_codec.digests(empty, PIECES).count() == 0


def test_packing_places_every_id_once_without_gaps(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    rows = packing.pack(docs, BYTES, capacity=256).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    placed, sequences = {i: [] for i in ids}, {}
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32 and len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        placed[r.doc_id] += range(r.start, r.start + r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(v) == list(range(len(ids[i]))) for i, v in placed.items())
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        total = sum(n for _, n in parts)
        assert total <= 256 and total & (total - 1) == 0
    assert packing.pack(empty, BYTES).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.HarmonicBins(100, 0)


def plain_dedup(texts, least):
    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))

    n = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    return ["\n".join(x for x in (t or "").split("\n") if not key(x) or n[key(x)] < least) for t in texts]


@pytest.mark.parametrize("limit", [256_000_000, 0])
def test_line_dedup_against_a_plain_count(spark, empty, limit):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice([" Common LINE ", "common line", "rare " + str(rng.random()), "", "other\t", "É line"]) for _ in range(rng.randint(1, 6))) for _ in range(60)] + [None, "", "common line"]
    d = docs_of(spark, texts)
    got = {r.doc_id: r for r in line_dedup.dedup_corpus(d, 10, broadcast_bytes=limit).collect()}
    want = plain_dedup(texts, 10)
    assert [got[i].text for i in range(len(texts))] == want
    assert all(got[i].n_lines - got[i].n_dropped == (len(w.split("\n")) if got[i].n_dropped < got[i].n_lines else 0) for i, w in enumerate(want))
    rows = line_dedup.dedup_corpus(d, 10, broadcast_bytes=limit, shape="rows")
    assert rows.columns == d.columns and {r.doc_id: r.text or "" for r in rows.collect()} == dict(enumerate(want))
    assert line_dedup.dedup_corpus(empty).count() == 0


def test_line_dedup_is_reversible(spark):
    a, b = docs_of(spark, ["same\nx" + str(i) for i in range(6)]), docs_of(spark, ["same\ny" + str(i) for i in range(6)])
    rows = lambda t: sorted(map(tuple, t.collect()))
    first = line_dedup.references(a)
    both = line_dedup.merge(first, b, 1)
    assert rows(line_dedup.merge(both, b, -1)) == rows(first)
    before = line_dedup.filters(first, 10)
    grown = line_dedup.update_filters(before, first, both, 10)
    key = line_dedup.halves([line_dedup.digest("same")])[0]
    held = lambda f: any(key in line_dedup.CuckooFilter(np.frombuffer(t, np.uint16).reshape(-1, 4)) for _, t in f.collect())
    assert not held(before) and held(grown) and not held(line_dedup.update_filters(grown, both, first, 10))


def test_cuckoo_filter_holds_what_it_was_given():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, (2000, 2)).astype(np.uint64)
    made = line_dedup.CuckooFilter.of(keys)
    assert made.contains(keys).all()
    for k in keys[:1000]:
        assert made.delete(k)
    assert made.contains(keys[1000:]).all() and made.contains(keys[:1000]).mean() < 0.01


def greedy(word, initial, continuing):
    at = n = 0
    while at < len(word):
        pieces = continuing if at else initial
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return None
        at, n = at + size, n + 1
    return n


def test_token_counts_against_longest_match(spark, docs, empty):
    initial, continuing = map(set, token_counts.piece_vocabulary(open(PIECES, "rb").read()))
    rows = {r.doc_id: r for r in token_counts.token_counts(docs, PIECES).collect()}
    for i, t in enumerate(TEXTS):
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        counts = [greedy(w, initial, continuing) for w in words]
        assert (rows[i].n_words, rows[i].n_tokens, rows[i].n_unknown) == (len(words), sum(1 if c is None else c for c in counts), counts.count(None))
    rng = random.Random(3)
    for _ in range(300):
        some = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(6)}
        more = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(6)}
        machine, word = token_counts.LongestMatch(some, more), "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        want = greedy(word, some, more)
        assert machine.count(word) == (token_counts.UNKNOWN + 1 if want is None else want)
    assert token_counts.token_counts(empty, PIECES).count() == 0


def plain_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_pii_base_spans_against_plain_patterns(spark, empty):
    rng = random.Random(4)
    parts = ["a.b@c.d_e@f.g.h", "x@y", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.02.3.255", "4111 1111-1111 1111", "4111111111111111", "12 34", "+1 (555) 010-9999", "+12", "5", "é", " ", "-", ".", "@", "word", "+49 30 1234567", "79927398713", "\n", "9" * 25]
    texts = [None, "", *("".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randint(1, 9))) for _ in range(150)), "7" * 20000, "a" * 20000 + "@", ("1." * 5000) + "x", "z@" + "b." * 5000 + "c"]
    got = {r.doc_id: r for r in pii.find(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest(), (t, want, got[i].spans)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(w[3] == k for w in want) for k in pii.KINDS]
    assert pii.find(empty).count() == 0


def test_pii_terms_that_give_an_entity_away(spark):
    texts = [f"Ask Quillon at q@firm.example today, please {i}" for i in range(4)] + ["please ask for it today", "call at noon today please", None, "nothing"] + [f"please wait today {i}" for i in range(20)]
    d = docs_of(spark, texts)
    got = {r.doc_id: r.spans for r in pii.find(d).collect()}
    assert got[0] == "remove:4:11,email:15:29" and got[4] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert clean[0] == "Ask  at [EMAIL] today, please 0" and clean[4] == texts[4] and clean[6] is None
    assert pii.sanitise(d).columns == d.columns


def test_pii_terms_of_entities_in_one_or_two_documents(spark):
    texts = ["Ask Quillon at q@firm.example today", "call Brannick, +49 30 1234567, today", "Brannick at noon: +49 30 1234567"] + [f"ask or call at noon today {i}" for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.find(docs_of(spark, texts)).collect()}
    assert got[0] == "remove:4:11,email:15:29"
    assert got[1] == "remove:5:13,phone:15:29" and got[2] == "remove:0:8,phone:18:32"
    assert all(got[i] == "" for i in range(3, 33))


def plain_term_spans(texts):
    """The terms' spans by the definition, in plain Python."""
    words = [[(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")] for t in texts]
    base = [plain_spans(t or "") for t in texts]
    entities = [{(k, t[s:e].lower()) for s, _, e, k in b} for t, b in zip(texts, base, strict=True)]
    n, n_c, n_t, n_ct = len(texts), Counter(), Counter(), Counter()
    for w, c in zip(words, entities, strict=True):
        own = {x[2] for x in w}
        n_c.update(c), n_t.update(own), n_ct.update((x, t) for x in c for t in own)
    out = []
    for w, c, b in zip(words, entities, base, strict=True):
        found = []
        for s, e, t in w:
            share = max((np.log(n * n_ct[x, t] / (n_c[x] * n_t[t])) / np.log(n / n_c[x]) for x in c if n_c[x] < n), default=0)
            if share >= pii.GENERALISE_AT and not any(s < y[2] and y[0] < e for y in b):
                found.append((s, 4, e, "remove") if share >= pii.REMOVE_AT else (s, 5, e, "generalise"))
        out.append(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted([*b, *found])))
    return out


def test_pii_terms_anywhere_in_the_text(spark):
    far = " ".join(["please wait today and call at noon"] * 10)
    texts = [f"Quillon, {far} q@firm.example {far} yours, Quillon"] + [f"please wait today and call at noon yours {i}" for i in range(30)]
    got = {r.doc_id: r.spans for r in pii.find(docs_of(spark, texts)).collect()}
    assert got[0] == ",".join([f"{k}:{s}:{e}" for k, s, e in [("remove", 0, 7), ("email", texts[0].index("q@"), texts[0].index("q@") + 14), ("remove", len(texts[0]) - 7, len(texts[0]))]])
    assert got[0] == plain_term_spans(texts)[0] and all(got[i] == "" for i in range(1, 31))
    rng = random.Random(15)
    names = [f"{a}{b}" for a in ("Éla", "bro", "日本語", "Quo", "mer") for b in ("nick", "ßen", "vast")]
    values = ["a@b.example", "jane.brovast@c.example", "+49 30 1234567", "10.1.2.3", "4111 1111 1111 1111"]
    texts = [None, "", *(" ".join(rng.choice([rng.choice(names), prose(rng, 3), prose(rng, 3), "😀", rng.choice(values) if i % 4 == 0 else "x"]) for _ in range(rng.randint(1, 40))) for i in range(150))]
    texts += texts[2:40:6]
    texts += [f"{prose(rng, 20)} one{'x' * i} z{i}@d.example twice{'y' * (i // 2)} +1 555 010 99{i // 2:02}" for i in range(20)]
    texts += [f"{prose(rng, 9)} Halvard{' +44 20 7946 0000' if i else ''}" for i in range(11)]
    got = {r.doc_id: r.spans for r in pii.find(docs_of(spark, texts)).collect()}
    want = plain_term_spans(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert any("remove" in w for w in want) and any("generalise" in w for w in want)


def test_language_identification(spark, empty):
    rng = random.Random(6)
    words = {"aa": ("lomi", "tesa", "ruvo", "kima"), "bb": ("strak", "blund", "fjork", "grumt"), "cc": ("шила", "море", "ветер")}
    texts, langs = [], []
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        texts.append(prose(rng, 20, words[lang]))
        langs.append(None if i % 17 == 0 else lang)
    texts += [None, "", "123 ²³ !!", "lomi tesa"]
    langs += ["aa", "bb", None, "cc"]
    got = {r.doc_id: r for r in language_id.identify(docs_of(spark, texts, langs)).collect()}
    assert all(got[i].lang_pred == ("aa", "bb", "cc")[i % 3] and 0 < got[i].score <= 1 for i in range(240))
    assert [got[i].lang_pred for i in (240, 241, 242)] == ["und"] * 3 and got[243].lang_pred == "aa"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert language_id.identify(empty).count() == 0
    alone = language_id.identify(docs_of(spark, ["some text"], [None])).collect()
    assert alone[0].lang_pred == "und"


def test_language_profiles_hold_four_letters(spark):
    rows = language_id.profiles(docs_of(spark, ["stone lanterns"] * 3)).collect()
    assert {len(r.gram) for r in rows} == {1, 2, 3, 4} and "ston" in {r.gram for r in rows}


def test_quality_base_counts(spark, docs, empty):
    assert quality_rules.repeated_words(b"a b c a b c d".split()) == 6 and quality_rules.repeated_words(b"a a a a".split()) == 4 and quality_rules.repeated_words(b"a b".split()) == 0
    rng = random.Random(8)
    for _ in range(100):
        w = [rng.choice("abc").encode() for _ in range(rng.randint(0, 25))]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        assert quality_rules.repeated_words(w) == len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})
    rows = {r.doc_id: r for r in quality_rules.judge(docs, None).collect()}
    assert rows[9].n_dup_lines == 1 and rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept and rows[11].base_failed and rows[16].n_words == 3000 and rows[16].base_failed == (2 * rows[16].n_repeat_words > 3000)
    assert quality_rules.judge(empty, None).count() == 0


def test_quality_learns_from_labels(spark):
    rng = random.Random(9)
    texts = [prose(rng, 60) if i % 2 else " ".join(w + "&&&" for w in prose(rng, 60).split()) for i in range(200)]
    d = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality_rules.train(d, labels)
    rows = quality_rules.judge(d, model).collect()
    assert all(r.kept == bool(r.doc_id % 2) for r in rows)
    assert quality_rules.train(d, labels.where("quality = 1")) is None


def test_toxicity_finds_marked_documents(spark, empty):
    rng = random.Random(10)
    texts = [prose(rng, 60) for _ in range(400)]
    for i in range(0, 400, 4):
        w = texts[i].split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["blargface", "snorkwit"]))
        texts[i] = " ".join(w)
    texts += [None, ""]
    d = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.score_corpus(d, labels).collect()]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in rows if r.doc_id < 400) >= 380 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert toxicity.score_corpus(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_corpus(d, labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_curve_sees_the_whole_sample(spark, monkeypatch):
    seen, fit = [], toxicity.fit_curve
    monkeypatch.setattr(toxicity, "fit_curve", lambda x, y, weight: seen.append((len(x), int(y.sum()))) or fit(x, y, weight))
    rng = random.Random(16)
    d = docs_of(spark, [prose(rng, 20) + (" blargface" if i < 40 else "") for i in range(740)])
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(740)], "doc_id long, quality int, toxic int")
    toxicity.train(d, labels)
    toxicity.train(d, labels, ordinary_rows=600)
    assert seen == [(740, 40), (640, 40)]


def plain_groups(texts):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("limit", [jaccard_join.BROADCAST_ROWS, 0])
def test_jaccard_join_against_all_pairs(spark, empty, limit, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 80))] for _ in range(12)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = list(TEXTS[:14])
    for b in base:
        for _ in range(rng.randint(1, 7)):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w + (passage if rng.random() < 0.4 else [])))
    chain = [rng.choice(vocabulary) for _ in range(60)]
    for k in range(8):
        texts.append(" ".join(chain[k * 3 :] + [f"v{i}" for i in range(k * 3)]))
    texts += [" ".join(base[0]).upper(), "One TWO"]
    want, sizes = plain_groups(texts)
    got = {r.doc_id: r for r in jaccard_join.join(docs_of(spark, texts)).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want
    kept = jaccard_join.one_of_each(docs_of(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    assert jaccard_join.join(empty).count() == 0


def test_jaccard_join_links_a_copy_with_more_text_to_a_hot_one(spark):
    rng = random.Random(14)
    words = lambda tag, n: [f"{tag}{i}" for i in rng.sample(range(10_000), n)]
    a = words("a", 84)  # 80 shingles; in 30 documents they are hot and come last
    texts = [" ".join(a)] * 30 + [" ".join(a + words("b", 20))]
    for k, (before, after) in enumerate([(5, 0), (12, 12), (0, 26), (0, 32), (30, 0)]):
        b = words(f"c{k}x", 104)
        texts += [" ".join(b)] * 25 + [" ".join(words(f"d{k}x", before) + b + words(f"e{k}x", after))]
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs_of(spark, texts)).collect()}
    assert got[30] == 0
    assert [got[i] for i in range(len(texts))] == plain_groups(texts)[0]


def test_divide_skip_counts_occurrences():
    rng = random.Random(12)
    for _ in range(200):
        lists = [np.array(sorted(rng.sample(range(30), rng.randint(1, 25)))) for _ in range(rng.randint(1, 12))]
        least = rng.randint(1, len(lists))
        n = Counter(int(i) for x in lists for i in x)
        assert jaccard_join.divide_skip(lists, least) == {i: c for i, c in n.items() if c >= least}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_against_key_sets(spark, empty):
    rng = random.Random(13)
    texts = [*TEXTS[:12], *("\n".join(prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 25))) for _ in range(25)), "\n".join(str(i) for i in range(900))]
    rows = {r.doc_id: r for r in fingerprints.compare_with_edit(docs_of(spark, texts)).collect()}
    keys = lambda t: set(re.findall("[^\n]{1,%d}" % fingerprints.PIECE, t))

    def share(a, b):
        return 1.0 if not a | b else len(a & b) / len(a | b)

    whole = [t or "" for t in texts]
    for i, t in enumerate(whole):
        after, k = whole[(i + 1) % len(whole)], len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(rows[i].near_edited - share(keys(t), keys(edited))) < 1e-9 and abs(rows[i].near_next - share(keys(t), keys(after))) < 1e-9
    same = [r.fingerprint for r in fingerprints.fingerprints(docs_of(spark, ["a\nb", "a\nb", "a\nc", None, ""])).orderBy("doc_id").collect()]
    assert same[0] == same[1] != same[2] and same[3] == same[4]
    assert fingerprints.compare_with_edit(empty).count() == 0
    assert fingerprints.compare_with_edit(docs_of(spark, ["only one\nhere"])).first().near_next == 1.0
