"""Kernels of the text operators against brute force, without Spark."""

import random
import re
import struct
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from coogrid.llm import language, licenses, ordermin, packing, pii, quality, segmentation, simhash, tokens, toxicity

ODD_TEXTS = [
    "", " ", "a", "\n", "The quick brown fox.", "word " * 3000, "x" * 5000, "漢字 und Ünïcode… 😀", "a\tb\r\nc", "<|endoftext|> x",
    "1.2.3.4 " * 50, "\x00\x01", " ", "e" + "́" * 40,
]


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_fingerprint_is_the_stated_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_nothing_is_zero(monkeypatch):
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    long = " ".join(str(i) for i in range(500))
    whole = simhash.fingerprint(long)
    monkeypatch.setattr(simhash, "_PART", 7)
    assert simhash.fingerprint(long) == whole == plain_fingerprint(long)


def test_pairs_within_two_bits_share_six_bytes_of_some_choice():
    rng = random.Random(3)
    masks = [m & 0xFFFFFFFFFFFFFFFF for m in simhash._masks()]
    assert len(masks) == 28
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(x & m == y & m for m in masks)


@pytest.mark.parametrize("n", [1, 2, 40, 900])
def test_roots_within_a_posting(n):
    rng = np.random.default_rng(n)
    free = np.sort(rng.choice(1 << 16, n, replace=False))
    values = free.astype(np.uint64)
    got = simhash._joined(values, free)
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in combinations(range(n), 2):
            if int(values[a] ^ values[b]).bit_count() <= 2 and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got.tolist() == root


# --- packing


def test_ids_are_those_of_the_tokenizer():
    plain, encode = Tokenizer.from_file(tokens.VOCABULARY), tokens.encoder()
    rng = random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choices("ab ,'s9\n\té漢 <|>", k=60)) for _ in range(200)]
    for text in texts:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def check_plan(histogram, capacity=packing.CAPACITY):
    runs, sequences = packing.plan(histogram, capacity)
    placed = Counter()
    level = np.zeros(sequences, int)
    for run in sorted(runs, key=lambda r: r.offset):
        placed[run.length] += run.count
        assert (level[run.first : run.first + run.count] == run.offset).all()  # gapless
        level[run.first : run.first + run.count] += run.length
    assert placed == {n: c for n, c in histogram.items() if c}
    assert sequences == 0 or (level.max() <= capacity and level.min() > 0)
    return sequences


def test_plan_holds_every_piece_once_and_wastes_little():
    rng = random.Random(2)
    assert check_plan({}) == 0
    assert check_plan({2048: 5}) == 5
    assert check_plan({1: 4096}) == 2
    assert check_plan({1024: 3}) == 2
    assert check_plan({1100: 7, 900: 7}) == 7
    assert check_plan({2047: 2, 1: 2}) == 2
    for n in (10, 300, 5000):
        histogram = Counter(min(2048, max(1, int(rng.lognormvariate(6.3, 1)))) for _ in range(n))
        least = -(-sum(k * c for k, c in histogram.items()) // 2048)
        assert least <= check_plan(histogram) <= 1.01 * least + 1


def test_plan_grows_with_counts_not_in_size():
    rng = random.Random(5)
    small = Counter(rng.randrange(1, 2049) for _ in range(3000))
    large = {n: c * 1000 for n, c in small.items()}
    runs, sequences = packing.plan(large)
    assert len(runs) < 20 * 2048 and sequences <= 1.1 * sum(n * c for n, c in large.items()) / 2048


def test_groups_have_equal_cardinality():
    cut = packing.group_lengths({1500: 5, 1000: 3, 900: 4}, 4)
    assert [sum(c for _, c in g) for g in cut] == [3, 3, 3, 3]
    assert [n for g in cut for n, c in g for _ in range(c)] == [1500] * 5 + [1000] * 3 + [900] * 4


# --- segmentation


@pytest.fixture(scope="module")
def pieces():
    return segmentation.Pieces()


def all_scores(pieces, text):
    whole, found = segmentation.normalised(text), []

    def go(i, score):
        if i == len(whole):
            found.append(score)
        for j in range(i + 1, min(len(whole), i + pieces.longest) + 1):
            known = pieces.ids.get(whole[i:j])
            if known:
                go(j, score + known[1])
            elif j == i + 1:
                go(j, score + pieces.unknown)

    go(0, 0.0)
    return sorted(found, reverse=True)


def test_best_segmentations_are_the_best_of_all(pieces):
    rng = random.Random(4)
    segment = segmentation.segmenter(pieces)
    for _ in range(150):
        text = "".join(rng.choices("the an 漢 é\nX", k=rng.randrange(10)))
        paths = segment(text)
        assert [s for s, _, _ in paths] == all_scores(pieces, text)[: segmentation.BEST]
        assert all(pieces.decode(ids) == text and same for _, ids, same in paths)
        assert len({ids.tobytes() for _, ids, _ in paths}) == len(paths)


@pytest.mark.parametrize("text", [*ODD_TEXTS, None])
def test_segmentations_decode_to_the_text(pieces, text):
    paths = segmentation.segmenter(pieces)(text)
    assert [s for s, _, _ in paths] == sorted((s for s, _, _ in paths), reverse=True)
    assert all(pieces.decode(ids) == (text or "") for _, ids, _ in paths)
    if not text:
        assert len(paths) == 1 and len(paths[0][1]) == 0


def test_leader_agrees_with_the_search(pieces):
    for word in ("▁the", "▁international", "▁漢é", "▁" * 9, "▁x" + "y" * 40):
        score, loss, ids, spelt = pieces.leader(word)
        assert spelt
        paths = pieces.search(word, 2)
        assert paths[0][0] == score and pieces.spell(np.frombuffer(ids, "<u4")) == word.encode()
        assert loss == (score - paths[1][0] if len(paths) > 1 else np.inf)


def test_words_in_arrays_agree_with_the_leader(pieces):
    rng = random.Random(5)
    words = ["▁the", "▁", "▁" * 48, "▁" * 49, "▁" + "x" * 47, "▁" + "x" * 48, "▁漢é\0\U0010ffff", "▁\ud800", "▁a,\n\r\t"]
    words += ["▁" + "".join(rng.choices("thean ▁漢é\n.,=", k=rng.randrange(60))).replace(" ", "▁") for _ in range(2000)]
    found = zip(*pieces.leaders(words), strict=True)
    for word, (score, loss, ids, sound) in zip(words, found, strict=True):
        assert (score, loss, ids, sound) == pieces.leader(word)
    assert [len(x) for x in pieces.leaders([])] == [0, 0, 0, 0]


def test_words_of_texts_are_not_searched_one_by_one(pieces, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("theanrsio", k=8)) for _ in range(300)) for _ in range(20)]
    calls = []
    for name in ("leader", "search"):
        plain = getattr(pieces, name)
        monkeypatch.setattr(pieces, name, lambda *args, plain=plain: calls.append(args) or plain(*args))
    segment = segmentation.segmenter(pieces)
    for text in texts:
        assert all(same for _, _, same in segment(text))
    assert len(calls) <= len(texts) * (segmentation.BEST - 1)  # the words that the alternatives depart in


def test_words_forgotten_between_batches_change_nothing(pieces, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("thean漢\n", k=4)) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, ""]
    plain = [segmentation.segmenter(pieces)(t) for t in texts]
    for bound in (0, 10**6):
        monkeypatch.setattr(segmentation, "_CACHE", bound)
        monkeypatch.setattr(segmentation, "_BATCH_CHARS", 500)
        for one, other in zip(plain, segmentation.batch_segmenter(pieces)(texts), strict=True):
            assert [(s, ids.tobytes(), same) for s, ids, same in one] == [(s, ids.tobytes(), same) for s, ids, same in other]


# --- personal data

_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def holds(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, *m.span()) for k, p in _PLAIN.items() for m in re.finditer(p, text) if holds(k, m[0])]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(6)
    for text in ODD_TEXTS:
        assert pii.base_spans(text) == plain_spans(text)
    for i in range(8000):
        alphabet = ("a1@.-+ (٣", "0123456789 -+.@a", "4111 -1")[i % 3]
        text = "".join(rng.choices(alphabet, k=rng.randrange(50)))
        assert pii.base_spans(text) == plain_spans(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 10**5, "a" * 10**5 + "@", "@" * 10**5, "+1" + "(" * 10**5, "1." * 10**5, "+1 " * 10**4):
        pii.candidates(text, pii.base_spans(text))


def test_reliabilities_follow_the_majority():
    n = len(pii.LABELERS)
    prior, table, belief = pii.reliabilities({"+" * n: 30, "-" * n: 60, "0" * n: 10})
    assert belief["+" * n] > 0.99 and belief["-" * n] < 0.01 and 0.2 < prior < 0.5
    assert np.allclose(table.sum(2), 1)


def test_redaction_covers_overlaps():
    assert pii.redacted("call +1 (2) now", [("phone", 5, 11)]) == "call [PHONE] now"
    assert pii.redacted("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a[IP]f"


# --- licences


def test_longest_rising_places():
    rng = random.Random(7)
    for _ in range(200):
        values = [rng.randrange(12) for _ in range(rng.randrange(10))]
        found = [values[i] for i in licenses.rising(values)]
        assert all(a < b for a, b in zip(found, found[1:], strict=False))
        longest = max(
            (k for k in range(len(values) + 1) for c in combinations(values, k) if all(a < b for a, b in zip(c, c[1:], strict=False))),
            default=0,
        )
        assert len(found) == longest


def test_alignment_is_increasing_and_equal():
    rng = random.Random(8)
    for _ in range(200):
        a, b = (rng.choices("abcdefgh", k=rng.randrange(12)) for _ in range(2))
        matched = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in matched)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(matched, matched[1:], strict=False))
    assert len(licenses.align(list("abcde"), list("abcde"))) == 5


def test_notices_are_found_where_they_stand():
    scan = licenses.scanner()
    mit, apache = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["Apache-2.0"][0]
    text = "İ pre " + "la le lu. " * 40 + mit.replace("Software", "Program").upper() + "\n" + "xy. " * 30 + apache + " " + mit
    found = scan(text)
    assert [n.license for n in found] == ["MIT", "Apache-2.0", "MIT"]
    assert text[found[1].start : found[1].end] == apache.rstrip(".")
    assert all(n.coverage >= licenses.COVERAGE for n in found)
    assert scan(None) == scan("") == scan("the license of the software is under the " * 200) == []
    assert len(scan("Released under the MIT License. " * 40)) == 40


NEAR_MISSES = [
    "Released under the BSD License.", "It was released under the new license in May.", "Released under the modified MIT License.",
    "Licensed under the Educational License, Version 2.0.", "Licensed under the Apache License, Version 1.1.",
    "This work is licensed under the GNU General Public License, version 2.",
    "This work is licensed under the GNU Lesser General Public License, version 3.",
    "This work is licensed under the GNU Affero General Public License, version 3.",
    "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY 3.0.",
    "Licensed under CC BY-NC 3.0.", "Licensed under CC BY 3.0. See section 4.0.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution 3.0 International License.",
    "This is free and unencumbered software released into the public library.",
    licenses.TEMPLATES["GPL-3.0"][1].replace("General", "Lesser General"),
    licenses.TEMPLATES["GPL-2.0"][0].replace("General", "Library General"),
    licenses.TEMPLATES["GPL-3.0"][1].replace("version 3", "version 1"),
    licenses.TEMPLATES["MPL-2.0"][0].replace("v. 2.0", "v. 1.1"),
    licenses.TEMPLATES["MPL-2.0"][0].replace("Mozilla", "Other"),
    licenses.TEMPLATES["Apache-2.0"][1].replace("Apache License", "Educational Community License"),
    licenses.TEMPLATES["MIT"][1].replace("sublicense, and/or sell", "and/or lend"),
    licenses.TEMPLATES["ISC"][0].replace("this software", "this software and its documentation"),
    licenses.TEMPLATES["BSD-2-Clause"][0] + " Neither the name of the holder may be used to endorse products.",
]


@pytest.mark.parametrize("text", NEAR_MISSES)
def test_notices_of_other_licences_are_not_taken(text):
    scan = licenses.scanner()
    assert scan(text) == scan("Some words before. " + text + " Some words after.") == []


@pytest.mark.parametrize("name,k", [(name, k) for name, ts in licenses.TEMPLATES.items() for k in range(len(ts))])
def test_every_template_is_its_own_notice(name, k):
    text = licenses.TEMPLATES[name][k]
    found = licenses.scanner()(f"Some words before. {text} Some words after.")
    assert [(n.license, n.coverage) for n in found] == [(name, 1.0)]


@pytest.mark.parametrize("name,line", [(k, t) for k, ts in licenses.TEMPLATES.items() for t in ts])
@pytest.mark.parametrize("before", [0, 1, 3, 6, 10, 17])
def test_repeats_behind_other_text_are_all_found(name, line, before):
    scan = licenses.scanner()
    for times in (2, 3, 40):
        text = "other " * before + f"{line} " * times + "and more."
        places = [m.start() for m in re.finditer(re.escape(line), text)]
        assert [(n.license, n.start, n.coverage) for n in scan(text)] == [(name, p, 1.0) for p in places]


def test_repeats_beside_changed_copies_are_found():
    scan = licenses.scanner()
    apache, cc = licenses.TEMPLATES["Apache-2.0"][0], "Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0. "
    changed = apache.replace("the Apache", "the terms of the Apache")
    assert [n.license for n in scan("Some words. " + f"{changed} {apache} " * 20)] == ["Apache-2.0"] * 40
    assert [n.license for n in scan("Some words. " + cc * 20)] == ["CC-BY-4.0"] * 20
    mit = licenses.TEMPLATES["MIT"][1]
    assert len(scan("Some words. " + (mit.replace("Software", "Program") + " " + mit + " ") * 5)) == 10


def test_repeated_notices_take_linear_time():
    scan = licenses.scanner()
    for line in (licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["GPL-3.0"][1]):
        assert len(scan("Some words. " + f"{line} " * 2000)) == 2000


# --- learned kernels without training data


def test_models_without_training_are_constant():
    model = quality._train([], np.zeros(0))
    score = quality.scorer(model)
    for text in [*ODD_TEXTS, None]:
        assert 0 < score(text, None) < 1
    tox = toxicity.scorer(toxicity.ToxicityModel(-6.0, {}))
    assert tox(None) == tox("") == (0.0, [])
    assert 0 < tox("some words. and more!")[0] < 0.01
    predict = language.predictor(language.LanguageModel((), ()))
    assert predict(["abc", None]) == [("und", 0.0, True)] * 2


def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    w, v = rng.normal(size=quality.SIZE).astype(np.float32), rng.normal(size=(quality.SIZE, quality.FACTORS)).astype(np.float32)
    model = quality.QualityModel(0.1, (w / 50).tobytes(), (v / 20).tobytes())
    text = "a few words, a few MORE words | and 12 numbers"
    at, x = quality.extractor()(text, len(text))
    vv = np.frombuffer(model.factors, np.float32).reshape(-1, quality.FACTORS).astype(float)
    z = 0.1 + float(np.frombuffer(model.linear, np.float32)[at].astype(float) @ x)
    z += sum(float(vv[i] @ vv[j]) * a * b for (i, a), (j, b) in combinations(zip(at, x, strict=True), 2))
    assert quality.scorer(model)(text, len(text)) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_noisy_or_finds_the_offending_sentence():
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rng = random.Random(9)
    names, bags = ["vile"], []
    for d in range(200):
        rows = [[rng.choice(vocabulary)] for _ in range(6)]
        if d % 4 == 0:
            rows[3] = ["vile"]
        cells = Counter(tuple(sorted(names.index(w) for w in r if w in names)) for r in rows)
        blob = np.concatenate([np.array([n, len(b), *b], np.int32) for b, n in cells.items()]).tobytes()
        bags.append((int(d % 4 == 0), blob))
    score = toxicity.scorer(toxicity._train(bags, names))
    p, found = score("Nice words here. You vile thing! More words.")
    assert p > 0.9 and [(a, b) for a, b, _ in found] == [(16, 32)]
    assert score("Nice words here. More words.")[0] < 0.1


# --- order MinHash in plain Python


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash(values, seed=42):
    for v, form in values:
        content = v.encode() if form == "s" else struct.pack("<" + form, v)
        seed = xxhash.xxh64_intdigest(content, seed)
    return _signed(seed)


def plain_order_minhash(text):
    """The fingerprint, from its description."""
    words = re.split(r"[ \t\n\x0b\f\r]+", text)
    top = ~((1 << 30) - 1)
    packed = sorted(
        (_hash([(w, "s") for w in words[i : i + ordermin.WORDS]]) & top) | i for i in range(len(words))
    )
    seen, ring = Counter(), []
    for x in packed:
        kind = x >> 30
        ring.append((_hash([(kind, "q"), (seen[kind], "i")]) & top) | (x & ~top))
        seen[kind] += 1
    ring.sort()
    marks = [((k * (1 << 64) // ordermin.HASHES - (1 << 63)) & top) | ~top for k in range(ordermin.HASHES)]
    out = []
    for mark in marks:
        first = sum(r < mark for r in ring)
        chosen = [ring[(first + q) % len(ring)] for q in range(ordermin.CHOSEN)]
        # Text order: by position, then by the hash read as an unsigned number.
        ordered = sorted((c & ~top, (c >> 30) & ((1 << 34) - 1)) for c in chosen)
        out.append(_hash([(h, "q") for _, h in ordered]) & 65535)
    return out


def test_one_rule_rejects_at_all_lengths():
    import zstandard

    texts = ["the cat sat on the mat and " * 20, "le chat est sur la table et " * 20]
    model = language.LanguageModel(("en", "fr"), tuple(t.encode() for t in texts))
    predict = language.predictor(model)
    asked = ["the mat", "la table", "zq", "qxqz " * 9, "the cat and the mat", "le chat et la table" * 50, "12", None]
    for text, (lang, score, rejected) in zip(asked, predict(asked), strict=True):
        if text is None or not any(c.isalpha() for c in text):
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        # A fresh compressor for every text, nothing precomputed.
        sizes = []
        for held in model.dictionaries:
            parameters = zstandard.ZstdCompressionParameters(**language._PARAMETERS)
            content = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)
            data = text.encode()
            sizes.append(sum(len(pack.compress(data[k : k + 8192])) for k in range(0, len(data), 8192)))
        assert lang == model.languages[sizes.index(min(sizes))]
        assert rejected == (max(sizes) - min(sizes) <= 0.002 * max(sizes))
