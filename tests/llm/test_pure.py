"""The operators' cores, against plain versions, without Spark."""

import random
from collections import Counter
from fractions import Fraction
from os.path import commonprefix

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import additive_ann, bpe, edit_counts, language_id, mixing, simhash, sparse_suffixes, toxicity

BLOCK = language_id.BLOCK
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOOL = bpe.codec(VOCABULARY, public_tokenizers.PATTERN, 8)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TOOL.ranks, special_tokens={})
TEXT = st.text(st.sampled_from("ab'lres 12\n\t.,!é ẞ漢字\x1c\x85"), max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_tree_encoding_is_the_plain_encoding(text):
    ids = TOOL.encode(text)
    assert ids.tolist() == PLAIN.encode_ordinary(text)
    assert TOOL.decode(ids) == text.encode()


@pytest.mark.parametrize("letters", ["a", "ab", "0123456789", "漢字かな", " \t\n", "'sre l", "abcABC012+/", "the on "])
def test_texts_without_sure_borders_are_joined(letters):
    rng = random.Random(len(letters))
    for _ in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(120)))
        assert TOOL.encode(text).tolist() == PLAIN.encode_ordinary(text), text


def test_long_runs_are_joined_by_their_tokens():
    tool = bpe.codec(VOCABULARY, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for text in ("x" * 30_000, "".join(rng.choice("abcdefghij") for _ in range(30_000)), "漢字" * 10_000, "7" * 20_000, " " * 9_000 + "a"):
        ids = tool.encode(text)
        assert ids.tolist() == PLAIN.encode_ordinary(text)
        assert tool.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60))
def test_merges_of_halves_join_to_those_of_the_whole(data, at):
    assert TOOL.join_tokens(TOOL._merge(data[:at]), TOOL._merge(data[at:])) == TOOL._merge(data) == TOOL._merge_queued(data)


def test_letters_are_those_of_the_library():
    """Every code point, by whether it stays with a letter, a digit, a mark or a line feed behind it."""
    ranks = {bytes([i]): i for i in range(256)}
    for b in range(128, 256):
        for behind in b"a1!\n":
            ranks[bytes([b, behind])] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for c in map(chr, (*range(128, 0xD800, 3), *range(0xE000, 0x110000, 7), *range(0x20000, 0x34000, 5))):
        split = TOOL.splitter(c)
        for behind in "a1!\n":
            assert (len(probe.encode_ordinary("x" + c + behind)) == 1 + len(c.encode())) == (len(split.findall(c + behind)) == 1), hex(ord(c))
    assert regex.__version__


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 90), st.integers(-1, 30), TEXT, st.booleans()), max_size=5))
def test_edited_counts_are_those_of_a_full_encoding(text, edits):
    tree = edit_counts.TokenTree(text, TOOL, segment=6)
    for start, length, new, kept in edits:
        if kept:
            tree = edit_counts.TokenTree(tree.text, TOOL, segment=6, kept=tree.segments)
            assert not tree.reencoded
        at = min(max(start, 0), len(text))
        text = text[:at] + new + text[min(at + max(length, 0), len(text)) :]
        tree.replace(start, length, new)
        assert tree.text == text
        assert tree.count == len(PLAIN.encode_ordinary(text))


@pytest.mark.parametrize("letters", ["some words of a text. ", "漢字かな。，", "abcABC012+/"])
def test_an_edit_encodes_little(letters):
    rng = random.Random(1)
    text = "".join(rng.choice(letters) for _ in range(50_000))
    tree = edit_counts.TokenTree(text, TOOL)
    for new in ("", "new", "inserted words " * 400):
        tree.reencoded = 0
        tree.replace(rng.randrange(50_000), 3, new)
        assert 0 < tree.reencoded < len(new) + 4 * edit_counts.SEGMENT


def _apportioned(votes, seats, most):
    given_ = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if given_[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        best = max(open_, key=lambda i: (Fraction(votes[i], 2 * given_[i] + 1), -i))
        given_[best] += 1
    return given_


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 120))
def test_apportionment_gives_each_seat_to_the_highest_quotient(entries, seats):
    votes, most = zip(*entries)
    assert mixing.apportion(votes, seats, most) == _apportioned(votes, seats, most)


def test_targets_stop_at_the_limit_and_the_rest_is_shared():
    assert mixing.fill_targets([10, 100, 100], [5, 2, 1]) == [30, 120, 60]
    assert mixing.fill_targets([], []) == []
    assert mixing.fill_targets([0, 5], [5, 2]) == [0, 5]


def test_fingerprint_is_the_majority_of_the_shingle_hashes():
    import xxhash

    text = "One two  three\tFOUR five one two"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert simhash.fingerprint(text, 4) & (1 << 64) - 1 == want
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0
    assert simhash.fingerprint("a b", 4) & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b", 42)


def test_links_hold_the_components_of_all_pairs():
    rng = random.Random(1)
    ids = [rng.getrandbits(64) for _ in range(60)]
    ids += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in ids for _ in range(3)]
    ids = sorted(set(ids))

    def groups(pairs):
        parent = {x: x for x in ids}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        return sorted(sorted(x for x in ids if root(x) == r) for r in {root(x) for x in ids})

    every = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (a ^ b).bit_count() <= 4]
    found = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash._links(np.array(ids, np.uint64), 4)]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert groups(found) == groups(every)


def test_every_close_pair_shares_a_table():
    for count in (100, 10**7, 10**9):
        masks = simhash._masks(*simhash.tables_for(count, 4))
        rng = random.Random(2)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def _phrases(text, samples):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and any(text[at : at + n + 1] in s for s in samples):
            n += 1
        count, at = count + 1, at + n
    return count


@pytest.mark.parametrize(("block", "cells"), [(3, 20), (7, 400), (16, 1), (BLOCK, language_id.CELLS)])
def test_cross_parsing_counts_longest_phrases(monkeypatch, block, cells):
    monkeypatch.setattr(language_id, "BLOCK", block)
    monkeypatch.setattr(language_id, "CELLS", cells)
    rng = random.Random(1)
    mixed = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = {"x": ["abracadabra", mixed("abc", 200)], "y": [mixed("abcdefg", 300)], "z": [mixed("漢字かな楽しい", 200)], "r": [mixed("привет", 200)]}
    parser = language_id.CrossParser(samples)
    texts = [mixed(rng.choice(["abc", "abcdefg", "漢字かな楽", "приветq", "abqz"]), rng.randrange(120)) for _ in range(150)]
    texts += [samples["x"][1], samples["z"][0][:100] + samples["x"][1], "abra", "qqq", ""]
    for text, found in zip(texts, parser.phrases(texts)):
        assert found.tolist() == [_phrases(text, samples[k]) for k in parser.langs], text


def test_languages_of_six_scripts():
    samples = {
        "en": ["it was a pleasure to see the house and the people in it"], "zh": ["今天天气很好我们去公园散步吧"], "ja": ["今日は天気がいいですとても楽しかったです"],
        "ko": ["오늘은 날씨가 좋아서 공원에 갔습니다"], "ru": ["сегодня хорошая погода и мы идем в парк"], "el": ["σήμερα ο καιρός είναι καλός και πάμε στο πάρκο"],
    }
    parser = language_id.CrossParser(samples)
    asked = {"en": "the people of the house", "zh": "我们去公园", "ja": "楽しかったです", "ko": "공원에 갔습니다", "ru": "мы идем", "el": "είναι καλός"}
    assert [lang for lang, _ in parser.predict(list(asked.values()))] == list(asked)
    assert parser.predict([None, "", "123 !!"]) == [("und", 0.0)] * 3
    assert language_id.CrossParser({}).predict(["a"]) == [("und", 0.0)]


@settings(max_examples=300, deadline=None)
@given(st.text("abcs", min_size=1, max_size=7))
def test_automaton_finds_the_fewest_edits(word):
    terms = ["abcab", "cab", "sss*"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    best = min([edits(word, "abcab"), edits(word, "cab"), *(edits(word[:n], "sss") for n in range(len(word) + 1))])
    assert toxicity.Automaton(terms, 1).least_edits(word) == (best if best <= 1 else -1)


def test_quotation_is_told_from_abuse():
    text = 'he said "you idiot" and left'
    at = text.index("idiot")
    assert toxicity.Scorer.quoted(text, at, at + 5)
    assert not toxicity.Scorer.quoted("you idiot and left", 4, 9)


def test_scores_of_misspelled_terms():
    rng = random.Random(3)
    plain = [" ".join(rng.choices("one two three four five six seven eight".split(), k=30)) for _ in range(200)]
    bad = [t + " what an idiot you are idiot" for t in plain[:60]]
    scorer = toxicity.fit(plain[60:] + bad, [0] * 140 + [1] * 60, {0: 140, 1: 60})
    assert "idiot" in scorer.terms
    assert scorer.score("one two three idiot four") > 0.5 > scorer.score("one two three four")
    assert scorer.kind("idjot") == toxicity.FUZZY
    assert 0 <= scorer.score(None) == scorer.score("") < 0.5


def test_terms_of_any_length():
    rng = random.Random(9)
    some = [f"w{i}x" for i in range(300)]
    plain = [" ".join(rng.choices(some, k=60)) for _ in range(200)]
    for term in ("zut", "unverschaemtheit", "zz", "混蛋"):
        bad = [f"{t} {term}{'' if term.isascii() else '们'} {t[:20]}" for t in plain[:60]]
        scorer = toxicity.fit(plain[60:] + bad, [0] * 140 + [1] * 60, {0: 140, 1: 60})
        assert [t.rstrip("*") for t in scorer.terms[:1]] in ([term], ["蛋们"]), (term, scorer.terms)
        assert all(scorer.score(t) > 0.5 for t in bad) and not any(scorer.score(t) > 0.5 for t in plain[60:])


def test_branches_are_the_beginnings_that_words_share():
    rng = random.Random(2)
    for _ in range(40):
        documents = [Counter("".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(30))) for _ in range(12)]
        known = toxicity.Vocabulary(documents)
        groups = {tuple(x for x in known.words if x.startswith(w[:k])) for w in known.words for k in range(4, len(w) + 1)}
        branches = range(len(known.words), len(known.text))
        assert {tuple(known.words[known.low[e] : known.high[e]]): known.text[e] for e in branches} == {g: commonprefix(g) for g in groups if len(g) > 1}
        for e in branches:
            for d, words in enumerate(documents):
                hits = sum(n for w, n in words.items() if w.startswith(known.text[e]))
                at = np.flatnonzero((known.at == d) & (known.entry == e))
                assert [toxicity.density(hits, words.total())] * (hits > 0) == known.mass[at].tolist()


def test_windows_tell_reports_from_abuse():
    rng = random.Random(4)
    fill = lambda: " ".join(rng.choices([f"w{i}x" for i in range(200)], k=30))
    bad = [f"{fill()} you are such a clown really {fill()}" for _ in range(80)]
    told = [f"{fill()} the witness said clown reportedly {fill()}" for _ in range(20)]
    cues = toxicity.learn_cues(toxicity.Scorer(["clown"]), bad + told, np.array([1] * 80 + [0] * 20))
    assert cues["such"] > 0 > cues["witness"]


def test_stems_that_plain_texts_hold_now_and_then_are_told_by_density():
    rng = random.Random(5)
    some = [f"w{i}x" for i in range(400)]
    endings = [f"{a}{b}" for a in "abcdefgh" for b in "rstuvw"]
    plain = [" ".join(rng.choices(some, k=300)) for _ in range(300)]
    plain[::10] = [f"{t} grumpel{rng.choice(endings)}" for t in plain[::10]]
    bad = [" ".join(rng.choices(some, k=100) + [f"grumpel{e}" for e in rng.sample(endings, 4)]) for _ in range(60)]
    texts = [t for i in range(300) for t in ([plain[i], bad[i // 5]] if i % 5 == 0 else [plain[i]])]
    scorer = toxicity.fit(texts, [int(t in set(bad)) for t in texts], {0: 300, 1: 60})
    assert scorer.terms and all(t.startswith("grumpel") for t in scorer.terms)
    assert all(scorer.score(t) >= 0.5 for t in bad) and sum(scorer.score(t) >= 0.5 for t in plain) <= 3
    fresh = " ".join(rng.choices(some, k=100))
    assert scorer.score(f"{fresh} grumpelau grumpelei grumpelnn") > 0.5 > scorer.score(f"{fresh} {fresh} grumpelau")


def test_fits_without_a_class():
    assert toxicity.fit([], [], {}).terms == ()
    assert toxicity.fit(["a b", "c"], [1, 1], {1: 2}).terms == ()
    assert toxicity.fit(["a b", ""], [0, 0], {0: 2}).score("a") < 0.5


def test_beam_codes_rebuild_their_norms():
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 8))
    books = additive_ann.train(data, 4, 16, 5)
    codes, norms = additive_ann.encode(data, books)
    rebuilt = sum(books[b][codes[:, b]] for b in range(4))
    assert np.allclose((rebuilt**2).sum(axis=1), norms)
    assert ((data - rebuilt) ** 2).sum() < ((data) ** 2).sum() * 0.5


def _repeats(texts):
    seen = {}
    for doc, text in texts:
        words = text.split()
        for at in range(len(words) - 49):
            seen.setdefault(tuple(words[at : at + 50]), set()).add(doc)
    return {(doc, at) for doc, text in texts for at in range(len(text.split()) - 49) if len(seen[tuple(text.split()[at : at + 50])]) > 1}


@pytest.mark.parametrize("longest", [2, 5, 16_384])
def test_matches_are_extended_as_all_passages_say(monkeypatch, longest):
    monkeypatch.setattr(sparse_suffixes, "RUN", longest)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    shared = rng.choices(words, k=90)
    texts = []
    for doc in range(30):
        a = rng.randrange(30)
        texts.append((doc, " ".join([*rng.choices(words, k=rng.randrange(30)), *shared[a : a + rng.randrange(45, 60)], *rng.choices(words, k=20)])))
    texts += [(40, " ".join(shared)), (40, " ".join(shared)), (41, "x " * 120), (41, "x " * 60), (42, "x " * 55)]
    every = [(pa.array([d for d, _ in texts], pa.int64()), pa.array([t for _, t in texts]))]
    picked = []
    for doc, text in texts:
        own = sparse_suffixes.Words([text.encode()])
        picked.append(np.unique(own.anchors()[1]).astype(np.int32))
    places = pa.array([p.tolist() for p in picked], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([*every[0], places], names=["doc_id", "text", "places"])
    rows = pa.Table.from_batches(sparse_suffixes._contexts(iter([batch]))).sort_by([("suffix", "ascending"), ("before", "ascending"), ("doc_id", "ascending")])
    found = pa.Table.from_batches(sparse_suffixes._extended(iter(rows.to_batches(max_chunksize=7)))).to_pylist()
    keys = {}
    for r in found:
        keys.setdefault(r["key"], set()).update((r["doc_id"], r["high"]))
    sure = [r for r in found if r["first"] is not None and (r["key"] is None or len(keys[r["key"]]) > 1)]
    assert {(r["doc_id"], at) for r in sure for at in range(r["first"], r["last"] + 1)} == _repeats(texts)


def test_picked_places_do_not_depend_on_the_slice():
    rng = random.Random(3)
    text = " ".join(rng.choices([f"w{i}" for i in range(50)], k=400)).encode()
    alone = sparse_suffixes.Words([text]).anchors()[1]
    behind = sparse_suffixes.Words([b"a b c", text])
    assert (behind.anchors()[1] - 3).tolist() == alone.tolist()
    grams = [sparse_suffixes.Words([text]).run(np.array([i]), 5)[0] for i in range(396)]
    assert alone.tolist() == [min(range(i, i + 20), key=lambda j: (grams[j], j)) for i in range(351)]


def test_word_hashes_depend_on_the_words_only():
    one = sparse_suffixes.Words([b"a bb ccc dd", b"x a  bb\tccc dd y"])
    two = sparse_suffixes.Words([b"dd a bb ccc dd"])
    assert one.run(np.array([0]), 4) == one.run(np.array([5]), 4) == two.run(np.array([1]), 4)
    assert one.run(np.array([0]), 3) != one.run(np.array([1]), 3)


def test_empty_inputs():
    assert sparse_suffixes.Words([b""]).count == 0
    assert [len(x) for x in sparse_suffixes.Words([b"", b"a b"]).anchors()] == [0, 0]
    assert simhash.jaccard(None, "", 5) == 1.0
    assert mixing.apportion([], 3, []) == []
    assert additive_ann.train(np.zeros((0, 2)), 1, 2).shape == (1, 2, 2)
