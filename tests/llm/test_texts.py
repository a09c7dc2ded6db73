"""Operators on texts against plain Python on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cinelake.llm import bpe, jaccard, language, licenses, line_dedup, mixing, suffix_dedup, toxicity
from cinelake.llm.components import components, forest

SPACE = "[\x20\x09-\x0d]"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def rows(df):
    return [(x["doc_id"], x["text"]) for x in df.select("doc_id", "text").collect()]


# --- line dedup


def dropped_lines(docs):
    last = 2**63
    ids = [last if i is None else i for i, _ in docs]
    keys = [[lower(re.sub(f"^{SPACE}+|{SPACE}+$", "", x)) for x in (text or "").split("\n")] for _, text in docs]
    holders = defaultdict(set)
    for i, own in zip(ids, keys, strict=True):
        for key in own:
            holders[key].add(i)
    out = []
    for (i, text), name, own in zip(docs, ids, keys, strict=True):
        lines = (text or "").split("\n")
        kept = [x for x, key in zip(lines, own, strict=True) if len(key) < 10 or len(holders[key]) < 2 or min(holders[key]) == name]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("table", ["odd", "corpus", "empty"])
def test_line_dedup(table, request):
    docs = request.getfixturevalue(table)
    found = line_dedup.drop_repeats(docs)
    assert set(docs.columns) < set(found.columns)
    assert Counter((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"]) for x in found.collect()) == dropped_lines(rows(docs))


def test_filters_hold_all_repeats(corpus):
    size = line_dedup.filter_size(corpus)
    assert size.bits == 20 and line_dedup.Size(30).inner == 21
    held = {k: np.unpackbits(np.frombuffer(line_dedup.zstandard.decompress(v), np.uint8)) for k, v in line_dedup.seen_twice(corpus, size).items()}
    times = Counter(key for _, text in rows(corpus) for key in {k for k in map(line_dedup.line_key, text.split("\n")) if k})
    for key, n in times.items():
        if n > 1:
            h = np.array([line_dedup.xxhash.xxh3_64_intdigest(key)], np.uint64)
            assert held[int(size.segment(h)[0])][size.places(h).astype(int)].all()


def test_line_dedup_with_full_filters(corpus, monkeypatch):
    """Filters that suspect almost every line give the same result."""
    monkeypatch.setattr(line_dedup, "filter_size", lambda docs: line_dedup.Size(9))
    assert Counter((x["doc_id"], x["n_lines"], x["n_dropped"], x["text"]) for x in line_dedup.drop_repeats(corpus).collect()) == dropped_lines(rows(corpus))


# --- suffix dedup


def removed(docs, length=400):
    texts = [(text or "").encode() for _, text in docs]
    times = Counter(x[k : k + length] for x in texts for k in range(len(x) - length + 1))
    out = []
    for (i, _), x in zip(docs, texts, strict=True):
        gone = np.zeros(len(x) + 1, int)
        for k in range(len(x) - length + 1):
            if times[x[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((i, len(x), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), kept))
    return Counter(out)


@pytest.mark.parametrize("table", ["corpus", "empty"])
def test_suffix_dedup(table, request):
    docs = request.getfixturevalue(table)
    found = suffix_dedup.remove_repeats(docs)
    assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in found.collect()) == removed(rows(docs))


def test_suffix_dedup_of_odd_texts(spark, odd):
    periodic = [(20, "ab" * 500), (21, "x" * 399), (22, "y" * 400), (23, "z" * 401), (24, "q" * 200 + "".join(chr(97 + k % 23) + chr(97 + k % 7) for k in range(300)))]
    docs = odd.where("doc_id is null or doc_id not in (5, 6)").select("doc_id", "text").union(spark.createDataFrame(periodic, "doc_id long, text string"))
    found = suffix_dedup.remove_repeats(docs)
    assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in found.collect()) == removed(rows(docs))
    clashing = odd.where("doc_id is null or doc_id not in (5, 6)")
    assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in suffix_dedup.remove_repeats(clashing).collect()) == removed(rows(clashing))
    both = {x["doc_id"]: x["n_removed"] for x in suffix_dedup.remove_repeats(odd.where("doc_id in (5, 6)")).collect()}
    assert both[5] == len(rows(odd.where("doc_id = 5"))[0][1]) and both[6] >= both[5]


@pytest.mark.parametrize("wide", [4, 4096])
def test_suffix_dedup_of_a_passage_with_many_edges(spark, monkeypatch, wide):
    """Documents that share a passage, or most of it, amid text of their own: with ``wide`` 4 its grams are cut to slices and windows."""
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, docs = letters(900), []
    for k in range(60):
        low, high = sorted(rng.integers(0, 901, 2)) if k % 3 == 0 else (0, 900)
        docs.append((k // 2, letters(rng.integers(0, 500)) + passage[low:high] + rng.choice(["", letters(20)]) + letters(rng.integers(0, 500))))
    docs += [(None, passage[:450]), (None, passage[300:]), (7, docs[3][1]), (8, passage * 2)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in found.collect()) == removed(docs)


def test_multikey_quicksort():
    rng = np.random.default_rng(6)
    for n in (0, 1, 30, 500):
        keys = rng.integers(0, 4, (n, 3)).astype(np.uint64)
        assert sorted(keys.tolist()) == keys[suffix_dedup.multikey_quicksort(keys)].tolist()


def test_blind_trie_sorts():
    rng = np.random.default_rng(1)
    for _ in range(300):
        texts = [bytes(rng.integers(97, 99, rng.integers(0, 12)).tolist()) for _ in range(rng.integers(1, 15))]
        order, prefix = suffix_dedup.blind_trie(texts, list(range(len(texts))))
        assert [texts[k] for k in order] == sorted(texts)
        assert prefix == [suffix_dedup.common(texts[a], texts[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
        order, prefix = suffix_dedup.deep_shallow(texts, np.zeros(len(texts), int))[0]
        assert [texts[k] for k in order] == sorted(texts)
        assert prefix == [suffix_dedup.common(texts[a], texts[b]) for a, b in zip(order[:-1], order[1:], strict=True)]


# --- Jaccard join


def shingle_sets(docs):
    out = {}
    for i, text in docs:
        words = WORDS.findall(lower(text))
        out[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    return out


def classes(sets):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for k, i in enumerate(names):
        for j in names[:k]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in names}


@pytest.mark.parametrize("table", ["odd", "corpus", "empty"])
def test_jaccard(table, request):
    docs = request.getfixturevalue(table)
    plain = {2**63 - 1 if i is None else i: text for i, text in rows(docs) if i is not None or text}
    found = {x["id"]: (x["n_shingles"], x["component"]) for x in jaccard.link(docs.where("doc_id is not null or text is not null")).collect()}
    assert found == classes(shingle_sets(plain.items()))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_of_large_groups(spark, monkeypatch, seed):
    """Groups of near copies, exact copies and chains, with tiles of several blocks and arrays of several groups of pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "GROUP", 4)
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    docs = []
    for _ in range(3):
        text = rng.choice(words, 120).tolist()
        for _ in range(60):
            own = list(text)
            own[int(rng.integers(0, len(own)))] = str(rng.choice(words))
            docs.append(own)
            if rng.random() < 0.4:
                text = own  # a chain: its ends need not link
    order = rng.permutation(len(docs))
    docs = [(int(k), " ".join(docs[j])) for k, j in enumerate(order)]
    found = {x["id"]: (x["n_shingles"], x["component"]) for x in jaccard.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == classes(shingle_sets(docs))


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64)]))
        if not len(b):
            continue
        sets = sorted((a, b), key=len)
        shared = len(np.intersect1d(a, b))
        links = 100 * shared >= 80 * (len(a) + len(b) - shared)
        passing = [x for x, y in jaccard._passing(np.array([len(x) for x in sets]), [jaccard.bitmap(x).tobytes() for x in sets])]
        assert passing == [1] or not links


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)]
    found = {x["node"]: x["root"] for x in components(spark.createDataFrame([*links, (None, 1), (7, 7)], "a long, b long")).collect()}
    assert {k: v for k, v in found.items() if k != v} == dict(forest([x for x in links if x[0] != x[1]]))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- toxicity


@pytest.fixture(scope="module")
def marked(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for k in range(900):
        own = rng.choice(words, rng.integers(5, 120)).tolist()
        toxic = int(rng.random() < 0.25)
        if toxic:
            own.insert(int(rng.integers(0, len(own))), "zwyqk")
        docs.append((k, " ".join(own)))
        labels.append((k, 1, toxic if k % 50 else None))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, marked, odd, empty):
    docs, labels = marked
    model = toxicity.fit(docs, labels)
    truth = {x["doc_id"]: x["toxic"] for x in labels.collect()}
    found = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [k for k in found if zlib.crc32(str(k).encode()) % 5 == 0 and truth[k] is not None]
    assert len(held) > 100 and sum(found[k]["predicted"] == truth[k] for k in held) / len(held) > 0.98
    assert {x["doc_id"] for x in toxicity.clean(docs, model).collect()} == {k for k, x in found.items() if not x["predicted"]}
    scores = toxicity.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in scores)
    assert toxicity.score(empty, model).count() == 0 and toxicity.clean(odd, model).columns == odd.columns


def test_toxicity_never_learns_held_out_rows(spark, marked):
    docs, labels = marked
    some = toxicity.training_rows(docs, labels)
    texts = {x["text"] for x in docs.collect() if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0}
    assert not texts & {x["text"] for x in some.collect()}
    assert toxicity.training_rows(docs, labels, sample=10).count() == 10
    nothing = toxicity.fit(docs, labels.where("false"))
    assert {x["score"] for x in toxicity.score(docs.limit(3), nothing).collect()} == {0.0}


def toxic_by_definition(docs, labels):
    """Counts, ratios and scores of the same features by plain Python over strings."""
    import math

    norm = lambda text: "".join(c.lower() if "A" <= c <= "Z" else c if ord(c) > 127 or c.isalnum() else " " for c in text or "")

    def buckets(text):
        out, text = set(), [ord(c) for c in norm(text)]
        for n in toxicity.ORDERS:
            for k in range(len(text) - n + 1):
                h = 0
                for c in text[k : k + n]:
                    h = (h * 0x9E3779B1 + c) % 2**32
                out.add(((h ^ (h >> 15)) * 0x85EBCA6B % 2**32) >> (32 - toxicity.BITS))
        return out

    train = [(buckets(text), labels[i]) for i, text in docs if labels.get(i) in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    n = [sum(y == k for _, y in train) for k in (0, 1)]
    counts = defaultdict(lambda: [0, 0])
    for own, y in train:
        for b in own:
            counts[b][y] += 1
    ratio = {}
    for b, (c0, c1) in counts.items():
        both = (c0 + c1) / sum(n)
        error = math.sqrt(max(both * (1 - both), 1e-12) * (1 / n[0] + 1 / n[1]))
        if abs(c1 / n[1] - c0 / n[0]) / error > toxicity.SIGNIFICANT and c0 + c1 >= toxicity.LEAST:
            ratio[b] = math.log((c1 + 1) / (n[1] + 2) / ((c0 + 1) / (n[0] + 2)))
    return ratio, buckets, train


def test_toxicity_by_definition(spark, marked, odd):
    docs, labels = marked
    model = toxicity.fit(docs, labels)
    ratio, buckets, train = toxic_by_definition(rows(docs), {x["doc_id"]: x["toxic"] for x in labels.collect()})
    assert sorted(ratio) == model.buckets.tolist()
    # the weights are at the least loss: the slope of the penalised logistic loss is near 0
    scale = np.array([ratio[b] for b in sorted(ratio)])
    x = np.array([[b in own for b in sorted(ratio)] for own, _ in train]) * scale
    y = np.array([label for _, label in train])
    wrong = 1 / (1 + np.exp(-(x @ (model.weights / scale) + model.intercept))) - y
    assert abs(wrong.mean()) < 1e-3 and np.abs(x.T @ wrong / len(y) + 1e-4 * model.weights / scale).max() < 2e-3
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    for table in (docs, odd.where("doc_id is null or doc_id not in (5, 6)")):
        want = Counter((i, round(1 / (1 + float(np.exp(-model.intercept - sum(weight.get(b, 0.0) for b in buckets(text))))), 4)) for i, text in rows(table))
        assert Counter((r["doc_id"], round(r["score"], 4)) for r in toxicity.score(table, model).collect()) == want


# --- language


def test_language(spark, odd, empty):
    rng = np.random.default_rng(5)
    tongues = {"aa": "the of and ing tion er with that".split(), "bb": "der die und ung keit sch ein mit".split(), "cc": "de la les ment eau que pour dans".split()}
    docs = [(k, " ".join("".join(rng.choice(tongues[lang], rng.integers(1, 4))) for _ in range(40)), lang) for k, lang in enumerate(rng.choice(list(tongues), 400).tolist())]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    held = ~language.F.coalesce(language.crc_mod("doc_id", 3) == 1, language.F.lit(False))
    learned = language.learn(table, held)
    assert sorted(learned) == sorted(tongues) and all(len(x) <= language.DICTIONARY for x in learned.values())
    found = {x["doc_id"]: x for x in language.predict(table, learned).collect()}
    tested = [(k, lang) for k, _, lang in docs if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(found[k]["lang_pred"] == lang for k, lang in tested) / len(tested) > 0.97
    odd_rows = language.predict(odd, learned).collect()
    assert len(odd_rows) == odd.count()
    assert {x["lang_pred"] for x in odd_rows if x["doc_id"] in (3, 4, 9)} == {"und"} and all(0 <= x["score"] <= 1 for x in odd_rows)
    assert language.predict(empty, learned).count() == 0 and language.learn(empty, held) == {}
    assert {x["lang_pred"] for x in language.predict(odd, {}).collect()} == {"und"}


def test_language_sizes_by_definition(spark, odd):
    """Predictions against sizes that the zstandard library gives for the same blocks and dictionaries."""
    import zstandard

    learned = {"x": b"one line that is long enough and others " * 20, "y": "der die das und 漢字 é ü ".encode() * 30, "z": b""}
    found = {(x["doc_id"], x["lang_pred"], round(x["score"], 12)) for x in language.predict(odd, learned).collect()}
    want = set()
    for i, text in rows(odd):
        raw = (text or "").lower().encode()
        sizes = {}
        for name, content in learned.items():
            made = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = sum(len(made.compress(raw[k : k + language.BLOCK])) for k in range(0, len(raw), language.BLOCK))
        order = sorted(learned, key=lambda name: (sizes[name], name))
        letters = any(map(str.isalpha, text or ""))
        want.add((i, order[0] if letters else "und", round(1 - sizes[order[0]] / sizes[order[1]], 12) if letters else 0.0))
    assert found == want


def test_language_shares():
    texts = [b"a" * 10, b"b" * 5000, bytes(range(256)) * 40, b""]
    own = language.shares(texts, 4000)
    assert own[0] == texts[0] and own[3] == b"" and sum(map(len, own)) <= 4000 and abs(len(own[1]) - len(own[2])) < 500
    assert own[2][:100] == texts[2][:100] and own[2][-100:] == texts[2][-100:]
    assert language.shares(texts, 10**6) == texts and language.shares([], 5) == []


# --- BPE


def test_bpe_is_tiktoken(odd, empty):
    import public_tokenizers
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_path()), special_tokens={})
    found = bpe.encode_decode(odd).collect()
    assert Counter((x["doc_id"], bytes(x["ids"]), bytes(x["decoded"]), x["n_tokens"]) for x in found) == Counter(
        (i, np.array(ids := encoding.encode_ordinary(text or ""), dtype="<u4").tobytes(), (text or "").encode(), len(ids)) for i, text in rows(odd)
    )
    assert bpe.encode_decode(empty).count() == 0
    one = {x["doc_id"]: x for x in bpe.digests(odd).collect()}[10]
    assert one["decoded_sha256"] == hashlib.sha256(rows(odd.where("doc_id = 10"))[0][1].encode()).hexdigest()


def test_bpe_model_with_gaps(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 301, b"bc": 299}
    path = tmp_path / "small"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    codec = bpe.Codec(str(path), r"\S+|\s+")
    assert np.frombuffer(codec.encode("abcd"), "<u4").tolist() == [301, 100]  # bc first, then a with it, as tiktoken does
    assert np.frombuffer(codec.encode("abc ab"), "<u4").tolist() == [301, 32, 300]  # whole entries stay whole


# --- licenses


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def detections_of(text):
    """Rules by Python's regular expressions, gate and suppression by definition."""
    spaced = " ".join(["", *re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), ""]) or " "
    if not any(x in spaced for x in licenses.STEMS):
        return set()
    found = [(m.start(), m.end(), rank, label) for rank, (label, word, pattern, _) in enumerate(licenses.rules()) if word in spaced for m in re.finditer(f" {pattern}(?= )", spaced)]
    return {x for x in found if not any(y[0] <= x[0] and x[1] <= y[1] and y[2] < x[2] for y in found)}


def test_licenses(spark, odd, empty):
    texts = [
        "MIT License mit license", "Licensed under the Apache License, Version 2.0; and the General Public License", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under CC BY-NC 4.0.",
        "GNU General Public License version 3, or (at your option) any later version", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This work is licensed under the GNU General Public License, version 3. Released under the MIT License.", "mit license is one word", "Creative Commons Attribution-ShareAlike 4.0 International License",
    ]
    docs = odd.unionByName(spark.createDataFrame([(100 + k, x) for k, x in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    found = licenses.scan(docs).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) for x in found) == Counter((i, *base_of(text)) for i, text in rows(docs))
    by_id = {x["doc_id"]: x for x in found}
    for i, text in rows(docs):
        if i is not None:
            own = detections_of(text)
            assert {(x["start"], x["end"], x["rank"], x["label"]) for x in by_id[i]["detections"]} == own
            assert by_id[i]["labels"] == ",".join(sorted({x[3] for x in own} | set(filter(None, by_id[i]["base_labels"].split(",")))))
    assert "gpl-2.0-or-later" in by_id[102]["labels"] and "cc-by-nc-4.0" in by_id[103]["labels"] and by_id[100]["score"] >= 0.6
    assert licenses.scan(empty).count() == 0


def test_licenses_without_common_words(spark):
    """Texts whose only hint is a rule's own keyword; every rule tried on every text, without any gate on the text."""
    texts = {
        "Released under GPLv3": "gpl-3.0", "CC BY 4.0": "cc-by-4.0", "GNU GPL v2": "gpl-2.0", "LGPLv2.1 or AGPLv3": "agpl-3.0,lgpl-2.1", "BSD 3-Clause": "bsd-3-clause", "WTFPL": "wtfpl", "CC0 1.0": "cc0-1.0",
        "with the Classpath Exception": "classpath-exception", "GCC Runtime Library Exception": "gcc-exception", "As a special exception, you may link it": "linking-exception", "Commons Clause": "commons-clause",
        "under the same terms as Perl itself": "perl", "Neither the name of X nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
        "This product includes software developed by the OpenSSL Project": "openssl", "no hint at all": "",
    }
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["labels"] for x in found} == dict(enumerate(texts.values()))
    for x, text in zip(sorted(found), texts, strict=True):
        spaced = " ".join(["", *re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), ""])
        every = [(m.start(), m.end(), rank, label) for rank, (label, word, pattern, _) in enumerate(licenses.rules()) if word in spaced for m in re.finditer(f" {pattern}(?= )", spaced)]
        assert {(y["start"], y["end"], y["rank"], y["label"]) for y in x["detections"]} == {y for y in every if not any(z[0] <= y[0] and y[1] <= z[1] and z[2] < y[2] for z in every)}
    assert all(any(stem in word for stem in licenses.STEMS) for _, word, _, _ in licenses.rules())


def test_licenses_in_long_texts(spark):
    """About a megabyte of places, many within others."""
    texts = ["mit license all rights reserved " * 32_000, "licensed under the mit license or the gnu general public license version 3 or later " * 300, "word " * 250_000 + "mit license"]
    found = {x["doc_id"]: x for x in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (found[0]["n_words"], found[0]["n_base"], found[0]["first_word"], found[0]["last_word"], found[0]["labels"]) == (160_000, 32_000, 0, 159_995, "all-rights-reserved,mit")
    assert len(found[0]["detections"]) == 32_000 and found[2]["first_word"] == found[2]["last_word"] == 250_000
    assert {(x["start"], x["end"], x["rank"], x["label"]) for x in found[1]["detections"]} == detections_of(texts[1])


def test_license_rules():
    rules = licenses.rules()
    assert len(rules) > 300 and all(re.compile(pattern) and 0 < sure <= 1 for _, _, pattern, sure in rules)


# --- mixing


def mixed(docs):
    """The definition over a plain list."""
    from fractions import Fraction

    size = [len(WORDS.findall(text or "")) for _, text, _ in docs]
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, d in zip(size, docs, strict=True) if d[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, budget = {}, set(sources), Fraction(3 * sum(size), 2)
    while open_:
        share = {s: (budget - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * total[s]}
        target |= {s: Fraction(2 * total[s]) for s in full} if full else share
        open_ = open_ - full if full else set()
    return size, total, target


@pytest.mark.parametrize("table", ["odd", "corpus", "empty"])
def test_mixing(table, request):
    docs = request.getfixturevalue(table)
    plain = [(x["doc_id"], x["text"], x["source"]) for x in docs.collect()]
    size, total, target = mixed(plain)
    found = mixing.mix(docs)
    again = Counter(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    got = found.collect()
    assert Counter(map(tuple, got)) == again and len(got) == len(plain)
    assert Counter((x["doc_id"], x["source"], x["size"], x["source_size"]) for x in got) == Counter((i, s, n, total[s]) for (i, _, s), n in zip(plain, size, strict=True))
    taken = defaultdict(int)
    for x in got:
        assert x["target"] == pytest.approx(float(target[x["source"]])) and x["taken"] in (0, x["size"], 2 * x["size"])
        taken[x["source"]] += x["taken"]
    assert sum(taken.values()) <= 1.5 * sum(size)
    for s, n in taken.items():
        assert abs(n - float(target[s])) <= 2 * max(size, default=0)
