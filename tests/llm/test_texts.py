"""Operators on documents: edge cases, and brute force on small fixtures."""

import hashlib
import random
import struct
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest

from lattice_spectra.llm import language_id, packing, pieces, repeats, sharding, toxicity, weighted_minhash
from lattice_spectra.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"


def docs(spark, texts, ids=None):
    """Documents with two more columns whose names operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, 1.0, 7) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def prose(n, seed, words=200):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# repeats


def brute_repeats(texts, length):
    count = Counter()
    for t in texts:
        b = (t or "").encode()
        count.update(b[p : p + length] for p in range(len(b) - length + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [8, 20, 40])
def test_repeats_equal_brute_force(spark, length):
    rng = random.Random(length)
    shared = [prose(30, i)[: rng.randint(length - 3, 3 * length)] for i in range(4)]
    texts = [None, "", "é" * 60, "a" * 100, "ab" * 50, prose(60, 1), prose(60, 1), "short"]
    for i in range(30):
        texts.append(prose(15, 100 + i) + (rng.choice(shared) if i % 2 else "") + prose(15, 200 + i) + (rng.choice(shared) if i % 3 else ""))
    got = repeats.remove_repeats(docs(spark, texts), length).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts, length)


def test_repeats_across_slices(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 512)
    texts = [prose(900, 1), prose(50, 2) + prose(900, 1)[1000:2200] + prose(40, 3), prose(300, 4)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([0, 1, 2]), pa.array(texts)], names=["doc_id", "text_key", "text"])
    found = pa.Table.from_batches(list(repeats._anchors(iter([batch]), 100))).to_pandas()
    covered = found.groupby("doc_id").span.apply(lambda s: int((s + 1).sum())).tolist()
    assert covered == [len(t.encode()) - 99 for t in texts]  # each window has one anchor


def test_periodic_texts_are_a_few_rows(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STRETCH", 700)
    line = prose(4, 31) + "\n"
    texts = ["a" * 3000, "ab" * 1500, line * 60, prose(80, 5) + "xyz" * 700 + prose(80, 6), "xyz" * 300 + prose(40, 7), "a" * 100]
    got = repeats.remove_repeats(docs(spark, texts), 100).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts, 100)
    import pyarrow as pa

    for text in ("a" * 1_000_000, "ab" * 500_000, line * 20_000):
        batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([text])], names=["doc_id", "text_key", "text"])
        found = pa.Table.from_batches(list(repeats._anchors(iter([batch]), 400))).to_pandas()
        assert len(found) < 50 and (found.span + 1).sum() == len(text) - 399


def test_ten_million_letters(spark):
    """One letter, but for two marks that part a string of its own from it."""
    n = 10_000_000
    text = "a" * n
    marked = text[: n // 2] + "<" + prose(100, 4) + ">" + text[n // 2 :]
    got = repeats.remove_repeats(docs(spark, [marked, prose(60, 2)]), 400).orderBy("doc_id").collect()
    own = len(prose(100, 4)) + 2
    assert got[0]["n_removed"] == n and got[0]["n_spans"] == 2 and got[0]["n_bytes"] == n + own
    assert got[0]["kept_sha256"] == hashlib.sha256(("<" + prose(100, 4) + ">").encode()).hexdigest() and got[1]["n_removed"] == 0


def test_repeats_with_equal_ids_and_null_ids(spark):
    text = prose(30, 1)
    got = repeats.remove_repeats(docs(spark, [text, text, prose(30, 2), None], [5, 5, None, None]), 40).collect()
    assert sorted((r["n_removed"] > 0) for r in got) == [False, False, True, True]


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(docs(spark, ["x"]).where("false"), 40).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs(spark, ["x"]), 7)


def test_kept_text(spark):
    passage = prose(20, 9)
    got = repeats.remove_repeats(docs(spark, ["one " + passage + " é", "two " + passage + " è"]), 40, ("doc_id", "source"), keep_text=True).orderBy("doc_id").collect()
    assert got[0]["kept_text"].startswith("one") and passage not in got[0]["kept_text"] and got[0]["source"] == "s"


# near-duplicates


def test_near_duplicates(spark):
    base = [prose(150, i, 2000) for i in range(8)]
    texts = list(base)
    for i in range(4):  # copies with a word changed, and exact ones
        w = base[i].split()
        w[40 + i] = "changed"
        texts.append(" ".join(w))
    texts += [base[0], base[7].upper(), "", None, "", "one two", "one two"]
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in weighted_minhash.near_duplicates(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[8 + i][0] for i in range(4)] == [0, 1, 2, 3] and got[12][0] == 0 and got[13][0] == 7
    assert got[0][1] == 3 and got[5] == (5, 1)
    assert got[14][0] == got[15][0] == got[16][0] == 14 and got[17][0] == got[18][0] == 17


def test_similarity_equals_brute_force(spark):
    idf = np.ones(weighted_minhash.BUCKETS, np.float32)
    a, b = prose(80, 1), prose(80, 1)[:300] + " other words here " + prose(30, 3)

    def brute(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    x, y = brute(a), brute(b)
    want = sum(min(x[k], y[k]) for k in x) / sum(max(x[k], y[k]) for k in {*x, *y})
    got = weighted_minhash.similarity(weighted_minhash._vector(a, idf), weighted_minhash._vector(b, idf))
    assert abs(got - want) < 1e-6


def test_samples_agree_as_often_as_sets_do():
    tables = weighted_minhash._variates(900)
    rng = np.random.default_rng(0)
    both = np.sort(rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64))
    w = rng.uniform(1, 5, 400).astype(np.float32)
    x, y = (both[:350], w[:350]), (both[50:], w[50:])
    same = (weighted_minhash._sample(*x, tables) == weighted_minhash._sample(*y, tables)).mean()
    assert abs(same - weighted_minhash.similarity(x, y)) < 0.06


def test_dense_family_is_joined_as_by_brute_force(spark):
    """Copies at all distances from one text: classes are the components of all links."""
    rng = random.Random(3)
    base = prose(120, 5, 3000).split()
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    own = docs(spark, texts)
    got = {r["doc_id"]: r["class_id"] for r in weighted_minhash.near_duplicates(own).collect()}
    idf = weighted_minhash.word_idf(own.select("text"))
    vectors = [weighted_minhash._vector(t, idf) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if weighted_minhash.similarity(vectors[i], vectors[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert [got[i] for i in range(len(texts))] == label


def test_deduplicate_keeps_one_of_each(spark):
    texts = [prose(50, 1), prose(50, 1), None, "", prose(50, 2), prose(50, 2)]
    left = weighted_minhash.deduplicate(docs(spark, texts, [3, 2, None, None, 9, 9])).collect()
    assert len(left) == 3 and {r["doc_id"] for r in left} == {2, None, 9} and set(left[0].asDict()) == set(SCHEMA.replace(",", "").split()[::2])
    assert weighted_minhash.near_duplicates(docs(spark, ["x"]).where("false")).count() == 0


# packing


def brute_fit(lengths, window):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(window - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(20))
def test_packing_equals_one_by_one(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 5, 16, 100])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(0, 200))]
    used = {}
    for n, lo, hi, each, first, offset in packing.best_fit_decreasing(dict(Counter(lengths)), window):
        for k in range(hi - lo):
            used.setdefault(first + k // each, []).append((offset + k % each * n, n))
    left = []
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        left.append(window - at)
    assert sorted(left) == brute_fit(lengths, window) and sorted(used) == list(range(len(used)))


def test_pack(spark):
    from tokenizers import Tokenizer

    texts = [prose(900, 1), None, "", "Hello, World! x\x1cy", prose(3, 2), prose(3, 2), "don't <|endoftext|> ÀÉ ß, ² ́", "x" * 5000]
    path = tokenizer_file("word_bpe_49k.json")
    rows = packing.pack(docs(spark, texts), path, 256, 1, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert [x for r in own for x in r["ids"]] == want and own[0]["doc_tokens"] == len(want)
        assert all(r["ids_crc32"] == zlib.crc32(array("I", r["ids"]).tobytes()) for r in own)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 256
    assert packing.pack(docs(spark, ["x"]).where("false"), path).count() == 0


# sharding


def test_sharding(spark):
    texts = [prose(random.Random(i).randint(1, 60), i) for i in range(300)] + ["same text"] * 200 + [None, "", None]
    rows = sharding.shard_documents(docs(spark, texts, [*range(500), None, None, 3]), 16).toPandas()
    assert len(rows) == 503 and set(rows.shard) <= set(range(16))
    key = [zlib.crc32((t or "").encode()) for t in texts]
    assert sorted(rows.text_crc32) == sorted(key) and rows.groupby("text_crc32").shard.nunique().max() == 1
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sizes = rows.groupby("shard")["size"].sum()
    assert sizes.max() <= 1.02 * sizes.mean()


def test_one_giant_group(spark):
    rows = sharding.shard_documents(docs(spark, ["a giant text"] * 400 + [prose(5, i) for i in range(60)]), 4).toPandas()
    sizes = rows.groupby("shard")["size"].sum().sort_values().tolist()
    assert len(sizes) == 4 and sizes[2] - sizes[0] <= 60 and sizes[3] == 400 * 13
    assert sharding.shard_documents(docs(spark, ["x"]).where("false")).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_tree_placement_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 300])
    sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 150))]
    used = Counter()
    for size, lo, hi, shard in sharding.best_fit_decreasing(dict(Counter(sizes)), capacity):
        used[shard] += size * (hi - lo)
    assert sorted(capacity - x for x in used.values()) == brute_fit(sizes, capacity)
    assert sharding.best_fit_decreasing({capacity + 1: 1}, capacity) is None


def test_capacity(spark):
    groups = spark.createDataFrame([(i, 10 + i % 7) for i in range(50)], "g int, size long")
    placed = sharding.place_groups(groups, ["g"], "size", capacity=40).toPandas()
    assert placed.groupby("shard")["size"].sum().max() <= 40 and len(placed) == 50
    with pytest.raises(ValueError):
        sharding.place_groups(groups, ["g"], "size", capacity=12)


def test_a_group_that_fills_a_shard_alone(spark):
    groups = spark.createDataFrame([(i, 1_000_000) for i in range(3)] + [(3, 70_000), (4, 930_000)], "g int, size long")
    placed = sharding.place_groups(groups, ["g"], "size", capacity=1_000_000).toPandas()
    assert placed.groupby("shard")["size"].sum().max() <= 1_000_000 and placed.shard.nunique() in (4, 5)
    with pytest.raises(ValueError):
        sharding.place_groups(groups, ["g"], "size", capacity=999_999)


def test_another_tokenizer_gets_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    texts = ["Hello, World!  Two  spaces", "x\ny", "", "it's ÀÉ"]
    library = Tokenizer.from_file(path)
    own = packing.WordIds(path)
    assert not own.by_words and packing.WordIds(tokenizer_file("word_bpe_49k.json")).by_words
    assert [array("I", b).tolist() for b in own(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# pieces


def field(number, value):
    """A field of a serialised message: whole numbers, single-precision ones, bytes."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def model_file(path, pieces_, kind=1, trim=0, charsmap=b""):
    """A small SentencePiece model with byte pieces and the given scores; nothing is trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], *[(p, s, 1) for p, s in pieces_]]
    blob = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in rows)
    blob += field(2, field(3, kind) + field(35, 1) + field(40, 0) + field(41, 1) + field(42, 2))
    blob += field(3, field(1, b"identity") + (field(2, charsmap) if charsmap else b"") + field(3, 1) + field(4, trim) + field(5, 1))
    path.write_bytes(blob)
    return str(path)


def test_unigram_pieces_equal_the_library(tmp_path):
    import sentencepiece

    rng = random.Random(7)
    letters = "abcde▁é"
    vocabulary = {c: -rng.uniform(4, 6) for c in "abcd▁"}
    for _ in range(150):
        p = rng.choice(["", "▁"]) + "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
        vocabulary[p] = -rng.uniform(2, 9)
    vocabulary["▁▁"] = -3.5
    path = model_file(tmp_path / "m.model", list(vocabulary.items()))
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCodec(path)
    assert own.kind == pieces.UNIGRAM
    texts = ["".join(rng.choice(letters.replace("▁", " ")) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    texts += ["", " ", "   a", "a   ", "日本 a", "e" * 30, "abc " * 50]
    for t, blob in zip(texts, own.encode(texts), strict=True):
        assert array("I", blob).tolist() == library.encode(t) and own.decode(blob) == library.decode(library.encode(t))


def test_models_that_cannot_be_read_raise(tmp_path):
    some = [("▁a", -1.0), ("a", -2.0), ("▁", -3.0)]
    for name, made in (("word", {"kind": 3}), ("trim", {"trim": 1}), ("map", {"charsmap": b"x"})):
        with pytest.raises(ValueError):
            pieces.PieceCodec(model_file(tmp_path / name, some, **made))
    with pytest.raises(ValueError):
        pieces.PieceCodec(model_file(tmp_path / "crossing", [*some, ("a▁b", -1.0)]))


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [prose(50, 1), "Hello  world", "  x ", " a\nb\tc", "▁x y", "日本語🙂 a", "", "a" * 900, "it's 12345\0!", " " * 50 + "x", "........................", "İÅßﬁ é", "Le français où ça"]
    own = pieces.codec(path)
    for t, blob in zip(texts, own.encode(texts), strict=True):
        ids = library.encode(t)
        assert array("I", blob).tolist() == ids and own.decode(blob) == library.decode(ids)
    rows = docs(spark, [*texts, None])
    ids = pieces.encode(rows, path)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(ids, path).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate([*texts, None]))
    trip = pieces.round_trip(rows, path).toPandas()
    assert trip.round_trip.all() and len(trip) == len(texts) + 1
    assert pieces.round_trip(rows.where("false"), path).count() == 0


# language and toxicity


def test_language(spark):
    sounds = {"a": "kra zom tuk vel", "b": "ölä üme ßir änü", "c": "сло вод нар бег"}
    rows, truth = [], []
    for i in range(240):
        lang = "abc"[i % 3]
        rng = random.Random(i)
        rows.append((i, " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang, 1.0))
        truth.append(lang)
    rows += [(900, None, "a", 1.0), (901, "", None, 1.0), (902, "12 34 %%", "b", 1.0), (903, rows[0][1] * 300, None, 1.0), (None, rows[1][1], None, 1.0)]
    own = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    found = language_id.identify(own).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == 245
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in range(240) if got[i]["held_out"]]) > 0.95
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] == "a" and got[None]["lang_pred"] == "b"
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert {r["lang_pred"] for r in language_id.identify(own.withColumn("lang", own.lang.substr(9, 1)).where("false")).collect()} == set()


def test_toxicity(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w = prose(rng.randint(20, 200), i, 3000).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(["blockhead", "nitwit", "scumbag", "dunce"])
        rows.append((i, " ".join(w), 1.0))
        labels.append((i, int(toxic)))
    rows += [(500, None, 1.0), (501, "", 1.0), (502, "y" * 100_000, 1.0), (None, "plain", 1.0)]
    labels += [(1, 1), (None, 1), (7, None)]
    own, known = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.classify(own, known).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    held = [i for i in range(400) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.95
    assert not any(got[i]["predicted"] for i in (500, 501, 502, None))
    assert {r["score"] for r in toxicity.classify(own, known.where("false")).collect()} == {0.0}
