"""The pipeline's stages on a planted corpus, and the entry module's guard."""

import random
import subprocess
import sys
import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from lattice_spectra.llm import oracles, queries
from lattice_spectra.llm.common import materialize


def prose(n, seed, sounds):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


SOUNDS = {"a": "kra zom tuk vel dar".split(), "b": "ölä üme ßir änü hö".split()}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(300):
        lang = "ab"[i % 2]
        words = prose(80 + i % 40, i, SOUNDS[lang]).split()
        toxic = i % 6 == 0
        if toxic:
            for j in range(4):
                words[5 + 17 * j] = ["scumbag", "nitwit", "dunce", "blockhead"][(i + j) % 4]
        rows.append((i, " ".join(words), lang, "s", 1.0))
        labels.append((i, int(toxic)))
    clean = [i for i in range(300) if i % 6]
    passage = prose(120, 999, SOUNDS["a"])
    for n, i in enumerate(clean[:6]):
        rows.append((1000 + n, rows[i][1], rows[i][2], "s", 1.0))  # exact copies
        w = rows[clean[20 + n]][1].split()
        w[30] = "zomzom"
        rows.append((1100 + n, " ".join(w), rows[clean[20 + n]][2], "s", 1.0))  # near copies
        rows.append((1200 + n, prose(300, 5000 + n, SOUNDS["a"]) + " " + passage, "a", "s", 1.0))
    rows += [(2000, None, "a", "s", 1.0), (2001, "", "a", "s", 1.0), (2002, "12 %% 77", "b", "s", 1.0)]
    own = [(i, t, lang, s, len(t) if t else None, x) for i, t, lang, s, x in rows]
    spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, passage


def test_stages(spark, corpus):
    folder, rows, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {i: t for i, t, *_ in rows}
    seen = [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, folder), name)
        assert after.columns == docs.columns
        docs = after
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert seen[0] - seen[1] == {2000, 2001, 2002}
    gone = seen[1] - seen[2]
    toxic = {i for i in range(300) if i % 6 == 0}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 3
    left = seen[3]
    assert not any(1000 + n in left or 1100 + n in left for n in range(6)) and all(1200 + n in left for n in range(6))
    assert len(seen[2] - left) == 12
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert seen[4] == left and all(passage[20:-20] not in kept[1200 + n]["text"] and len(kept[1200 + n]["text"]) > 300 for n in range(6))
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    untouched = [i for i in left if i < 300]
    assert sum(kept[i]["text"] == texts[i] for i in untouched) >= len(untouched) - 2
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    for i in untouched[:20]:
        own = sorted((r for r in packed if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(tokenizer.encode(kept[i]["text"], add_special_tokens=False).ids) + 1
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_passages_of_just_over_fifty_words_are_cut(spark):
    short = [w for w in prose(2000, 800, SOUNDS["a"]).lower()[:-1].split() if len(w) <= 6]
    passages = [" ".join(short[80 * i : 80 * i + n]) for i, n in enumerate((51, 53, 57, 59, 65))]
    assert all(n <= len(p.encode()) < 400 for p, n in zip(passages, (200, 200, 250, 250, 300), strict=True))
    rows = [(10 * i + j, f"{prose(90, 6000 + 10 * i + j, SOUNDS['a'])} {p} {prose(90, 7000 + 10 * i + j, SOUNDS['a'])}") for i, p in enumerate(passages) for j in range(2)]
    rows.append((900, prose(40, 7999, SOUNDS["a"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert kept.keys() == {i for i, _ in rows} and kept[900] == rows[-1][1]
    for i, p in enumerate(passages):
        for j in range(2):
            before, after = rows[2 * i + j][1].split(p)
            # what stands around both copies alike, at least the two spaces, may go as well
            assert p[10:-10] not in kept[10 * i + j] and before[:-12] in kept[10 * i + j] and after[12:] in kept[10 * i + j]


def test_empty_tables(spark, corpus, tmp_path):
    folder, *_ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert queries.QUERIES["op2_toxicity"](spark, str(tmp_path)).count() == 0 and queries.QUERIES["op4_language"](spark, str(tmp_path)).count() == 0


def test_stages_with_repeated_rows_nulls_and_long_texts(spark):
    """Each stage alone: repeated rows, null ids and texts, a text of a megabyte, and columns named as operators name theirs."""
    long = prose(180_000, 71, SOUNDS["a"])
    rows = [(1, prose(90, 1, SOUNDS["a"]), "a", 0.5), (1, prose(90, 1, SOUNDS["a"]), "a", 0.5), (None, prose(90, 2, SOUNDS["b"]), None, None), (None, None, None, None), (3, "", "a", 1.0), (4, long, "a", 2.0), (5, long, "b", 2.0), (6, prose(80, 6, SOUNDS["a"]) + long[3000:4000], "a", 2.0)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, lang string, score double, node long, start int")
    left = materialize(corpus_pipeline.near_duplicates(spark, docs, ""), "left")
    assert left.columns == docs.columns and sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in left.collect()) == sorted([(1, len(rows[0][1])), (0, len(rows[2][1])), (3, 0), (4, len(long)), (6, len(rows[7][1]))])
    cut = corpus_pipeline.repeated_passages(spark, left, "")
    assert cut.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert len(kept) == 5 and kept[3] == "" and 900 <= len(long) - len(kept[4]) <= 1100 and len(kept[6]) < len(rows[7][1]) - 900 and kept[1] == rows[0][1]
    pieces = corpus_pipeline.packed(spark, left, "").collect()
    assert {r["doc_id"] for r in pieces} == {1, None, 3, 4, 6} and max(r["start"] + r["length"] for r in pieces if r["doc_id"] == 4) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == 4)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "repeats", "packing"]
    assert set(oracles.ORACLES) <= set(queries.QUERIES) and sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_top_k_equals_sql(spark):
    from tests.test_registered import SF, same, sql_rows  # noqa: PLC0415

    same(queries.QUERIES["op1_exact_top_k"](spark, SF).toPandas(), sql_rows(SF, oracles.ORACLES["op1_exact_top_k"]))


def test_entry_without_the_folder():
    code = "import sys; sys.modules['lattice_spectra.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[2])


def test_held_out_rows_are_told_by_hash(spark, corpus):
    folder, *_ = corpus
    rows = queries.QUERIES["op2_toxicity"](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
