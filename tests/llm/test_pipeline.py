"""The whole pipeline against brute force on a small corpus."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from evidentia.llm import language_id, mixing

from . import helpers as H


def test_run(spark, tmp_path):
    rows = H.corpus(9, 150)
    H.docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r[0]: r for r in rows}

    found = H.by_id(language_id.identify(docs, language_id.fit(docs.where(~language_id.held_out(docs.doc_id)))))
    kept = {i: r for i, r in kept.items() if found[i].lang_pred != "und" and found[i].score >= P.SURE}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}

    last = {}
    for i, r in kept.items():
        last[r[1]] = max(i, last.get(r[1], -1))
    kept = {i: r for i, r in kept.items() if last[r[1]] == i}
    near = H.brute_near(list(kept.values()), 5)
    kept = {i: r for i, r in kept.items() if near[i][1] == i}
    drawn = H.by_id(mixing.mix(H.docs(spark, list(kept.values())), fraction=P.FRACTION, power=P.POWER))
    kept = {i: r for i, r in kept.items() if drawn[i].kept}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1 for i, r in kept.items()}
    got: dict = {}
    for r in P.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and len(got) > 10


def test_stages_return_documents(spark):
    for rows in ([], H.corpus(1, 20), [(None, None, None, None, None), (3, "", None, None, 0), (3, "some words", "en", None, 0)]):
        docs = H.docs(spark, rows)
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.dtypes == H.docs(spark, []).dtypes
        P.STAGES[-1][1](spark, docs, "").collect()


def test_near_copies_without_id_stay(spark):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(1, long, "en", "s", 0), (2, long + " more", "en", "s", 0), (None, long + " other", None, None, None), (None, long, None, None, None)]
    kept = P.drop_near_copies(spark, H.docs(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(0, long + " other"), (0, long), (1, long)])


def test_foreign_and_random_texts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    foreign = [
        "Wczoraj poszliśmy na długi spacer po lesie i zobaczyliśmy wiele zwierząt.",
        "昨天我们去森林里散步，看到了很多动物。",
        "Вчера мы долго гуляли по лесу и видели много животных.",
        "Tegnap hosszú sétát tettünk az erdőben és sok állatot láttunk.",
    ]
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k)) for k in (50, 100, 300, 1000) for _ in range(50)]
    clean = ["Hello world", "the house", "Yesterday we went for a long walk in the forest.", "Hier nous avons fait une longue promenade dans la forêt."]
    added = [(10_000_000 + i, t, None, "x", len(t)) for i, t in enumerate([*foreign, *noise, *clean])]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(H.docs(spark, added))
    left = P.identify_language(spark, both, "")
    kept = {r.doc_id for r in left.select("doc_id").collect()}
    texts = {i: t for i, t, *_ in added}
    assert {texts[i] for i in kept if i in texts} == set(clean)
    assert sum(i < 10_000_000 for i in kept) >= 0.99 * docs.count()
