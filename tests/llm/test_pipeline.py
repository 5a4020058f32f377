"""The pipeline's stages one after the other, against brute force on a small corpus."""

import random
import re
from collections import Counter

import corpus_pipeline
from tribunal.llm import quality
from tribunal.llm.tokens import tokenizer_path

from .conftest import prose
from .test_operators import ASCII_LOWER, jaccard_brute, secret_brute


def corpus():
    rng = random.Random(21)
    stop = quality.STOP_WORDS
    text = lambda n: " ".join(w if rng.random() < 0.7 else rng.choice(stop) for w in prose(rng, n, 5000))
    rows = [(i, text(rng.randrange(60, 300))) for i in range(40)]
    rows += [(40 + i, rows[i][1].replace("w1", "v1", 1)) for i in range(6)] + [(46, rows[7][1]), (47, rows[7][1])]
    rows += [(50, "short"), (51, None), (52, ""), (53, " ".join("".join(rng.choices("ABCDEFGH", k=6)) for _ in range(200))), (54, " ".join(w + "$$$" for w in text(200).split())), (55, "spam " * 300)]
    item = " ".join(f"b{k}" for k in range(30))
    rows += [(60, f"{text(200)} {item} {text(100)}"), (61, f"{text(80)} {item} {item}"), (62, f"{text(100)} token = abcdef123456 {text(40)} AKIA{'Z' * 16} end")]
    rng.shuffle(rows)
    return rows, item


def test_pipeline(spark, tmp_path):
    rows, item = corpus()
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, d).write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
        seen.append(docs)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    texts = [{r.doc_id: r.text for r in x.collect()} for x in seen[:-1]]
    good = {i: t for i, t in rows if i not in (50, 51, 52, 53, 54, 55)}
    assert texts[0] == good
    one = {c for _, _, c in jaccard_brute(sorted(good.items()), 5, 80)}
    assert texts[1] == {i: t for i, t in good.items() if i in one} and not {46, 47} & set(texts[1]) and len(one) < len(good) - 2
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = {}
    for i, t in texts[1].items():
        if item in t:
            n, hit = len(rule.findall(t.translate(ASCII_LOWER))), 30 * t.count(item)
            if hit > 0.2 * n:
                continue
            t = t.replace(item, "")
        want[i] = t
    assert texts[2] == want and 61 not in want and 60 in want
    for i, t in want.items():
        for _, s, e in reversed(secret_brute(t)):
            t = t[:s] + "[secret]" + t[e:]
        assert texts[3][i] == t and (i != 62 or t.count("[secret]") == 2)
    assert all(r.n_chars == len(r.text) for r in seen[3].collect())
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    total = Counter()
    for r in seen[4].collect():
        total[r.doc_id] += r.length
    assert total == Counter({i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in texts[3].items()})
    whole = corpus_pipeline.run(spark, d)
    assert whole.groupBy().sum("length").first()[0] == sum(total.values())


def test_pipeline_keeps_rows_of_shared_or_missing_ids(spark, tmp_path):
    """Clean texts of one id or none all stay, copies don't; columns whose names occur inside the stages come through; empty tables give empty results."""
    rng = random.Random(22)
    stop = quality.STOP_WORDS
    text = lambda n: " ".join(w if rng.random() < 0.7 else rng.choice(stop) for w in prose(rng, n, 5000))
    texts = [text(rng.randrange(60, 200)) for _ in range(30)]
    rows = [(None, t) for t in texts[:12]] + [(5, t) for t in texts[12:20]] + [(10 + k, t) for k, t in enumerate(texts[20:])]
    rows += [(None, texts[3]), (5, texts[3]), (11, texts[12]), rows[0], (None, None), (7, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, sk string, root string, spans string, token string, __spans string"
    frame = lambda x: spark.createDataFrame([(i, t, "en", "s", len(t or ""), *"abcde") for i, t in x], schema)
    for name, some in (("full", rows), ("none", [])):
        d = str(tmp_path / name)
        frame(some).repartition(3).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "not in any text " * 5)] if some else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, docs, d).write.parquet(f"{d}/stage{k}")
            docs = spark.read.parquet(f"{d}/stage{k}")
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        left = Counter(r.text for r in docs.collect())
        assert left == (Counter(texts) if some else Counter())
        assert corpus_pipeline.run(spark, d).select("doc_id").distinct().count() == (12 if some else 0)
