"""What workers hold after their tasks."""

import pyarrow as pa

from tribunal.llm import packing, token_counts
from tribunal.llm.tokens import REST, PieceCache, split_words, tokenizer_path, word_parts

WORD, BPE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def held(spark):
    """The pieces and parts that the workers' caches hold now, at most."""

    def run(batches):
        from tribunal.llm import tokens

        for b in batches:
            caches = list(tokens._CACHES.values())
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([max((len(c._pieces) for c in caches), default=0)]), pa.array([max((len(c._known) for c in caches), default=0)])], ["n", "pieces", "parts"])

    found = spark.range(0, 16, 1, 16).mapInArrow(run, "n long, pieces long, parts long").collect()
    return max(r.pieces for r in found), max(r.parts for r in found)


def test_workers_keep_little_of_a_task(spark):
    words = [f"{'abcdefghij'[k % 10]}q{k}x" for k in range(REST + 30_000)]
    docs = spark.createDataFrame([(k, " ".join(words[k * 1000 : k * 1000 + 1000] * 2)) for k in range(len(words) // 1000)], "doc_id long, text string").coalesce(1)
    assert packing.pack(docs, WORD).where("start = 0").count() == docs.count()
    pieces, parts = held(spark)
    assert pieces <= REST and parts == 0
    assert token_counts.count_tokens(docs, BPE, f"{spark.conf.get('spark.checkpoint.dir')}/cache-lean").count() == docs.count()
    pieces, parts = held(spark)
    assert pieces <= REST and parts == 0


def test_ids_are_right_after_a_rest(monkeypatch):
    monkeypatch.setattr("tribunal.llm.tokens.REST", 50)
    cache = PieceCache(WORD, split_words, word_parts)
    for turn in range(4):
        texts = [" ".join(f"word{(k * 7 + turn * i) % 90}, once{turn}-{k}-{i}" for i in range(20)) for k in range(40)]
        ids, at = cache.ids(texts)
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids
        cache.rest()
        assert len(cache._pieces) == len(cache._len) == len(cache._seen) <= 50
