"""Each operator against a brute-force version, over nulls, empties, long texts, copies, repeated rows and clashing columns; and over empty tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tribunal.llm import automata, chat, decontamination, jaccard, lm_scores, packing, quality, repeats, secrets, substring_dedup, suffix_dedup, token_counts
from tribunal.llm.common import shared_dir
from tribunal.llm.components import components
from tribunal.llm.repeats import Repeats
from tribunal.llm.tokens import PieceCache, spaced_parts, split_before_spaces, split_words, tokenizer_path, word_parts

from .conftest import prose

WORD, BPE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- 1


def test_scores(docs, texts, none):
    all_words = [words((t or "").translate(ASCII_LOWER)) for _, t in texts]
    grams = [[tuple(w[max(0, i - k + 1) : i + 1]) for k in (1, 2, 3) for i in range(k - 1, len(w))] for w in all_words]
    total, n = Counter(g for x in grams for g in x), sum(map(len, all_words))
    want = Counter()
    for (i, _), w, own in zip(texts, all_words, map(Counter, grams), strict=True):
        left = lambda g: total[g] - own[g]  # noqa: B023, E731
        score, levels = 0, [0, 0, 0]
        for j in range(len(w)):
            m = min(j, 2)
            for k in range(m + 1, 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if k == 1 or left(g) > 0:
                    ratio = max(left(g), 1) / max(n - len(w), 1) if k == 1 else left(g) / left(g[:-1])
                    score += round((math.log(ratio) + (m + 1 - k) * math.log(0.4)) * 1e6)
                    levels[k - 1] += 1
                    break
        want[i, len(w), score, *levels] += 1
    names = ["doc_id", "n_words", "score_micro", "n_order_1", "n_order_2", "n_order_3"]
    assert rows(lm_scores.score(docs), *names) == want
    assert lm_scores.score(none).count() == 0


# --- 2


def open_pieces(some, last):
    """The pieces of the document that ends with `last`: back to its start."""
    k = next(n for n, r in enumerate(some) if r is last)
    j = k
    while some[j].start:
        j -= 1
    return some[j : k + 1]


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(docs, texts, none, size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    got = packing.pack(docs, WORD, size).toPandas()
    spans = got.sort_values(["sequence_id", "offset"])
    assert (spans.groupby("sequence_id").length.sum() <= size).all()
    assert (spans.offset == spans.groupby("sequence_id").length.cumsum() - spans.length).all()
    crc = lambda x: zlib.crc32(b"".join(y.to_bytes(4, "little") for y in x))
    # each document in pieces without gap or overlap, the ids in order: documents of one id by their length and pieces
    left = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [1])) for i, x in texts)
    pieces = defaultdict(list)
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        pieces[None if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), r.doc_tokens].append(r)
    for (i, n), some in pieces.items():
        at = 0
        for r in some:  # a task packs whole documents one after the other
            assert r.start == at, (i, r.start, at)
            at = (at + r.length) % n
            if at == 0:
                whole = [d for (j, d), m in left.items() if j == i and len(d) == n and m and all(crc(d[q.start : q.start + q.length]) == q.ids_crc32 for q in open_pieces(some, r))]
                assert whole, (i, n)
                left[i, whole[0]] -= 1
        assert at == 0
    assert not +left
    sizes = got.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else size - n for n in sizes[:-1])
    assert size < 2048 or padding <= 0.05 * sizes.sum() + 3 * size  # an unfinished sequence for each of three tasks
    assert packing.pack(none, WORD).count() == 0


def test_cuts_are_the_cheapest():
    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        gaps = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 30))]
        at = np.concatenate(([0], np.cumsum(gaps)))
        pen = np.array([0] + [rng.choice([0, 8, 64]) for _ in gaps])
        size = 16
        cost = lambda i, j: (0 if (n := int(at[j] - at[i])) & (n - 1) == 0 else size - n) + int(pen[j]) + packing.SEQUENCE  # noqa: B023, E731
        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost(i, j) for i in range(j) if at[j] - at[i] <= size)
        path = packing.cut_windows(at, pen, size, True)
        assert path[0] == 0 and path[-1] == len(at) - 1
        assert sum(cost(i, j) for i, j in zip(path, path[1:], strict=False)) == best[-1]


# --- 3


def suffix_brute(texts, width):
    first: dict[bytes, int] = {}
    big = 1 << 62
    for i, t in texts:
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            k = b[s : s + width]
            first[k] = min(first.get(k, big), big if i is None else i)
    out = Counter()
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < (big if i is None else i):
                gone[s : s + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)] += 1
    return out


SUFFIX = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_dedup(docs, texts, none, spark):
    want = suffix_brute(texts, 50)
    for shares in ((1.0,), (0.6, 0.4), (0.3, 0.3, 0.4)):
        assert rows(suffix_dedup.remove_repeated_bytes(docs, shares=shares), *SUFFIX) == want
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    kept = suffix_dedup.remove_repeated_bytes(docs, text=True).select("kept", "kept_sha256").collect()
    assert all(sha(r.kept) == r.kept_sha256 for r in kept)


def test_suffix_levels_grow_batch_by_batch(docs, texts, spark):
    """Batches in any order: those of an earlier one come first. Each opens the levels again, as another session would; sizes fall by half or more."""
    of = lambda i: 4 if i is None else (i * 7) % 5
    rank = lambda i: of(i) * 1000 + (999 if i is None else i)
    want = Counter({(texts_of[k[0]], *k[1:]): n for k, n in suffix_brute([(rank(i), t) for i, t in texts], 50).items()} if (texts_of := {rank(i): i for i, _ in texts}) else {})
    path, got, history = f"{shared_dir(spark)}/levels-{random.random()}", Counter(), None
    for k in range(5):
        batch = docs.where(F.coalesce(F.pmod(F.col("doc_id") * 7, F.lit(5)), F.lit(4)) == k)
        levels = suffix_dedup.SuffixLevels(spark, path)
        got += rows(levels.add(batch, history), *SUFFIX)
        history = batch if history is None else history.unionByName(batch)
        for _, n in levels.levels.live:
            spark.sql(f"DROP TABLE {n}")  # as if this session had not made it
    assert got == want
    before = sum(n for n, _ in levels.levels.live)
    levels._settle()  # as the next batch would
    live = levels.levels.live
    assert sum(n for n, _ in live) == before and all(a[0] >= 2 * b[0] for a, b in zip(live, live[1:], strict=False))
    hs = [tuple(r) for _, n in live for r in levels.levels.table(n).select("a", "h").collect()]
    assert len(hs) == sum(n for n, _ in live)


@pytest.mark.parametrize("shares", [(1.0,), (0.25,) * 4])
def test_small_windows_by_brute_force(spark, shares):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 90)))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = suffix_dedup.remove_repeated_bytes(docs, Repeats("byte", 9, 4, True), shares=shares)
    assert rows(got, *SUFFIX) == suffix_brute(texts, 9)


#: The Thue-Morse word of 2^10 letters and its complement: equal under any polynomial modulo 2^64.
MORSE = ["".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(1 << 10)) for flip in (0, 1)]


def test_words_that_sums_modulo_a_power_of_two_cannot_tell_apart(spark):
    import numpy as np

    from tribunal.llm.text import Runs, word_hashes

    data = np.frombuffer("".join(MORSE).encode(), np.uint8)
    assert len(set(word_hashes(data, np.array([0, 1024]), np.array([1024, 2048])).tolist())) == 2
    for units in (np.array([3, 2**63 + 5], np.uint64), np.array([1, 2], np.uint64)):
        both = np.concatenate([units[[int(x == "b") for x in w]] for w in MORSE])
        for k in (64, 256, 1024):
            assert len(set(Runs(both).of(np.array([0, 1024]), np.array([k, 1024 + k])).tolist())) == 2
    rng = random.Random(30)
    texts = [(k, " ".join([w, *prose(rng, 40, 10**6)])) for k, w in enumerate(MORSE)] + [(2, MORSE[0]), (3, MORSE[1])]
    texts += [(4 + k, " ".join([w] * 40)) for k, w in enumerate(MORSE)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(jaccard.groups(docs, jaccard.CONTRACT), "doc_id", "n_shingles", "component_id") == jaccard_brute(texts, 4, 85)
    assert rows(removed_words(docs), "doc_id", "n_units", "n_removed", "kept_sha256") == words_brute(texts)
    few = lm_scores.score(docs.where("doc_id in (2, 3)")).collect()
    assert all(r.score_micro == 0 for r in few)  # each is a word of its own, once in the other's text of one word


@pytest.mark.parametrize("spec", [Repeats("byte", 50, 24, True), substring_dedup.WORDS], ids=["bytes", "words"])
@pytest.mark.parametrize("shared", [100_000, 0])
def test_many_rows_without_id(spark, monkeypatch, spec, shared):
    """Different texts under one doc_id or none, in pairs that agree in 16 bits of a digest: one with unclear windows, one of other length that has none."""
    rng = random.Random(16)
    passage = prose(rng, 200, 10**6)
    digest, known, pairs = lambda t: hashlib.blake2b(t.encode(), digest_size=2).digest(), {}, []
    while len(pairs) < 30:
        at = rng.randrange(0, 150)
        t = " ".join([*prose(rng, rng.randrange(5, 20), 10**6), *passage[at : at + rng.randrange(38, 50)], *prose(rng, rng.randrange(5, 200), 10**6)])
        if (other := known.setdefault(digest(t), t)) != t:
            pairs.append((other, t))
    texts = [(0, " ".join(passage))] + [(None if k % 3 else 5, t) for k, both in enumerate(pairs) for t in both]
    texts += [texts[2], texts[2], (5, pairs[1][0]), texts[1]]
    monkeypatch.setattr(repeats, "SHARED", shared)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    if spec.first_stays:
        assert rows(suffix_dedup.remove_repeated_bytes(docs, spec), *SUFFIX) == suffix_brute(texts, 50)
    else:
        got = removed_words(docs, spec)
        assert rows(got, "doc_id", "n_units", "n_removed", "kept_sha256") == words_brute(texts)


def test_equal_rows_are_resolved_once(spark):
    """Thousands of rows of one text, of no id, next to rows that share a part of it, in time that grows with the rows."""
    rng = random.Random(31)
    text = " ".join(prose(rng, 400, 10**6))
    part = " ".join(words(text)[100:180])
    texts = [(1, f"before {part} after"), (2, " ".join(prose(rng, 60, 10**6))), (3, "short"), (3, "short")] + [(None, text)] * 4000
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    seen = texts[:4] + [(None, text)] * 2
    many = lambda want: Counter({k: 4000 if k[0] is None else n for k, n in want.items()})
    assert rows(suffix_dedup.remove_repeated_bytes(docs), *SUFFIX) == many(suffix_brute(seen, 50))
    assert rows(removed_words(docs), "doc_id", "n_units", "n_removed", "kept_sha256") == many(words_brute(seen))


def test_a_batch_that_failed_leaves_no_matches(spark, docs, texts, monkeypatch):
    index = substring_dedup.FingerprintIndex(spark, f"{shared_dir(spark)}/failing-{random.random()}", most=2)
    parts = [docs.where(F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)) == k) for k in range(3)]
    index.add(parts[0])
    with monkeypatch.context() as m:
        m.setattr(index.runs, "commit", lambda live: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(docs)
    for p in parts[1:]:
        index.add(p)
    assert rows(index.remove_repeats(docs), "doc_id", "n_units", "n_removed", "kept_sha256") == words_brute(texts)
    index.runs.drop()


# --- 4


def decontaminate_brute(texts, items, width):
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for name, t in items:
        w = rule.findall((t or "").translate(ASCII_LOWER))
        k = min(width, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(name)
    out = Counter()
    for i, t in texts:
        w, hit, found = rule.findall((t or "").translate(ASCII_LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    found |= windows[tuple(w[s : s + k])]
        out[i, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))] += 1
    return out


def test_decontamination(docs, texts, none, spark):
    by_id = {i: t for i, t in texts}
    items = [(1, by_id[5]), (2, " ".join(words(by_id[41])[25:60])), (10, "the end"), (3, None), (4, ""), (None, by_id[6]), (5, "漢字"), (1, by_id[8]), (6, "w1 w2 w3 not there at all in any of the texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = decontaminate_brute(texts, items, 10)
    shape = lambda df: Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r["spans"]), tuple(r["items"])) for r in df.collect())
    assert shape(decontamination.find_contamination(docs, bench)) == want
    assert shape(decontamination.find_contamination(docs, bench, block_bytes=300)) == want  # several blocks
    assert decontamination.find_contamination(none, bench).count() == 0
    assert shape(decontamination.find_contamination(docs, bench.limit(0))) == decontaminate_brute(texts, [], 10)
    left = decontamination.cleaned(docs, bench)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()
    assert all(r.n_words == 0 or sum(s.end - s.start for s in r["spans"]) <= 1 for r in decontamination.find_contamination(left, bench.where("item_id = 2")).collect())


def test_cleaned_by_blocks(docs, texts, spark):
    """Several blocks cut what one cuts: documents with 15 % of two items each, windows that overlap, and texts that meet when what is between them goes."""
    rng = random.Random(14)
    items = [" ".join(f"i{k}x{j}" for j in range(15)) for k in range(40)]
    more = [(1000 + k, " ".join([*prose(rng, 35), items[2 * k], *prose(rng, 35), items[2 * k + 1]])) for k in range(20)]
    more += [(1100 + k, " ".join([*prose(rng, 300), f"j{k}", *words(items[k])[:11], f"k{k}"])) for k in range(40)]
    more += [(1200 + k, " ".join([*prose(rng, 300), *words(items[k])[:5], items[k + 1], *words(items[k])[5:]])) for k in range(39)]
    bench = [(k, x) for k, x in enumerate(items)] + [(100 + k, " ".join([*[f"p{k}x{j}" for j in range(5)], f"j{k}", *words(items[k])[:8]])) for k in range(40)]
    more += [(1300 + k, " ".join([*prose(rng, 300), *[f"p{k}x{j}" for j in range(5)], f"j{k}", *words(items[k])])) for k in range(40)] + [(None, more[0][1]), (None, more[60][1]), more[61], more[61]]
    both = docs.select("doc_id", "text", "spans").unionByName(spark.createDataFrame([(*x, "s") for x in more], "doc_id long, text string, spans string"))
    bench = spark.createDataFrame(bench, "item_id long, text string")
    want = rows(decontamination.cleaned(both, bench), "doc_id", "text", "spans")
    got = decontamination.cleaned(both, bench, block_bytes=300)
    assert got.columns == both.columns and rows(got, *both.columns) == want
    assert not any((i, t, "s") in want for i, t in more[:20]) and len(want) > 100


# --- 5


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<|im_end|>", "<|im_sep|>", "\\", "<", "[", "\n", "é", "", "ok", "<|x|>", "|>", "im_end", "$1", "\\1", "<\\/s>"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", None, "<|im_sep|>", "a\nb"]), rng.choice([None, "".join(rng.choices(parts, k=rng.randrange(0, 9)))])) for c in [*range(40), None] for t in range(rng.randrange(1, 7))]
    turns += [turns[0], turns[0]]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x")).withColumn("shown", F.lit(1))
    shown = chat.format_chats(chat.canonical(df))
    back = {r.conv_id: r for r in chat.read_chats(shown).collect()}
    for c in {x[0] for x in turns}:
        own = sorted((t, r or "", x or "") for k, t, r, x in turns if k == c)
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in own]
        assert back[c].learned == [x for _, r, x in own if r == "assistant"]
    for r in shown.collect():
        assert r.formatted.count(chat.END) == r.n_turns and "</s>" not in r.formatted and "[INST]" not in r.formatted
    assert chat.format_chats(chat.canonical(df.limit(0))).count() == 0


def test_chat_layouts(spark):
    rows_ = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]},
        {"prompt": "q", "completion": "r"}, {"prompt": "q", "response": "r"}, {"instruction": "q", "output": "r"}, {"instruction": "q", "input": "", "output": "r"},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(rows_)] + [(99, "no json"), (98, '{"a": 1}'), (97, None)], "conv_id long, value string")
    got = chat.canonical_json(df).collect()
    assert Counter((r.conv_id, r.turn, r.role, r.text) for r in got) == Counter((i, k, *x) for i in range(len(rows_)) for k, x in enumerate([("user", "q"), ("assistant", "r")]))
    assert {r.conv_id for r in chat.unmatched_json(df).collect()} == {97, 98, 99}
    odd = [
        '{"messages": [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "r"}], "id": 7, "system": null}', '{"instruction": "q", "input": null, "output": "r", "tags": [1]}',
        '{"conversations": [{"from": "human", "value": "q", "at": 1}, {"from": "gpt", "value": "r"}]}', '{"messages": [{"role": "user", "content": [1]}]}', '{"messages": []}', '{"messages": "q"}', '{"prompt": 3, "response": "r"}', "[1]",
    ]
    df2 = spark.createDataFrame(list(enumerate(odd)), "conv_id long, value string")
    assert Counter((r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_json(df2).collect()) == Counter((i, k, *x) for i in range(3) for k, x in enumerate([("user", "q"), ("assistant", "r")]))
    assert {r.conv_id for r in chat.unmatched_json(df2).collect()} == {3, 5, 6, 7}  # the empty list is a conversation without turns
    nested = [
        '{"messages": [{"role": "user", "meta": {"content": "lost"}}]}', '{"messages": [{"meta": {"role": "user", "content": "lost"}}]}', '{"messages": [{"role": "user", "content": "q"}], "prompt": "p", "completion": "c"}',
        '{"prompt": "p", "completion": "c", "response": "r"}', '{"messages": [{"role": "user", "content": "q"}], "instruction": "i", "input": "x", "output": "o"}', '{"messages": [{"role": "user", "content": "q"}, "more"]}',
        '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": {"text": "r"}}]}',
    ]
    kept = ['{"messages": [{"role": "user", "content": "q", "meta": {"content": "z"}}, {"role": "assistant", "content": "r"}]}', '{"instruction": "q", "input": "", "output": "r", "messages": 3}', '{"messages": [null, null]}', '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant"}]}']
    df3 = spark.createDataFrame(list(enumerate(nested + kept)), "conv_id long, value string")
    assert {r.conv_id for r in chat.unmatched_json(df3).collect()} == set(range(len(nested)))
    got = Counter((r.conv_id - len(nested), r.turn, r.role, r.text) for r in chat.canonical_json(df3).collect())
    assert got == Counter([(0, 0, "user", "q"), (0, 1, "assistant", "r"), (1, 0, "user", "q"), (1, 1, "assistant", "r"), (2, 0, "", ""), (2, 1, "", ""), (3, 0, "user", "q"), (3, 1, "assistant", "")])
    with pytest.raises(ValueError, match="several layouts"):
        chat.layout_of(spark.createDataFrame([], "prompt string, completion string, response string").schema)
    for i, x in enumerate(rows_):
        one = spark.read.json(spark.sparkContext.parallelize([json.dumps(x | {"other": 3})])).withColumn("conv_id", F.lit(i).cast("long"))
        assert [(r.role, r.text) for r in chat.canonical(one).orderBy("turn").collect()] == [("user", "q"), ("assistant", "r")]
    with pytest.raises(ValueError):
        chat.layout_of(df.schema)


# --- 6


def test_quality(docs, texts, none):
    want = Counter()
    for i, t in texts:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        triples = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {k + o for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for o in range(3)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)] += 1
    names = ["__q_" + s for s in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    assert rows(quality.with_signals(docs), "doc_id", *names) == want
    left = quality.keep_good(docs, quality.BASE)
    assert left.columns == docs.columns
    assert rows(left, "doc_id") == Counter({(i,): n for i, n in Counter(k[0] for k in want.elements() if k[1] >= 50 and 2 * k[5] <= k[1]).items()})
    assert quality.keep_good(none).count() == 0


# --- 7


def secret_brute(t):
    kinds = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    out = []
    for n, (k, p) in enumerate(kinds):
        for m in re.finditer(p, t, re.ASCII):
            if len(m[1]) >= 6 if k == "assign" else len(m[0]) >= (20 if k == "access" else 24):
                out.append((m.start(), n, m.end(), k))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def test_secrets(spark, docs, none):
    rng = random.Random(1)
    bits = ["token", "=", ":", "secret", " ", '"', "'", "abcdef", "ab", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "api_key", "apikey", "PASSWORD", "é", "\n", "passwd", ".", "-", "ſ"]
    texts = [(i, "".join(rng.choices(bits, k=rng.randrange(0, 14)))) for i in range(3000)] + [(None, None), (1, ""), (2, "é" * 50_000 + "secret: hunter2hunter2")]
    found = secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"))
    base = {r.kind for r in secrets.BASE}
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind in base)) for r in found.collect())
    assert got == Counter((i, tuple(secret_brute(t or ""))) for i, t in texts)
    keys = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "AIza" + "x" * 35, "xoxb-1234567890-abcdefghij"]
    clean = secrets.redact(docs.limit(1).withColumn("text", F.lit(f"a {' b '.join(keys)} c")))
    assert clean.columns == docs.columns and clean.first().text == "a [secret] b [secret] b [secret] b [secret] c"
    assert secrets.redact(docs).count() == docs.count() and secrets.find_secrets(none).count() == 0


def test_automata_agree_with_regexes():
    import numpy as np

    rng = random.Random(2)
    patterns = ["ab+c?", "(a|bc){2,3}", "[^a]b", "(?i:ax)|c{2}", "a.b".replace(".", "\\."), "(ab|a)(c|bc)"]
    one = automata.compile_rules([automata.parse(p) for p in patterns], True)
    for _ in range(300):
        s = "".join(rng.choices("abcxA.", k=rng.randrange(0, 12))).encode()
        data = np.frombuffer(s, np.uint8)
        _, ends, states = automata.scan(one, data, np.array([0, len(s)]))
        got = {(int(e), k) for e, st in zip(ends, states, strict=True) for k in range(len(patterns)) if one.accepts[st] >> k & 1}
        want = {(e, k) for k, p in enumerate(patterns) for e in range(1, len(s) + 1) if any(re.fullmatch(p.encode(), s[b:e]) for b in range(e))}
        assert got == want


# --- 8


def jaccard_brute(texts, size, percent):
    sets = []
    for _, t in texts:
        w = words((t or "").translate(ASCII_LOWER))
        sets.append(set(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = top(x), top(y)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        least[top(k)].append(1 << 63 if i is None else i)
    low = [min(least[top(k)]) for k in range(len(texts))]
    return Counter((i, len(s), None if m == 1 << 63 else m) for (i, _), s, m in zip(texts, sets, low, strict=True))


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 40)])
def test_jaccard(docs, texts, none, size, percent):
    spec = jaccard.Shingles(size, percent)
    assert rows(jaccard.groups(docs, spec), "doc_id", "n_shingles", "component_id") == jaccard_brute(texts, size, percent)
    assert jaccard.groups(none, spec).count() == 0


def test_large_family_of_near_copies(spark, monkeypatch):
    """Chains and stars of edits, with rounds of leaders and without."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    family = [base]
    for _ in range(250):
        w = list(rng.choice(family[-40:]))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        family.append(w)
    texts = [(i, " ".join(w)) for i, w in enumerate(family)]
    docs, want = spark.createDataFrame(texts, "doc_id long, text string"), jaccard_brute(texts, 4, 85)
    assert rows(jaccard.groups(docs, jaccard.CONTRACT), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    assert rows(jaccard.groups(docs, jaccard.CONTRACT), "doc_id", "n_shingles", "component_id") == want


def test_keep_one(docs, texts):
    """Of the texts (not the ids, which some rows share or lack) one of each component stays, and all without words do."""
    left = jaccard.keep_one(docs, jaccard.Shingles(5, 80))
    assert left.columns == docs.columns
    number = [(k, t) for k, (_, t) in enumerate(texts)]
    component = defaultdict(set)
    for i, n, c in jaccard_brute(number, 5, 80):
        component[c].add(i) if n else None
    got = Counter(r.text for r in left.select("text").collect())
    assert sum(n for t, n in got.items() if words(t)) == len(component)
    assert all(sum(got[t] for t in {texts[k][1] for k in of}) == 1 for of in component.values())
    assert {t: n for t, n in got.items() if not words(t)} == Counter(t for _, t in texts if not words(t))


def test_keep_one_of_each_component(spark):
    """Texts, not ids: unrelated texts under one doc_id or none each stay; of copies, the one of the smallest doc_id."""
    rng = random.Random(15)
    t = [" ".join(prose(rng, 60, 10**6)) for _ in range(12)]
    given = [(3, t[0]), (5, t[0]), (5, t[1]), (7, t[2]), (7, t[3]), (7, t[3]), (9, t[4] + " more"), (8, t[4]), (None, t[4]), (10, ""), (10, None), (None, " "), (None, None), (None, None)]
    given += [(None, x) for x in [*t[5:], t[5], t[6]]]
    left = jaccard.keep_one(spark.createDataFrame(given, "doc_id long, text string").repartition(3), jaccard.Shingles(5, 80))
    want = [(3, t[0]), (5, t[1]), (7, t[2]), (7, t[3]), (8, t[4]), (10, ""), (10, None), (None, " "), (None, None), (None, None)] + [(None, x) for x in t[5:]]
    assert rows(left, "doc_id", "text") == Counter(want)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


# --- 9


def words_brute(texts):
    count = Counter(tuple(w[s : s + 35]) for _, t in texts for w in [words(t)] for s in range(len(w) - 34))
    out = Counter()
    for i, t in texts:
        w = words(t)
        gone = {k for s in range(len(w) - 34) if count[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        out[i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def removed_words(docs, spec=substring_dedup.WORDS, batches=2):
    spark = docs.sparkSession
    index = substring_dedup.FingerprintIndex(spark, f"{shared_dir(spark)}/index-{random.random()}", spec)
    for k in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == k))
    return index.remove_repeats(docs)


WORDS = ["doc_id", "n_units", "n_removed", "kept_sha256"]


def test_substring_dedup(docs, texts, none, spark):
    """Batch by batch, with compaction, each time with the index opened again; then all documents, or the last batch beside history."""
    want = words_brute(texts)
    path = f"{shared_dir(spark)}/index-{random.random()}"
    part = F.coalesce(F.pmod("doc_id", F.lit(4)), F.lit(0))
    for k in range(4):
        index = substring_dedup.FingerprintIndex(spark, path, most=2)
        index.add(docs.where(part == k))
        assert len(index.runs.live) == min(k + 1, 2)
    assert rows(index.remove_repeats(docs), *WORDS) == want
    last = Counter({k: n for k, n in want.items() if k[0] is not None and k[0] % 4 == 3})
    assert rows(index.remove_repeats(docs.where(part == 3), docs.where(part < 3)), *WORDS) == last
    assert removed_words(none).count() == 0


def test_equal_fingerprints_of_different_words_are_not_taken_as_repeats(spark, docs, texts):
    class Weak(Repeats):
        def groups(self, runs, at):
            row, a, h, first, last = super().groups(runs, at)
            return row, a, a, first, last  # a fingerprint that looks at the anchor only

    spec = Weak("word", 35, 8, first_stays=False)
    assert rows(removed_words(docs, spec), *WORDS) == words_brute(texts)


@pytest.mark.parametrize(("compared", "held"), [(200, 300), (50, 10**6)])
def test_anchors_of_many_stretches(spark, docs, texts, monkeypatch, compared, held):
    """Anchors of more stretches than a task holds are compared by windows; others go on from batch to batch."""
    monkeypatch.setattr(repeats, "COMPARED", compared)
    monkeypatch.setattr(repeats, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(removed_words(docs), *WORDS) == words_brute(texts)
        assert rows(suffix_dedup.remove_repeated_bytes(docs), *SUFFIX) == suffix_brute(texts, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_history_is_read_only_where_a_match_needs_it(spark):
    rng = random.Random(31)
    old = [(k, " ".join(prose(rng, 200, 10**6))) for k in range(30)]
    new = [(100, " ".join(words(old[5][1])[20:90])), (101, " ".join([*prose(rng, 60, 10**6), *words(old[9][1])[50:120], *prose(rng, 60, 10**6)])), (102, " ".join(prose(rng, 200, 10**6)))]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, f"{shared_dir(spark)}/index-{random.random()}")
    index.add(frame(old))
    index.add(frame(new))
    want = Counter({k: n for k, n in words_brute(old + new).items() if k[0] >= 100})
    assert rows(index.remove_repeats(frame(new), frame(old)), *WORDS) == want
    marks = repeats.marks_of(repeats.tied(frame(new)), index.matches(), index.spec)
    read, _ = repeats.sought(index.wanted(marks, index.matches()), ["tie"], repeats.tied(frame(old)), lambda df, name: df)
    assert {r.doc_id for r in read.collect()} == {5, 9}


# --- 10


def test_token_counts(docs, texts, none, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    want = Counter((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in texts)
    path = f"{shared_dir(spark)}/cache-{random.random()}"
    assert rows(token_counts.count_tokens(docs.where("doc_id < 30"), BPE, path), "n_bytes", "n_tokens") == sum((Counter({k[1:]: n}) for k, n in want.items() if k[0] is not None and k[0] < 30), Counter())
    before = spark.read.parquet(path).count()
    assert rows(token_counts.count_tokens(docs, BPE, path), "doc_id", "n_bytes", "n_tokens") == want
    known = spark.read.parquet(path)
    assert known.count() == len({x or "" for _, x in texts}) > before  # only distinct misses were added
    assert token_counts.count_tokens(none, BPE, path).count() == 0 and spark.read.parquet(path).count() == known.count()
    twice = f"{path}-twice"
    known.unionByName(known).write.parquet(twice)  # as two writers at once would leave it
    assert rows(token_counts.count_tokens(docs, BPE, twice), "doc_id", "n_bytes", "n_tokens") == want


@pytest.mark.parametrize(("path", "split", "parts"), [(WORD, split_words, word_parts), (BPE, split_before_spaces, spaced_parts)])
def test_pieces_give_the_library_s_ids(path, split, parts):
    rng = random.Random(12)
    cache = PieceCache(path, split, parts)
    bits = ["a", "Word", "'s", "'", " ", "  ", "\n", "\t", ".", ",", "é", "É", "İ", "Σ", "́", "1", "23", "<|endoftext|>", "漢", " ", " ", "᠎", "-", "don't", "ß", "\r\n", "\x1c", "\x85", "_"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 25))) for _ in range(3000)]
    ids, at = cache.ids(texts)
    n = cache.counts(texts)
    for k, t in enumerate(texts):
        want = cache.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want and n[k] == len(want), repr(t)
