"""The registered queries against DuckDB, at the smallest scale, and those without SQL against the libraries they use."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tribunal.llm.queries import QUERIES, SQL
from tribunal.llm.tokens import tokenizer_path

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda x: x[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(columns).reset_index(drop=True)
    assert plain(got).equals(plain(want))


def test_token_counts(spark, con):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for i, x in con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        n = len(t.encode(x, add_special_tokens=False).ids)
        want[i, len(x.encode()), n, n > 1024] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op10_token_counts"](spark, DATA).collect()) == want


def test_packing(spark, con):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op2_packing"](spark, DATA).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)) and len(own) == r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, some in pieces.items():
        assert [s for s, _ in sorted(some)] == [0, *[s + n for s, n in sorted(some)][:-1]] and sum(n for _, n in some) == len(ids[i])
    assert set(pieces) == set(ids)
    sizes = []
    for some in sequences.values():
        assert [s for s, _ in sorted(some)] == [0, *[s + n for s, n in sorted(some)][:-1]]
        sizes.append(sum(n for _, n in some))
    assert max(sizes) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding <= 0.02 * sum(sizes) + 2048 * 4  # the last sequence of each task may be short


def test_sql_covers_what_it_can():
    assert set(QUERIES) - set(SQL) == {"op2_packing", "op10_token_counts", "op11_embedding_whitening"}
