import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.common import SCHEMA, clashing, corpus, frame
from tilework import storage
from tilework.llm import alignment, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    " starts with a space", "two  spaces\n\n\nand  lines \n end ", "tab\there\r\nand\rthere", "\n", " ", "<|endoftext|> and <s> </s> <unk> <0x41>", "a\né ß\n", "it's don't\n'quoted' x\n's",
    "▁ is a space of one of them", "naïve 日本語 中 文\nрус \U0001f600 \U0001f468‍\U0001f469", "\0 zero\x01", "é combining ́x", "x" * 5000, "1234567890 " * 50, " nbsp  x y", "a \n b", "trailing\n",
]


def brute(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {x: y for y, x in tokens._byte_letters().items() if y} | {"Ā": 0}
    found, counts = [], Counter()
    for text in texts:
        full = (" " + text).encode() if text else b""
        ids = (a.encode(full.decode(), add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        size = ([bytes(back[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]])
        if any(b"".join(x) != full for x in size):
            ids = size = ([], [])
        spans = []
        for x in size:
            at, own = 0, []
            for y in x:
                own.append((at, at + len(y)))
                at += len(y)
            spans.append(own)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        shown, start = [], 0
        for cut in cuts:
            shown.append("|".join(",".join(str(i) for i, (s, e) in zip(ids[k], spans[k], strict=True) if start <= s and e <= cut) for k in (0, 1)))
            start = cut
        links = [(ids[0][i], ids[1][j]) for i, (s, e) in enumerate(spans[0]) for j, (s2, e2) in enumerate(spans[1]) if s < e2 and s2 < e]
        counts.update(links)
        found.append((len(ids[0]), len(ids[1]), len(cuts), links, hashlib.sha256(";".join(shown).encode()).hexdigest() if ids[0] else ""))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(x, y, g, len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for x, y, g, ls, sha in found]


def rows_of(got):
    return sorted(((x.doc_id is None, x.doc_id or 0), tuple(x[n] for n in NAMES)) for x in got)


@pytest.mark.parametrize("chunk", [8 << 20, 600])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    rows = [(i, t[:800] if t else t, *x) for i, t, *x in corpus(30)] + [(5000 + i, t, "en", "s", 0) for i, t in enumerate(ODD)]
    want = sorted(((i is None, i or 0), x) for (i, *_), x in zip(rows, brute([r[1] for r in rows]), strict=True))
    got = alignment.alignments(clashing(frame(spark, rows)), A, B).collect()
    assert rows_of(got) == want
    assert any(x.n_a == 0 and x.doc_id == 5008 for x in got)


def test_the_query(spark, tmp_path):
    rows = corpus(12)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = alignment.op11_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", *NAMES]
    assert rows_of(got.collect()) == sorted(((i is None, i or 0), x) for (i, *_), x in zip(rows, brute([r[1] for r in rows]), strict=True))


def test_empty_table_and_no_tokens(spark):
    assert alignment.alignments(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    got = alignment.alignments(spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string"), A, B).collect()
    assert len(got) == 3 and all(tuple(x[n] for n in NAMES) == (0, 0, 0, 0, 0, 0, "") for x in got)


def test_chunks_are_row_groups_of_their_own(spark, monkeypatch, tmp_path):
    """A task's chunks, megabytes each, don't come to one row group, which a reader would hold whole."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 600)
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert alignment.alignments(frame(spark, partitions=1), A, B).count() == len(corpus())
    files = [pq.ParquetFile(p).metadata for p in tmp_path.glob("aligned-*/*.parquet")]
    assert max(m.num_rows for m in files) > 20
    assert all(m.row_group(i).num_rows == 1 for m in files for i in range(m.num_row_groups))
