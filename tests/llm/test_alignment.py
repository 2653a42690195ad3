"""Cross-tokenizer alignment against a plain version with the tokenizers and sentencepiece libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import alignment, queries
from marginalia.llm.bpe import byte_alphabet

SF = "/root/testdata/sf0.001"
A, B = queries.vocabulary_path("byte_bpe_50k.json"), queries.vocabulary_path("piece_bpe_32k.model")


def plain(texts):
    """The contract's columns by a walk over bytes, a row for each text."""
    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    to_byte = {c: b for b, c in byte_alphabet().items()}
    docs, holding = [], Counter()
    for text in texts:
        links, groups, n_a, n_b = Counter(), [], 0, 0
        if text:
            a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            raw_a = [bytes(to_byte[c] for c in tokenizer.id_to_token(i)) for i in a]
            raw_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
                n_a, n_b = len(a), len(b)
                owner_a, owner_b = ([k for k, r in enumerate(raw) for _ in r] for raw in (raw_a, raw_b))
                links = Counter((a[i], b[j]) for i, j in set(zip(owner_a, owner_b, strict=True)))
                ends_a, ends_b = set(np.cumsum([len(r) for r in raw_a]).tolist()), set(np.cumsum([len(r) for r in raw_b]).tolist())
                begin = 0
                for end in sorted(ends_a & ends_b):
                    groups.append(",".join(str(a[k]) for k in sorted(set(owner_a[begin:end]))) + "|" + ",".join(str(b[k]) for k in sorted(set(owner_b[begin:end]))))
                    begin = end
        docs.append((n_a, n_b, groups, links))
        holding.update(links.keys())
    most = defaultdict(int)
    for (a, _), n in holding.items():
        most[a] = max(most[a], n)
    return [
        (n_a, n_b, len(g), sum(ls.values()), sum(n for p, n in ls.items() if holding[p] == most[p[0]]), sum(n * holding[p] for p, n in ls.items()), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n_a, n_b, g, ls in docs
    ]


def found(df):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in df.orderBy("doc_id").collect()]


def test_alignment_equals_a_plain_walk(spark, monkeypatch):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "the", "The", "ing", "é", "▁", "<|endoftext|>", "<s>", "<0x41>", "日本", "\U0001f600", "\x00", " ", "12", "don't", ".", "é", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(400)] + ["the the the", "the the the", "", None, "x" * 30000, " " * 4000, "\n" * 2500 + "end"]
    monkeypatch.setattr(alignment, "SLICE", 700)  # many slices
    df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, slice int, pairs string").repartition(7)
    want = plain(texts)
    assert found(alignment.op11_token_alignment(df, A, B)) == want
    assert sum(not w[0] for w in want) > 5 and sum(w[4] < w[3] for w in want) > 50  # some texts are changed, some links are not the best


def test_registered_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert found(queries.QUERIES["op11_token_alignment"](spark, SF)) == plain([r["text"] for r in rows])


def test_groups_and_pairs_are_real_output(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (None, None)], "doc_id long, text string")
    table = alignment.aligned(df, A, B).cache()
    shown = [r["groups"] for r in table.filter("pairs IS NULL").orderBy("doc_id").collect()]
    assert shown[0] == "" and shown[1] == shown[2]
    assert all(all(x.isdigit() for x in side.split(",")) for g in shown[1].split(";") for side in g.split("|"))
    counts = {r["pair"]: (r["count"], r["best"]) for r in alignment.pair_counts(alignment.pairs_of(table)).collect()}
    assert set(counts.values()) == {(2, True)}  # repeated rows count each
    assert alignment.op11_token_alignment(df.filter(F.lit(False)), A, B).count() == 0


def test_long_white_space_has_another_encoder():
    side = alignment.ByteLevel(A)
    fast = side.encode(["a" + " " * 900 + "b\n" * 5])[0]
    assert fast == side._long(" a" + " " * 900 + "b\n" * 5).tolist()
    assert len(side.encode([" " * 300_000])[0]) > 1
    assert pa.array(side.bytes_of[:3], pa.binary())
