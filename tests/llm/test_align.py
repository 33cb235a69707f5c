"""Operator 13 against brute force over whole texts."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("strandlake.llm")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from strandlake.llm import align, queries  # noqa: E402
from strandlake.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    a, b = tokenizers.Tokenizer.from_file(align.A_FILE), sentencepiece.SentencePieceProcessor(model_file=align.B_FILE)
    a.encode_special_tokens = True
    alphabet = {c: bytes([x]) for c, x in align.byte_alphabet().items()}
    names = {i: t for t, i in a.get_vocab().items()}

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts_a = [b"".join(alphabet[c] for c in names[i]) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + text).encode()
        return ([], []) if b"".join(parts_a) != want or b"".join(parts_b) != want else (list(zip(ids_a, parts_a)), list(zip(ids_b, parts_b)))

    return encode


def grouped(a, b):
    out, i, j, left, right, x, y = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if left <= right:
            x.append(a[i][0])
            left += len(a[i][1])
            i += 1
        else:
            y.append(b[j][0])
            right += len(b[j][1])
            j += 1
        if left == right and x and y:
            out.append((x, y))
            x, y = [], []
    return out


def brute(rows, encode):
    docs = []
    count = Counter()
    for i, text in rows:
        a, b = encode(text) if text else ([], [])
        groups = grouped(a, b)
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        count.update(links.keys())
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        docs.append((i, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = [(i, n_a, n_b, g, sum(links.values()), sum(m for p, m in links.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in links.items()), sha) for i, n_a, n_b, g, links, sha in docs]
    return sorted(out, key=str), count, most


def figures(df):
    names = ("doc_id", "_n_a", "_n_b", "_n_groups", "_n_links", "_n_best", "_count_sum", "_groups")
    return sorted((tuple(r[x] for x in names) for r in df.collect()), key=str)


def test_query(spark, both):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = [tuple(r[x] for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in queries.op13_token_align(spark, SF).collect()]
    assert sorted(got, key=str) == brute(rows, both)[0]


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", "one two one two", "x\ty\n z", "▁", "a ▁b", "  x  y", "　 a", "é è  ê", "中文 没有 空格 中文没有空格", "<|endoftext|> <s> </s> <unk> <0x41>", "\U0001f600 \U0001f468‍\U0001f469 ok", "don't we'll  'tis", "\x00 \x01 a", "1234567890 12 34", "\r\n \r\n x", "á é", "﻿ b ​ c", "ﬁ ½ Å"]


@pytest.mark.parametrize("parts", [1, 3])
def test_odd_texts(spark, both, monkeypatch, parts):
    monkeypatch.setattr(align, "PART_LINKS", 1 << 27 if parts == 1 else 1)
    rows = [(n if n else None, t) for n, t in enumerate(ODD)] + [(7, "one two one two"), (7, "one two one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_id", "_home", "_text", "_kind", "_at", "_groups")})
    assert figures(align.align(df, stripes=7)) == brute(rows, both)[0]
    assert align.align(df.limit(0)).count() == 0


def test_long_texts_are_read_in_segments(spark, both):
    long = " ".join(f"wörd{n % 89} Δ{n % 7}  and{n % 13}\n" for n in range(3000))
    rows = [(1, long), (2, "short one"), (3, long + "▁"), (4, None), (5, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert figures(align.align(df, stripes=16, chunk=4096)) == brute(rows, both)[0]


def test_links_and_groups(spark, both):
    rows = [(1, "hello world"), (2, "hello there worlds"), (3, "hello")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, count, most = brute(rows, both)
    assert sorted((r.a_id, r.b_id, r.n_docs, r.best) for r in align.links(df, stripes=5).collect()) == sorted((x, y, n, n == most[x]) for (x, y), n in count.items())
    said = {r.doc_id: r._groups for r in align.align(df, groups=True).collect()}
    assert all(hashlib.sha256(said[i].encode()).hexdigest() == sha for i, *_, sha in brute(rows, both)[0])


def test_hot_pairs(spark, both):
    """A third of all rows are copies; their entries are added up chunk by chunk."""
    rows = [(n, "the same words again" if n % 3 == 0 else f"the number {n} stands here") for n in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert figures(align.align(df, chunk=512)) == brute(rows, both)[0]
