import hashlib
import random

import pytest

from quillon.llm import token_alignment as ta

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """Whole texts, all pairs of tokens compared: the columns of align without doc_id, in order of texts."""
    a_of, b_of = libraries
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in prints} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in prints)}
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b = a_of.encode(" " + t, add_special_tokens=False).ids, b_of.encode(t)
        x = [bytes(byte_of[c] for c in a_of.id_to_token(i)) for i in a]
        y = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and b_of.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_of.id_to_piece(i)]]
        if b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append(None)
            continue
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        xs, ys = spans(x), spans(y)
        links = [(i, j) for i, s in zip(a, xs, strict=True) for j, u in zip(b, ys, strict=True) if s[0] < u[1] and u[0] < s[1]]
        ends = sorted({e for _, e in xs} & {e for _, e in ys})
        groups = ";".join(
            ",".join(str(i) for i, s in zip(a, xs, strict=True) if lo <= s[0] < hi) + "|" + ",".join(str(j) for j, u in zip(b, ys, strict=True) if lo <= u[0] < hi) for lo, hi in zip([0, *ends], ends)
        )
        docs.append((len(a), len(b), len(ends), links, groups))
    count = {}
    for d in docs:
        for pair in set(d[3]) if d else ():
            count[pair] = count.get(pair, 0) + 1
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d[0], d[1], d[2], len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), hashlib.sha256(d[4].encode()).hexdigest()))
    return out


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\tx  y\r\n", "it's they'll 'tis 12345 67", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve Größe, señor", "☃ 漢字 かな 한국어", "▁x", "a ▁ b", "x　y z w",
    "\x00a\x1c b \x1d", "é é ﬁ ①", "🙂🙂 👩‍👩‍👧", "word " * 300, "x" * 3000, "  a\u0085 b ᠎ c", "a" * 70 + " " + "b" * 70, "don't can't I'd we've", "--==++ ... !!! ,,, ", "١٢٣ ४५६",
]


def test_same_as_brute_force(spark, libraries):
    rng = random.Random(3)
    letters = "aab \n\t  eé.,'1ß漢▁ \x1c-"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)] + ["the cat sat"] * 5
    df = spark.createDataFrame([(i if i % 9 else None, t, i, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, Groups string").repartition(7)
    got = ta.align(df, A, B, with_groups=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    want = [(i if i % 9 else None, *r) for i, r in enumerate(brute(texts, libraries))]
    assert sorted([tuple(r)[:8] for r in got.collect()], key=str) == sorted(want, key=str)


def test_pieces_encode_like_the_whole(libraries, monkeypatch):
    monkeypatch.setattr(ta, "PIECE", 3)
    a, b = libraries
    rng = random.Random(4)
    pool = list("ab'1.,<>|s \n\t") + ["  ", "é", "漢", "\u00a0", "\u2003", "\u200b", "\x1e", "ll", "'s", "🙂"]
    for _ in range(3_000):
        t = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))
        pieces = ta.pieces_of(t)
        assert " ".join(pieces) == t
        assert [i for p in pieces for i in a.encode(" " + p, add_special_tokens=False).ids] == a.encode(" " + t, add_special_tokens=False).ids
        assert [i for p in pieces for i in b.encode(p)] == b.encode(t)


def test_the_faster_encoder_gives_the_files_ids(libraries):
    a, encode = libraries[0], ta.a_encoder(A)
    rng = random.Random(5)
    letters = [chr(c) for c in (*range(0x250), *range(0x370, 0x400), *range(0x600, 0x620), *range(0x2000, 0x2070), *range(0x3000, 0x3050), 0x180E, 0xFEFF, 0x1F600, 0x10FFFF)]
    texts = ["".join(rng.choice(letters if rng.random() < 0.5 else "ab '\n1.") for _ in range(rng.randrange(40))) for _ in range(4_000)] + ["<|endoftext|> x"]
    assert encode(texts) == [x.ids for x in a.encode_batch(texts, add_special_tokens=False)]


def test_partial_counts_merge_however_often_they_are_passed_on(spark, libraries, monkeypatch):
    texts = [f"alpha beta {i % 4} gamma{i % 3}" for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    import quillon.llm.token_alignment as m

    monkeypatch.setattr(m, "KEYS_HELD", 5)
    monkeypatch.setattr(m, "CHARS", 30)
    got = {r[0]: tuple(r)[1:] for r in m.align(df, A, B).collect()}
    assert [got[i] for i in range(60)] == brute(texts, libraries)


def test_empty(spark, none):
    assert ta.align(none, A, B).collect() == []
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in ta.align(blank, A, B).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_the_shared_folder_must_be_mounted():
    with pytest.raises(RuntimeError):
        ta._local("hdfs://host/folder")
