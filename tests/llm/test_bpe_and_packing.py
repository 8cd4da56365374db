"""Encoding and decoding against the tokenizers library; packing against its own invariants."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import bpe, bpe_job, packing

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(PATH, memo=500)


ALPHABET = "aab'sthrevmld 5½Ⅷ\n\t  \u0085ÉéßΣσİI’&<|endoftext>é中🎉ñoin\x1c\x00́"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(ALPHABET, max_size=40), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "the quick", "don't", "WE'LL ''s 'say"])), max_size=6))
def test_encode_is_the_library(library, enc, parts):
    t = "".join(parts)
    ids = enc.batch([t, None, t + " x"])
    assert ids[0].tolist() == library.encode(t, add_special_tokens=False).ids and not len(ids[1])
    assert ids[2].tolist() == library.encode(t + " x", add_special_tokens=False).ids
    assert "".join(bpe.TextDecoder(enc.voc, shown=True).feed(ids[0].tolist(), 3)) == library.decode(ids[0].tolist(), skip_special_tokens=False)


def test_every_code_point_is_the_library(library, enc):
    """Between letters, and at the start of a word with marks after it."""
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = [" ".join(f"a{c}B {c}\u0301\u0323x" for c in points[k : k + 4096] if c != "<") for k in range(0, len(points), 4096)]
    for k, want in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert enc.batch([texts[k]])[0].tolist() == want.ids, hex(ord(points[4096 * k]))


def test_marks_in_any_order_are_the_library(library, enc):
    """Marks of all classes after one another, among them those that newer versions of Unicode order differently."""
    import unicodedata

    rng = random.Random(8)
    marks = [chr(i) for i in range(0x110000) if unicodedata.combining(chr(i))]
    odd = [chr(i) for i in (0x0EBA, 0x0D3B, 0x0D3C, 0x09FE, 0x0C3C, 0x1133B, 0x11D42, 0x3099, 0x309A, 0x0345, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x212B, 0x1E9B)]
    texts = [f"a{a}{b}" for a in odd for b in marks] + [f"{b}{a}e" for a in odd for b in marks]
    texts += ["".join(rng.choice([*odd, rng.choice(marks), rng.choice("aeıİßΣσ"), chr(rng.randrange(0x250, 0xD800))]) for _ in range(rng.randrange(1, 9))) for _ in range(60_000)]
    for k in range(0, len(texts), 5000):
        part = texts[k : k + 5000]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in enc.batch(part)] == want


def test_settled_characters_do_not_compose(enc):
    import unicodedata

    chars = [chr(i) for i in range(0xD800) if bpe.SETTLED.fullmatch(chr(i))]
    second = {unicodedata.normalize("NFD", chr(i))[-1] for i in range(0x30000) if len(unicodedata.normalize("NFD", chr(i))) > 1}
    assert not any(unicodedata.combining(c) or c in second for c in chars) and all(unicodedata.is_normalized("NFC", c) for c in chars)
    text = "".join(chars)
    assert enc.form.normalize_str(text) == text.replace("Σ", "σ").lower()


def test_long_texts_and_long_words(library, enc):
    rng = random.Random(5)
    for t in ("".join(rng.choice("abinthero") for _ in range(6000)), "ab" * 5000, "the cat sat. " * 40_000, "x" * 700 + "'s" + "é" * 900):
        assert enc.batch([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_words_that_a_hash_takes_for_equal(library, spark):
    """Complementary Thue-Morse words collide under any polynomial hash modulo a power of two; in one batch and across documents."""
    swap = str.maketrans("ab", "ba")
    words = ["a"]
    for _ in range(13):
        words.append(words[-1] + words[-1].translate(swap))
    texts = [f"{w} {w.translate(swap)} {w}" for w in words[9:]] + [w for x in words[9:] for w in (x, x.translate(swap))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in bpe.Encoder(PATH).batch(texts)] == want
    got = bpe_job.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == dict(enumerate(want))


def test_transducer_memory_does_not_grow(enc):
    """The window, not the word, bounds what is held: tokens leave while symbols still arrive."""
    seen, ahead = 0, []

    def symbols():
        nonlocal seen
        for _ in range(20_000):
            seen += 1
            yield enc.voc.inner[ord("a")]

    out = 0
    for t in bpe.transduce(symbols(), enc.voc):
        out += enc.voc.sizes[t]
        ahead.append(seen - out)
    assert out == 20_000 and max(ahead) <= enc.voc.lookahead + max(enc.voc.longest, enc.voc.lookahead, 64)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_lookahead_is_sufficient_for_random_merge_lists(seed):
    rng = random.Random(seed)
    tokens, sizes = list(range(3)), dict.fromkeys(range(3), 1)
    rules, rank = [], {}
    for _ in range(rng.randrange(1, 9)):
        pair = (rng.choice(tokens), rng.choice(tokens))
        if pair not in rank:
            new = len(tokens)
            tokens.append(new)
            sizes[new] = sizes[pair[0]] + sizes[pair[1]]
            rank[pair] = (len(rules), new)
            rules.append((*pair, new))
    ahead = bpe.sufficient_lookahead(rules, sizes)
    voc = type("V", (), {"lookahead": ahead, "longest": max(sizes.values()), "sizes": sizes, "rank": rank})()
    word = [rng.randrange(3) for _ in range(300)]
    assert list(bpe.transduce(iter(word), voc)) == bpe.merge_all(word.copy(), rank)


def test_decoder_round_trip_and_broken_bytes(enc):
    text = "naïve 🎉 中文 x"
    ids = enc.batch([text])[0].tolist()
    assert "".join(bpe.TextDecoder(enc.voc).feed(ids)).split() == "naïve 🎉 中文 x".split()
    half = enc.voc.inner[0xF0]
    assert "".join(bpe.TextDecoder(enc.voc).feed([half])) == "�"


def test_jobs(spark):
    df = spark.createDataFrame([(1, "Hello  world"), (2, None), (2, ""), (None, "x")], "doc_id long, text string").withColumn("ids", bpe_job.F.lit(1))
    got = {(r["doc_id"], tuple(r["ids"])) for r in bpe_job.encode(df, PATH).collect()}
    assert len(got) == 3 and (2, ()) in got
    back = bpe_job.decode(bpe_job.encode(df, PATH), PATH)
    assert {r["text"] for r in back.collect()} == {"hello world ", "", "x "}
    d = {r["doc_id"]: r for r in bpe_job.digests(df, PATH).collect()}
    assert d[2]["n_tokens"] == 0 and d[2]["ids_sha256"] == d[2]["decoded_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert bpe_job.digests(df.where("false"), PATH).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=40))
def test_assign_fills_every_place(lengths):
    lengths = sorted(lengths, reverse=True)
    rows = packing.assign(lengths, 32)
    cover = {i: [] for i in range(len(lengths))}
    seqs = {}
    for item, start, n, s, off in rows:
        cover[item].append((start, n))
        seqs.setdefault(s, []).append((off, n))
    for i, parts in cover.items():
        assert sum(n for _, n in parts) == lengths[i] and sorted(parts)[0][0] == 0
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at & (at - 1) == 0 and at <= 32


def test_assign_balances_cost():
    lengths = sorted([40] * 10 + [7] * 60, reverse=True)
    rows = packing.assign(lengths, 128)
    cost = {}
    for _, _, n, s, _ in rows:
        cost[s] = cost.get(s, 0) + n + n * n / 128
    full = [cost[s] for s in range(sum(lengths) // 128)]
    assert max(full) < 1.35 * min(full)


def test_pack(spark, library):
    rows = [(1, "one two three"), (2, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (None, "nobody"), (4, "'s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", packing.F.lit("clash"))
    out = packing.pack(df, PATH).collect()
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    for d, lists in want.items():
        got = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out if r["doc_id"] == d)
        for ids in lists:
            at = 0
            while at < len(ids):
                piece = next(p for p in got if p[0] == at and p[3] == len(ids) and p[2] == zlib.crc32(np.array(ids[at : at + p[1]], "<u4").tobytes()))
                got.remove(piece)
                at += piece[1]
            assert at == len(ids)
        assert not got
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_equal_rows_spread_over_groups(spark, tmp_path):
    """Equal rows with null ids: as many groups as their text asks for, none much larger than the others."""
    path = str(tmp_path / "equal")
    spark.range(3000).selectExpr("cast(null as long) as doc_id", "'the same few words again and again' as text").write.parquet(path)
    out = packing.pack(spark.read.parquet(path), PATH, group_bytes=6000).collect()
    sizes = {}
    for r in out:
        g = r["sequence_id"] % (3000 * 38 // 6000 + 1)
        sizes[g] = sizes.get(g, 0) + r["length"]
    assert len(sizes) == 20 and max(sizes.values()) < 2 * min(sizes.values()) and sum(sizes.values()) == 3000 * 8


def test_texts_of_a_batch_are_looked_up_together(monkeypatch):
    """Texts of 900,000 characters share one chunk, and their ids are those of each text alone."""
    enc, calls = bpe.Encoder(PATH), []
    texts = [" ".join(f"word{(i * k) % 700} and, {k}" for i in range(6000)) for k in range(1, 9)]
    alone = [enc.batch([t])[0].tolist() for t in texts]
    plain = bpe.Encoder._chunk
    monkeypatch.setattr(bpe.Encoder, "_chunk", lambda self, text: calls.append(len(text)) or plain(self, text))
    assert [x.tolist() for x in enc.batch(texts)] == alone
    assert 600_000 < sum(calls) < 1_000_000 and len(calls) == 1
