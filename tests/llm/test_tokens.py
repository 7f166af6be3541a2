"""Chunked encoders and BPE against the libraries; the queue's order."""

import base64
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lattica.llm import bpe, tokens  # noqa: E402

PARTS = ["hello", " world", "It's", "  ", " ", "\n", " \n", "\t", "\r\n", "é", "é", "ß", "Σ", "ΑΣ ", "İ", "日本語", " 12345", "###", "<|endoftext|>",
         "<|startoftext|>", "<|ENDOFTEXT|>", "\x1c", " \x1f", "\xa0", " ", "​", "'S", "'re", "x" * 70, "aaaaaaaaaaaa", "\x00", "😀", " ́", "…", "foo,bar", "\x85", "᠎"]


def _texts(n, seed):
    rng = random.Random(seed)
    return ["", " ", "\n", "   ", *["".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(n)]]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_give_the_librarys_ids(file):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    library, ours = Tokenizer.from_file(path), tokens.json_encoder(path)
    import numpy as np
    for text in _texts(4000, 1):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_texts_looked_up_together_give_the_librarys_ids(file, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    library = Tokenizer.from_file(path)
    texts = [*_texts(2000, 7), "word " * 500]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for chars, chunks, most in ((1, 3, 10), (300, 7, 1 << 20), (1 << 22, 20_000, 1 << 20)):
        monkeypatch.setattr(tokens, "BATCH_CHARS", chars)
        monkeypatch.setattr(tokens, "NEW_CHUNKS", chunks)
        monkeypatch.setattr(tokens, "CACHE_CHUNKS", most)
        ours = tokens._json_encoder(path)
        for _ in range(2):  # the second time with remembered chunks
            assert [np.frombuffer(ids, "<u4").tolist() for ids in ours.encode_batch(texts)] == want
    assert list(ours.encode_batch([])) == []


def test_bpe_gives_tiktokens_ids_and_round_trips():
    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    ours = bpe.from_file(path, pattern)
    rng = random.Random(3)
    long = ["ab" * 20_000, "a" * 30_001, "".join(rng.choices("abcde", k=20_000)), "=-" * 9_999, " " * 5_000 + "x"]
    for text in [*_texts(4000, 2), *long]:
        ids = ours.encode(text)
        assert ids == library.encode_ordinary(text), repr(text[:80])
        assert ours.decode(ids) == text.encode()


def test_merge_order_with_ranks_that_fall_below():
    # Any table of merges, also ones where a new pair ranks below the last merge.
    rng = random.Random(5)
    for _ in range(200):
        words = {bytes([c]) for c in b"abc"}
        while len(words) < 30:
            words.add(rng.choice(sorted(words)) + rng.choice(sorted(words)))
        order = sorted(words, key=lambda w: (len(w) > 1, rng.random()))
        ranks = {w: i for i, w in enumerate(order)}
        ours = bpe.Bpe(ranks, r"\S+")
        for _ in range(5):
            piece = bytes(rng.choices(b"abc", k=rng.randint(1, 40)))
            parts = [piece[i:i + 1] for i in range(len(piece))]
            while piece not in ranks:
                found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not found:
                    break
                i = min(found)[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            assert ours.merge(piece) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])


def test_queue_pops_lowest_rank_then_leftmost():
    rng = random.Random(7)
    queue = bpe.RankQueue(300_000)
    entries = [(rng.randrange(300_000 if k % 2 else 40), rng.randrange(1000)) for k in range(3000)]
    for e in entries:
        queue.push(*e)
    got = []
    while queue.top:
        got.append(queue.pop())
    assert got == sorted(entries)


def test_many_pretokens_in_one_queue():
    """Against one at a time; ranks in random order, so that merges make pairs of lower rank too."""
    rng = random.Random(11)
    for trial in range(20):
        words = {bytes([i]) for i in range(256)}
        while len(words) < 340:
            words.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))))
        ranks = dict(zip(rng.sample(sorted(words), len(words)), range(len(words))))
        ours = bpe.Bpe(ranks, r"\S+")
        pieces = list({bytes(rng.choice(b"abcd\xff") for _ in range(rng.randint(1, 40))) for _ in range(300)} - ranks.keys())
        pieces += [b"a" * 64, b"ab" * 20, b"d"]
        expected = [np.asarray(ours.merge(p), "<u4").tobytes() for p in pieces]
        assert ours.merge_many(pieces) == expected
        assert not ours._queue.top and not ours._queue.buckets


def test_encode_all_equals_one_text_at_a_time(monkeypatch):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeé\n ") for _ in range(rng.randint(1, 9))) for _ in range(9000)]
    texts = ["", " ", " a  b ", *[" ".join(rng.sample(words, 200)) for _ in range(60)], "", "x" * 5000]
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ours = bpe.from_file(path, pattern)
    expected = [ours.encode(t) for t in texts]
    for together in (1_000_000, 4_000):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        monkeypatch.setattr(bpe, "LEAST", 500)
        assert list(bpe.Bpe(ours.ranks, pattern).encode_all(texts)) == expected
    assert list(ours.encode_all([])) == []
