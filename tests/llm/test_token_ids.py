"""Ids and counts against the tokenizers library, over all characters of the fast paths and beyond."""

import random
import tracemalloc

import public_tokenizers
from tokenizers import Tokenizer

from strataq.llm import packing, token_counts


def texts(n, seed):
    rng = random.Random(seed)
    low, wide = [chr(c) for c in range(0x20, 0x250)], [chr(c) for c in (*range(0x250, 0x600), *range(0x1E00, 0x2200), 0x212A, 0x212B, 0x3A3, 0x130, 0x1F600)]
    plain = list("abc THE 'll's'T .,!?-  \t\n012") + ["don't", " I'M "]
    for _ in range(n):
        pool = rng.choice([low, plain, low + plain * 20, low + wide])
        yield "".join(rng.choice(pool) for _ in range(rng.randrange(1, 40)))


def characters():
    for c in range(0x20, 0x250):
        for x in {chr(c), chr(c).upper(), chr(c).lower()}:
            yield from (x, x + "x", "X" + x, f"a {x} {x}b", f"{x}1{x}'s")


def test_packing_ids_are_the_library_s():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    lib.no_truncation()
    lib.no_padding()
    every = [*characters(), *texts(20_000, 1)]
    for t, ids, want in zip(every, own.encode(every), lib.encode_batch(every, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, repr(t)


def test_packing_holds_few_pretokens_at_a_time():
    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    text = "the cat sat on a mat " * 5_000
    many, want = [text, "", "A b", "x\u4e00"] * 40, [own.whole(t).tolist() for t in (text, "", "A b", "x\u4e00")]
    list(own.encode(many[:4]))
    tracemalloc.start()
    n = 0
    for k, ids in enumerate(own.encode(many)):
        n += ids.tolist() == want[k % 4] if k < 4 or k > 150 or k % 4 else len(ids) == len(want[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(many) and peak < 45e6, peak  # 69 MB when all 4.2 MB of text were held at once


def test_letters_from_elsewhere():
    """All characters that leave the fast path's set only by being lower-cased into it."""
    inside = lambda t: not packing._OTHER.search(t)
    elsewhere = {chr(c) for c in range(0x110000) if not inside(chr(c)) and inside(chr(c).lower())}
    assert elsewhere == set(packing._FROM_ELSEWHERE)


def test_counts_are_the_library_s():
    path = public_tokenizers.path
    lib = Tokenizer.from_file(path("byte_bpe_50k.json"))
    every = [*characters(), *texts(20_000, 2)]
    got = token_counts.counter(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))(every)
    for t, n, want in zip(every, got, lib.encode_batch(every, add_special_tokens=False), strict=True):
        assert n == len(want.ids), repr(t)
