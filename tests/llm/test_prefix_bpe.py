"""Encoding by prefixes against the tokenizers library."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from test_operators import LONG, ODD, odd, pairs, texts_of

from tallymark.llm import prefix_bpe
from tallymark.llm import queries as Q

PATH = public_tokenizers.path("byte_bpe_50k.json")
DIGESTS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
MORE = [
    (20, "<|endoftext|>"),
    (21, "a  <|endoftext|> <|endoftext|>\n\nx!!<|endoftext|>?<|endoftext|"),
    (22, "<|endof<|endoftext|>text|>'s <|endoftext|>'s  "),
    (23, "   　x\x85y\x1cz​ ﻿᠎٣Ⅷ½ a\u0558b !\u058b? \U00011de0 9\U00011de19"),
    (24, "-" * 5000 + "ab" * 4000),
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_words(library):
    """Words of all kinds, short ones together and long ones alone, by both ways."""
    vocab, rnd = prefix_bpe.vocabulary(PATH), random.Random(4)
    names = list(vocab.bytes.values())
    words = ["".join(rnd.choice("aabcdeilnorstu") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    words += ["".join(rnd.choice("éüßñλжעن中日本🙂xyz") for _ in range(rnd.randint(1, 20))) for _ in range(500)]
    words += [c * n for c in "a-=*#xz " for n in (1, 2, 3, 7, 16, 31, 64, 130, 999)]
    for _ in range(4000):
        try:
            words.append((rnd.choice(names) + rnd.choice(names) + rnd.choice(names)).decode())
        except UnicodeDecodeError:
            continue
    raw = [w.encode() for w in words if w]
    model = library.model
    letters = {b: c for c, b in prefix_bpe.byte_letters().items()}
    want = [[t.id for t in model.tokenize("".join(letters[b] for b in w))] for w in raw]
    got = [np.frombuffer(x, "<u4").tolist() for x in vocab.encode(raw)]
    assert got == want
    assert [vocab.encode_long(w) for w in raw[:1500]] == want[:1500]
    assert vocab.encode([]) == [] and vocab.encode([b""]) == [b""]


def test_every_token_is_met(library):
    vocab = prefix_bpe.vocabulary(PATH)
    assert all(np.frombuffer(x, "<u4").tolist() == [i] for i, x in zip(vocab.bytes, vocab.encode(list(vocab.bytes.values())), strict=True))


def test_query(spark, sf, library):
    assert pairs(Q.op13_prefix_bpe(spark, sf), *DIGESTS) == expected(library, texts_of(spark, sf))


def test_odd(spark, library):
    rows = ODD + MORE
    assert pairs(Q.prefix_bpe_digests(odd(spark, rows)), *DIGESTS) == expected(library, rows)
    assert Q.prefix_bpe_digests(odd(spark).limit(0)).collect() == []


def test_long_texts(spark, library):
    assert pairs(Q.prefix_bpe_digests(odd(spark, LONG)), *DIGESTS) == expected(library, LONG)


def test_unicode_classes(library):
    """Every code point is cut as the library cuts it."""
    import regex

    find = regex.compile(prefix_bpe.library_pattern(public_tokenizers.PATTERN, {"<|endoftext|>": 50256}, prefix_bpe.unlike(PATH))).findall
    for start in range(0, 0x110000, 0x400):
        points = [chr(c) for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b1{c}2!{c}? {c}" for c in points)
        if text:
            cut = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert find(text) == cut, hex(start)


def test_bad_vocabulary(tmp_path):
    import json

    bad = {"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}
    (tmp_path / "v.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError):
        prefix_bpe.Vocabulary(str(tmp_path / "v.json"))
