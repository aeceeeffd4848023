"""Token-id files: adaptive context mixing over ids, arithmetic coded in blocks.

A file is a table of segments in ascending document order.  A segment holds whole
documents: their ids and lengths, and the ids of their tokens cut into blocks.  Every
block starts with a fresh model and can be read alone.  Its bytes are

    magic "TMK3", ids in the block, CRC-32 of the ids as little-endian unsigned 32-bit
    integers and all that follows, words of code (4 bytes each), those words (2 bytes
    each), ids that are not coded (3 bytes each).

A block's ids are dealt in runs to lanes, which numpy codes in step; all lanes learn
into one model, lane after lane.  The contexts of one and two earlier ids each name the
id that last followed them, with a confidence; logistic mixing, with weights learned online, says
how likely the better name is, and a range coder writes whether it holds.  If it doesn't, the id is
coded by the context of no ids: the distribution of all ids that were not named so far.
An id new to that distribution is an escape, and is listed behind the code.

The file is written and read by Spark, so it can lie in any store that Spark reaches.

Defined cases: a null or empty text has only its end id; null ids come first; rows with
equal ids stay separate rows, side by side; a bad magic or checksum raises an error; a
very long text is a segment of its own, of as many blocks as it needs; other columns are
ignored; an empty table gives an empty file.
"""

from __future__ import annotations

import codecs
import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import spread
from .common import block_number, give_back, written

MAGIC = b"TMK3"
HEAD = struct.Struct("<4sIII")
END_ID = 2
BLOCK_IDS = 1 << 21
SEGMENT_IDS = 2_000_000
PIECE_BYTES = 1 << 23
#: Ids a lane has at least, and lanes at most.
LANE_IDS, LANES = 256, 4096
CONF, STATES = 8, 128
TWO_BITS = 18
#: The distribution of ids is learned anew after 1, 2, 4, ... and then every so many steps.
REFRESH = 32
_LIMIT = 1 << 24
#: The symbol of ids that the distribution doesn't know, and the sum of its intervals' bits.
ESCAPE, SCALE = (1 << 16) - 1, 17
#: Ranges of 32 to 48 bits, written in 16-bit words: a flag (12 bits, 16 parts at least)
#: and an id's interval (17 bits) leave 7 bits.
_BOTTOM, _WORD = 1 << 32, 16
# Tables and integers, not exp() and log(): every machine must compute the same predictions.
_SQUASH = np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))).clip(16, 4080).astype(np.int64)
_ODDS = np.arange(4097).clip(8, 4088)
_STRETCH = np.round(np.log(_ODDS / (4096 - _ODDS)) * 256).astype(np.int64)
#: Next confidence: after a wrong name it halves, after a right one (from CONF on) it grows.
_NEXT = np.array([c >> 1 for c in range(CONF)] + [min(c + 1, CONF - 1) for c in range(CONF)], np.int32)
#: A name that was right twice stays after a wrong one.
_STAYS = np.arange(2 * CONF) // 2 % CONF > 0
_STAYS[CONF:] = False
#: Of a state: whether both contexts name one id, and their confidences.
_BOTH, _ONE, _TWO = np.arange(STATES) >> 6, np.arange(STATES) >> 3 & 7, np.arange(STATES) & 7


class _Model:
    """What a block's lanes have learned so far.

    A cell of a context is the id that it names and the confidence in it (lowest 3 bits).
    """

    def __init__(self):
        self.one = np.full(1 << 16, -CONF, np.int32)
        self.two = np.full(1 << TWO_BITS, -2 * CONF, np.int32)
        self.seen = np.zeros(4 * STATES, np.int64)  # states by which of the two names were right
        self.fresh = np.zeros(4 * STATES, np.int64)
        self.weights = np.full((3, 3), 1 << 15, np.int64)  # of a bias and two contexts, in 65536ths
        self.weights[:, 0] = 0
        self.counts = np.zeros(ESCAPE + 1, np.int64)
        self.missed: list[np.ndarray] = []
        self.mix()
        self.settle()

    def mix(self) -> None:
        """Weights follow their errors since the last time; then each state's probability in 4096ths."""
        if self.seen.any() or self.fresh.any():
            split = self.fresh.reshape(4, STATES)
            met, right = split.sum(axis=0), np.where(self.second, split[2] + split[3], split[1] + split[3])
            error = right * 4096 - met * self.p
            for k in range(3):
                own = self.group == k
                n = max(1, int(met[own].sum()))
                for j, x in enumerate((256, self.x_one, self.x_two)):
                    self.weights[k, j] += int((error * x)[own].sum()) // n >> 6
            self.seen += self.fresh
            self.fresh[:] = 0
        split = self.seen.reshape(4, STATES)
        rate = lambda right, conf: (np.bincount(conf, right, CONF).astype(np.int64) * 4096 + 2048) // (np.bincount(conf, split.sum(axis=0), CONF).astype(np.int64) + 1)
        one, two = rate(split[1] + split[3], _ONE)[_ONE], rate(split[2] + split[3], _TWO)[_TWO]
        self.second = two >= one
        self.group = np.where(_BOTH, 2, self.second)
        self.x_one, self.x_two = _STRETCH[one], _STRETCH[two]
        w = self.weights[self.group]
        self.p = _SQUASH[(((w[:, 0] * 256 + w[:, 1] * self.x_one + w[:, 2] * self.x_two) >> 16) + 2048).clip(0, 4095)]

    def settle(self) -> None:
        """The distribution of the ids that were not named: intervals that add up to 2**SCALE."""
        counts = self.counts
        if self.missed:
            new = np.bincount(np.concatenate(self.missed), minlength=ESCAPE + 1)
            self.missed, escapes, n = [], int(new[ESCAPE]), int(new.sum())
            counts[:ESCAPE] += new[:ESCAPE]
            counts[ESCAPE] = 0
            counts[ESCAPE] = 1 + escapes * int(counts.sum()) // max(1, n)
        else:
            counts[ESCAPE] = 1
        known = np.flatnonzero(counts)
        own = np.cumsum(counts[known])
        ends = own * ((1 << SCALE) - len(known)) // own[-1] + np.arange(1, len(known) + 1)
        sizes = np.diff(ends, prepend=0)
        self.start, self.size = np.zeros(ESCAPE + 1, np.int64), np.zeros(ESCAPE + 1, np.int64)
        self.start[known], self.size[known] = ends - sizes, sizes
        self.at = np.repeat(known.astype(np.uint16), sizes)

    def predict(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likelier of the names of the two contexts, and its probability in 4096ths."""
        self.first = last & 0xFFFF
        mixed = (last.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1) ^ (before.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)
        self.both = (mixed * np.uint32(0x27D4EB2F) >> np.uint32(32 - TWO_BITS)).astype(np.int64)
        one, two = self.one.take(self.first), self.two.take(self.both)
        self.conf = one & (CONF - 1), two & (CONF - 1)
        self.named = one >> 3, two >> 3
        self.state = (self.named[0] == self.named[1]) * np.int64(64) + (self.conf[0] << 3) + self.conf[1]
        return np.where(self.second.take(self.state), self.named[1], self.named[0]), self.p.take(self.state)

    def learn(self, symbol: np.ndarray) -> None:
        state = self.state
        for cells, at, conf, named, bit in zip((self.one, self.two), (self.first, self.both), self.conf, self.named, (STATES, 2 * STATES), strict=True):
            right = named == symbol
            state = state + right * np.int64(bit)
            case = conf + right * np.int32(CONF)
            # Of equal slots the last lane's cell stays, as numpy assigns.
            cells[at] = (np.where(_STAYS.take(case), named, symbol) << 3) | _NEXT.take(case)
        self.fresh += np.bincount(state, minlength=4 * STATES)

    def step(self, t: int) -> None:
        """After a step: what was seen counts from now on, at times."""
        if (t + 1) % REFRESH == 0 or (t + 1) & t == 0:
            self.mix()
            self.settle()


def _lanes(n: int) -> tuple[int, int, int]:
    """Lanes of a block, steps, and lanes that have an id in the last step."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def _encode(ids: np.ndarray) -> bytes:
    n = len(ids)
    if n > BLOCK_IDS or n and (ids.min() < 0 or ids.max() >= _LIMIT):
        raise ValueError("a block is too long or holds an id out of range")
    lanes, steps, full = _lanes(n)
    dealt = np.zeros((steps + 2, lanes), np.int32)  # every lane starts after two ids 0
    if n:
        dealt[2:, :full] = ids[: full * steps].reshape(full, steps).T
        dealt[2 : steps + 1, full:] = ids[full * steps :].reshape(lanes - full, steps - 1).T
    model = _Model()
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    owners, words, escaped = [], [], []
    for t in range(steps):
        live = lanes if t < steps - 1 else full
        symbol = dealt[t + 2, :live]
        best, p = model.predict(dealt[t + 1, :live], dealt[t, :live])
        part = (span[:live] >> 12) * p
        miss = np.flatnonzero(best != symbol)
        split, missed = part[miss], symbol[miss]
        coded = np.minimum(missed, ESCAPE)
        unknown = model.size.take(coded) == 0
        unknown |= coded == ESCAPE
        if unknown.any():
            escaped.append(missed[unknown])
            shown = np.where(unknown, ESCAPE, coded)
        else:
            shown = coded
        rest = (span[miss] - split) >> SCALE
        low[miss] += split + model.start.take(shown) * rest
        span[:live] = part
        span[miss] = model.size.take(shown) * rest
        model.missed.append(coded)
        small = np.flatnonzero(span < _BOTTOM)
        while len(small):
            a, r = low[small], span[small] << _WORD
            owners.append(small.astype(np.uint16))
            words.append((a >> 32).astype(np.int32))
            low[small], span[small] = (a & (_BOTTOM - 1)) << _WORD, r
            small = small[r < _BOTTOM]
        model.learn(symbol)
        model.step(t)
    owners.append(np.arange(lanes, dtype=np.uint16))
    words.append(((low + (_BOTTOM - 1)) >> 32).astype(np.int32))
    code = _in_reading_order(np.concatenate(owners), np.concatenate(words), lanes)
    raw = np.concatenate([np.zeros(0, np.int32), *escaped]).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    body = code.astype("<u2").tobytes() + raw.tobytes()
    return HEAD.pack(MAGIC, n, _checksum(ids, body), len(code)) + body


def _checksum(ids: np.ndarray, body: bytes) -> int:
    return zlib.crc32(body, zlib.crc32(ids.astype("<u4").tobytes()))


def _in_reading_order(owners: np.ndarray, words: np.ndarray, lanes: int) -> np.ndarray:
    """The lanes' words as a reader takes them: three a lane, then the next one of the lane that wrote."""
    every, later = np.arange(lanes), len(owners) - lanes
    order = np.argsort(np.concatenate([owners, *[every.astype(np.uint16)] * 3]), kind="stable")
    line = np.append(words, np.zeros(3 * lanes, np.int32))[order]  # lane by lane, three zeros behind each
    over = line >> 16
    while over.any():  # carries, within a lane
        line &= 0xFFFF
        line[:-1] += over[1:]
        over = line >> 16
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    ends = np.cumsum(np.bincount(owners, minlength=lanes) + 3)
    begins = np.append(0, ends[:-1])
    return np.trim_zeros(np.concatenate([line[begins], line[begins + 1], line[begins + 2], line[place[:later] + 3]]), "b")


def _decode(data: bytes) -> np.ndarray:
    if len(data) < HEAD.size or data[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    _, n, check, size = HEAD.unpack_from(data)
    if n > BLOCK_IDS or len(data) < HEAD.size + 2 * size or (len(data) - HEAD.size - 2 * size) % 3:
        raise ValueError("a block's length is out of range")
    lanes, steps, full = _lanes(n)
    # No step reads more than three words a lane; what lies behind the code is zero.
    stream = np.concatenate([np.frombuffer(data, "<u2", size, HEAD.size), np.zeros(3 * lanes, np.uint16)]).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, -1, HEAD.size + 2 * size).reshape(-1, 3).astype(np.int32)
    escaped, used = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16, 0
    dealt = np.zeros((steps + 2, lanes), np.int32)
    model = _Model()
    code = stream[:lanes] << 32 | stream[lanes : 2 * lanes] << 16 | stream[2 * lanes : 3 * lanes]
    span, at = np.full(lanes, 1 << 48, np.int64), 3 * lanes
    for t in range(steps):
        live = lanes if t < steps - 1 else full
        best, p = model.predict(dealt[t + 1, :live], dealt[t, :live])
        part = (span[:live] >> 12) * p
        miss = np.flatnonzero(code[:live] >= part)
        split = part[miss]
        rest, value = (span[miss] - split) >> SCALE, code[miss] - split
        # Below 2**48, so the quotient of doubles has the right whole part.
        coded = model.at.take((value / rest).astype(np.int64), mode="clip")
        code[miss] = value - model.start.take(coded) * rest
        span[:live] = part
        span[miss] = model.size.take(coded) * rest
        missed = coded.astype(np.int32)
        unknown = np.flatnonzero(coded == ESCAPE)
        if len(unknown):
            if used + len(unknown) > len(escaped):
                raise ValueError("a block lacks ids")
            missed[unknown] = escaped[used : used + len(unknown)]
            used += len(unknown)
        model.missed.append(np.minimum(missed, ESCAPE))
        symbol = dealt[t + 2, :live]
        symbol[:] = best
        symbol[miss] = missed
        small = np.flatnonzero(span < _BOTTOM)
        while len(small):
            k, r = len(small), span[small] << _WORD
            new = stream[at : at + k]
            code[small] = code[small] << _WORD | (new if len(new) == k else np.append(new, np.zeros(k - len(new), np.int64)))
            span[small] = r
            at += k
            small = small[r < _BOTTOM]
        model.learn(symbol)
        model.step(t)
    ids = np.empty(n, np.int32)
    if n:
        ids[: full * steps].reshape(full, steps)[:] = dealt[2:, :full].T
        ids[full * steps :].reshape(lanes - full, steps - 1)[:] = dealt[2 : steps + 1, full:].T
    if _checksum(ids, data[HEAD.size :]) != check:
        raise ValueError("a block's checksum doesn't match")
    return ids


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's bytes; ids below 2**24, at most BLOCK_IDS a block."""
    return list(map(_encode, blocks))


def decode_blocks(data: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError on a bad magic or checksum."""
    return list(map(_decode, data))


def _byte_kinds() -> np.ndarray:
    """Of each byte: 0 unsure, 1 letter, 2 digit, 3 apostrophe, 4 other sign, 5 space, 6 other white, 7 not ASCII."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 4
    for n in range(128):
        if chr(n).isalpha():
            kinds[n] = 1
        elif chr(n).isdigit():
            kinds[n] = 2
    kinds[ord("'")], kinds[ord(" ")], kinds[9:14], kinds[128:] = 3, 5, 6, 7
    return kinds


def _kind_cuts() -> np.ndarray:
    """Whether a pre-token always starts between bytes of two kinds, by the first's kind times 8 plus the second's.

    Only blanks alone and a single space before other characters hold white space, and no
    pre-token has anything behind a letter but letters, behind a digit but digits, or a
    letter or digit behind a sign, but for letters behind an apostrophe.
    """
    cuts = np.zeros((8, 8), bool)
    cuts[np.ix_([1, 2, 3, 4, 7], [5, 6])] = cuts[6, [1, 2, 3, 4, 7]] = True
    cuts[1, [2, 3, 4]] = cuts[2, [1, 3, 4]] = cuts[4, [1, 2]] = cuts[3, 2] = True
    return cuts.reshape(-1)


_KINDS = _byte_kinds().tobytes()
#: For every byte, as bytes.translate takes it; 64 pairs are in use.
_CUTS = _kind_cuts().tobytes().ljust(256, b"\0")
#: What a byte-level tokenizer writes for each byte, but for the line's end between words.
_HIDDEN = [n for n in range(256) if not (33 <= n < 127 or 161 <= n < 256 and n != 173)]
_SHOWN = "".join("\n" if n == 10 else chr(256 + _HIDDEN.index(n)) if n in _HIDDEN else chr(n) for n in range(256))
#: One pre-token: letters of the first blocks only (up to U+024F), of which all Unicode versions say the same.
_WORD_OF = re.compile(rb" ?(?:[A-Za-z]|\xc2[\xaa\xb5\xba]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
#: Characters of more than one byte that are, or were in some Unicode version, white space.
_WIDE = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)])


def cut_places(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each byte of UTF-8 texts, whether a piece starts there: the pieces' tokens are those of the texts.

    A pre-token surely starts there, whatever else the text holds, and no pre-token looks
    beyond its piece.  ``starts`` are those of texts that are not empty; they count as no cuts.
    """
    kinds = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
    pairs = (kinds[:-1] << 3) | kinds[1:]
    pairs[starts[starts > 0] - 1] = 0
    found = np.zeros(len(data), bool)
    found[1:] = np.frombuffer(pairs.tobytes().translate(_CUTS), bool)
    wide = np.flatnonzero(found[1:] & ((pairs >= 56) | (pairs & 7 == 7))) + 1
    if len(wide):
        last = len(data) - 1
        byte = lambda at: data.take(at.clip(0, last)).astype(np.int64)
        after = kinds[wide] == 7
        head = np.where(after, wide, wide - 3)
        three = byte(head) << 16 | byte(head + 1) << 8 | byte(head + 2)
        two = np.where(after, three >> 8, three & 0xFFFF)
        found[wide[np.isin(three, _WIDE) | np.isin(two, _WIDE)]] = False
    # The last of several blanks before another character stands alone, if it isn't a space.
    found[:-1] |= found[1:] & (pairs >> 3 == 6)
    return found


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct piece encoded once.

    The library's defaults hold: a special token's string in a text is that token, and
    such a text is not cut.

    Texts are cut where a pre-token surely starts, so a text's ids are those of its pieces
    in order.  New pieces that are words, one pre-token each, are encoded together; the
    bytes that tokens stand for tell them apart.  ``most`` bounds the pieces that are remembered, and their bytes
    sixteenfold.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # A character of a byte-level token stands for one byte.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        # The same model behind a plain splitter, for words that are one pre-token each.
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = WhitespaceSplit()
        split = self.tokenizer.pre_tokenizer
        #: Whether texts may be cut: what is known of pre-tokens holds for this splitter alone.
        self.cuts = isinstance(split, ByteLevel) and split.use_regex and not split.add_prefix_space and self.tokenizer.normalizer is None
        self.job = None
        self._forget()

    def serve(self, job: str) -> None:
        """Pieces are remembered within one job, by all tasks of the worker."""
        if job != self.job:
            self.job = job
            self._forget()

    def _forget(self) -> None:
        """Only piece 0, the end of a text, is known."""
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.pool, self.starts, self.sizes = np.array([END_ID], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _learn(self, fresh: list[bytes]) -> None:
        found = list(map(_WORD_OF.fullmatch, fresh)) if self.cuts else [None] * len(fresh)
        words, other = list(compress(fresh, found)), [c for c, f in zip(fresh, found, strict=True) if f is None]
        ids, sizes = [], []
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            shown = codecs.charmap_decode(b"\n".join(part), "strict", _SHOWN)[0]
            got = np.array(self.words.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.int32)
            wanted = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)))
            covered = np.cumsum(self.bytes[got])
            ends = np.searchsorted(covered, wanted) + 1
            if ends[-1] != len(got) or (covered[ends - 1] != wanted).any():
                raise ValueError("the tokens of words don't cover them")
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        for at in range(0, len(other), 2048):
            got = self.tokenizer.encode_batch_fast([c.decode() for c in other[at : at + 2048]], add_special_tokens=False)
            ids += [np.array(e.ids, np.int32) for e in got]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
        before, sizes = len(self.sizes), np.concatenate(sizes)
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.pool = np.concatenate([self.pool, *ids])
        self.known.update(zip(words + other, range(before, before + len(sizes)), strict=True))
        self.held += sum(map(len, fresh))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id behind each, and how many each has."""
        if len(self.known) > self.most or self.held > 16 * self.most:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        marked = [pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in self.special]
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begins = offsets[:-1][np.diff(offsets) > 0]
        found = cut_places(data, begins) if self.cuts and len(data) else np.zeros(len(data), bool)
        found[begins] = True
        for n in np.flatnonzero(np.logical_or.reduce(marked)) if marked else ():
            found[offsets[n] + 1 : offsets[n + 1]] = False
        starts = np.flatnonzero(found)
        where = np.append(starts, len(data))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(data)]).dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = [words[n] for n in new.tolist()]
            self._learn(fresh)
            numbers[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(new))
        ends = np.searchsorted(starts, offsets[1:])
        lines = np.insert(numbers[pieces.indices.to_numpy()], ends, 0)
        sizes = self.sizes[lines]
        done = np.cumsum(sizes)[ends + np.arange(len(ends))]
        return self.pool[spread(self.starts[lines], sizes)], np.diff(done, prepend=0)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, whose tokenizer serves all its tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    return Encoder(path)


def _pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES):
    """Slices of at most that many bytes of text, or of one longer text: what a worker cuts into chunks at once."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _write(batches, path: str, target: str, id_type: pa.DataType, block_ids: int, segment_ids: int):
    encoder = _encoder(path)
    encoder.serve(target)
    part = block_number() >> 32
    number, ids, lengths, tokens, held = 0, [], [], [], 0

    def close():
        nonlocal number, ids, lengths, tokens, held
        flat = np.concatenate(tokens)
        blocks = encode_blocks([flat[a : a + block_ids] for a in range(0, len(flat), block_ids)])
        out = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([np.concatenate(lengths)], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))],
            names=["part", "number", "n_ids", "ids", "lengths", "blocks"],
        )
        number, ids, lengths, tokens, held = number + 1, [], [], [], 0
        give_back()
        return out

    for batch in batches:
        for piece in _pieces(batch):
            found, sizes = encoder.encode(piece.column(1))
            ends, at = np.cumsum(sizes), 0
            while at < len(ends):
                # Up to the first text that fills the segment.
                done = int(ends[at - 1]) if at else 0
                end = min(len(ends), int(np.searchsorted(ends, done + segment_ids - held)) + 1)
                tokens.append(found[done : ends[end - 1]])
                ids += piece.column(0).slice(at, end - at).to_pylist()
                lengths.append(sizes[at:end])
                held += len(tokens[-1])
                if held >= segment_ids:
                    yield close()
                at = end
    if ids:
        yield close()


def write(docs: DataFrame, path: str, target: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode the texts by the tokenizer at ``path`` into a file at ``target``."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["id"].dataType
    arrow = to_arrow_type(id_type)
    fields = [("part", T.LongType()), ("number", T.LongType()), ("n_ids", T.LongType()), ("ids", T.ArrayType(id_type)), ("lengths", T.ArrayType(T.LongType())), ("blocks", T.ArrayType(T.BinaryType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])
    # Ranges of ids, ties dealt by text, so that one id's copies need not meet in one task.
    spread = source.repartitionByRange(F.asc("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    spread.mapInArrow(lambda it: _write(it, path, target, arrow, block_ids, segment_ids), schema).write.option("compression", "none").parquet(target)


def _read(batches, id_col: str, id_type: pa.DataType, packed: bool):
    for batch in batches:
        for n in range(batch.num_rows):
            held, lengths, blocks, start = (batch.column(k)[n] for k in range(4))
            flat = np.concatenate(decode_blocks(blocks.as_py()))
            give_back()
            ends = np.cumsum(lengths.values.to_numpy())
            if ends[-1] != len(flat):
                raise ValueError("a segment's lengths don't match its ids")
            ends = np.append(0, ends)
            for at in range(0, len(ends) - 1, 1024):
                where = ends[at : at + 1025]
                own, where = flat[where[0] : where[-1]], where - where[0]
                if packed:
                    texts = pa.Array.from_buffers(pa.large_binary(), len(where) - 1, [None, pa.py_buffer(where * 4), pa.py_buffer(own.astype("<i4"))]).cast(pa.binary())
                else:
                    texts = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(own))
                yield pa.RecordBatch.from_arrays([held.values.slice(at, len(texts)).cast(id_type), pa.array(start.as_py() + ends[at : at + len(texts)]), texts], names=[id_col, "start", "ids_le" if packed else "tokens"])


def read(spark, target: str, id_col: str = "doc_id", packed: bool = False) -> DataFrame:
    """Return id_col, start (ids of all documents before) and tokens array<int>.

    If ``packed``, ids_le binary (the ids as little-endian unsigned 32-bit integers) in
    place of tokens.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    segments = spark.read.parquet(target)
    sizes = segments.select("part", "number", "n_ids")
    # Running sums: within each part, then over one row a part.
    inner = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    starts = sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(parts, "part").select("part", "number", (F.col("own") + F.col("before")).alias("start"))
    whole = segments.join(starts, ["part", "number"]).select("ids", "lengths", "blocks", "start")
    id_type = segments.schema["ids"].dataType.elementType
    arrow = to_arrow_type(id_type)
    tokens = T.StructField("ids_le", T.BinaryType()) if packed else T.StructField("tokens", T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("start", T.LongType()), tokens])
    return whole.mapInArrow(lambda it: _read(it, id_col, arrow, packed), schema)


def _pack(batches, names: list[str]):
    for batch in batches:
        found = batch.column(2)
        offsets = found.offsets.to_numpy().astype(np.int64)
        data = found.values.to_numpy(zero_copy_only=False).astype("<i4")
        packed = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(offsets * 4), pa.py_buffer(data)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=names)


def digests(read_back: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Return id_col, start, n_tokens and ids_crc32 of rows from :func:`read`, packed or not."""
    if "tokens" in read_back.columns:
        names = [id_col, "start", "ids_le"]
        schema = T.StructType([read_back.schema[id_col], T.StructField("start", T.LongType()), T.StructField("ids_le", T.BinaryType())])
        read_back = read_back.mapInArrow(lambda it: _pack(it, names), schema)
    return read_back.select(id_col, "start", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), F.crc32("ids_le").alias("ids_crc32"))


def written_and_read(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, **sizes) -> DataFrame:
    """Write a file to the shared folder and return its documents as :func:`read` does."""
    spark = docs.sparkSession
    target = written(spark, "tokens")
    write(docs, path, target, id_col, text_col, **sizes)
    return read(spark, target, id_col, packed)


__all__ = ["decode_blocks", "digests", "encode_blocks", "read", "write", "written_and_read"]
