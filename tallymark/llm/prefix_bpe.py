"""Byte-pair encoding by dynamic programming over a word's prefixes.

Every prefix of a word has one encoding, so one last token.  An automaton of all tokens
gives the tokens that end at a byte, longest first; the last token of the prefix is the
one of them that is compatible with the last token of the shorter prefix before it: no
merge would join the two across their border.  Back-pointers from the word's end are its
ids.  Work is linear in a word's bytes, however long it is.

Two tokens are compatible unless some merge (x, y) crosses the border, x on the right edge
of the first token's merges and y on the left edge of the second's, while both are there: the
merge must come before x is merged into its token and no later than y into its own.

Words are the distinct pre-tokens of blocks of documents; they meet by hash bucket and are
encoded once each (``bpe.py`` has the blocks).  Within a bucket, many words take a byte at
a time together.  Special tokens' strings in a text are special tokens.

Defined cases: a null or empty text has no tokens; rows with equal or null ids stay
separate rows; other columns are ignored; an empty table gives an empty result.  A very
long text is a block of its own.  A vocabulary that lacks a byte, or in which a token has
two merges or a merge comes before its parts', raises an error.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BLOCK_CHARS, _assemble, _blocks
from .blocks import bucket_count, pack_lists, unpack_words
from .common import give_back, settled

#: Words of more bytes are encoded one by one, so that a long one doesn't make steps for all.
LONG = 48
#: Packed bytes of the lists whose words are encoded together.
TOGETHER = 4_000_000
_NEVER = np.int64(1 << 40)


def byte_letters() -> dict[str, int]:
    """The letters by which a vocabulary file writes bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens with their merges, and what follows from them: the automaton and the edges of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        letters = byte_letters()
        names = whole["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        self.bytes = {i: bytes(letters[c] for c in name) for name, i in names.items() if name not in self.special}
        n = max(names.values()) + 1
        self.count = n
        # Rank of the merge that makes a token (-1: a byte), and its two parts.
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        keys = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, t = names[a], names[b], names[a + b]
            if self.rank[t] >= 0 or max(self.rank[x], self.rank[y]) >= r:
                raise ValueError("a token has two merges, or a merge comes before its parts'")
            self.rank[t], self.left[t], self.right[t], keys[r] = r, x, y, x * n + y
        order = np.argsort(keys)
        self._keys, self._ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, 0)
        self._by_pair = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self._memo: dict[int, bool] = {}
        size = {i: len(b) for i, b in self.bytes.items()}
        if len({b for b in self.bytes.values() if len(b) == 1}) < 256:
            raise ValueError("the vocabulary lacks a byte")
        # A token that its own bytes don't give is never met.
        usable = [i for i, b in self.bytes.items() if len(b) == 1 or (self.rank[i] >= 0 and self._whole(i))]
        self.size = np.zeros(n, np.int64)
        self.size[list(size)] = list(size.values())
        self._automaton(usable)

    def _whole(self, token: int) -> bool:
        """Whether a token's bytes are encoded as the token: its parts are, and nothing crosses their border sooner."""
        x, y = int(self.left[token]), int(self.right[token])
        parts = all(self.rank[p] < 0 or self._known_whole(int(p)) for p in (x, y))
        return parts and not self._crossed(x, y, int(self.rank[token]))

    def _known_whole(self, token: int) -> bool:
        key = -1 - token
        if key not in self._memo:
            self._memo[key] = self._whole(token)
        return self._memo[key]

    def _crossed(self, x: int, y: int, before: int) -> bool:
        """Whether a merge of rank below ``before`` crosses the border of two tokens."""
        rank, n, end_x, end_y = self.rank, self.count, before, before
        while True:
            r = self._by_pair.get(x * n + y)
            if r is not None and r < end_x and (r <= end_y if end_y < before else r < before):
                return True
            a, b = int(rank[x]), int(rank[y])
            if a < 0 and b < 0:
                return False
            if a > b:
                end_x, x = a, int(self.right[x])
            else:
                end_y, y = b, int(self.left[y])

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether both stay as they are side by side."""
        good = np.ones(len(x), bool)
        rows, x, y = np.arange(len(x)), x.copy(), y.copy()
        end_x, end_y = np.full(len(x), _NEVER), np.full(len(x), _NEVER)
        while len(rows):
            key = x * self.count + y
            at = np.searchsorted(self._keys, key)
            r = np.where(self._keys[at] == key, self._ranks[at], _NEVER)
            crossed = (r < end_x) & (r <= end_y) & (r < _NEVER)
            good[rows[crossed]] = False
            a, b = self.rank[x], self.rank[y]
            keep = ~crossed & ((a >= 0) | (b >= 0))
            rows, x, y, end_x, end_y, a, b = (v[keep] for v in (rows, x, y, end_x, end_y, a, b))
            first = a > b
            end_x, end_y = np.where(first, a, end_x), np.where(first, end_y, b)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return good

    def _automaton(self, usable: list[int]) -> None:
        """Dense moves by state and byte; for each state the longest token that ends there, for each token the next shorter."""
        children: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for i in usable:
            s = 0
            for b in self.bytes[i]:
                nxt = children[s].get(b)
                if nxt is None:
                    nxt = children[s][b] = len(children)
                    children.append({})
                    own.append(-1)
                s = nxt
            own[s] = i
        n = len(children)
        self.move, fall, self.out = np.zeros((n, 256), np.int32), np.zeros(n, np.int32), np.array(own, np.int32)
        self.shorter = np.full(self.count, -1, np.int32)
        level = [0]
        while level:
            edges = np.array([(p, b, v) for p in level for b, v in children[p].items()], np.int64).reshape(-1, 3)
            p, b, v = edges.T
            if level != [0]:
                fall[v] = self.move[fall[p], b]
                self.move[level] = self.move[fall[level]]
            self.move[p, b] = v
            below = self.out[fall[v]]
            mine = self.out[v] >= 0
            self.shorter[self.out[v[mine]]] = below[mine]
            self.out[v[~mine]] = below[~mine]
            level = v.tolist()
        self.out[0] = -1

    def encode_long(self, word: bytes) -> list[int]:
        """The ids of one word."""
        out, move, shorter, size, last, s = self.out, self.move, self.shorter, self.size, [], 0
        for i, b in enumerate(word):
            s = int(move[s, b])
            t = int(out[s])
            while (before := i - int(size[t])) >= 0 and not self._pair(last[before], t):
                t = int(shorter[t])
            last.append(t)
        ids, at = [], len(word) - 1
        while at >= 0:
            ids.append(last[at])
            at -= int(size[last[at]])
        return ids[::-1]

    def _pair(self, x: int, y: int) -> bool:
        key = x * self.count + y
        found = self._memo.get(key)
        if found is None:
            if len(self._memo) > 1_000_000:
                self._memo.clear()
            found = self._memo[key] = bool(self.compatible(np.array([x]), np.array([y]))[0])
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero((length > 0) & (length <= LONG))
        short = short[np.argsort(-length[short], kind="stable")]
        ids = [b""] * len(words)
        for i in np.flatnonzero(length > LONG).tolist():
            ids[i] = np.array(self.encode_long(words[i]), "<u4").tobytes()
        if not len(short):
            return ids
        data = np.frombuffer(b"".join(words[i] for i in short.tolist()), np.uint8)
        size = length[short]
        start = np.cumsum(size) - size
        last, state = np.full(len(data), -1, np.int64), np.zeros(len(short), np.int64)
        for i in range(int(size[0])):
            n = int(np.searchsorted(-size, -i, side="left"))  # words of more than i bytes come first
            at = start[:n] + i
            state[:n] = self.move[state[:n], data[at]]
            token, rows = self.out[state[:n]].astype(np.int64), np.arange(n)
            while len(rows):
                before = i - self.size[token]
                inner = before >= 0
                good = ~inner
                good[inner] = self.compatible(last[start[rows[inner]] + before[inner]], token[inner])
                last[at[rows[good]]] = token[good]
                rows, token = rows[~good], self.shorter[token[~good]].astype(np.int64)
        # All words go back from their ends together; what they meet is turned around.
        found, owner, at = [], [], start + size - 1
        rows = np.arange(len(short))
        while len(rows):
            token = last[at[rows]]
            found.append(token)
            owner.append(rows)
            at[rows] -= self.size[token]
            rows = rows[at[rows] >= start[rows]]
        met, owner = np.concatenate(found)[::-1], np.concatenate(owner)[::-1]
        order = np.argsort(owner, kind="stable")
        flat, many = met[order].astype("<u4"), np.bincount(owner, minlength=len(short))
        ends = (np.cumsum(many) * 4).tolist()
        body = flat.tobytes()
        for i, a, b in zip(short.tolist(), [0, *ends[:-1]], ends, strict=True):
            ids[i] = body[a:b]
        return ids


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    """A worker keeps the one it has built."""
    return Vocabulary(path)


@lru_cache(maxsize=1)
def unlike(path: str) -> dict[str, str]:
    """For letters and numbers the ranges of characters that ``regex`` classes so and the library of the file doesn't.

    The two follow different versions of Unicode.
    """
    import regex
    import tokenizers

    cut = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = {}
    for kind, mate in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        text = "".join(f"{mate}{c}{mate}\n" for c in regex.findall(kind, every))
        whole = {text[a + 1] for _, (a, b) in cut(text) if b - a == 3}
        odd = [ord(c) for c in text[1::4] if c not in whole]
        first = [c for c, before in zip(odd, [-2, *odd[:-1]], strict=True) if c != before + 1]
        last = [c for c, after in zip(odd, [*odd[1:], -2], strict=True) if c + 1 != after]
        out[kind] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last, strict=True))
    return out


def library_pattern(pattern: str, special: dict[str, int], odd: dict[str, str]) -> str:
    """``pattern`` as the library cuts a text: special tokens are matches of their own, and ``odd`` characters are neither letters nor numbers.

    Special tokens start with punctuation and hold no blanks, so only runs of punctuation and
    of blanks can reach one.
    """
    import regex

    if any(s[0].isalnum() or s[0] == "'" or any(c.isspace() for c in s) for s in special):
        raise ValueError("a special token has to start with punctuation and hold no blanks")
    one = "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) or r"(?!)"
    either, out = "".join(odd.values()), pattern.replace(r"[^\s\p{L}\p{N}]+", "<other>")
    if either:
        # Odd characters are rare and never among the first few hundred: only what lies beyond is asked one by one.
        low = f"[\\0-\\U{min(int(x, 16) for x in regex.findall(r'U(.{8})-', either)) - 1:08x}]"
        for kind in odd:
            out = out.replace(f"{kind}+", rf"(?:[{kind}&&{low}]+|(?!{low}|[{either}]){kind})+")
        other = rf"(?:[^\s\p{{L}}\p{{N}}]|(?!{low})[{either}])"
    else:
        other = r"[^\s\p{L}\p{N}]"
    # No earlier alternative can match where a special token or blanks before one begin, so these come late.
    out = out.replace(r"\s+(?!\S)", rf"{one}|\s+(?={one})|\s+(?!\S)")
    return "(?V1)" + out.replace("<other>", rf"(?:(?!{one}){other})+")


def _encode_lists(batches, path: str, schema: pa.Schema):
    """Rows sorted by bucket: a bucket's words are encoded once each."""
    vocab = vocabulary(path)
    fixed = {s.encode(): np.array([i], "<u4").tobytes() for s, i in vocab.special.items()}
    now, known = -1, {}

    def encoded(rows):
        lists = [unpack_words(row["data"]) for row in rows]
        new = list({w for words in lists for w in words if w not in known and w not in fixed})
        known.update(zip(new, vocab.encode(new), strict=True))
        for row, words in zip(rows, lists, strict=True):
            found = [known[w] if w in known else fixed[w] for w in words]
            row["data"] = pack_lists(np.fromiter(map(len, found), np.uint32, len(found)), b"".join(found))
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch in batches:
        rows, size = [], 0
        for row in batch.to_pylist():
            if rows and (row["bucket"] != now or size >= TOGETHER):
                yield encoded(rows)
                rows, size = [], 0
            if row["bucket"] != now:
                now, known = row["bucket"], {}
            rows.append(row)
            size += len(row["data"])
        if rows:
            yield encoded(rows)
    give_back()


def _token_pool(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and where each id's start and how many they are."""
    tokens = vocab.bytes | {i: s.encode() for s, i in vocab.special.items()}
    size = np.zeros(max(tokens) + 1, np.int64)
    for i, b in tokens.items():
        size[i] = len(b)
    return np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8), np.cumsum(size) - size, size


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Encode every text by the vocabulary file at ``path`` and decode its ids again.

    Returns ``id_col``, ``n_tokens`` long, ``ids_le`` binary (the ids as little-endian
    unsigned 32-bit integers) and ``decoded`` binary, special tokens as their strings.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, vocab = docs.sparkSession, vocabulary(path)
    cut = library_pattern(pattern, vocab.special, unlike(path))
    # Both cuts must see the rows in one order.
    source = settled(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "prefix-bpe-texts")
    id_type = source.schema["id"].dataType
    fields = [("block", T.LongType()), ("bucket", T.IntegerType()), ("ids", T.ArrayType(id_type)), ("lengths", T.ArrayType(T.LongType())), ("data", T.BinaryType()), ("check", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    arrow, buckets = to_arrow_schema(schema), bucket_count(spark)
    part = lambda heads: source.mapInArrow(lambda it: _blocks(it, cut, block_chars, buckets, arrow, heads), schema)
    met = part(False).repartition("bucket").sortWithinPartitions("bucket")
    encoded = met.mapInArrow(lambda it: _encode_lists(it, path, arrow), schema)
    back = part(True).unionByName(encoded).repartition("block").sortWithinPartitions("block", "bucket")
    result = T.StructType([T.StructField(*k) for k in [(id_col, id_type), ("n_tokens", T.LongType()), ("ids_le", T.BinaryType()), ("decoded", T.BinaryType())]])
    out, tokens = to_arrow_schema(result), spark.sparkContext.broadcast(_token_pool(vocab))  # as large as the vocabulary
    return back.mapInArrow(lambda it: _assemble(it, tokens, out), result)
